"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs once to warm up and
``BENCH_RUNS`` times for the clock; the best run counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from check import session
from ledgerloom.operators import layout, profiling, routing, sheets
from ledgerloom.plans.extraction import enrich, normalize_rows, settled_and_ambiguous
from ledgerloom.session import configure
from ledgerloom.sources.records import row_records
from workload.views import order_register_rows, text_items

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def routed(spark):
    return settled_and_ambiguous(order_register_rows(spark, FOLDER))


def route_documents(spark):
    return routing.route_counts(routed(spark))


def infer_schemas(spark):
    sample = profiling.head_sample(order_register_rows(spark, FOLDER))
    return profiling.infer_schema(normalize_rows(sample))


def store_settled_rows(spark):
    return row_records(routed(spark).filter("route = 'deterministic'"))


def enrich_ambiguous_rows(spark):
    result = enrich(routed(spark).filter("route = 'ambiguous'"))
    reviews = result.reviews.groupBy("priority").agg(F.count("*").alias("n"))
    return reviews


def batch_rows(spark):
    return routing.with_batches(routed(spark))


def page_layout(spark):
    return layout.block_records(layout.page_blocks(text_items(spark, FOLDER)))


def assemble_sheet(spark):
    """Line items as one wide sheet: 600,000 rows of five cells at sf0.1."""
    line = configure(spark).read.parquet(f"{FOLDER}/lineitem.parquet")
    placed = line.select(
        F.lit("book").alias("document_id"), F.lit("s").alias("sheet_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_num"),
        F.posexplode(
            F.array(
                *[
                    F.struct(text.cast("string").alias("str_value"), number.alias("num_value"))
                    for text, number in (
                        (F.col("l_returnflag"), F.lit(None).cast("double")),
                        (F.col("l_linestatus"), F.lit(None).cast("double")),
                        (F.lit(None), F.col("l_quantity")), (F.lit(None), F.col("l_extendedprice")),
                        (F.lit(None), F.col("l_discount")),
                    )
                ]
            )
        ).alias("col_num", "cell"),
    )
    cells = placed.select(
        "document_id", "sheet_name", "row_num", "col_num", "cell.str_value", "cell.num_value"
    )
    return sheets.read_sheets(cells)


QUERIES = {
    fn.__name__: fn
    for fn in (
        route_documents, infer_schemas, store_settled_rows, enrich_ambiguous_rows, batch_rows,
        page_layout, assemble_sheet,
    )
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(CPUS)
    only = os.environ.get("BENCH_ONLY", "").split()
    rows = order_register_rows(spark, FOLDER).count()
    times = {}
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        run(query(spark))
        best = float("inf")
        for _ in range(RUNS):
            start = time.time()
            run(query(spark))
            best = min(best, time.time() - start)
        times[name] = round(best, 3)
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "register_rows": rows,
        "rows_per_sec_route_documents": round(rows / times.get("route_documents", 1)),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
