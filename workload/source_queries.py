"""File scans and streaming loads over files that Spark writes from the driver's tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerloom.operators.layout import line_records
from ledgerloom.session import shared_folder
from ledgerloom.sources.csv import csv_rows, valid_csv_rows
from ledgerloom.streaming import ingest, metrics

from .registry import query
from .views import table


def write_csv(df, **options):
    """Write CSV files with a header each; returns their folder."""
    path = shared_folder(df.sparkSession, "csv")
    given = {
        "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False, **options,
    }
    df.write.options(**given).csv(path)
    return path


def cell(name):
    return F.try_element_at(F.col("raw"), F.lit(name))


def write_in_order(rows, key, **options):
    """Write many CSV files by range of ``key``, nulls last: each in order, and so are their names."""
    last = F.col(f"`{key}`").asc_nulls_last()
    return write_csv(rows.repartitionByRange(last).sortWithinPartitions(last), **options)


@query(
    "csv_scan",
    """SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS row_index, p_partkey::VARCHAR AS part_key,
         concat(p_name, ', "', p_brand, '"', chr(1)) AS description, p_type AS part_type FROM part""",
)
def csv_scan(spark, folder):
    """Fields with commas, quotes and control characters survive the scan, each at its row of the table."""
    text = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"\x01'))
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias(" Part Key"), text.alias("Description"),
        F.col("p_type").alias("Part Type "),
    )
    rows = csv_rows(spark, write_in_order(part, " Part Key"), one_table=True)
    return rows.select(
        "row_index", cell("part_key").alias("part_key"), cell("description").alias("description"),
        cell("part_type").alias("part_type"),
    )


@query(
    "csv_scan_line_breaks",
    """SELECT row_number() OVER (ORDER BY doc_id) + 1 AS row_index, doc_id::VARCHAR AS doc_id,
         sha256(text) AS text_hash, length(text)::BIGINT AS length FROM documents""",
)
def csv_scan_line_breaks(spark, folder):
    """Whole document texts, line breaks included, survive the scan, each at its row of the table."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = csv_rows(spark, write_in_order(documents, "doc_id", quoteAll=True), one_table=True)
    return rows.select(
        "row_index", cell("doc_id").alias("doc_id"), F.sha2(cell("text"), 256).alias("text_hash"),
        F.length(cell("text")).alias("length"),
    )


@query(
    "csv_row_warnings",
    """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'Missing columns: priority.' WHEN o_orderkey % 10 = 1 THEN 'Extra columns detected: 1.' ELSE 'none' END AS reason,
         CASE WHEN o_orderkey % 10 > 1 THEN o_orderstatus END AS status,
         CASE WHEN o_orderkey % 10 > 1 THEN o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY ALL""",
)
def csv_row_warnings(spark, folder):
    """Short and long lines become warnings, the others stay rows."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    digit = F.col("o_orderkey") % 10
    line = (
        F.when(digit == 0, status)
        .when(digit == 1, F.concat_ws(",", status, priority, F.lit("EXTRA")))
        .otherwise(F.concat_ws(",", status, priority))
    )
    lines = table(spark, folder, "orders").select(line.alias("status,priority"))
    good, bad = valid_csv_rows(spark, write_csv(lines.repartition(3), sep="\u0001"))
    none = F.lit(None).cast("string")
    kept = good.select(
        F.lit("none").alias("reason"), cell("status").alias("status"),
        cell("priority").alias("priority"),
    )
    lost = bad.select("reason", none.alias("status"), none.alias("priority"))
    return kept.unionByName(lost).groupBy("reason", "status", "priority").agg(
        F.count("*").alias("n")
    )


ORDER_SCHEMA = "o_orderkey bigint, o_orderstatus string"


def load_orders(spark, folder, transform=lambda df: df):
    """Orders as eight CSV files, loaded three at a time, then once more with nothing new."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    arrived = write_csv(orders.repartition(8))
    target, state = shared_folder(spark, "loaded"), shared_folder(spark, "stream-state")
    for _ in range(2):
        stream = ingest.stream_files(spark, arrived, ORDER_SCHEMA, files_per_trigger=3, header="true")
        ingest.run_available(stream, target, state, transform)
    return ingest.loaded(spark, target, ORDER_SCHEMA), ingest.batch_log(spark, state)


@query("streamed_files", "SELECT o_orderkey, o_orderstatus FROM orders")
def streamed_files(spark, folder):
    return load_orders(spark, folder)[0].select("o_orderkey", "o_orderstatus")


@query(
    "stream_batches",
    "SELECT 3::BIGINT AS batches, count(*) AS total, TRUE AS all_once FROM orders",
)
def stream_batches(spark, folder):
    loaded, _ = load_orders(spark, folder)
    once = F.count_distinct("o_orderkey") == F.count("*")
    metrics = ingest.batch_metrics(loaded).agg(
        F.count("*").alias("batches"), F.sum("rows").alias("total")
    )
    return metrics.withColumn("all_once", loaded.agg(once).scalar())


@query(
    "streamed_lines",
    """SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) l
       WHERE line <> '' GROUP BY doc_id""",
)
def streamed_lines(spark, folder):
    """Document texts streamed from parquet and split into line records on the way in."""
    schema = table(spark, folder, "documents").select("doc_id", "text").schema.simpleString()[7:-1]
    typed = ", ".join(part.replace(":", " ") for part in schema.split(","))
    # A pattern, for the table may be one file as well as a folder of files.
    stream = ingest.stream_files(spark, f"{folder}/documents.parque[t]", typed, kind="parquet")
    target, state = shared_folder(spark, "lines"), shared_folder(spark, "stream-state")
    ingest.run_available(stream, target, state, line_records)
    lines = ingest.loaded(spark, target, "doc_id bigint, line string, line_number int")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"))


def mixed_folder(spark, folder):
    """Part, supplier and customer lists as CSV files with a header of their own, twelve files."""
    lists = [
        table(spark, folder, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("Label")),
        table(spark, folder, "supplier").select(
            F.col("s_name").alias("label"), F.col("s_suppkey").alias("Supplier Id"), F.col("s_acctbal").alias("Balance")),
        table(spark, folder, "customer").select(
            F.col("c_custkey").alias("CUSTOMER"), F.lit("x").alias(""), F.col("c_name").alias(" label ")),
    ]
    path = shared_folder(spark, "mixed")
    for frame, key in zip(lists, ("Part Key", "Supplier Id", "CUSTOMER")):
        part = F.pmod(F.col(f"`{key}`"), F.lit(4))
        frame.repartition(4, part).write.mode("append").option("header", True).csv(path)
    return path


MIXED_SQL = """SELECT 'part' AS kind, p_partkey::VARCHAR AS key, p_name AS label FROM part
    UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier
    UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name FROM customer"""
KEYS = {"part": "part_key", "supplier": "supplier_id", "customer": "customer"}


def named_rows(rows):
    """``kind, key, label`` of the rows of any of the lists; a key ``broken`` is refused."""
    kind = F.coalesce(*[F.when(F.map_contains_key("raw", F.lit(k)), F.lit(n)) for n, k in KEYS.items()])
    key = F.coalesce(*[cell(k) for k in KEYS.values()])
    refused = F.when(key == "broken", F.raise_error(F.lit("no such key")).cast("string")).otherwise(key)
    return rows.select(kind.alias("kind"), refused.alias("key"), cell("label").alias("label"))


LOADED_SCHEMA = "kind string, key string, label string"


def load_mixed(spark, folder):
    """Files with three headers and a bad one, through a run in which storage fails once."""
    arrived = mixed_folder(spark, folder)
    bad = spark.createDataFrame([("broken", "none")], "`Part Key` string, Label string")
    bad.coalesce(1).write.mode("append").option("header", True).csv(arrived)
    target, state = shared_folder(spark, "loaded"), shared_folder(spark, "stream-state")
    calls = []

    def read(session, paths):
        calls.append(len(paths))
        if len(calls) == 2:
            raise OSError("storage does not answer")
        return named_rows(csv_rows(session, paths))

    for _ in range(2):
        names = ingest.stream_file_names(spark, arrived, 5, pathGlobFilter="*.csv")
        ingest.run_available(names, target, state, ingest.loading(read), pause=0.1)
    return target, state


@query(
    "stream_failures",
    f"""SELECT kind, key, label, 1 AS failed_files FROM ({MIXED_SQL}) m""",
)
def stream_failures(spark, folder):
    """Every row of the good files is there once, whatever failed; the bad file is named."""
    target, state = load_mixed(spark, folder)
    failed = ingest.batch_log(spark, state).filter("status = 'failed' AND source_file IS NOT NULL")
    return ingest.loaded(spark, target, LOADED_SCHEMA).select(
        "kind", "key", "label", failed.agg(F.count("*")).scalar().alias("failed_files"))


@query(
    "stream_retries",
    f"""SELECT kind, key, label, 0 AS failed_files FROM ({MIXED_SQL}) m
        UNION ALL SELECT 'part', 'broken', 'none', 0""",
)
def stream_retries(spark, folder):
    """The bad file is loaded once its rows are accepted, and nothing else is loaded again."""
    target, state = load_mixed(spark, folder)

    def read(session, paths):
        rows = csv_rows(session, paths)
        key = F.coalesce(*[cell(k) for k in KEYS.values()])
        return rows.select(
            F.lit("part").alias("kind"), key.alias("key"), cell("label").alias("label"),
            F.col("document_id").alias(ingest.FILE_COLUMN))

    for _ in range(2):
        ingest.retry_failed(spark, target, state, read)
    failed = ingest.batch_log(spark, state).filter("status = 'failed' AND source_file IS NOT NULL")
    return ingest.loaded(spark, target, LOADED_SCHEMA).select(
        "kind", "key", "label", failed.agg(F.count("*")).scalar().alias("failed_files"))


@query(
    "stream_metrics",
    "SELECT 3::BIGINT AS batches, count(*) AS rows, FALSE AS running, NULL::VARCHAR AS error FROM orders",
)
def stream_metrics(spark, folder):
    """What a listener wrote while eight files were loaded in three batches."""
    path = shared_folder(spark, "stream-metrics")
    listener = metrics.ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        load_orders(spark, folder)
        for _ in range(60):
            # Events arrive a little after the stream has ended.
            rows = metrics.stream_totals(metrics.progress_rows(spark, path))
            if rows.filter("running").isEmpty() and rows.count() == 2:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    return rows.filter("batches > 0").select("batches", "rows", "running", "error")
