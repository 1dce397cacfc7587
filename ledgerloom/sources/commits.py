"""Committed writes to stored tables: a batch counts in all of its tables or in none.

Every stored row carries the batch it belongs to and the attempt that wrote it. An attempt counts
only once its mark is there, and a mark is one small file written after all tables. So a batch
that broke off anywhere stays invisible, and a batch that is written again replaces what its
earlier attempts wrote. A rewrite (``rewrite``) replaces some buckets of one table in the same
way: its mark names them, and rows of these buckets that are older no longer count. Nothing is
deleted or changed in place; files whose rows no longer count go with ``remove_replaced``.

One process at a time writes to a folder of tables; any number may read meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from .tables import SCHEMAS, table_row

MARKS = "commit_marks"
MARK_SCHEMA = "seq bigint, attempt string, batch_id string, name string, buckets array<int>"
BUCKETS = 256
#: What a table is bucketed by: the key under which its rows are looked up and changed.
BUCKET_KEYS = {
    "documents": "document_id", "processing_jobs": "job_id",
    "extracted_asset_fields": "document_id", "validation_flags": "entity_id",
    "review_queue": "review_id", "sessions": "session_id", "document_pages": "document_id",
}


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its schema; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket_of(name: str, key: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(key if key is not None else F.col(BUCKET_KEYS[name])), F.lit(BUCKETS)).cast("int")


def marks(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed attempt; ``seq`` tells their order."""
    return _scan(spark, _path(root, MARKS), MARK_SCHEMA)


def _append(df: DataFrame, root: str, name: str, attempt: str) -> None:
    placed = df.withColumn("attempt", F.lit(attempt)).withColumn("bucket", bucket_of(name))
    spread = placed.hint("rebalance", "bucket")
    spread.write.mode("append").partitionBy("bucket").parquet(_path(root, name))


def _mark(spark: SparkSession, root: str, attempt: str, batch_id=None, name=None, buckets=None) -> None:
    seq = (marks(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    row = spark.createDataFrame([(seq, attempt, batch_id, name, buckets)], MARK_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(_path(root, MARKS))


def commit(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], batch_id: str | None = None,
    created_at: Column | None = None,
) -> str:
    """Write a batch: its rows count in all ``tables`` together, once this returns.

    A batch that was committed before under the same id is replaced, in every table. Without an
    id the batch is one of its own. Returns the id.
    """
    attempt = uuid.uuid4().hex
    batch_id = attempt if batch_id is None else batch_id
    for name, df in tables.items():
        stored = table_row(df, name, created_at).withColumn("batch_id", F.lit(batch_id))
        _append(stored, root, name, attempt)
    _mark(spark, root, attempt, batch_id=batch_id)
    return batch_id


def _physical(spark: SparkSession, root: str, name: str) -> DataFrame:
    extra = "batch_id string, attempt string, bucket int"
    return _scan(spark, _path(root, name), f"{SCHEMAS[name]}, {extra}")


def _counting(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows of marked attempts that neither their batch nor their bucket has replaced since.

    Rows without an attempt were written by others; they count until their bucket is rewritten.
    The lists of marks and buckets are joined as their size allows.
    """
    attempts = known.select("attempt", F.col("seq").alias("_seq"))
    again = known.filter("batch_id is not null").groupBy("batch_id").agg(
        F.max("seq").alias("_again"))
    rewritten = known.filter(F.col("name") == name).select(
        F.explode("buckets").alias("bucket"), "seq").groupBy("bucket").agg(
        F.max("seq").alias("_rewritten"))
    placed = rows.join(attempts, "attempt", "left").join(again, "batch_id", "left").join(
        rewritten, "bucket", "left")
    own = F.when(F.col("attempt").isNull(), F.lit(0)).otherwise(F.col("_seq"))
    return placed.filter(
        (own >= F.coalesce("_again", F.lit(0))) & (own >= F.coalesce("_rewritten", F.lit(0)))
    ).select(*rows.columns)


def committed(
    spark: SparkSession, root: str, name: str, where: Column | None = None
) -> DataFrame:
    """The rows of a table that count; a filter on plain columns reaches the files."""
    rows = _physical(spark, root, name)
    rows = rows.filter(where) if where is not None else rows
    return _counting(rows, marks(spark, root), name)


def rewrite(
    spark: SparkSession, root: str, name: str, touched: DataFrame,
    change: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """Replace the rows of the buckets that ``touched`` falls into by ``change`` of them.

    ``touched`` has the bucket key of all rows that may change. Files of other buckets are neither
    read nor written. Rows that ``change`` leaves out are gone; rows keep the batch they came with,
    so a batch that is repeated later still replaces them. Returns the buckets.
    """
    # BUCKETS numbers at most.
    wanted = touched.select(bucket_of(name).alias("bucket")).distinct()
    buckets = sorted(r["bucket"] for r in wanted.collect())
    if not buckets:
        return []
    attempt = uuid.uuid4().hex
    old = committed(spark, root, name, F.col("bucket").isin(buckets)).drop("attempt", "bucket")
    new = change(old)
    batch = [F.col("batch_id")] if "batch_id" in new.columns else [F.lit(attempt).alias("batch_id")]
    plain = spark.createDataFrame([], SCHEMAS[name])
    _append(new.select(*[F.col(f.name).cast(f.dataType) for f in plain.schema.fields], *batch),
            root, name, attempt)
    _mark(spark, root, attempt, name=name, buckets=buckets)
    return buckets


def remove_replaced(spark: SparkSession, root: str, name: str, files_at_once: int = 1000) -> int:
    """Delete the files of a table in which no row counts any more; returns how many.

    Run it when nobody reads or writes the table. Names reach the driver in portions.
    """
    removed = 0
    while True:
        rows = _physical(spark, root, name)
        place = rows.withColumn("_file", rows.metadataColumn("_metadata")["file_path"])
        alive = _counting(place, marks(spark, root), name).select("_file").distinct()
        dead = place.select("_file").distinct().join(alive, "_file", "left_anti").limit(files_at_once)
        names = [r["_file"] for r in dead.collect()]
        for path in names:
            remove(spark, path)
        removed += len(names)
        if len(names) < files_at_once:
            return removed
