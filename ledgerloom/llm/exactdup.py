"""Exact de-duplication as a stream with keyed state that is kept on disk and never expires.

Files of documents arrive one micro-batch after another. The state (RocksDB, saved in the
checkpoint) has one entry per digest of the normalised text and no watermark, so a text is known
however long ago it came. An entry holds the least document (its stable identifier), where the
first text stands that came with this digest (the content locator: file and row) and the number of
rows; the text itself stays in its file. A batch first combines its own rows per digest, so a text
that a third of all rows repeat reaches the state as one row per task.

A digest that more than one row has is a hit: the full texts of its rows, the located one among
them, are compared byte by byte (least and greatest text of the digest). Where they differ, the
texts decide instead of the digest.

Everything here is Spark's own expressions and the streaming aggregate; no Python touches a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_folder
from .common import matched, written

#: A micro-batch takes files of so many bytes together, at least one file.
BATCH_BYTES = 1 << 40
DIGEST_BYTES = 32
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores of an executor don't reserve disk ahead of what they write.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share this much memory; the rest of the state is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _rows(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """``_id, _text, _sha, _digest`` and the place (``_file, _at``) of every row of a file scan."""
    place, text = docs.metadataColumn("_metadata"), normalised(F.col("text"))
    rows = docs.select(
        F.col("doc_id").alias("_id"), text.alias("_text"),
        place["file_path"].alias("_file"), place["row_index"].alias("_at"))
    sha = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    return rows.withColumn("_sha", sha).withColumn(
        "_digest", F.substring("_sha", 1, digest_bytes))


def _least() -> Column:
    """The row that stays: least doc_id, null ids last; of equal ids the one that stands first."""
    return F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), "_file", "_at"))


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches; streams take a single file by a pattern alone."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ingest(
    spark: SparkSession, path: str, home: str, batch_bytes: int = BATCH_BYTES,
    digest_bytes: int = DIGEST_BYTES,
) -> None:
    """Take the files under ``path`` that ``home`` doesn't know yet into the state kept there.

    Each micro-batch writes the new entry of every digest that it touched to ``home/entries``
    under its number; a repeated batch replaces what it wrote.
    """
    configure(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxBytesPerTrigger", batch_bytes).parquet(_pattern(path))
    # One time for a whole batch, later in later ones and the same again when a batch is repeated.
    arriving = _rows(stream, digest_bytes).drop("_text", "_sha").withColumn(
        "_arrived", F.current_timestamp())
    first = F.struct(F.col("_arrived").alias("arrived"), "_file", "_at")
    entries = arriving.groupBy("_digest").agg(
        _least().alias("_least"), F.min(first).alias("_first"), F.count("*").alias("_members"))

    def keep(touched: DataFrame, batch: int) -> None:
        touched.write.mode("overwrite").parquet(f"{home}/entries/batch={batch}")

    with _settings(spark, STATE):
        running = entries.writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        running.awaitTermination()


def known(spark: SparkSession, path: str, home: str) -> DataFrame:
    """``_digest, _least, _first, _members``: the last entry of every digest."""
    kind = spark.read.parquet(path).schema["doc_id"].dataType.simpleString()
    entries = spark.read.schema(
        f"_digest binary, _least struct<no: boolean, id: {kind}, _file: string, _at: bigint>, "
        "_first struct<arrived: timestamp, _file: string, _at: bigint>, _members bigint, "
        "batch bigint").parquet(f"{home}/entries")
    last = F.max_by(F.struct("_least", "_first", "_members"), "batch").alias("_last")
    return entries.groupBy("_digest").agg(last).select("_digest", "_last.*")


def deduplicate(
    spark: SparkSession, path: str, home: str | None = None, batch_bytes: int = BATCH_BYTES,
    digest_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, file, row_index`` of every row under ``path``.

    Rows whose normalised texts are equal form a group; null texts are empty ones. The row with
    the least doc_id stays, rows without doc_id after all others; of rows that repeat the doc_id
    the one that stands first in the files. Columns other than ``doc_id`` and ``text`` play no
    part whatever their names. An empty table gives no rows.

    ``home`` keeps the state between calls, so that a later call takes new files only; without one
    a fresh folder is used. ``digest_bytes`` shortens the digest; results stay the same.
    """
    home = home or shared_folder(spark, "exactdup")
    docs = spark.read.parquet(path)
    rows = _rows(docs, digest_bytes)
    if docs.isEmpty():
        entries = rows.groupBy("_digest").agg(_least().alias("_least"), F.count("*").alias("_members"))
    else:
        ingest(spark, path, home, batch_bytes, digest_bytes)
        entries = written(known(spark, path, home), "entries")
    clashes = written(_clashes(rows, entries), "digest-clashes")
    found = matched(rows.drop("_text"), entries.select("_digest", "_least", "_members"), "_digest")
    if not clashes.isEmpty():
        clash = matched(rows, clashes, "_digest", "left_semi")
        texts = clash.groupBy("_digest", "_text").agg(
            _least().alias("_least"), F.count("*").alias("_members"))
        by_text = matched(clash, texts, ["_digest", "_text"]).drop("_text")
        found = matched(found, clashes, "_digest", "left_anti").unionByName(by_text)
    kept = (F.col("_file") == F.col("_least._file")) & (F.col("_at") == F.col("_least._at"))
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_least.id").alias("keep_id"),
        F.col("_members").alias("group_size"), kept.alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.col("_file").alias("file"),
        F.col("_at").alias("row_index"))


def _clashes(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Digests whose rows have different texts: every text of every hit is compared in full."""
    hits = entries.filter("_members > 1").select("_digest")
    texts = matched(rows.select("_digest", "_text"), hits, "_digest", "left_semi")
    ends = texts.groupBy("_digest").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
    return ends.filter("_low <> _high").select("_digest")
