"""Live metrics of running streams, as a table that others can read meanwhile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = (
    "query_id string, run_id string, event string, load_batch bigint, input_rows bigint, "
    "rows_per_second double, batch_ms bigint, waiting_files bigint, error string, at timestamp"
)


class ProgressTable(StreamingQueryListener):
    """Writes one row for each start, micro-batch and end of a stream to ``path``.

    Register it by ``spark.streams.addListener``. Events hold no data, so each is a small file, in
    a folder of its own, since streams tell at the same time; a failure to write one is printed
    and doesn't stop the stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, event, kind: str, at: str | None, **values) -> None:
        row = {name.split()[0]: None for name in SCHEMA.split(", ")}
        row |= {"query_id": str(event.id), "run_id": str(event.runId), "event": kind} | values
        try:
            frame = self.spark.createDataFrame(
                [tuple(row.values())], SCHEMA.replace("at timestamp", "at string"))
            time = F.to_timestamp(F.lit(at)) if at else F.current_timestamp()
            frame.withColumn("at", time).coalesce(1).write.parquet(
                f"{self.path.rstrip('/')}/event_id={uuid.uuid4().hex}")
        except Exception as error:
            print(f"stream metrics not written: {str(error).splitlines()[0]}")

    def onQueryStarted(self, event) -> None:
        self._add(event, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._add(
            progress, "batch", progress.timestamp, load_batch=progress.batchId,
            input_rows=progress.numInputRows, rows_per_second=float(progress.processedRowsPerSecond),
            batch_ms=progress.batchDuration, waiting_files=_waiting(progress))

    def onQueryIdle(self, event) -> None:
        self._add(event, "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._add(event, "ended", None, error=event.exception and event.exception[:8000])


def _waiting(progress) -> int | None:
    """Files that have arrived and are in no batch yet, where a source tells."""
    told = [source.metrics.get("numFilesOutstanding") for source in progress.sources]
    known = [int(value) for value in told if value is not None]
    return sum(known) if known else None


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, event_id string").parquet(path).drop("event_id")


def stream_totals(rows: DataFrame) -> DataFrame:
    """Per run of a stream: batches and rows so far, the slowest batch, and whether it runs still."""
    batch = F.col("event") == "batch"
    return rows.groupBy("query_id", "run_id").agg(
        F.count_if(batch & (F.col("input_rows") > 0)).alias("batches"),
        F.coalesce(F.sum(F.when(batch, F.col("input_rows"))), F.lit(0)).alias("rows"),
        F.max(F.when(batch, F.col("batch_ms"))).alias("slowest_ms"),
        (F.count_if(F.col("event") == "ended") == 0).alias("running"),
        F.max("error").alias("error"),
    )
