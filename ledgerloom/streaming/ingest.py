"""Incremental ingest with Structured Streaming: each file once, each batch written once.

What goes wrong is told apart. A fault of the data (a value that can't be cast, a broken file, a
``raise_error``) belongs to a file: the batch is halved until the bad files are found, the others
are loaded, and the bad ones are named in the log, from where ``retry_failed`` takes them again.
Anything else, such as storage that doesn't answer, a full disk or a lost executor, belongs to no
file: the batch fails, the checkpoint doesn't advance, and the next attempt or the next run takes
the same files again.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, remove

ATTEMPTS = 3
#: Seconds before the second attempt; each further one waits twice as long.
PAUSE = 2.0
FILES_PER_TRIGGER = 1000
BATCH_COLUMN = "load_batch"
PORTION_COLUMN = "portion"
FILE_COLUMN = "source_file"
LOG_COLUMNS = "source_file string, status string, reason string, logged_at bigint"
#: SQLSTATE classes of faults in the data: data exceptions and errors raised by an expression.
DATA_FAULTS = ("22", "P0")
#: SQLSTATE of files that can't be read, whatever the cause.
UNREADABLE = ("KD000", "KD001")

Transform = Callable[[DataFrame], DataFrame]


def stream_files(
    spark: SparkSession, path: str, schema: str, kind: str = "csv",
    files_per_trigger: int | None = FILES_PER_TRIGGER, **options: str,
) -> DataFrame:
    """File stream over a folder or a path pattern; the source remembers which files it has taken.

    A micro-batch takes at most ``files_per_trigger`` files, or what the option
    ``maxBytesPerTrigger`` allows. Rows carry the file they came from in ``source_file``.
    """
    reader = configure(spark).readStream.format(kind).schema(schema).options(**options)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn(FILE_COLUMN, F.col("_metadata.file_path"))


def stream_file_names(
    spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER, **options: str
) -> DataFrame:
    """Stream of the names of arriving files (``path``) without their content.

    For files that have no schema in common: ``run_available`` with ``loading`` opens each batch's
    files by an operator that reads every file's own header.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    named = stream_files(spark, path, schema, "binaryFile", files_per_trigger, **options)
    return named.select("path", FILE_COLUMN)


def loading(read: Callable[[SparkSession, list[str]], DataFrame]) -> Transform:
    """A transform from file names to the rows that ``read(spark, paths)`` finds in the files.

    A batch has at most ``files_per_trigger`` names, so the list is bounded.
    """

    def load(names: DataFrame) -> DataFrame:
        paths = sorted(r["path"] for r in names.select("path").distinct().collect())
        return read(names.sparkSession, paths)

    return load


def is_data_fault(error: BaseException) -> bool:
    """Whether an error tells about the data that was read, not about the machines.

    Spark's errors carry an SQLSTATE, along the whole chain of causes. A file that can't be read
    counts as bad data only if no I/O error is behind it.
    """
    states, broken_io = [], False
    origin = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    if isinstance(error, PySparkException) and error.getSqlState():
        states.append(error.getSqlState())
    while origin is not None:
        name = origin.getClass().getName()
        broken_io |= _is_io(origin)
        if hasattr(origin, "getSqlState") and "SparkThrowable" in _interfaces(origin):
            states.append(origin.getSqlState() or "")
        if name.endswith("MalformedInputException"):
            states.append("22000")
        cause = origin.getCause()
        origin = None if cause is None or cause.equals(origin) else cause
    if any(s.startswith(DATA_FAULTS) for s in states):
        return True
    return any(s in UNREADABLE for s in states) and not broken_io


def _interfaces(throwable) -> str:
    kind, names = throwable.getClass(), []
    while kind is not None:
        names += [i.getName() for i in kind.getInterfaces()]
        kind = kind.getSuperclass()
    return " ".join(names)


def _is_io(throwable) -> bool:
    kind = throwable.getClass()
    while kind is not None:
        if kind.getName() == "java.io.IOException":
            return True
        kind = kind.getSuperclass()
    return False


def _batch_path(table: str, batch_id: int) -> str:
    return f"{table.rstrip('/')}/{BATCH_COLUMN}={batch_id}"


def write_portion(df: DataFrame, batch_id: int, table: str, portion: str) -> None:
    """Write part of a micro-batch to a folder of its own; a repeated one replaces what it wrote.

    Of a portion that fails nothing stays, also where the file system shows files of broken jobs.
    """
    path = f"{_batch_path(table, batch_id)}/{PORTION_COLUMN}={portion}"
    try:
        df.write.mode("overwrite").parquet(path)
    except Exception:
        remove(df.sparkSession, path)
        raise


def _log_path(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-log"


def _log(spark: SparkSession, checkpoint: str, batch_id: int, rows: list[tuple]) -> None:
    """Add entries about a batch to the log; nothing in it is ever replaced."""
    entries = spark.createDataFrame([(*r, time.time_ns()) for r in rows], LOG_COLUMNS)
    entries.coalesce(1).write.mode("append").parquet(
        f"{_log_path(checkpoint)}/{BATCH_COLUMN}={batch_id}")


def _load(
    rows: DataFrame, batch_id: int, table: str, transform: Transform, name: str
) -> list[tuple]:
    """Load rows, halving the files on a fault of the data; entries of the files that stay out.

    Files are told apart by a hash of their name, so no list of files is needed; ``k`` bad files
    among ``n`` cost about ``k log n`` further jobs.
    """
    failed, todo = [], [(0, 0)]
    bits = F.xxhash64(FILE_COLUMN)
    while todo:
        depth, value = todo.pop()
        some = rows if not depth else rows.filter(bits.bitwiseAND(F.lit((1 << depth) - 1)) == value)
        try:
            write_portion(transform(some.drop(FILE_COLUMN)), batch_id, table, f"{name}-{depth}-{value}")
        except Exception as error:
            if not is_data_fault(error):
                raise
            files = [r[0] for r in some.select(FILE_COLUMN).distinct().limit(2).collect()]
            if len(files) == 1:
                failed.append((files[0], "failed", _reason(error)))
            elif files:
                todo += [(depth + 1, value), (depth + 1, value | 1 << depth)]
    return failed


def _reason(error: BaseException) -> str:
    """The message of the innermost Spark error, on one line."""
    text, origin = str(error), getattr(error, "_origin", None)
    while origin is not None:
        if "SparkThrowable" in _interfaces(origin) and origin.getMessage():
            text = origin.getMessage()
        origin = origin.getCause()
    return " ".join(text.split())[:500]


def run_available(
    stream: DataFrame, table: str, checkpoint: str,
    transform: Transform = lambda df: df, attempts: int = ATTEMPTS, pause: float = PAUSE,
):
    """Process everything that has arrived, then stop. Returns the finished query.

    Bad files are left out and named in the log (``batch_log``). A batch that fails for another
    reason is tried again after a pause, ``attempts`` times in all, and then ends the run with
    its error; no file of it is given up. A run that breaks off is started again from the checkpoint:
    finished batches are not repeated, and the broken one replaces whatever it had written.
    """

    def step(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        _log(spark, checkpoint, batch_id, [(None, "queued", None)])
        # What an attempt that broke off has written, in whatever portions.
        remove(spark, _batch_path(table, batch_id))
        failed = _load(df, batch_id, table, transform, "p")
        state = "failed" if failed else "completed"
        _log(spark, checkpoint, batch_id, [(None, state, None), *failed])

    for attempt in range(1, attempts + 1):
        query = (
            stream.writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt == attempts:
                raise
            time.sleep(pause * 2 ** (attempt - 1))


def retry_failed(
    spark: SparkSession, table: str, checkpoint: str,
    read: Callable[[SparkSession, list[str]], DataFrame], transform: Transform = lambda df: df,
    files_at_once: int = FILES_PER_TRIGGER,
) -> int:
    """Load the files again that the log names as failed; returns how many were loaded.

    ``read(spark, paths)`` reads files as the stream did, for instance
    ``spark.read.schema(...).csv``, or gives rows that name their file in ``source_file``. Files
    are taken batch by batch, at most ``files_at_once`` together, each under the batch that it
    arrived in; what still fails stays in the log.
    """
    loaded_files = 0
    for batch_id, run, files in _failed_portions(spark, checkpoint, files_at_once):
        rows = read(spark, files)
        if FILE_COLUMN not in rows.columns:
            rows = rows.withColumn(FILE_COLUMN, F.col("_metadata.file_path"))
        still = _load(rows, batch_id, table, transform, f"again{run}")
        bad = {r[0] for r in still}
        good = [(f, "completed", "retried") for f in files if f not in bad]
        _log(spark, checkpoint, batch_id, good + still)
        loaded_files += len(good)
    return loaded_files


def _failed_portions(spark: SparkSession, checkpoint: str, size: int):
    """Failed files in portions of one batch each, with a number that no earlier retry had."""
    log = batch_log(spark, checkpoint)
    failed = log.filter("status = 'failed' AND source_file IS NOT NULL")
    waiting = failed.groupBy(BATCH_COLUMN).agg(F.max("logged_at").alias("run")).orderBy(BATCH_COLUMN)
    for row in waiting.toLocalIterator():
        batch_id, last = row[BATCH_COLUMN], None
        while True:
            some = failed.filter(F.col(BATCH_COLUMN) == batch_id)
            some = some if last is None else some.filter(F.col(FILE_COLUMN) > last)
            files = [r[0] for r in some.select(FILE_COLUMN).orderBy(FILE_COLUMN).limit(size).collect()]
            if not files:
                break
            last = files[-1]
            yield batch_id, f"{row['run']}x{zlib.crc32(last.encode())}", files


def batch_log(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``load_batch, source_file, status, reason, logged_at``: how things stand.

    One row for each batch (no ``source_file``): ``queued`` from its start, then ``completed`` or,
    where files stayed out, ``failed``; and one for each such file, ``completed`` once a retry has
    loaded it. A batch that was started again counts from its last start.
    """
    entries = spark.read.schema(f"{LOG_COLUMNS}, {BATCH_COLUMN} bigint").parquet(_log_path(checkpoint))
    begun = entries.filter("status = 'queued'").groupBy(BATCH_COLUMN).agg(
        F.max("logged_at").alias("_begun"))
    last = F.max(F.struct("logged_at", "status", "reason")).alias("_last")
    return entries.join(begun, BATCH_COLUMN).filter("logged_at >= _begun").groupBy(
        BATCH_COLUMN, "source_file").agg(last).select(
        BATCH_COLUMN, "source_file", "_last.status", "_last.reason", "_last.logged_at")


def loaded(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """Everything loaded so far, with the batch each row came in."""
    rows = spark.read.schema(f"{schema}, {BATCH_COLUMN} bigint, {PORTION_COLUMN} string").parquet(table)
    return rows.drop(PORTION_COLUMN)


def batch_metrics(table: DataFrame) -> DataFrame:
    """Rows per finished batch."""
    return table.groupBy(BATCH_COLUMN).agg(F.count("*").alias("rows"))


def progress_metrics(log: DataFrame) -> DataFrame:
    """Batches ever queued, completed and failed; the rest of the queued ones wait or are broken off.

    A batch with a file that still stays out has failed; once its files are loaded, it is completed.
    """
    whole = F.count_if(F.col("source_file").isNull() & (F.col("status") == "queued")) > 0
    bad = F.count_if(F.col("source_file").isNotNull() & (F.col("status") == "failed")) > 0
    batches = log.groupBy(BATCH_COLUMN).agg(whole.alias("waiting"), bad.alias("bad"))
    return batches.agg(
        F.count("*").alias("queued"), F.count_if(~F.col("bad") & ~F.col("waiting")).alias("completed"),
        F.count_if("bad").alias("failed"),
    )
