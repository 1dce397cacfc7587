"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Two source columns may carry one canonical name; the later column wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot partition of a join even when the split costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on, also where one was changed since."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Fixed, so that two passes over the same files cut them at the same places even when the
        # number of executors changes in between.
        slices = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(slices))
    return spark


def _bytes(size: str) -> int:
    """Bytes of a Spark size setting such as ``134217728b`` or ``64m``."""
    digits, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(digits) * 1024 ** " kmgt".index(unit or " ")


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``; for files read without a filter, the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that is too small to be split into enough tasks.

    Only inputs below one split per core are shuffled, so the cost is bounded; larger inputs
    already come in enough splits and are left alone.
    """
    conf, slices = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    split = _bytes(conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(slices) if planned_bytes(df) < split * slices else df


_local: list[str] = []


def _local_folder() -> str:
    """One temporary folder for this process, removed when it ends."""
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ledgerloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. A session that
    runs in one process does without; anywhere else a missing folder is an error, for executors
    would not see each other's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for kept in _scratch:
        kept.append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that were written inside, once the block is left.

    For a job that writes its result inside the block: ``with scratch(spark): run().write...``.
    Results that are read later must not come from inside. If the block fails, the tables go too.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of a table, if it is there, wherever Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a stage's result is used more than once or where the planner should see its real
    size. A lost executor re-reads the files instead of recomputing the stage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
