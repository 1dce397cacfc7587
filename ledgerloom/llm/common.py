"""What several operators share: words of texts, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import os
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
ALNUM_ONLY = bytes(
    b + 32 if 65 <= b <= 90 else (b if b in _WORD or b >= 128 else 32) for b in range(256)
)
BATCH_ROWS = 1000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CACHED_WORDS = 400_000


def batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, for one row may be a very long text; workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, lost executors re-read it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column itself."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def matched(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle and sort whatever the sizes, so that small inputs show the large ones' plan."""
    return left.join(right.hint("merge"), on, how)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen most recently."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    values = np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)
    return values | np.uint64(1)


def packed(model) -> bytes:
    return pickle.dumps(model, protocol=5)
