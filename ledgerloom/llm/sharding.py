"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, text checksum, size). A keyed permutation of
these numbers gives each row its place, and the place gives shard and slot:
``shard = place mod shards``, ``slot = place div shards``. So any row's shard and slot follow from
its number alone, and ``row_at`` goes back from shard and slot to the number. Shard sizes differ
by one row at most (law ``rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mixed, written

SHARDS = 40
ROUNDS = 6
ROWS_PER_PARTITION = 2_000_000
ROW_BYTES = 16


def _sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds ``n`` numbers."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _round(values: np.ndarray, number: int, key: int, modulus: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + (number + 1) * 0xBF58476D1CE4E5B9) % 2**64)
    return (mixed(values.astype(np.uint64) ^ salt) % np.uint64(modulus)).astype(np.int64)


def _forward(x: np.ndarray, a: int, b: int, key: int) -> np.ndarray:
    left, right, size, other = x % a, x // a, a, b
    for number in range(ROUNDS):
        left, right = right, (left + _round(right, number, key, size)) % size
        size, other = other, size
    return left + a * right


def _backward(x: np.ndarray, a: int, b: int, key: int) -> np.ndarray:
    left, right, size, other = x % a, x // a, b, a
    for number in reversed(range(ROUNDS)):
        left, right = (right - _round(left, number, key, size)) % size, left
        size, other = other, size
    return left + a * right


def _walk(step, x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Apply ``step`` until the value is below ``n``; the grid has fewer than sqrt(n) numbers more."""
    a, b = _sides(n)
    x = step(np.asarray(x, dtype=np.int64), a, b, key)
    while (out := x >= n).any():
        x[out] = step(x[out], a, b, key)
    return x


def place_of(row: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each row number below ``n``; a bijection of 0..n-1."""
    return _walk(_forward, row, n, key)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, key: int, shards: int) -> np.ndarray:
    """Row number that stands at a slot of a shard."""
    return _walk(_backward, np.asarray(slot) * shards + np.asarray(shard), n, key)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[int]]:
    """Written rows with ``_part`` and ``_index``, and the rows before each part.

    The parts are ranges of ``order``; equal rows are told apart by where they were read, so a
    value that holds a third of the rows is cut as well. The list has one number per part.
    """
    conf = rows.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_PARTITION)
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(parts, *order, "_read").sortWithinPartitions(*order, "_read")
    place = F.monotonically_increasing_id()
    table = written(
        ranged.select(
            *rows.columns,
            F.shiftright(place, 33).alias("_part"),
            place.bitwiseAND(F.lit(2**33 - 1)).alias("_index"),
        ),
        "numbered",
    )
    counts = {r["_part"]: r["count"] for r in table.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    return table, [*before, total]


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: int = 2024) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number`` for every row.

    A null text has size 16 and a null checksum; empty texts size 16. Repeated rows get rows of
    their own. Rows with a null doc_id come first. An empty table gives an empty result.
    """
    batches(docs.sparkSession)
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    table, before = numbered(narrow, ["doc_id", "text_crc32", "size"])
    n, starts = before[-1], np.array(before, dtype=np.int64)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            row = starts[batch["_part"].to_numpy()] + batch["_index"].to_numpy()
            to = place_of(row, n, key)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["size"], batch["text_crc32"],
                    pa.array(["rows"] * len(row)), pa.array((to % shards).astype(np.int32)),
                    pa.array(to // shards), pa.nulls(len(row), pa.int32()), pa.array(row),
                ],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard",
                       "row_number"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(
        place,
        f"doc_id {kind}, size long, text_crc32 long, law string, shard int, slot long, "
        "grown_shard int, row_number long",
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, its rows in the order of their slots."""
    ranged = assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)
