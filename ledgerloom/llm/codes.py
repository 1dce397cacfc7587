"""Product codes of vectors with integer arithmetic that is exact whatever the order of sums.

Components become whole numbers. Distances of parts to codebook entries are matrix products: the
numbers are broken into limbs of so few bits that a product of two limb matrices stays below 2^53,
where float64 BLAS is exact, and the products are put together in 64-bit integers. The first least
distance wins. A round of training adds up, in every task, the parts that chose an entry; Spark
adds the tasks' sums, and only the codebooks themselves reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, matched, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
EXACT_BITS = 53
#: Sums leave a task as limbs of so many bits, so that Spark's own sums can't overflow.
SUM_BITS = 30


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good, F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` exactly; an array of Python integers where 64 bits are too few."""
    if not vectors.size or np.abs(vectors).max() < 2.0**52:
        return np.floor(vectors * SCALE).astype(np.int64)
    whole = [
        math.floor(v * SCALE) if abs(v) < 2.0**53 else int(v) * SCALE for v in vectors.ravel().tolist()
    ]
    return np.array(whole, dtype=object).reshape(vectors.shape)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float matrices with ``x = sum(limb << (bits * k))``; all but the last are below ``2^bits``."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers by float64 products that are exact."""
    bits = (EXACT_BITS - math.ceil(math.log2(max(2, a.shape[1])))) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            total += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every row; the lowest index of equal ones."""
    if not parts.size:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    largest = max(int(np.abs(parts).max()), int(np.abs(book).max()))
    if parts.shape[1] * (2 * largest) ** 2 < 1 << 62:
        own, other = parts.astype(np.int64), book.astype(np.int64)
        far = (other**2).sum(1)[None, :] - 2 * products(own, other)
        chosen = far.argmin(axis=1)
        return chosen, far[np.arange(len(own)), chosen] + (own**2).sum(1)
    # Components beyond 64-bit distances, entry by entry in Python's integers.
    far = np.stack([((parts.astype(object) - row) ** 2).sum(1) for row in book.astype(object)], 1)
    chosen = np.array([min(range(len(book)), key=row.__getitem__) for row in far.tolist()])
    return chosen, far[np.arange(len(parts)), chosen]


def bounds_of(size: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; equal if ``PARTS`` divides its length."""
    at = [size * k // PARTS for k in range(PARTS + 1)]
    return list(zip(at[:-1], at[1:]))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``size`` components."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)


def _split(value: int, n: int) -> list[int]:
    """``n`` limbs of ``SUM_BITS`` bits, the last with the sign; one limb is the value itself."""
    return [(value >> (SUM_BITS * k)) & ((1 << SUM_BITS) - 1) for k in range(n - 1)] + [
        value >> (SUM_BITS * (n - 1))]


def _next_books(kept: DataFrame, books: list[np.ndarray], size: int, n_limbs: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    bounds, width = bounds_of(size), max(e - b for b, e in bounds_of(size)) * n_limbs

    def add_up(portions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int64 if n_limbs == 1 else object
        sums = [np.zeros(book.shape, kind) for book in books]
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        for batch in portions:
            whole = whole_numbers(matrix(batch["embedding"], size))
            for k, (b, e) in enumerate(bounds):
                chosen, _ = nearest_entries(whole[:, b:e], books[k])
                counts[k] += np.bincount(chosen, minlength=len(books[k]))
                np.add.at(sums[k], chosen, whole[:, b:e])
        part, entry = np.nonzero(counts)
        if len(part):
            flat = []
            for k, j in zip(part, entry):
                split = [_split(int(v), n_limbs) for v in sums[k][j]]
                line = [v for limb in split for v in limb]
                flat.append(line + [0] * (width - len(line)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
                 pa.array(counts[part, entry]), pa.array(flat, pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"])

    sums = kept.select("embedding").mapInArrow(
        add_up, "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)
    out = [book.astype(object) for book in books]
    # At most PARTS * ENTRIES rows.
    for row in total.collect():
        b, e = bounds[row["part"]]
        for i in range(e - b):
            value = sum(
                int(row[f"s{i * n_limbs + k}"]) << (SUM_BITS * k) for k in range(n_limbs))
            out[row["part"]][row["entry"], i] = value // row["n"]
    small = all(abs(v) < 1 << 62 for book in out for v in book.ravel())
    return [book.astype(np.int64) for book in out] if small else out


def train(kept: DataFrame, size: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """A codebook (entries x components) for each part, from vectors of ``size`` finite components.

    It starts from the ``entries`` least vec_ids (rows without one last; of equal ids the least
    vector) or from all vectors, if there are fewer.
    """
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    seeds = [r["embedding"] for r in kept.orderBy(*order).limit(entries).collect()]
    start = whole_numbers(np.array(seeds, dtype=np.float64).reshape(len(seeds), size))
    books = [start[:, b:e] for b, e in bounds_of(size)]
    top = kept.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 0.0
    bits = math.ceil(math.log2(max(1.0, top))) + 9
    n_limbs = max(1, -(-bits // SUM_BITS))
    for _ in range(rounds):
        books = _next_books(kept, books, size, n_limbs)
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    text = ",".join(str(int(v)) for book in books for v in book.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """``vec_id, label, code, error`` of every vector; an error beyond 64 bits is null."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    bounds = bounds_of(size)

    def code(portions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions:
            whole = whole_numbers(matrix(batch["embedding"], size))
            chosen = np.zeros((len(whole), PARTS), np.uint8)
            error = np.zeros(len(whole), object)
            for k, (b, e) in enumerate(bounds):
                chosen[:, k], far = nearest_entries(whole[:, b:e], books[k])
                error += far.astype(object)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array([row.tobytes().hex() for row in chosen]),
                 pa.array([v if v < 1 << 63 else None for v in error.tolist()], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "embedding").mapInArrow(
        code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Vectors that are null or hold null or non-finite components take no part, nor do those of
    another length than the most frequent one (the longer, if two are equally frequent). Rows that
    repeat a vec_id or have none are rows like others. ``label_error`` adds the errors of equal
    labels, nulls together; it is null where a sum leaves 64 bits. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    batches(vectors.sparkSession)
    kept = vectors.select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(finite(F.col("embedding")))
    sizes = kept.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    kept = kept.filter(F.size("embedding") == size)
    books = train(kept, size, rounds, entries) if usual else []
    if not usual:
        none = F.lit(None)
        return kept.select(
            "vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"),
            none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    coded = written(encode(kept, books, size), "vector-codes")
    whole = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(19,0)")))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("_sum"))
    sums = sums.select("_label", F.col("_sum").try_cast("long").alias("label_error"))
    out = matched(coded, sums, coded["label"].eqNullSafe(sums["_label"]))
    return out.select(
        "vec_id", "label", "code", "error", "label_error",
        F.lit(fingerprint(books)).alias("codebooks_sha256"))
