"""Nearest neighbours by collision counting on sorted projections (query-aware hashing).

Vectors are cut into segments. A segment keeps, for each of ``PROJECTIONS`` random directions, its
vectors sorted by their projection. A query's window on each direction is centred on the query's
own projection and widens with the search radius (virtual rehashing: a wider radius reads further
along the same sorted arrays). A vector that lies inside the windows of enough directions is
verified with the exact inner product.

A query first searches one segment, its home, until a radius within which the k-th best verified
vector lies. That score bounds what can still be among the nearest, so in all other segments its
windows are cut once, at the radius of the bound; vectors as near as that have collided often
enough with high probability. The best of all segments are merged. A segment is built once for up
to ``QUERY_ROWS`` queries, which stream through it.

Inner products become distances by one more component: with ``M`` the largest norm, a vector gets
``sqrt(M^2 - |x|^2)`` and a query 0; the nearest are then those with the largest inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, matched, written

K = 20
SEGMENT_ROWS = 16_384
QUERY_ROWS = 65_536
BLOCK = 256
PROJECTIONS = 60
#: Half the window's width, as a part of the radius.
HALF_WIDTH = 0.7
#: Standard deviations that the threshold lies below the expected count of a vector at the radius.
SLACK = 1.2
GROWTH = 1.05


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sums from the first component to the last, so that equal vectors have equal scores."""
    return np.cumsum(rows * query, axis=1)[:, -1]


class Segment:
    """Sorted projections of some vectors; equal vectors are one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # Rows by id; equal vectors share a number, so they collide together and score alike.
        self.vectors, number = np.unique(vectors[order] + 0.0, axis=0, return_inverse=True)
        self.number = number = number.ravel()
        self.rows = np.argsort(number, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(number))])
        norms = (self.vectors**2).sum(1)
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(largest**2 - norms, 0))])
        self.square = largest**2
        self.directions = np.random.default_rng(seed).normal(size=(lifted.shape[1], PROJECTIONS))
        projected = (lifted @ self.directions).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        p = math.erf(HALF_WIDTH / math.sqrt(2))
        spread = math.sqrt(PROJECTIONS * p * (1 - p))
        self.threshold = max(1, math.floor(PROJECTIONS * p - SLACK * spread))

    def search(
        self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and inner products of the ``k`` nearest found but its own id.

        A finite ``bound`` is a score that ``k`` vectors elsewhere have: only vectors that reach
        it are looked for.
        """
        if len(self.vectors) <= 4 * k:
            for query, name in zip(queries, own):
                everything = np.arange(len(self.vectors))
                yield self._best(everything, self.vectors @ query, query, name, k)
            return
        centres = queries @ self.directions[:-1]
        squares = (queries**2).sum(1)
        bounded = np.isfinite(bound)
        ask = np.flatnonzero(bounded)
        found: list = [None] * len(queries)
        if len(ask):
            radius = np.sqrt(np.maximum(self.square + squares[ask] - 2 * bound[ask], 0)) * (1 + 1e-9)
            low, high = self._windows(centres[ask], radius[:, None])
            for at, q in enumerate(ask):
                found[q] = self._within(queries[q], own[q], bound[q], k, low[at, 0], high[at, 0])
        ask = np.flatnonzero(~bounded)
        if len(ask):
            radii = self._radii(queries[ask], squares[ask], k)
            low, high = self._windows(centres[ask], np.broadcast_to(radii, (len(ask), len(radii))))
            for at, q in enumerate(ask):
                found[q] = self._widen(queries[q], own[q], k, radii, low[at], high[at])
        yield from found

    def _windows(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin and end: query x radius x direction."""
        return tuple(
            np.stack([
                np.searchsorted(line, centres[:, j, None] + sign * HALF_WIDTH * radii, side)
                for j, line in enumerate(self.sorted)], axis=2)
            for sign, side in ((-1, "left"), (1, "right"))
        )

    def _radii(self, queries: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
        # A few exact distances only tell at which radius to begin; the end is found by counting.
        tried = self.square + squares[:8, None] - 2 * (self.vectors @ queries[:8].T).T
        start = 0.9 * math.sqrt(max(float(np.partition(tried, k, axis=1)[:, k].min()), 0))
        top = math.sqrt(self.square) + float(np.sqrt(squares).max())
        start = max(start, top / 1000)
        return start * GROWTH ** np.arange(math.ceil(math.log(top / start, GROWTH)) + 2)

    def _within(self, query, own, bound, k: int, low, high) -> tuple[np.ndarray, np.ndarray]:
        rings = [self.order[j, low[j] : high[j]] for j in range(PROJECTIONS)]
        count = np.bincount(np.concatenate(rings), minlength=len(self.vectors))
        near = np.flatnonzero(count >= self.threshold)
        score = self.vectors[near] @ query
        reach = score >= bound - self._margin(query)
        return self._best(near[reach], score[reach], query, own, k, bound)

    def _margin(self, query) -> float:
        """More than sums in any order can differ by."""
        return 1e-13 * len(query) * math.sqrt(self.square * float(query @ query))

    def _widen(self, query, own, k: int, radii, low, high) -> tuple[np.ndarray, np.ndarray]:
        n, lines = len(self.vectors), range(PROJECTIONS)
        count = np.zeros(n, np.int64)
        score = np.full(n, -np.inf)
        others = np.diff(self.first) - self._own(own)
        a = b = None
        for radius, lows, highs in zip(radii, low, high):
            if a is None:
                rings = [self.order[j, lows[j] : highs[j]] for j in lines]
            else:
                rings = [self.order[j, lows[j] : a[j]] for j in lines]
                rings += [self.order[j, b[j] : highs[j]] for j in lines]
            a, b = lows, highs
            count += np.bincount(np.concatenate(rings), minlength=n)
            new = np.flatnonzero((count >= self.threshold) & (score == -np.inf))
            if len(new):
                score[new] = self.vectors[new] @ query
            # The inner product of a vector that stands at this radius.
            least = (self.square + query @ query - radius**2) / 2
            if others[score >= least].sum() >= k:
                break
        else:
            score = self.vectors @ query
        known = np.flatnonzero(score > -np.inf)
        return self._best(known, score[known], query, own, k)

    def _own(self, own) -> np.ndarray:
        """How many rows of each vector have the query's id."""
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        return np.bincount(self.number[a:b], minlength=len(self.vectors))

    def _best(
        self, numbers, score, query, own, k: int, bound: float = -np.inf
    ) -> tuple[np.ndarray, np.ndarray]:
        """The best rows of some vectors, ties to the smaller id.

        ``score`` is as good as BLAS gives it. It picks the vectors that can be among the best;
        these get the sums in order that are told and compared.
        """
        size = np.diff(self.first)
        if len(numbers) > 4 * k:
            # The own row may be among the best k and one, so these are not yet too few.
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            near = score >= least - self._margin(query)
            if (size[numbers[near]] - self._own(own)[numbers[near]]).sum() >= k:
                numbers = numbers[near]
        score = inner_products(self.vectors[numbers], query)
        numbers, score = numbers[score >= bound], score[score >= bound]
        rows = np.concatenate([self.rows[self.first[v] : self.first[v + 1]] for v in numbers]) if len(
            numbers) else np.zeros(0, np.int64)
        score = np.repeat(score, size[numbers])
        other = self.ids[rows] != own
        ids, score = self.ids[rows[other]], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Stretches of rows of one group and kind."""
    group, kind = (batch[c].to_numpy() for c in ("group", "kind"))
    cut = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        yield int(group[a]), int(kind[a]), batch.slice(a, b - a)


def _found(rows: DataFrame, largest: float, k: int) -> DataFrame:
    """What the queries (kind 1) of each group find among its vectors (kind 0)."""

    def matrix(part: pa.RecordBatch) -> np.ndarray:
        return part["embedding"].flatten().to_numpy().reshape(part.num_rows, -1)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, segment = None, [], None
        for batch in parts:
            for group, kind, part in _runs(batch) if batch.num_rows else ():
                if group != now:
                    now, held, segment = group, [], None
                if kind == 0:
                    held.append((part["vec_id"].to_numpy(), matrix(part)))
                    continue
                if segment is None and held:
                    segment = Segment(*map(np.concatenate, zip(*held)), largest)
                    held = []
                for at in range(0, part.num_rows if segment else 0, BLOCK):
                    some = part.slice(at, BLOCK)
                    names = some["vec_id"].to_numpy()
                    found = list(segment.search(matrix(some), names, some["bound"].to_numpy(), k))
                    sizes = [len(ids) for ids, _ in found]
                    if sum(sizes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(names, sizes)),
                             pa.array(np.concatenate([ids for ids, _ in found])),
                             pa.array(np.concatenate([score for _, score in found]))],
                            names=["query_id", "vec_id", "score"])

    keys = ["group", "kind", "vec_id"]
    dealt = rows.repartition("group").sortWithinPartitions(*keys)
    return dealt.select("group", "kind", "vec_id", "embedding", "bound").mapInArrow(
        find, "query_id long, vec_id long, score double")


def _first_k(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, query: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query row, nearest first.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those
    of another length than the most frequent one. Rows that repeat a ``vec_id`` are candidates of
    their own but not of a query with that id; of its rows the least vector asks. With ``k``
    candidates or fewer all are returned. Equal scores go by the smaller vec_id.
    Segments and groups of queries have fixed sizes, so a task's memory doesn't grow. Of very many
    equal vectors only those can be among anybody's nearest that have one of the ``k + 1`` smallest
    ids; the others are left out before the search.
    """
    spark = vectors.sparkSession
    batches(spark)
    good = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"),
    ).filter("vec_id is not null").filter(usable(F.col("embedding")))
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    good = good.filter(F.size("embedding") == usual["size"])
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    largest = math.sqrt(good.agg(F.max(norm)).first()[0])
    segments = max(1, -(-usual["n"] // SEGMENT_ROWS))
    equal = W.partitionBy("embedding").orderBy("vec_id")
    few = good.withColumn("_ids", F.dense_rank().over(equal)).filter(F.col("_ids") <= k + 1)
    again = W.partitionBy("embedding", "vec_id").orderBy(F.lit(1))
    few = few.withColumn("_rows", F.row_number().over(again)).filter(F.col("_rows") <= k)
    place = F.pmod(F.xxhash64("embedding"), F.lit(segments)).cast("int")
    placed = written(few.select("vec_id", "embedding", place.alias("segment")), "vectors")
    asked = written(
        good.filter(query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asking = asked.withColumns({
        "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long"),
        "home": F.pmod(F.xxhash64("vec_id", F.lit("home")), F.lit(segments)).cast("int")})
    none = F.lit(float("-inf"))
    group = (F.col("segment") * F.lit(blocks) + F.col("block")).alias("group")

    def groups(queries: DataFrame) -> DataFrame:
        # A segment's vectors once for each block of queries.
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        indexed = placed.withColumn("block", every)
        columns = ["vec_id", "embedding"]
        own = indexed.select(group, F.lit(0).alias("kind"), *columns, none.alias("bound"))
        return own.unionByName(queries.select(group, F.lit(1).alias("kind"), *columns, "bound"))

    home = asking.withColumns({"segment": F.col("home"), "bound": none})
    at_home = written(_found(groups(home), largest, k), "home-neighbours")
    if segments == 1:
        return _first_k(at_home, k).select("query_id", "rank", "vec_id", "score")
    last = at_home.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("_bound"))
    bounded = matched(asking, last, F.col("vec_id") == F.col("query_id"), "left").withColumn(
        "bound", F.coalesce("_bound", none))
    # Every query meets every other segment: a stated query set against all rows.
    others = bounded.withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).filter("segment != home")
    away = _found(groups(others.withColumn("segment", F.col("segment").cast("int"))), largest, k)
    return _first_k(at_home.unionByName(away), k).select("query_id", "rank", "vec_id", "score")
