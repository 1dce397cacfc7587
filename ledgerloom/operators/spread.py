"""Ordinals, running totals and joins that stay balanced when one key holds most of the rows.

A window partitioned by document or sheet would pull a hot document into one task. The functions
here split each key into blocks of consecutive order values, work inside the blocks, and carry only
one summary row per block across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import planned_bytes, write_through

BLOCK_ROWS = 65536
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 * 1024 * 1024


def with_position(
    rows: DataFrame,
    keys: list[str],
    order: str,
    name: str,
    within: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """1-based position of each row in its key group, ordered by ``within`` then ``order``.

    ``order`` is an integer column, unique inside ``keys`` + ``within``, so a block of
    ``block_rows`` consecutive order values bounds every window partition. Key columns are not null.
    """
    within = within or []
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block_rows))
    block_keys = keys + within + ["_block"]
    counts = blocked.groupBy(*block_keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(*within, "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *block_keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = blocked.withColumn(
        "_local", F.row_number().over(W.partitionBy(*block_keys).orderBy(order))
    )
    joined = local.join(offsets, block_keys)
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop(
        "_block", "_local", "_offset"
    )


def with_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows densely by part in the order of any columns.

    One range shuffle sorts them; ``name`` is the sorted part and the place in it, so consecutive
    rows of a part have consecutive numbers and blocks of numbers are full. Written, so that the
    numbers stay the same however often the result is read.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_through(ordered.withColumn(name, F.monotonically_increasing_id()), "ordered")


def first_rows(
    rows: DataFrame, keys: list[str], order: list[str | Column], n: int, name: str
) -> DataFrame:
    """The first ``n`` rows of each key with their 1-based position.

    Catalyst turns the filtered rank into a per-task group limit before the shuffle, so a task
    sends at most ``n`` rows per key whatever the size of the key.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, rank).filter(F.col(name) <= n)


def gap_starts(
    rows: DataFrame, keys: list[str], order: str, min_gap: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """First order value per key after which at least ``min_gap`` order values are absent.

    Gaps inside a block come from a window over the block; gaps between blocks come from the first
    and last value of neighbouring blocks.
    """
    blocked = rows.select(
        *keys, F.col(order).alias("_at"), F.floor(F.col(order) / block_rows).alias("_block")
    )
    step = W.partitionBy(*keys, "_block").orderBy("_at")
    stepped = blocked.withColumn("_next", F.lead("_at").over(step))
    summary = stepped.groupBy(*keys, "_block").agg(
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
        F.min(F.when(F.col("_next") - F.col("_at") > min_gap, F.col("_at"))).alias("_inner"),
    )
    across = F.lead("_first").over(W.partitionBy(*keys).orderBy("_block"))
    crossed = F.when(across - F.col("_last") > min_gap, F.col("_last"))
    return (
        summary.withColumn("_outer", crossed)
        .groupBy(*keys)
        .agg(F.min(F.least("_inner", "_outer")).alias("gap_after"))
        .filter(F.col("gap_after").isNotNull())
    )


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Join rows with a table that holds one row per key, where few keys own most of the rows.

    ``per_key`` is a table that is read, not one that is still being grouped: then both sides come
    straight from their shuffle and Spark splits the partition of a hot key over several tasks,
    repeating only that key's row. A small side is broadcast below Spark's own threshold.
    """
    return rows.join(per_key, keys, how)


def join_measured(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """As ``join_per_key`` for a table already written out: measured first, broadcast if small.

    The measure reads file sizes and footers only. Above ``BROADCAST_BYTES`` or ``broadcast_rows``
    the split join takes over.
    """
    if planned_bytes(per_key) <= BROADCAST_BYTES and per_key.count() <= broadcast_rows:
        return rows.join(F.broadcast(per_key), keys, how)
    return join_per_key(rows, per_key, keys, how)


def sorted_parts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows dealt by range of ``keys`` and ``order``, with the number of their part, written.

    A part holds consecutive values, a key with very many values has many parts, and equal values
    share one. The functions below look along the order inside parts and carry one row per key
    and part across them.
    """
    ranged = rows.repartitionByRange(*keys, order)
    return write_through(ranged.withColumn("_part", F.spark_partition_id()), "sorted-parts")


def _from_other_parts(parted: DataFrame, keys: list[str], value: Column, combine, later: bool) -> DataFrame:
    """``keys, _part, _carried``: ``combine`` of a key's values in all earlier (or later) parts."""
    order = F.col("_part").desc() if later else F.col("_part").asc()
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per_part = parted.groupBy(*keys, "_part").agg(value.alias("_own"))
    return per_part.select(*keys, "_part", combine(F.col("_own")).over(before).alias("_carried"))


def with_previous(parted: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The value before each one of its key in ``sorted_parts``; values are distinct."""
    near = F.lag(order).over(W.partitionBy("_part", *keys).orderBy(order))
    carried = _from_other_parts(
        parted, keys, F.max(order), lambda v: F.last(v, ignorenulls=True), later=False)
    return parted.withColumn("_near", near).join(carried, [*keys, "_part"]).withColumn(
        name, F.coalesce("_near", "_carried")).drop("_near", "_carried")


def with_running_count(
    parted: DataFrame, keys: list[str], order: str, flag: Column, name: str
) -> DataFrame:
    """How many values up to and with each one of its key are flagged, in ``sorted_parts``."""
    flagged = parted.withColumn("_flag", F.when(flag, 1).otherwise(0))
    upto = W.partitionBy("_part", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    carried = _from_other_parts(flagged, keys, F.sum("_flag"), F.sum, later=False)
    return flagged.withColumn("_near", F.sum("_flag").over(upto)).join(
        carried, [*keys, "_part"]).withColumn(
        name, F.col("_near") + F.coalesce("_carried", F.lit(0))).drop("_near", "_carried", "_flag")


def with_next_beyond(
    places: DataFrame, keys: list[str], order: str, reach: float, name: str
) -> DataFrame:
    """The least value of the key beyond each value plus ``reach`` (null at the end)."""
    given = places.select(*keys, F.col(order).alias("_at"), F.lit(None).cast("double").alias("_of"))
    asked = places.select(*keys, (F.col(order) + reach).alias("_at"), F.col(order).alias("_of"))
    parted = sorted_parts(given.unionByName(asked), keys, "_at")
    # From the end: an asked value stands before an equal given one, which is not beyond it.
    known = F.when(F.col("_of").isNull(), F.col("_at"))
    back = W.partitionBy("_part", *keys).orderBy(
        F.desc("_at"), F.col("_of").isNull()).rowsBetween(W.unboundedPreceding, -1)
    carried = _from_other_parts(
        parted, keys, F.min(known), lambda v: F.last(v, ignorenulls=True), later=True)
    near = parted.withColumn("_near", F.last(known, ignorenulls=True).over(back))
    found = near.join(carried, [*keys, "_part"]).filter("_of is not null")
    return found.select(*keys, F.col("_of").alias(order), F.coalesce("_near", "_carried").alias(name))
