"""Split rows into those settled by rules and those that need enrichment.

Rows carry ``data`` (column -> text) and ``slots`` (slot -> column of the row's document).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fields import is_falsy, off_limits, parse_currency, value_of
from ..functions.text import is_blank
from .spread import with_position


def slot_value(slot: str, data: str = "data", slots: str = "slots") -> Column:
    """Value of the column mapped to ``slot``; null when the slot or the value is missing."""
    return value_of(F.col(data), F.col(slots)[slot])


def has_slot(slot: str, slots: str = "slots") -> Column:
    return F.col(slots)[slot].isNotNull()


def ambiguity_reasons() -> Column:
    """Why a row cannot be settled by rules; an empty array means it can."""
    off_globe = off_limits(slot_value("latitude"), 90) | off_limits(slot_value("longitude"), 180)
    checks = [
        ("missing_or_invalid_currency",
         has_slot("currency") & parse_currency(slot_value("currency")).isNull()),
        ("missing_jurisdiction", has_slot("jurisdiction") & is_blank(slot_value("jurisdiction"))),
        ("missing_asset_type", has_slot("asset_type") & is_blank(slot_value("asset_type"))),
        ("invalid_coordinates", has_slot("latitude") & has_slot("longitude") & off_globe),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])


def has_schema_match() -> Column:
    """At least four fifths of the mapped required slots hold a value."""
    mapped = _count([has_slot(s) for s in vocab.REQUIRED_SLOTS])
    filled = _count([~is_falsy(slot_value(s)) for s in vocab.REQUIRED_SLOTS])
    return (mapped > 0) & (filled / F.greatest(mapped, F.lit(1)) >= 0.8)


def has_critical_fields() -> Column:
    """Currency and type are non-blank wherever they are mapped."""
    tests = [~has_slot(s) | ~is_blank(slot_value(s)) for s in ("currency", "asset_type")]
    return tests[0] & tests[1]


def initial_confidence(match: Column, complete: Column) -> Column:
    score = 0.5 + F.when(match, 0.3).otherwise(0.0) + F.when(complete, 0.2).otherwise(-0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def route_rows(rows: DataFrame) -> DataFrame:
    """Add ``reasons``, ``route`` and, for deterministic rows, ``overall_confidence``."""
    routed = rows.withColumn("reasons", ambiguity_reasons())
    ambiguous = F.size("reasons") > 0
    return routed.withColumn(
        "route", F.when(ambiguous, "ambiguous").otherwise("deterministic")
    ).withColumn(
        "overall_confidence",
        F.when(~ambiguous, initial_confidence(has_schema_match(), has_critical_fields())),
    )


def route_counts(routed: DataFrame) -> DataFrame:
    """Rows, settled rows and rows to enrich per document."""
    return routed.groupBy("document_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("route") == "deterministic").alias("deterministic_rows"),
        F.count_if(F.col("route") == "ambiguous").alias("ambiguous_rows"),
        F.avg("overall_confidence").alias("mean_confidence"),
    )


def is_ambiguous_by_fallback() -> Column:
    """Alternate test: a slot is unmapped and no well-known key helps, or a currency is malformed."""

    def none_of(*keys: str) -> Column:
        return reduce(lambda a, b: a & b, [is_falsy(value_of(F.col("data"), F.lit(k))) for k in keys])

    currency = slot_value("currency")
    return (
        (~has_slot("currency") & none_of("currency"))
        | (~has_slot("jurisdiction") & none_of("location", "jurisdiction", "country"))
        | (~has_slot("asset_type") & none_of("type", "asset_type", "category"))
        | (has_slot("currency") & ~is_falsy(currency) & (F.length(currency) != 3))
    )


def needs_enrichment() -> Column:
    """A slot is unmapped and the field of that name is missing (zero counts as missing)."""

    def missing(key: str, numeric: bool = False) -> Column:
        return is_falsy(value_of(F.col("data"), F.lit(key)), numeric)

    return (
        (~has_slot("currency") & missing("currency"))
        | (~has_slot("jurisdiction") & missing("jurisdiction"))
        | (
            (~has_slot("latitude") | ~has_slot("longitude"))
            & (missing("latitude", True) | missing("longitude", True))
        )
    )


def with_batches(
    routed: DataFrame,
    deterministic: int = vocab.DETERMINISTIC_BATCH,
    ambiguous: int = vocab.AMBIGUOUS_BATCH,
) -> DataFrame:
    """Number each document's rows into batches per route; the last batch may be short.

    Nothing is written for it: the places are counted from the rows' keys, and the rows are
    numbered in the shuffle that brings a block's rows together.
    """
    placed = with_position(
        routed, ["document_id", "route"], "row_index", "_pos", within=["sheet_name"])
    size = F.when(F.col("route") == "deterministic", deterministic).otherwise(ambiguous)
    return placed.withColumn("batch_id", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def provider_batch_size(size: int) -> int:
    """Batch size allowed for one provider call."""
    return min(max(size, 1), vocab.MAX_PROVIDER_BATCH)
