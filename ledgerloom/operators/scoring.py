"""Checks and scores of enrichment answers, review escalation and validation flags.

Answers carry ``normalized_name, currency, asset_type, jurisdiction, latitude, longitude, signals,
explanation, needs_review`` next to the row key, ``data`` and ``slots``.

Fixed values: codes, factor names, messages and reasons are those that stored data carries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import decimal_places, number_text, percent_text, trimmed
from .routing import has_slot

# Penalty and rank of each severity.
SEVERITY_PENALTY = {"critical": 0.4, "high": 0.3, "medium": 0.2, "low": 0.1}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _issue(field: str, severity: str, message: Column | str, code: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(severity).alias("severity"),
        text.alias("message"),
        F.lit(code).alias("code"),
    )


def _coordinate_issue(field: str, limit: int) -> Column:
    value, label = F.col(field), field.capitalize()
    places = decimal_places(value)
    out_of_range = F.concat(
        F.lit(f"{label} "), number_text(value), F.lit(f" is out of range (-{limit} to {limit})")
    )
    too_precise = F.concat(
        F.lit(f"{label} has excessive precision ("), places.cast("string"), F.lit(" decimals)")
    )
    broken = F.isnan(value) | (F.abs(value) == float("inf"))
    return (
        F.when(
            broken,
            _issue(field, "critical", f"{label} is not a valid number", f"INVALID_{field.upper()}"),
        )
        .when(
            ~value.between(-limit, limit),
            _issue(field, "critical", out_of_range, f"{field.upper()}_OUT_OF_RANGE"),
        )
        .when(
            places > vocab.COORDINATE_DECIMALS,
            _issue(field, "low", too_precise, "EXCESSIVE_COORDINATE_PRECISION"),
        )
    )


def answer_issues() -> Column:
    """Problems found in an answer, in the order latitude, longitude, currency, name."""
    currency, code = F.col("currency"), F.upper("currency")
    unknown = F.concat(F.lit("Currency "), code, F.lit(" is not in the standard currency list"))
    currency_issue = F.when(
        F.length(currency) != 3,
        _issue("currency", "high", "Currency must be a 3-letter code", "INVALID_CURRENCY_FORMAT"),
    ).when(~code.isin(vocab.CURRENCIES), _issue("currency", "medium", unknown, "UNKNOWN_CURRENCY"))
    name_issue = F.when(
        trimmed(F.col("normalized_name")) == "",
        _issue("normalizedAssetName", "high", "Asset name cannot be empty", "EMPTY_ASSET_NAME"),
    )
    return F.array_compact(
        F.array(
            F.when(F.col("latitude").isNotNull(), _coordinate_issue("latitude", 90)),
            F.when(F.col("longitude").isNotNull(), _coordinate_issue("longitude", 180)),
            F.when(currency.isNotNull(), currency_issue),
            name_issue,
        )
    )


def is_serious(issue: Column) -> Column:
    return issue["severity"].isin("critical", "high")


def validation_penalty(issues: Column) -> Column:
    """Sum of the issues' penalties, not below -1."""
    weight = F.create_map(*[F.lit(x) for p in SEVERITY_PENALTY.items() for x in p])
    total = F.aggregate(issues, F.lit(0.0), lambda acc, i: acc - weight[i["severity"]])
    return F.greatest(total, F.lit(-1.0))


def validate_answers(answers: DataFrame) -> DataFrame:
    """Add ``issues``, ``valid`` and ``penalty``."""
    return answers.withColumn("issues", answer_issues()).withColumns(
        {
            "valid": ~F.exists("issues", is_serious),
            "penalty": validation_penalty(F.col("issues")),
        }
    )


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def _sum_flags(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1).otherwise(0) for f in flags])


def _factor(name: str, score: Column | float, reason: Column | str) -> Column:
    return F.struct(
        F.lit(name).alias("factor"),
        (score if isinstance(score, Column) else F.lit(score)).alias("score"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    )


def _ratio_text(part: Column, whole: Column, tail: str) -> Column:
    return F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(f" {tail}"))


def confidence_factors() -> Column:
    """The factors that apply to a validated answer, in scoring order."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    # The value slot is counted as filled by the currency, as the currency slot is.
    expected = [
        (has_slot("asset_name"), _filled("normalized_name")),
        (has_slot("value"), _filled("currency")),
        (has_slot("currency"), _filled("currency")),
        (has_slot("jurisdiction"), _filled("jurisdiction")),
        (has_slot("latitude") & has_slot("longitude"), both),
    ]
    slots = _sum_flags([slot for slot, _ in expected])
    filled = _sum_flags([slot & value for slot, value in expected])
    mapped = F.when(slots > 0, filled / F.greatest(slots, F.lit(1)))

    signals = F.col("signals")
    inferable = [
        signals[s]
        for s in (
            "currency_inferred", "asset_type_inferred", "jurisdiction_inferred",
            "coordinates_inferred",
        )
    ]
    given = _sum_flags([s.isNotNull() for s in inferable])
    inferred = _sum_flags([F.coalesce(s, F.lit(False)) for s in inferable])
    inferred_ratio = F.when(given > 0, inferred / F.greatest(given, F.lit(1)))

    absent = [
        has_slot(slot) & F.col(column).isNull()
        for slot, column in (
            ("asset_name", "normalized_name"), ("currency", "currency"),
            ("jurisdiction", "jurisdiction"),
        )
    ]
    missing = reduce(lambda a, b: a | b, absent) | F.coalesce(
        signals["field_missing"], F.lit(False)
    )
    issue_text = F.concat(
        F.lit("Validation issues detected: "), F.size("issues").cast("string"), F.lit(" issues")
    )
    return F.array_compact(
        F.array(
            F.when(
                mapped >= 0.8,
                _factor("exact_column_mapping", 0.3,
                        _ratio_text(filled, slots, "fields mapped via exact column match")),
            ).when(
                mapped >= 0.5,
                _factor("partial_column_mapping", 0.1,
                        _ratio_text(filled, slots, "fields mapped via column match")),
            ),
            F.when(
                signals["exact_value_match"],
                _factor("deterministic_parse", 0.2, "Values matched exactly without inference"),
            ),
            F.when(
                inferred_ratio >= 0.5,
                _factor("llm_inference_required", -0.2,
                        _ratio_text(inferred, given, "fields required LLM inference")),
            ),
            F.when(
                missing,
                _factor("missing_fields", -0.3,
                        "Expected fields are missing or could not be inferred"),
            ),
            F.when(
                F.col("penalty") != 0,
                _factor("validation_issue", F.col("penalty"), issue_text),
            ),
            F.when(
                F.col("needs_review"),
                _factor("review_escalation_triggered", -0.3,
                        "LLM marked this row for human review"),
            ),
        )
    )


def overall_confidence(factors: Column) -> Column:
    total = F.aggregate(factors, F.lit(0.5), lambda acc, f: acc + f["score"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def field_confidences() -> Column:
    """Confidence per answered field: 0.9 given, 0.7 inferred, 0.3 absent."""

    def given(column: str, signal: str) -> Column:
        inferred = F.coalesce(F.col("signals")[signal], F.lit(False))
        return F.when(~_filled(column), 0.3).when(inferred, 0.7).otherwise(0.9)

    placed = F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0), F.lit(False))
    return F.create_map(
        F.lit("assetName"), F.when(_filled("normalized_name"), 0.9).otherwise(0.3),
        F.lit("currency"), given("currency", "currency_inferred"),
        F.lit("assetType"), given("asset_type", "asset_type_inferred"),
        F.lit("jurisdiction"), given("jurisdiction", "jurisdiction_inferred"),
        F.lit("coordinates"), F.when(placed, 0.9).otherwise(0.3),
    )


def confidence_text(factors: Column, score: Column) -> Column:
    """Sentence with the score in percent and the reasons for and against."""

    def reasons(side: Column) -> Column:
        return F.array_join(F.transform(side, lambda f: f["reason"]), "; ")

    plus = F.filter(factors, lambda f: f["score"] > 0)
    minus = F.filter(factors, lambda f: f["score"] < 0)
    return F.concat(
        F.lit("Overall confidence: "), percent_text(score), F.lit("%. "),
        F.when(F.size(plus) > 0, F.concat(F.lit("Positive signals: "), reasons(plus), F.lit(". ")))
        .otherwise(""),
        F.when(F.size(minus) > 0, F.concat(F.lit("Negative signals: "), reasons(minus), F.lit(".")))
        .otherwise(""),
    )


def score_answers(validated: DataFrame) -> DataFrame:
    """Add factors, overall and per-field confidence, and the explanation."""
    scored = validated.withColumn("factors", confidence_factors())
    scored = scored.withColumn("overall_confidence", overall_confidence(F.col("factors")))
    return scored.withColumns(
        {
            "field_confidence": field_confidences(),
            "confidence_text": confidence_text(F.col("factors"), F.col("overall_confidence")),
        }
    )


def needs_review_escalation(score: Column) -> Column:
    return score < vocab.REVIEW_THRESHOLD


def review_status(score: Column) -> Column:
    return F.when(needs_review_escalation(score), "requires_review").otherwise("auto_approved")


def escalation_reasons() -> Column:
    """Array of ``struct<reason, priority>`` that send a scored answer to review."""
    issues = F.col("issues")
    serious = F.filter(issues, is_serious)
    score = F.col("overall_confidence")

    def code_like(*parts: str) -> Column:
        return F.exists(
            issues, lambda i: reduce(lambda a, b: a | b, [i["code"].contains(p) for p in parts])
        )

    rules = [
        (score < vocab.REVIEW_THRESHOLD,
         F.concat(F.lit("Low confidence score: "), percent_text(score), F.lit("%")), 2),
        (F.size(serious) > 0,
         F.concat(F.lit("Validation issues: "),
                  F.array_join(F.transform(serious, lambda i: i["field"]), ", ")), 3),
        (F.size(issues) >= 2,
         F.concat(F.lit("Multiple validation issues: "), F.size(issues).cast("string"),
                  F.lit(" total")), 2),
        (code_like("LATITUDE", "LONGITUDE"), F.lit("Invalid coordinates detected"), 2),
        (code_like("CURRENCY"), F.lit("Invalid or unknown currency"), 1),
        (~F.col("valid"), F.lit("Deterministic validation failed"), 2),
    ]
    return F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(reason.alias("reason"), F.lit(priority).alias("priority")))
                for test, reason, priority in rules
            ]
        )
    )


def entity_id() -> Column:
    """Stable id of a row's record."""
    key = F.concat_ws("|", "document_id", "sheet_name", F.col("row_index").cast("string"))
    return F.sha2(key, 256)


def review_items(scored: DataFrame) -> DataFrame:
    """Review-queue rows for the answers that must be looked at.

    Best given a scored table that has been written out: the filter on the reasons would otherwise
    make the planner repeat the scoring expressions inside the filter.
    """
    found = scored.withColumn("_why", escalation_reasons()).filter(F.size("_why") > 0)
    return found.select(
        "document_id",
        "sheet_name",
        "row_index",
        F.lit("extracted_asset_field").alias("entity_type"),
        entity_id().alias("entity_id"),
        F.array_join(F.transform("_why", lambda w: w["reason"]), "; ").alias("review_reason"),
        F.array_max(F.transform("_why", lambda w: w["priority"])).alias("priority"),
        F.lit("pending").alias("status"),
    )


def validation_flags(scored: DataFrame) -> DataFrame:
    """One flag row per answer with issues: leading code, worst severity, all messages."""
    issues = F.col("issues")
    rank = F.create_map(*[F.lit(x) for p in SEVERITY_RANK.items() for x in p])
    worst = F.array_max(F.transform(issues, lambda i: F.struct(rank[i["severity"]], i["severity"])))
    leading = F.get(F.filter(issues, is_serious), F.lit(0))["code"]
    return scored.filter(F.size("issues") > 0).select(
        "document_id",
        "sheet_name",
        "row_index",
        F.lit("extracted_asset_field").alias("entity_type"),
        entity_id().alias("entity_id"),
        F.coalesce(leading, F.get(issues, F.lit(0))["code"]).alias("flag_type"),
        worst["severity"].alias("severity"),
        F.array_join(
            F.transform(issues, lambda i: F.concat_ws(": ", i["field"], i["message"])), "; "
        ).alias("explanation"),
    )
