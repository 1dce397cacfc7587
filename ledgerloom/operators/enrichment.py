"""Enrichment of ambiguous rows: direct answers, rule answers, provider batches, records."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fields import (
    literal_map,
    parse_currency,
    parse_latitude,
    parse_longitude,
    value_of,
)
from ..functions.text import blank_to_null, is_blank, json_object, merged_object, trimmed
from .routing import needs_enrichment, provider_batch_size, slot_value
from .scoring import entity_id, review_status
from ..session import write_through
from .spread import with_position

KEY = ["document_id", "sheet_name", "row_index"]
SIGNALS = (
    "struct<currency_inferred boolean, exact_value_match boolean, asset_type_inferred boolean, "
    "jurisdiction_inferred boolean, coordinates_inferred boolean, field_missing boolean>"
)
ANSWER_FIELDS = [
    "normalized_name", "currency", "asset_type", "jurisdiction", "latitude", "longitude",
    "signals", "explanation", "needs_review",
]

# JSON keys of an answer and the keys it must have.
ANSWER_JSON = (
    "normalizedAssetName string, currency string, assetType string, jurisdiction string, "
    "latitude double, longitude double, confidenceSignals struct<currencyInferred boolean, "
    "exactValueMatch boolean, assetTypeInferred boolean, jurisdictionInferred boolean, "
    "coordinatesInferred boolean, fieldMissing boolean>, explanation string, needsReview boolean"
)
REQUIRED_KEYS = ["confidenceSignals", "explanation", "needsReview"]

NOT_CONFIGURED = "LLM provider not configured"
EMPTY_EXPLANATION = "Enrichment failed - using raw values"


def _signals(**given: Column) -> Column:
    names = [
        "currency_inferred", "exact_value_match", "asset_type_inferred", "jurisdiction_inferred",
        "coordinates_inferred", "field_missing",
    ]
    return F.struct(
        *[given.get(n, F.lit(None)).cast("boolean").alias(n) for n in names]
    ).cast(SIGNALS)


def _named_slot(slot: str, key: str) -> Column:
    """Value of the slot's column, or of the column called ``key`` when the slot is open."""
    column = F.coalesce(F.col("slots")[slot], F.lit(key))
    return value_of(F.col("data"), column)


def direct_answers(rows: DataFrame) -> DataFrame:
    """Answers for rows that need no enrichment: the mapped name and a known currency."""
    none = F.lit(None)
    return rows.select(
        *KEY, "data", "slots",
        F.coalesce(_named_slot("asset_name", "asset_name"), F.lit("")).alias("normalized_name"),
        F.when(
            F.upper(_named_slot("currency", "currency")).isin(vocab.PROFILE_CURRENCIES),
            F.upper(_named_slot("currency", "currency")),
        ).alias("currency"),
        none.cast("string").alias("asset_type"),
        none.cast("string").alias("jurisdiction"),
        none.cast("double").alias("latitude"),
        none.cast("double").alias("longitude"),
        _signals(exact_value_match=F.lit(True), field_missing=F.lit(False)).alias("signals"),
        F.lit("Direct extraction - no LLM inference required").alias("explanation"),
        F.lit(False).alias("needs_review"),
    )


def rule_answers(rows: DataFrame) -> DataFrame:
    """Built-in provider: column values first, currency from the country where it is missing.

    Columns are found through ``filled``, the mapping with open slots filled.
    """

    def slot(name: str) -> Column:
        return slot_value(name, slots="filled")

    place = trimmed(slot("jurisdiction"))
    given = parse_currency(slot("currency"))
    looked_up = value_of(literal_map(vocab.COUNTRY_CURRENCY), F.upper(place))
    currency = F.coalesce(given, looked_up)
    lat, lng = parse_latitude(slot("latitude")), parse_longitude(slot("longitude"))
    kind = blank_to_null(trimmed(slot("asset_type")))
    inferred = given.isNull() & looked_up.isNotNull()
    off_globe = (lat["parsed"] & ~lat["valid"]) | (lng["parsed"] & ~lng["valid"])
    return rows.select(
        *KEY, "data", "slots",
        slot("asset_name").alias("normalized_name"),
        currency.alias("currency"),
        kind.alias("asset_type"),
        blank_to_null(place).alias("jurisdiction"),
        lat["value"].alias("latitude"),
        lng["value"].alias("longitude"),
        _signals(
            currency_inferred=inferred,
            exact_value_match=given.isNotNull(),
            asset_type_inferred=F.lit(False),
            jurisdiction_inferred=F.lit(False),
            coordinates_inferred=F.lit(False),
            field_missing=currency.isNull() | kind.isNull() | is_blank(place),
        ).alias("signals"),
        F.when(
            inferred, F.concat(F.lit("Currency inferred from "), place, F.lit(" jurisdiction."))
        )
        .when(given.isNotNull(), F.lit("Currency taken from the row."))
        .otherwise(F.lit("Currency could not be inferred."))
        .alias("explanation"),
        (currency.isNull() | off_globe).alias("needs_review"),
    )


def answers_for(rows: DataFrame, answer=rule_answers) -> DataFrame:
    """Direct answers for the rows that allow it, ``answer(rows)`` for the others."""
    marked = rows.withColumn("_ask", needs_enrichment())
    asked = answer(marked.filter("_ask").drop("_ask"))
    return direct_answers(marked.filter(~F.col("_ask")).drop("_ask")).unionByName(asked)


def checked_response(text: Column) -> Column:
    """Parsed answer JSON and whether its required keys are there: ``struct<answer, ok>``."""
    parsed = F.from_json(text, ANSWER_JSON)
    present = [parsed[k].isNotNull() for k in REQUIRED_KEYS]
    ok = parsed.isNotNull() & present[0] & present[1] & present[2]
    return F.struct(parsed.alias("answer"), F.coalesce(ok, F.lit(False)).alias("ok"))


Provider = Callable[[pd.DataFrame], list]


def ask_provider(
    rows: DataFrame, provider: Provider, batch_size: int = vocab.AMBIGUOUS_BATCH
) -> DataFrame:
    """Send rows to ``provider`` in batches and keep one result row per input row.

    The provider gets a frame with ``row_index, sheet_name, row`` (the row as JSON) and ``schema``
    (the document's slots as JSON) and returns a list of answer JSON texts in the same order. A short or malformed list gives an error and an
    empty answer for the rows it misses; a failing call gives an error for every row of its batch
    and leaves other batches alone.
    """
    size = provider_batch_size(batch_size)
    schema = F.to_json("slots") if "slots" in rows.columns else F.lit(None).cast("string")
    asked = rows.select(*KEY, json_object(F.col("data")).alias("row"), schema.alias("schema"))
    placed = with_position(
        write_through(asked, "asked"), ["document_id"], "row_index", "_pos", within=["sheet_name"]
    )
    batch = F.floor((F.col("_pos") - 1) / size).alias("batch_id")
    sent = placed.select(*KEY, batch, "row", "schema")

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["sheet_name", "row_index"])
        out = batch[["document_id", "sheet_name", "row_index", "batch_id"]].copy()
        try:
            replies = provider(batch[["row_index", "sheet_name", "row", "schema"]])
        except Exception as error:  # one failing batch must not stop the others
            out["response"] = None
            out["error"] = f"Batch enrichment failed: LLM batch enrichment failed: {error}"
            out["answered"] = False
            return out
        if not isinstance(replies, list):
            out["response"], out["answered"] = None, True
            out["error"] = "Invalid response format from LLM"
            return out
        padded = [*replies, *[None] * len(batch)][: len(batch)]
        out["response"] = padded
        out["error"] = [None if r else "No enrichment result returned" for r in padded]
        out["answered"] = True
        return out

    return sent.groupBy("document_id", "batch_id").applyInPandas(
        call,
        "document_id string, sheet_name string, row_index bigint, batch_id bigint, "
        "response string, error string, answered boolean",
    )


def provider_answers(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Answers of ``ask_provider`` joined back to their rows by key.

    Rows of a failed batch get no answer; a missing or malformed reply counts as an empty answer.
    """
    reply = results.filter("answered").withColumn("_r", checked_response(F.col("response")))
    answer, ok = F.col("_r")["answer"], F.col("_r")["ok"]
    told = answer["confidenceSignals"]
    spread = reply.select(
        *KEY,
        F.when(ok, answer["normalizedAssetName"]).alias("normalized_name"),
        F.when(ok, answer["currency"]).alias("currency"),
        F.when(ok, answer["assetType"]).alias("asset_type"),
        F.when(ok, answer["jurisdiction"]).alias("jurisdiction"),
        F.when(ok, answer["latitude"]).alias("latitude"),
        F.when(ok, answer["longitude"]).alias("longitude"),
        F.when(
            ok,
            _signals(
                currency_inferred=told["currencyInferred"],
                exact_value_match=told["exactValueMatch"],
                asset_type_inferred=told["assetTypeInferred"],
                jurisdiction_inferred=told["jurisdictionInferred"],
                coordinates_inferred=told["coordinatesInferred"],
                field_missing=told["fieldMissing"],
            ),
        ).otherwise(_signals(field_missing=F.lit(True))).alias("signals"),
        F.when(ok, answer["explanation"]).otherwise(EMPTY_EXPLANATION).alias("explanation"),
        F.when(ok, answer["needsReview"]).otherwise(True).alias("needs_review"),
    )
    return rows.select(*KEY, "data", "slots").join(spread, KEY)


def enriched_records(scored: DataFrame, job_id: Column | None = None) -> DataFrame:
    """Stored form of scored answers, with the job that they came from."""
    signals = F.col("signals")
    stored = F.to_json(
        F.struct(
            blank_to_null(F.col("normalized_name")).alias("normalizedAssetName"),
            blank_to_null(F.col("currency")).alias("currency"),
            blank_to_null(F.col("asset_type")).alias("assetType"),
            blank_to_null(F.col("jurisdiction")).alias("jurisdiction"),
            F.col("latitude"),
            F.col("longitude"),
            F.struct(
                signals["currency_inferred"].alias("currencyInferred"),
                signals["exact_value_match"].alias("exactValueMatch"),
                signals["asset_type_inferred"].alias("assetTypeInferred"),
                signals["jurisdiction_inferred"].alias("jurisdictionInferred"),
                signals["coordinates_inferred"].alias("coordinatesInferred"),
                signals["field_missing"].alias("fieldMissing"),
            ).alias("confidenceSignals"),
        )
    )
    name = F.coalesce(
        blank_to_null(F.col("normalized_name")),
        blank_to_null(_named_slot("asset_name", "asset_name")),
        F.concat(F.lit("asset_"), entity_id()),
    )
    return scored.select(
        *KEY,
        entity_id().alias("record_id"),
        (job_id if job_id is not None else F.lit(None).cast("string")).alias("extraction_job_id"),
        name.alias("raw_asset_name"),
        F.lit("enriched_asset_data").alias("field_name"),
        json_object(F.col("data")).alias("raw_value"),
        stored.alias("normalized_value"),
        F.col("overall_confidence").alias("confidence_score"),
        "overall_confidence",
        F.lit("LLM_EXTRACTION").alias("extraction_method"),
        review_status(F.col("overall_confidence")).alias("review_status"),
        F.lit(True).alias("is_inferred"),
        F.coalesce(blank_to_null(F.col("explanation")), F.col("confidence_text"))
        .alias("inference_explanation"),
    )


def merge_into_stored(stored: DataFrame, enriched: DataFrame) -> DataFrame:
    """New snapshot of the records table with enrichment merged in by document, sheet and row.

    A row that was enriched more than once, as by a repeated batch, is merged once: the last by
    ``enriched_at``, where there is such a column, else the greatest.
    """
    order = ["enriched_at"] if "enriched_at" in enriched.columns else []
    last = F.max(F.struct(*order, *[
        F.col(c) for c in (
            "normalized_value", "confidence_score", "review_status", "inference_explanation")
    ])).alias("_last")
    fresh = enriched.groupBy(
        "document_id", F.nullif("sheet_name", F.lit("")).alias("_sheet"),
        F.col("row_index").alias("_row"),
    ).agg(last).select(
        "document_id", "_sheet", "_row",
        F.col("_last.normalized_value").alias("_value"),
        F.col("_last.confidence_score").alias("_score"),
        F.col("_last.review_status").alias("_review"),
        F.col("_last.inference_explanation").alias("_why"),
    )
    hit = F.col("_value").isNotNull()
    same = (
        (stored["document_id"] == F.col("_document"))
        & (stored["source_row_index"] == F.col("_row"))
        & stored["source_sheet_name"].eqNullSafe(F.col("_sheet"))
    )
    merged = F.when(hit, merged_object(F.col("normalized_value"), F.col("_value")))
    return (
        stored.join(fresh.withColumnsRenamed({"document_id": "_document"}), same, "left")
        .withColumns(
            {
                "normalized_value": F.coalesce(merged, F.col("normalized_value")),
                "confidence_score": F.coalesce("_score", "confidence_score"),
                "overall_confidence": F.coalesce("_score", "overall_confidence"),
                "review_status": F.coalesce("_review", "review_status"),
                "is_inferred": hit | F.col("is_inferred"),
                "inference_explanation": F.coalesce("_why", "inference_explanation"),
            }
        )
        .drop("_document", "_sheet", "_row", "_value", "_score", "_review", "_why")
    )


def batch_summary(
    sent: DataFrame, records: DataFrame, errors: DataFrame, reviews: DataFrame, flags: DataFrame
) -> DataFrame:
    """Counts per document and enrichment batch.

    ``sent`` carries the row key and ``batch_id``; the others carry the row key. Every input is
    reduced to one tagged row per event, so the counts need a single shuffle by row key.
    """
    tags = {"record": records, "error": errors, "review": reviews, "flag": flags}
    events = sent.select(*KEY, "batch_id", F.lit("sent").alias("tag"))
    for tag, frame in tags.items():
        events = events.unionByName(
            frame.select(*KEY, F.lit(None).cast("bigint").alias("batch_id"), F.lit(tag).alias("tag"))
        )
    per_row = events.groupBy(*KEY).agg(
        F.max("batch_id").alias("batch_id"),
        *[F.count_if(F.col("tag") == t).alias(t) for t in ("sent", *tags)],
    )
    return per_row.groupBy("document_id", "batch_id").agg(
        F.sum("sent").alias("processed"),
        F.sum("record").alias("enriched"),
        F.sum("error").alias("failed"),
        F.sum("review").alias("review_items"),
        F.sum("flag").alias("validation_flags"),
    )
