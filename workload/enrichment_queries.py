"""Enrichment answers, checks, scores, flags, reviews and records over the register."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import enrichment, scoring
from ledgerloom.operators.routing import with_batches
from ledgerloom.plans.extraction import (
    enrich,
    enrich_by_provider,
    scored_answers,
    settled_and_ambiguous,
)
from ledgerloom.session import shared_folder, write_through
from ledgerloom.sources.records import (
    merge_enrichment,
    row_records,
    write_enrichment,
    write_rows,
)
from ledgerloom.sources.tables import read_table

from .registry import query
from .views import CODES, ROUTED_SQL, SHORT_CODES, register_rows, table

KEY = ["document_id", "row_index"]
# Currency of a country.
LOOKUP = """CASE upper(country)
  WHEN 'ALGERIA' THEN 'DZD' WHEN 'BRAZIL' THEN 'BRL' WHEN 'CANADA' THEN 'CAD' WHEN 'CHINA' THEN 'CNY'
  WHEN 'FRANCE' THEN 'EUR' WHEN 'GERMANY' THEN 'EUR' WHEN 'INDIA' THEN 'INR' WHEN 'INDONESIA' THEN 'IDR'
  WHEN 'JAPAN' THEN 'JPY' WHEN 'RUSSIA' THEN 'RUB' WHEN 'SAUDI ARABIA' THEN 'SAR'
  WHEN 'UNITED KINGDOM' THEN 'GBP' WHEN 'UNITED STATES' THEN 'USD' WHEN 'US' THEN 'USD'
  WHEN 'VIETNAM' THEN 'VND' END"""
ANSWERS_SQL = f"""
SELECT document_id, row_index, asks, name, country AS place,
  CASE WHEN asks THEN name ELSE coalesce(name, '') END AS normalized_name,
  CASE WHEN asks THEN coalesce(code, looked_up) WHEN upper(currency) IN ({SHORT_CODES}) THEN upper(currency) END AS currency,
  CASE WHEN asks THEN nullif(type, '') END AS asset_type,
  CASE WHEN asks THEN nullif(country, '') END AS jurisdiction,
  CASE WHEN asks THEN lat END AS latitude, CASE WHEN asks THEN lng END AS longitude,
  CASE WHEN asks THEN code IS NULL AND looked_up IS NOT NULL END AS currency_inferred,
  CASE WHEN asks THEN code IS NOT NULL ELSE TRUE END AS exact_value_match,
  asks AND (coalesce(code, looked_up) IS NULL OR coalesce(type, '') = '' OR coalesce(country, '') = '') AS field_missing,
  CASE WHEN NOT asks THEN 'Direct extraction - no LLM inference required'
       WHEN code IS NULL AND looked_up IS NOT NULL THEN concat('Currency inferred from ', country, ' jurisdiction.')
       WHEN code IS NOT NULL THEN 'Currency taken from the row.' ELSE 'Currency could not be inferred.' END AS explanation,
  asks AND (coalesce(code, looked_up) IS NULL OR coalesce(abs(lat) > 90, FALSE) OR coalesce(abs(lng) > 180, FALSE)) AS needs_review
FROM (SELECT *, {LOOKUP} AS looked_up,
        coalesce(currency, '') = '' OR coalesce(lat, 0) = 0 OR coalesce(lng, 0) = 0 AS asks
      FROM ({ROUTED_SQL}) r WHERE ambiguous) a
"""
NUMBER = r"regexp_replace({}::VARCHAR, '\.0$', '')"
CHECKED_SQL = f"""
SELECT *,
  CASE WHEN abs(latitude) > 90 THEN concat('latitude: Latitude ', {NUMBER.format('latitude')}, ' is out of range (-90 to 90)') END AS lat_issue,
  CASE WHEN abs(longitude) > 180 THEN concat('longitude: Longitude ', {NUMBER.format('longitude')}, ' is out of range (-180 to 180)') END AS lng_issue,
  CASE WHEN currency IS NOT NULL AND upper(currency) NOT IN ({CODES}) THEN concat('currency: Currency ', upper(currency), ' is not in the standard currency list') END AS currency_issue,
  CASE WHEN trim(normalized_name) = '' THEN 'normalizedAssetName: Asset name cannot be empty' END AS name_issue
FROM ({ANSWERS_SQL}) a
"""
VALID_SQL = f"""
SELECT *, (lat_issue IS NOT NULL)::INT + (lng_issue IS NOT NULL)::INT + (currency_issue IS NOT NULL)::INT + (name_issue IS NOT NULL)::INT AS issue_count,
  concat_ws('; ', lat_issue, lng_issue, currency_issue, name_issue) AS issue_text,
  lat_issue IS NULL AND lng_issue IS NULL AND name_issue IS NULL AS valid,
  greatest(-1, 0.0::DOUBLE - CASE WHEN lat_issue IS NULL THEN 0 ELSE 0.4 END::DOUBLE - CASE WHEN lng_issue IS NULL THEN 0 ELSE 0.4 END::DOUBLE
    - CASE WHEN currency_issue IS NULL THEN 0 ELSE 0.2 END::DOUBLE - CASE WHEN name_issue IS NULL THEN 0 ELSE 0.3 END::DOUBLE)::DOUBLE AS penalty
FROM ({CHECKED_SQL}) c
"""
# Only the name and jurisdiction slots are mapped by keywords.
FACTORS_SQL = f"""
SELECT *, filled / 2.0 AS mapped,
  normalized_name IS NULL OR jurisdiction IS NULL OR field_missing AS missing
FROM (SELECT *, coalesce(normalized_name <> '', FALSE)::INT + (jurisdiction IS NOT NULL)::INT AS filled FROM ({VALID_SQL}) v) f
"""
SCORED_SQL = f"""
SELECT *, greatest(0, least(1, 0.5::DOUBLE + CASE WHEN mapped >= 0.8 THEN 0.3 WHEN mapped >= 0.5 THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN exact_value_match THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN missing THEN 0.3 ELSE 0 END::DOUBLE
    + penalty - CASE WHEN needs_review THEN 0.3 ELSE 0 END::DOUBLE))::DOUBLE AS score
FROM ({FACTORS_SQL}) f
"""
ENTITY = "sha256(concat_ws('|', document_id, '', row_index::VARCHAR))"


def ambiguous_rows(spark, folder):
    return settled_and_ambiguous(register_rows(spark, folder)).filter(F.col("route") == "ambiguous")


def scored(spark, folder):
    return scored_answers(ambiguous_rows(spark, folder))


@query(
    "rule_answers",
    f"""SELECT document_id, row_index, normalized_name, currency, asset_type, jurisdiction, latitude, longitude,
        currency_inferred, exact_value_match, field_missing, explanation, needs_review FROM ({ANSWERS_SQL}) a""",
)
def rule_answers(spark, folder):
    return scored(spark, folder).select(
        *KEY, "normalized_name", "currency", "asset_type", "jurisdiction", "latitude", "longitude",
        "signals.currency_inferred", "signals.exact_value_match", "signals.field_missing",
        "explanation", "needs_review",
    )


@query(
    "answer_checks",
    f"""SELECT document_id, row_index, issue_text AS issues, valid, round(penalty, 6) AS penalty FROM ({VALID_SQL}) v""",
)
def answer_checks(spark, folder):
    text = F.transform("issues", lambda i: F.concat_ws(": ", i["field"], i["message"]))
    return scored(spark, folder).select(
        *KEY, F.array_join(text, "; ").alias("issues"), "valid", "penalty"
    )


FACTOR_TEXT = """concat_ws(',',
  CASE WHEN mapped >= 0.8 THEN 'exact_column_mapping' WHEN mapped >= 0.5 THEN 'partial_column_mapping' END,
  CASE WHEN exact_value_match THEN 'deterministic_parse' END, CASE WHEN missing THEN 'missing_fields' END,
  CASE WHEN penalty <> 0 THEN 'validation_issue' END, CASE WHEN needs_review THEN 'review_escalation_triggered' END)"""


@query(
    "answer_scores",
    f"""SELECT document_id, row_index, {FACTOR_TEXT} AS factors, round(score, 6) AS overall_confidence,
        CASE WHEN normalized_name <> '' THEN 0.9 ELSE 0.3 END::DOUBLE AS name_score,
        CASE WHEN currency IS NULL THEN 0.3 WHEN currency_inferred THEN 0.7 ELSE 0.9 END::DOUBLE AS currency_score,
        CASE WHEN coalesce(asset_type, '') = '' THEN 0.3 ELSE 0.9 END::DOUBLE AS type_score,
        CASE WHEN coalesce(jurisdiction, '') = '' THEN 0.3 ELSE 0.9 END::DOUBLE AS jurisdiction_score,
        CASE WHEN latitude <> 0 AND longitude <> 0 THEN 0.9 ELSE 0.3 END::DOUBLE AS place_score,
        CASE WHEN score < 0.65 THEN 'requires_review' ELSE 'auto_approved' END AS review_status
        FROM ({SCORED_SQL}) s""",
)
def answer_scores(spark, folder):
    part = lambda n: F.col("field_confidence")[n]
    return scored(spark, folder).select(
        *KEY,
        F.array_join(F.transform("factors", lambda f: f["factor"]), ",").alias("factors"),
        "overall_confidence",
        part("assetName").alias("name_score"),
        part("currency").alias("currency_score"),
        part("assetType").alias("type_score"),
        part("jurisdiction").alias("jurisdiction_score"),
        part("coordinates").alias("place_score"),
        scoring.review_status(F.col("overall_confidence")).alias("review_status"),
    )


@query(
    "confidence_texts",
    f"""SELECT document_id, row_index, concat('Overall confidence: ', round(score * 100)::INT::VARCHAR, '%. ',
          CASE WHEN plus <> '' THEN concat('Positive signals: ', plus, '. ') ELSE '' END,
          CASE WHEN minus <> '' THEN concat('Negative signals: ', minus, '.') ELSE '' END) AS confidence_text
        FROM (SELECT *, concat_ws('; ', CASE WHEN mapped >= 0.8 THEN concat(filled::VARCHAR, '/2 fields mapped via exact column match')
              WHEN mapped >= 0.5 THEN concat(filled::VARCHAR, '/2 fields mapped via column match') END,
              CASE WHEN exact_value_match THEN 'Values matched exactly without inference' END) AS plus,
            concat_ws('; ', CASE WHEN missing THEN 'Expected fields are missing or could not be inferred' END,
              CASE WHEN penalty <> 0 THEN concat('Validation issues detected: ', issue_count::VARCHAR, ' issues') END,
              CASE WHEN needs_review THEN 'LLM marked this row for human review' END) AS minus
          FROM ({SCORED_SQL}) s) t""",
)
def confidence_texts(spark, folder):
    return scored(spark, folder).select(*KEY, "confidence_text")


REVIEWS_SQL = f"""
SELECT document_id, row_index, {ENTITY} AS entity_id, concat_ws('; ',
    CASE WHEN score < 0.65 THEN concat('Low confidence score: ', round(score * 100)::INT::VARCHAR, '%') END,
    CASE WHEN NOT valid THEN concat('Validation issues: ', concat_ws(', ', CASE WHEN lat_issue IS NOT NULL THEN 'latitude' END,
      CASE WHEN lng_issue IS NOT NULL THEN 'longitude' END, CASE WHEN name_issue IS NOT NULL THEN 'normalizedAssetName' END)) END,
    CASE WHEN issue_count >= 2 THEN concat('Multiple validation issues: ', issue_count::VARCHAR, ' total') END,
    CASE WHEN lat_issue IS NOT NULL OR lng_issue IS NOT NULL THEN 'Invalid coordinates detected' END,
    CASE WHEN currency_issue IS NOT NULL THEN 'Invalid or unknown currency' END,
    CASE WHEN NOT valid THEN 'Deterministic validation failed' END) AS review_reason,
  CASE WHEN NOT valid THEN 3 WHEN score < 0.65 OR issue_count >= 2 THEN 2 ELSE 1 END::BIGINT AS priority, 'pending' AS status
FROM ({SCORED_SQL}) s WHERE score < 0.65 OR issue_count > 0
"""
FLAGS_SQL = f"""
SELECT document_id, row_index, {ENTITY} AS entity_id,
  CASE WHEN lat_issue IS NOT NULL THEN 'LATITUDE_OUT_OF_RANGE' WHEN lng_issue IS NOT NULL THEN 'LONGITUDE_OUT_OF_RANGE'
       WHEN name_issue IS NOT NULL THEN 'EMPTY_ASSET_NAME' ELSE 'UNKNOWN_CURRENCY' END AS flag_type,
  CASE WHEN lat_issue IS NOT NULL OR lng_issue IS NOT NULL THEN 'critical' WHEN name_issue IS NOT NULL THEN 'high' ELSE 'medium' END AS severity,
  issue_text AS explanation
FROM ({VALID_SQL}) v WHERE issue_count > 0
"""


@query("review_items", REVIEWS_SQL)
def review_items(spark, folder):
    return enrich(ambiguous_rows(spark, folder)).reviews.drop("sheet_name", "entity_type")


@query("validation_flags", FLAGS_SQL)
def validation_flags(spark, folder):
    return enrich(ambiguous_rows(spark, folder)).flags.drop("sheet_name", "entity_type")


@query(
    "enriched_records",
    f"""SELECT document_id, row_index, {ENTITY} AS record_id,
        coalesce(nullif(normalized_name, ''), nullif(name, ''), concat('asset_', {ENTITY})) AS raw_asset_name,
        'enriched_asset_data' AS field_name, concat('job-', document_id) AS extraction_job_id,
        nullif(normalized_name, '') AS stored_name, nullif(currency, '') AS stored_currency,
        nullif(asset_type, '') AS stored_type, nullif(jurisdiction, '') AS stored_jurisdiction,
        {NUMBER.format('latitude')} AS stored_latitude, {NUMBER.format('longitude')} AS stored_longitude,
        exact_value_match::VARCHAR AS exact, currency_inferred::VARCHAR AS inferred, field_missing::VARCHAR AS missing_field,
        round(score, 6) AS confidence_score, CASE WHEN score < 0.65 THEN 'requires_review' ELSE 'auto_approved' END AS review_status,
        TRUE AS is_inferred, explanation AS inference_explanation FROM ({SCORED_SQL}) s""",
)
def enriched_records(spark, folder):
    stored = lambda path: F.get_json_object("normalized_value", path)
    plain = lambda path: F.regexp_replace(stored(path), r"\.0$", "")
    job = F.concat(F.lit("job-"), F.col("document_id"))
    return enrich(ambiguous_rows(spark, folder), job_id=job).records.select(
        *KEY, "record_id", "raw_asset_name", "field_name", "extraction_job_id",
        stored("$.normalizedAssetName").alias("stored_name"),
        stored("$.currency").alias("stored_currency"), stored("$.assetType").alias("stored_type"),
        stored("$.jurisdiction").alias("stored_jurisdiction"),
        plain("$.latitude").alias("stored_latitude"), plain("$.longitude").alias("stored_longitude"),
        stored("$.confidenceSignals.exactValueMatch").alias("exact"),
        stored("$.confidenceSignals.currencyInferred").alias("inferred"),
        stored("$.confidenceSignals.fieldMissing").alias("missing_field"),
        "confidence_score", "review_status", "is_inferred", "inference_explanation",
    )


@query(
    "enrichment_stage",
    f"""SELECT r.document_id, count(*) AS records,
          (SELECT count(*) FROM ({FLAGS_SQL}) f WHERE f.document_id = r.document_id) AS flags,
          (SELECT count(*) FROM ({REVIEWS_SQL}) v WHERE v.document_id = r.document_id) AS reviews,
          'LLM provider not configured' AS error_without_provider
        FROM ({SCORED_SQL}) r GROUP BY r.document_id""",
)
def enrichment_stage(spark, folder):
    """The stage with the rule provider, and the error it reports without one."""
    rows = ambiguous_rows(spark, folder)
    result, nothing = enrich(rows), enrich(rows, answer=None)
    tally = result.records.groupBy("document_id").agg(F.count("*").alias("records"))
    for name, frame in (("flags", result.flags), ("reviews", result.reviews)):
        counts = frame.groupBy("document_id").agg(F.count("*").alias(name))
        tally = tally.join(counts, "document_id", "left").fillna(0, [name])
    error = nothing.errors.select("document_id", F.col("error").alias("error_without_provider"))
    return tally.join(error, "document_id")


@query(
    "written_enrichment",
    f"""SELECT 'records' AS kind, CASE WHEN score < 0.65 THEN 'requires_review' ELSE 'auto_approved' END AS label, count(*) AS n FROM ({SCORED_SQL}) GROUP BY ALL
        UNION ALL SELECT 'flags', severity, count(*) FROM ({FLAGS_SQL}) GROUP BY ALL
        UNION ALL SELECT 'reviews', concat(priority::VARCHAR, ' pending 2024-05-01'), count(*) FROM ({REVIEWS_SQL}) GROUP BY ALL""",
)
def written_enrichment(spark, folder):
    """Three tables written by the sink and read back."""
    root = shared_folder(spark, "enrichment")
    when = F.to_timestamp(F.lit("2024-05-01 12:00:00"))
    write_enrichment(enrich(ambiguous_rows(spark, folder)), root, when)
    review = F.concat_ws(
        " ", F.col("priority").cast("string"), "status", F.to_date("created_at").cast("string")
    )
    parts = [
        ("records", "extracted_asset_fields", F.col("review_status"), "record_id"),
        ("flags", "validation_flags", F.col("severity"), F.lit(1)),
        ("reviews", "review_queue", review, "review_id"),
    ]
    frames = [
        read_table(spark, root, name)
        .groupBy(F.lit(kind).alias("kind"), label.alias("label"))
        .agg(F.count(counted).alias("n"))
        for kind, name, label, counted in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "merged_records",
    f"""SELECT t.document_id, t.row_index, t.name AS old_name,
        CASE WHEN t.ambiguous THEN coalesce(s.currency, t.currency) ELSE t.currency END AS new_currency,
        round(CASE WHEN t.ambiguous THEN s.score ELSE 0.5 + CASE WHEN t.matched THEN 0.3 ELSE 0 END + CASE WHEN t.complete THEN 0.2 ELSE -0.2 END END::DOUBLE, 6) AS confidence_score,
        t.ambiguous AS is_inferred
        FROM ({ROUTED_SQL}) t LEFT JOIN ({SCORED_SQL}) s ON t.document_id = s.document_id AND t.row_index = s.row_index""",
)
def merged_records(spark, folder):
    """Enriched values merged into the stored rows of the same document and row."""
    routed = settled_and_ambiguous(register_rows(spark, folder))
    fresh = enrichment.enriched_records(
        scored_answers(routed.filter(F.col("route") == "ambiguous"))
    )
    root = shared_folder(spark, "stored")
    write_rows(row_records(routed), root, "extracted_asset_fields")
    merged = enrichment.merge_into_stored(
        read_table(spark, root, "extracted_asset_fields"), fresh
    )
    return merged.select(
        "document_id", F.col("source_row_index").alias("row_index"), F.get_json_object("normalized_value", "$.currency").alias("new_currency"),
        F.get_json_object("normalized_value", "$.asset_name").alias("old_name"),
        "confidence_score", "is_inferred",
    )


@query(
    "repeated_enrichment",
    f"""SELECT t.document_id, t.row_index,
        CASE WHEN t.ambiguous THEN coalesce(s.currency, t.currency) ELSE t.currency END AS currency,
        round(CASE WHEN t.ambiguous THEN s.score ELSE 0.5 + CASE WHEN t.matched THEN 0.3 ELSE 0 END + CASE WHEN t.complete THEN 0.2 ELSE -0.2 END END::DOUBLE, 2) AS confidence_score,
        t.ambiguous AS is_inferred, 1 AS copies
        FROM ({ROUTED_SQL}) t LEFT JOIN ({SCORED_SQL}) s ON t.document_id = s.document_id AND t.row_index = s.row_index""",
)
def repeated_enrichment(spark, folder):
    """Rows enriched three times, the last time rightly, and merged twice: one stored row each."""
    routed = write_through(settled_and_ambiguous(register_rows(spark, folder)), "routed")
    fresh = write_through(enrichment.enriched_records(
        scored_answers(routed.filter(F.col("route") == "ambiguous"))), "enriched")
    wrong = fresh.withColumns(
        {"confidence_score": F.lit(0.01), "normalized_value": F.lit('{"currency":"XXX"}')})
    first, second, last = (
        frame.withColumn("enriched_at", F.lit(at)) for frame, at in ((wrong, 1), (wrong, 2), (fresh, 3)))
    every = last.unionByName(first).unionByName(second)
    root = shared_folder(spark, "stored")
    write_rows(row_records(routed), root, "extracted_asset_fields", batch_id="b1")
    merge_enrichment(spark, root, every)
    merge_enrichment(spark, root, every)
    same = F.count("*").over(W.partitionBy("document_id", "source_row_index"))
    return read_table(spark, root, "extracted_asset_fields").select(
        "document_id", F.col("source_row_index").alias("row_index"),
        F.get_json_object("normalized_value", "$.currency").alias("currency"), "confidence_score",
        "is_inferred", same.alias("copies"))


@query(
    "committed_batches",
    f"""SELECT 'record' AS kind, {ENTITY} AS entity_id, CASE WHEN score < 0.65 THEN 'requires_review' ELSE 'auto_approved' END AS label FROM ({SCORED_SQL}) s WHERE row_index % 3 <> 2
        UNION ALL SELECT 'flag', entity_id, severity FROM ({FLAGS_SQL}) f WHERE row_index % 3 <> 2
        UNION ALL SELECT 'review', entity_id, review_reason FROM ({REVIEWS_SQL}) v WHERE row_index % 3 <> 2""",
)
def committed_batches(spark, folder):
    """A good, a repeated and a failed batch over three tables: the failed one leaves nothing."""
    root = shared_folder(spark, "batches")
    rows = write_through(ambiguous_rows(spark, folder), "ambiguous")

    def batch(n):
        return enrich(rows.filter(F.col("row_index") % 3 == n))

    good, repeated, failed = batch(0), batch(1), batch(2)
    write_enrichment(good, root, batch_id="good")
    # The first attempt stored other values, and more of them, before its reply was lost.
    lost = replace(repeated, records=repeated.records.withColumn("review_status", F.lit("lost")).union(
        failed.records), reviews=failed.reviews)
    for result in (lost, repeated):
        write_enrichment(result, root, batch_id="repeated")
    broken = F.when(F.col("review_reason").isNotNull(), F.raise_error(F.lit("disk full")))
    try:
        write_enrichment(
            replace(failed, reviews=failed.reviews.withColumn("review_reason", broken.cast("string"))),
            root, batch_id="failed")
    except Exception as error:
        if "disk full" not in str(error):
            raise
    parts = [
        ("record", "extracted_asset_fields", "record_id", "review_status"),
        ("flag", "validation_flags", "entity_id", "severity"),
        ("review", "review_queue", "entity_id", "review_reason"),
    ]
    frames = [
        read_table(spark, root, name).select(
            F.lit(kind).alias("kind"), F.col(key).alias("entity_id"), F.col(label).alias("label"))
        for kind, name, key, label in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "checked_responses",
    """SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS ok,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS currency FROM events""",
)
def checked_responses(spark, folder):
    """Provider replies, some without a required key and some that are not JSON."""
    key = F.col("event_id")
    reply = F.to_json(
        F.struct(
            F.col("event_type").alias("currency"),
            F.when(key % 5 != 0, F.struct(F.lit(True).alias("exactValueMatch")))
            .alias("confidenceSignals"),
            F.when(key % 7 != 0, "because").alias("explanation"),
            F.lit(False).alias("needsReview"),
        )
    )
    text = F.when(key % 11 == 0, "no answer").otherwise(reply)
    checked = table(spark, folder, "events").select(
        "event_id", enrichment.checked_response(text).alias("r")
    )
    return checked.select("event_id", "r.ok", "r.answer.currency")


def sample_provider(batch):
    """Stand-in for a model: refuses some batches, skips some rows, answers the others."""
    if int(batch["row_index"].min()) % 7 == 0:
        raise RuntimeError("busy")
    replies = []
    for number, text in zip(batch["row_index"], batch["row"]):
        row = json.loads(text)
        answer = {
            "normalizedAssetName": row.get("asset_name"), "currency": "USD",
            "assetType": row.get("asset_type"), "jurisdiction": row.get("jurisdiction"),
            "confidenceSignals": {"currencyInferred": True}, "explanation": "assumed",
            "needsReview": False,
        }
        replies.append(None if number % 10 == 3 else json.dumps(answer))
    return replies


BATCHES_SQL = f"""
SELECT *, min(row_index) OVER (PARTITION BY document_id, batch_id) % 7 = 0 AS refused FROM (
  SELECT *, ((row_number() OVER (PARTITION BY document_id ORDER BY row_index) - 1) // 50) AS batch_id
  FROM ({ROUTED_SQL}) r WHERE ambiguous) b
"""


@query(
    "provider_batches",
    f"""SELECT document_id, row_index, batch_id, NOT refused AS answered,
        CASE WHEN refused THEN 'Batch enrichment failed: LLM batch enrichment failed: busy'
             WHEN row_index % 10 = 3 THEN 'No enrichment result returned' END AS error,
        NOT refused AND row_index % 10 <> 3 AS replied FROM ({BATCHES_SQL}) b""",
)
def provider_batches(spark, folder):
    results = enrichment.ask_provider(ambiguous_rows(spark, folder), sample_provider)
    return results.select(
        "document_id", "row_index", "batch_id", "answered", "error",
        F.col("response").isNotNull().alias("replied"),
    )


@query(
    "provider_answers",
    f"""SELECT document_id, row_index, CASE WHEN row_index % 10 <> 3 THEN 'USD' END AS currency,
        CASE WHEN row_index % 10 <> 3 THEN name END AS normalized_name,
        row_index % 10 = 3 AS needs_review,
        CASE WHEN row_index % 10 = 3 THEN 'Enrichment failed - using raw values' ELSE 'assumed' END AS explanation
        FROM ({BATCHES_SQL}) b WHERE NOT refused""",
)
def provider_answers(spark, folder):
    rows = ambiguous_rows(spark, folder)
    answers = enrichment.provider_answers(rows, enrichment.ask_provider(rows, sample_provider))
    return answers.select(*KEY, "currency", "normalized_name", "needs_review", "explanation")


ASKED_SQL = f"""
SELECT *, min(row_index) OVER (PARTITION BY document_id, batch_id) % 7 = 0 AS refused FROM (
  SELECT *, ((row_number() OVER (PARTITION BY document_id ORDER BY row_index) - 1) // 50) AS batch_id
  FROM ({ANSWERS_SQL}) r WHERE asks) b
"""


@query(
    "provider_stage",
    f"""SELECT d.document_id, d.direct + coalesce(a.answered, 0) AS records, coalesce(a.errors, 0) AS errors
        FROM (SELECT document_id, count(*) FILTER (NOT asks) AS direct FROM ({ANSWERS_SQL}) GROUP BY document_id) d
        LEFT JOIN (SELECT document_id, count(*) FILTER (NOT refused) AS answered,
                     count(*) FILTER (refused OR row_index % 10 = 3) AS errors FROM ({ASKED_SQL}) GROUP BY document_id) a
          ON d.document_id = a.document_id""",
)
def provider_stage(spark, folder):
    """The stage with an outside provider: direct rows, answered rows, and an error per lost row."""
    result = enrich_by_provider(ambiguous_rows(spark, folder), sample_provider)
    records = result.records.groupBy("document_id").agg(F.count("*").alias("records"))
    errors = result.errors.groupBy("document_id").agg(F.count("*").alias("errors"))
    return records.join(errors, "document_id", "left").fillna(0, ["errors"])


@query(
    "batch_summary",
    f"""SELECT b.document_id, b.batch_id, count(*) AS processed, count(*) AS enriched,
        count(*) FILTER (b.row_index % 10 = 3) AS failed,
        count(v.row_index) AS review_items, count(f.row_index) AS validation_flags
        FROM ({BATCHES_SQL}) b LEFT JOIN ({REVIEWS_SQL}) v ON b.document_id = v.document_id AND b.row_index = v.row_index
        LEFT JOIN ({FLAGS_SQL}) f ON b.document_id = f.document_id AND b.row_index = f.row_index
        GROUP BY b.document_id, b.batch_id""",
)
def batch_summary(spark, folder):
    sent = with_batches(ambiguous_rows(spark, folder))
    result = enrich(sent.drop("batch_id"))
    errors = sent.filter(F.col("row_index") % 10 == 3)
    summary = enrichment.batch_summary(
        sent, result.records, errors, result.reviews, result.flags
    )
    return summary
