import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import vocab
from ledgerloom.operators import enrichment, scoring

ANSWER = (
    "document_id string, sheet_name string, row_index bigint, data map<string,string>, "
    f"slots struct<{', '.join(f'{s}:string' for s in vocab.SLOTS)}>, normalized_name string, "
    "currency string, asset_type string, jurisdiction string, latitude double, longitude double, "
    "signals struct<currency_inferred:boolean, exact_value_match:boolean, "
    "asset_type_inferred:boolean, jurisdiction_inferred:boolean, coordinates_inferred:boolean, "
    "field_missing:boolean>, explanation string, needs_review boolean"
)
SIGNALS = dict.fromkeys(
    ["currency_inferred", "exact_value_match", "asset_type_inferred", "jurisdiction_inferred",
     "coordinates_inferred", "field_missing"]
)


def answers(spark, *given, slots=("asset_name", "currency", "jurisdiction")):
    rows = []
    for i, values in enumerate(given):
        signals = {**SIGNALS, **values.get("signals", {})}
        rows.append(
            (
                "d", "", i, {"asset_name": "Mill"}, {s: (s if s in slots else None) for s in vocab.SLOTS},
                values.get("name", "Mill"), values.get("currency", "USD"), "plant",
                values.get("jurisdiction", "FRANCE"), values.get("lat"), values.get("lng"), signals,
                values.get("explanation", "why"), values.get("review", False),
            )
        )
    frame = spark.createDataFrame(rows, ANSWER)
    return scoring.score_answers(scoring.validate_answers(frame))


def test_critical_and_medium_issue(spark):
    row = answers(spark, {"lat": 95.5, "currency": "XYZ"}).first()
    assert [i["code"] for i in row["issues"]] == ["LATITUDE_OUT_OF_RANGE", "UNKNOWN_CURRENCY"]
    assert row["issues"][0]["message"] == "Latitude 95.5 is out of range (-90 to 90)"
    assert row["valid"] is False
    assert row["penalty"] == pytest.approx(-0.6)
    scored = answers(spark, {"lat": 95.5, "currency": "XYZ"})
    review = scoring.review_items(scored).first()
    assert review["priority"] == 3
    assert review["review_reason"] == (
        "Low confidence score: 20%; Validation issues: latitude; "
        "Multiple validation issues: 2 total; Invalid coordinates detected; "
        "Invalid or unknown currency; Deterministic validation failed"
    )
    flag = scoring.validation_flags(scored).first()
    assert (flag["flag_type"], flag["severity"]) == ("LATITUDE_OUT_OF_RANGE", "critical")


@pytest.mark.parametrize(
    "given, codes",
    [
        ({"currency": "US"}, ["INVALID_CURRENCY_FORMAT"]),
        ({"currency": ""}, ["INVALID_CURRENCY_FORMAT"]),
        ({"currency": None}, []),
        ({"lat": float("nan")}, ["INVALID_LATITUDE"]),
        ({"lng": float("inf")}, ["INVALID_LONGITUDE"]),
        ({"lat": 1.1234567}, ["EXCESSIVE_COORDINATE_PRECISION"]),
        ({"name": "  "}, ["EMPTY_ASSET_NAME"]),
        ({"name": None}, []),
        ({"lat": 90.0, "lng": -180.0}, []),
    ],
)
def test_issue_codes(spark, given, codes):
    assert [i["code"] for i in answers(spark, given).first()["issues"]] == codes


def test_penalty_has_a_floor(spark):
    worst = {"lat": 91.0, "lng": 181.0, "currency": "x", "name": ""}
    assert answers(spark, worst).first()["penalty"] == -1.0


def test_full_answer(spark):
    row = answers(spark, {"signals": {"exact_value_match": True}}).first()
    assert row["overall_confidence"] == pytest.approx(1.0)
    assert row["confidence_text"] == (
        "Overall confidence: 100%. Positive signals: 3/3 fields mapped via exact column match; "
        "Values matched exactly without inference. "
    )
    assert row["field_confidence"]["assetName"] == 0.9
    assert row["field_confidence"]["coordinates"] == 0.3


def test_inferred_missing_and_review(spark):
    row = answers(
        spark,
        {"jurisdiction": None, "review": True,
         "signals": {"currency_inferred": True, "jurisdiction_inferred": False}},
    ).first()
    assert [f["factor"] for f in row["factors"]] == [
        "partial_column_mapping", "llm_inference_required", "missing_fields",
        "review_escalation_triggered",
    ]
    assert row["overall_confidence"] == 0.0
    assert row["field_confidence"]["currency"] == 0.7
    assert row["field_confidence"]["jurisdiction"] == 0.3


def test_zero_coordinate_counts_as_absent_field_but_not_as_missing_slot(spark):
    row = answers(
        spark, {"lat": 0.0, "lng": 5.0}, slots=("latitude", "longitude")
    ).first()
    assert row["field_confidence"]["coordinates"] == 0.3
    assert row["factors"][0]["factor"] == "exact_column_mapping"


def test_scores_stay_between_zero_and_one(spark):
    cases = [
        {"lat": lat, "currency": c, "review": r, "signals": {"exact_value_match": e}}
        for lat in (None, 5.0, 99.0) for c in (None, "USD", "ZZZ", "Z")
        for r in (True, False) for e in (True, False)
    ]
    scores = [r["overall_confidence"] for r in answers(spark, *cases).collect()]
    assert len(scores) == 48 and all(0 <= s <= 1 for s in scores)


def test_record_is_sparse_json(spark):
    scored = answers(spark, {"name": "", "currency": None, "explanation": ""})
    record = enrichment.enriched_records(scored).first()
    stored = json.loads(record["normalized_value"])
    assert stored == {"assetType": "plant", "jurisdiction": "FRANCE", "confidenceSignals": {}}
    assert record["raw_asset_name"] == "Mill"
    assert record["inference_explanation"].startswith("Overall confidence: ")


def test_provider_that_returns_no_list(spark):
    rows = spark.range(120).select(
        F.lit("d").alias("document_id"), F.lit("").alias("sheet_name"),
        F.col("id").alias("row_index"), F.create_map(F.lit("a"), F.lit("b")).alias("data"),
        F.struct(*[F.lit(None).cast("string").alias(s) for s in vocab.SLOTS]).alias("slots"),
    )
    results = enrichment.ask_provider(rows, lambda batch: {"no": "list"}, batch_size=5000)
    assert results.select("batch_id").distinct().count() == 2  # a call takes at most 100 rows
    assert {r["error"] for r in results.collect()} == {"Invalid response format from LLM"}
    answered = enrichment.provider_answers(rows, results)
    assert answered.count() == 120
    assert answered.filter("needs_review AND signals.field_missing").count() == 120
