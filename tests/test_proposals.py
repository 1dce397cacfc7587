import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.operators import profiling, proposals
from ledgerloom.plans.extraction import documents_with_schemas, proposed_schemas

# Workers don't see this module; its functions go to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROWS = "document_id string, sheet_name string, row_index bigint, raw map<string,string>"


def table(spark, documents):
    rows = [
        (d, "", i + 2, raw) for d, raws in documents.items() for i, raw in enumerate(raws)
    ]
    return spark.createDataFrame(rows, ROWS)


def proposal(**changes):
    out = {
        "columns": [
            {"name": "latitude", "detectedType": "string", "semanticRole": "value", "confidence": 0.5, "reasoning": "r1"},
            {"name": "unseen", "detectedType": "string", "semanticRole": "unknown", "confidence": 0.1, "reasoning": "r2"},
            {"name": "holder", "detectedType": "string", "semanticRole": "asset_name", "confidence": 0.8, "reasoning": "r3"},
        ],
        "fieldMapping": {"assetNameColumn": {"column": "holder", "confidence": 0.8}, "valueColumn": {"column": "unseen", "confidence": 0.3}},
        "unmappedColumns": [], "inferenceNotes": ["n1", "n2"],
        "schemaQuality": {"completeness": 0.9, "ambiguityScore": 0.1, "deterministicCoverage": 0.5, "needsReview": False},
    }
    return out | changes


def late(columns, rows):
    time.sleep(3)
    return proposal()


def failing(columns, rows):
    raise ConnectionError("no route")


DOCUMENTS = {"a": [{"holder": "x", "latitude": "1.5"}, {"holder": "y", "latitude": "2"}], "b": [{"asset_name": "z", "currency": "EUR"}]}


def answers(spark, provider, limit=1.0):
    rows = table(spark, DOCUMENTS).withColumn("data", F.col("raw"))
    out = proposals.ask_for_schemas(profiling.head_sample(rows), provider, limit).collect()
    return {r["document_id"]: r for r in out}


@pytest.mark.parametrize("provider, error", [
    (late, proposals.TIMED_OUT), (failing, "ConnectionError: no route"), (lambda c, r: "[]", "not a schema"),
    (lambda c, r: "{}", "not a schema"), (lambda c, r: proposal(schemaQuality=None), "not a schema"),
    (lambda c, r: {"columns": object()}, "TypeError: Object of type object is not JSON serializable"),
])
def test_answers_that_are_none(spark, provider, error):
    start = time.time()
    got = answers(spark, provider, 0.4)
    assert {(r["proposal"], r["error"]) for r in got.values()} == {(None, error)} and len(got) == 2
    assert provider is not late or time.time() - start < 30


def test_the_provider_sees_columns_and_rows(spark):
    def provider(columns, rows):
        return proposal(inferenceNotes=[json.dumps([columns, rows])])

    got = {d: json.loads(r["proposal"]["inferenceNotes"][0]) for d, r in answers(spark, provider).items()}
    assert got == {
        "a": [["holder", "latitude"], [{"holder": "x", "latitude": "1.5"}, {"holder": "y", "latitude": "2"}]],
        "b": [["asset_name", "currency"], [{"asset_name": "z", "currency": "EUR"}]],
    }


def test_proposed_quality_slots_and_columns_are_kept(spark):
    documents = spark.createDataFrame([("a",), ("b",), ("empty",)], "document_id string")
    provider = lambda c, r: proposal() if "holder" in c else failing(c, r)
    schema, roles, failed = proposed_schemas(table(spark, DOCUMENTS), documents, provider, 2.0)
    found = {r["document_id"]: r for r in schema.collect()}
    a, b, empty = found["a"], found["b"], found["empty"]
    assert (a["slots"]["asset_name"], a["slots"]["value"], a["slots"]["currency"]) == ("holder", "unseen", None)
    assert [a[c] for c in profiling.QUALITY] == [0.9, 0.1, 0.5, False] and a["passed"]
    assert a["inference_notes"] == ["n1", "n2"] and b["inference_notes"] == [profiling.RULES_NOTE]
    # Slots that the proposal leaves open are filled from roles; the profile knows a coordinate.
    assert a["filled"]["latitude"] == "latitude" and a["slots"]["latitude"] is None
    assert b["slots"]["asset_name"] == "asset_name" and b["completeness"] == 0.25
    assert [empty[c] for c in profiling.QUALITY] == [0.0, 0.0, 0.0, True] and empty["inference_notes"] == []
    of_a = sorted((r for r in roles.collect() if r["document_id"] == "a"), key=lambda r: r["column_pos"])
    assert [(r["column"], r["role"], r["confidence"]) for r in of_a] == [
        ("latitude", "latitude", 1.0), ("unseen", "unknown", 0.1), ("holder", "asset_name", 0.8)]
    assert [tuple(r) for r in failed.collect()] == [("b", "ConnectionError: no route")]


def test_documents_get_the_whole_schema(spark):
    documents = spark.createDataFrame([("a",), ("empty",)], "document_id string")
    for provider, notes in ((None, [profiling.RULES_NOTE]), (lambda c, r: proposal(), ["n1", "n2"])):
        out = documents_with_schemas(documents, table(spark, {"a": DOCUMENTS["a"]}), provider, 2.0)
        got = {r["document_id"]: json.loads(r["inferred_schema"]) for r in out.collect()}
        assert got["a"]["inference_notes"] == notes and got["empty"]["columns"] == []
        names = [c["name"] for c in got["a"]["columns"]]
        assert names == (["latitude", "unseen", "holder"] if provider else ["holder", "latitude"])
        assert got["empty"]["needs_review"] and got["empty"]["unmapped_columns"] == []
        if provider:
            assert [c["name"] for c in got["a"]["unmapped_columns"]] == ["unseen"]


def test_head_sample_of_a_huge_document_ranks_keys(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 25_000, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("document_id"),
        F.lit("").alias("sheet_name"), (F.lit(40_000) - F.col("id")).alias("row_index"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("raw"))
    sample = profiling.head_sample(rows, 5)
    got = {}
    for r in sample.collect():
        got.setdefault(r["document_id"], []).append((r["sample_pos"], r["row_index"], r["raw"]["k"]))
    assert len(got) == 41
    assert sorted(got["hot"]) == [(n, 15_000 + n, str(25_000 - n)) for n in range(1, 6)]
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the ranks were found on keys alone
