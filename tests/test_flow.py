"""The whole flow over files: scan, schemas, routing, records, enrichment, second load."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import spread
from ledgerloom.operators.relations import not_yet_stored
from ledgerloom.operators.routing import route_counts
from ledgerloom.plans.extraction import enrich, settled_and_ambiguous
from ledgerloom.sources.csv import valid_csv_rows
from ledgerloom.sources.records import append_batch, row_records, write_enrichment
from ledgerloom.sources.tables import read_table


@pytest.fixture
def uploads(tmp_path):
    """A large and a small document with different headers."""
    folder = tmp_path / "uploads"
    folder.mkdir()
    lines = ["Asset Name,Value,Currency,Country,Type,Lat,Lng"]
    for i in range(600):
        currency = ["USD", " eur", "XYZ", ""][i % 4]
        lines.append(
            f'"Plant {i}, north","$1,{i % 900 + 100}.5",{currency},FRANCE,solar,'
            f"{i % 100},{i % 170}"
        )
    lines.append("too,short")
    (folder / "large.csv").write_text("\n".join(lines) + "\n")
    (folder / "small.csv").write_text(
        "name,location,kind\nMill,Oslo,water\nBarn,,farm\n,Bergen,\n"
    )
    return str(folder)


def routed_rows(spark, path):
    rows, warnings = valid_csv_rows(spark, path)
    return settled_and_ambiguous(rows), warnings


def summary(routed):
    counts = route_counts(routed).collect()
    return {
        r["document_id"].rsplit("/", 1)[1]: (r["total_rows"], r["deterministic_rows"])
        for r in counts
    }


def test_flow(spark, uploads, tmp_path):
    routed, warnings = routed_rows(spark, uploads)
    assert warnings.count() == 1
    assert warnings.first()["warning"].startswith("row 602: Missing columns: currency, ")
    # Half of the currencies are valid, less the rows with a latitude above 90. In the small file
    # only the type is mapped besides the name, and one row lacks it.
    off = sum(1 for i in range(600) if i % 4 < 2 and i % 100 > 90)
    assert summary(routed) == {"large.csv": (600, 300 - off), "small.csv": (3, 2)}

    root = str(tmp_path / "tables")
    settled = row_records(routed.filter("route = 'deterministic'"))
    assert append_batch(settled, f"{root}/settled").isEmpty()
    write_enrichment(enrich(routed.filter("route = 'ambiguous'")), root)
    stored = read_table(spark, f"{root}/settled", "extracted_asset_fields")
    enriched = read_table(spark, root, "extracted_asset_fields")
    assert stored.count() + enriched.count() == 603
    first = stored.filter("raw_asset_name = 'Plant 0, north'").first()
    value = spark.range(1).select(F.get_json_object(F.lit(first["normalized_value"]), "$.asset_value"))
    assert value.first()[0] == "1100.5"
    flags = read_table(spark, root, "validation_flags")
    assert {r["severity"] for r in flags.collect()} <= {"critical", "high", "medium", "low"}

    again = not_yet_stored(settled, stored)
    assert again.count() == 0


def test_salted_joins_give_the_same_routes(spark, uploads, monkeypatch):
    expected = summary(routed_rows(spark, uploads)[0])
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    assert summary(routed_rows(spark, uploads)[0]) == expected


def test_attached_schema_lists_every_column(spark):
    import json

    from ledgerloom.operators import profiling

    rows = [("d1", "", k, {"Name": f"n{k}", "Lat": str(k), "Odd": "", "Zeta": f"z {k}"}) for k in range(1, 9)]
    raw = spark.createDataFrame(
        rows, "document_id string, sheet_name string, row_index bigint, data map<string,string>")
    sample = profiling.head_sample(raw)
    roles = profiling.assign_roles(profiling.column_profile(sample))
    documents = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    out = profiling.attach_schema(documents, profiling.infer_schema(sample), roles)
    told = {r["document_id"]: r["inferred_schema"] for r in out.collect()}
    schema = json.loads(told["d1"])
    assert {c["name"]: c["detected_type"] for c in schema["columns"]} == {
        "Name": "string", "Lat": "number", "Odd": "empty", "Zeta": "string"}
    unmapped = {c["name"] for c in schema["columns"] if c["semantic_role"] == "unknown"}
    assert {c["name"] for c in schema["unmapped_columns"]} == unmapped
    assert schema["deterministic_coverage"] == 1.0 and schema["inference_notes"]
    assert told["d2"] is None
