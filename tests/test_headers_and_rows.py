from pyspark.sql import functions as F

from ledgerloom.operators import headers, rows
from workload import row_queries


def texts(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def test_csv_headers(value):
    assert value(headers.csv_headers(texts(" Asset ID ", " Asset Name ", "Asset ID"))) == [
        "asset_id", "asset_name", "asset_id_2",
    ]
    assert value(headers.csv_headers(texts("﻿Asset ID", " asset id ", ""))) == [
        "asset_id", "asset_id_2", "column_3",
    ]


def test_sheet_headers(value):
    assert value(headers.sheet_headers(texts("Asset ID", " asset id ", "!!!"))) == [
        "asset_id", "asset_id_2", "column_3",
    ]
    assert value(headers.sheet_headers(texts("Customers (Count)", None))) == [
        "customers_count", "column_2",
    ]


def test_strict_headers(value):
    given = texts("A b!", "a b", "", "A-B", "")
    assert value(headers.strict_headers(given)) == ["a_b", "a_b_2", "", "ab", "_2"]
    assert value(headers.strict_duplicates(given)) == ["a_b_2", "_2"]
    assert value(headers.has_required_headers(given, ["a_b_2", "ab"]))
    assert not value(headers.has_required_headers(given, ["name"]))


def test_header_names_are_unique_for_distinct_bases(value):
    got = value(headers.csv_headers(texts(*["Same"] * 50)))
    assert len(set(got)) == 50


def test_strict_csv_errors(value):
    raw = F.create_map(F.lit("assetid"), F.lit("A-1"), F.lit("_2"), F.lit("unexpected"))
    errors = rows.strict_csv_errors(
        texts("assetid", "name"), texts("A-1", None), raw, texts("unexpected")
    )
    assert value(errors) == ["Missing columns: name.", "Extra columns detected: 1."]


def test_strict_sheet_errors(value):
    assert value(rows.strict_sheet_errors(texts("A-1"), texts("unexpected", " "))) == [
        "Extra columns detected: 1."
    ]
    assert value(rows.strict_sheet_errors(texts(" "), texts())) == ["Row is empty."]


def test_row_errors(value):
    errors = rows.row_errors(texts("a", "b"), texts("", " ", None), 2, ["b", "c"])
    assert value(errors) == [
        "Column count mismatch: expected 2, got 3", "Missing required headers: c", "Empty row",
    ]


def test_repeats_are_numbered_as_in_a_walk(value):
    given = ["a", "", None, "A ", "b", "a", "", "a_2", None]
    names = [None if g is None else g.strip().lower() for g in given]
    walked = [
        n if n is None or n not in names[:i] else f"{n}_{names[:i].count(n) + 1}"
        for i, n in enumerate(names)
    ]
    assert value(headers.strict_headers(texts(*given))) == walked
    assert value(headers.strict_duplicates(texts(*given))) == [
        w for n, w in zip(names, walked) if n != w]
    assert value(headers.strict_headers(texts("a", None, None))) == ["a", None, None]


def times_made(column):
    """How often a name is made, as the expression is written."""
    return str(column).count("regexp_replace") // str(headers.strict_header_name(F.col("h"))).count(
        "regexp_replace")


def test_duplicates_are_found_from_names_made_once():
    assert times_made(headers.strict_duplicates(F.col("line"))) == 1


def test_csv_names_are_made_once(spark):
    made = str(headers.csv_headers(F.col("line"))).count("regexp_replace")
    assert made == str(headers.csv_header_name(F.col("h"))).count("regexp_replace")


def test_header_lines_of_a_small_table_go_to_all_cores(spark):
    lines = row_queries.header_lines(spark, "/root/testdata/sf0.001")
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_strict_names_are_made_once():
    assert times_made(headers.strict_headers(F.col("line"))) == 1


def test_required_names_are_looked_up_among_names_made_once():
    assert times_made(headers.has_required_headers(F.col("line"), ["a", "b"])) == 1
