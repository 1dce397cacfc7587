import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text
from ledgerloom.operators.routing import initial_confidence


@pytest.mark.parametrize(
    "given, expected",
    [
        ("12abc", 12.0), ("  -3.5e2x", -350.0), (".5", 0.5), ("5.", 5.0), ("abc", None),
        ("", None), (None, None), ("+7", 7.0), ("Infinity", math.inf), ("1e400", math.inf),
        ("1-URGENT", 1.0), (" 4", 4.0), ("1e", 1.0), ("--1", None),
    ],
)
def test_prefix_float(value, given, expected):
    assert value(text.prefix_float(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(
    "number, expected",
    [
        (1.0, "1"), (0.0, "0"), (-0.0, "0"), (1234.5, "1234.5"), (1e7, "10000000"),
        (123456789.25, "123456789.25"), (1e20, "100000000000000000000"), (0.0001, "0.0001"),
        (0.000001, "0.000001"), (1.5e-7, "1.5e-7"), (1e-7, "1e-7"), (1e21, "1e+21"),
        (1.25e22, "1.25e+22"), (-2.5, "-2.5"), (100.0, "100"),
        (2.0**-44, "5.684341886080802e-14"), (0.1 + 0.2, "0.30000000000000004"),
        (1 / 3, "0.3333333333333333"), (-1e-10, "-1e-10"), (2e10, "20000000000"),
    ],
)
def test_number_text(value, number, expected):
    assert value(text.number_text(F.lit(number))) == expected


@pytest.mark.parametrize(
    "number, places", [(1.0, 0), (1.25, 2), (0.1234567, 7), (1e-7, 0), (1.5e-7, 4), (1e9, 0)]
)
def test_decimal_places(value, number, places):
    assert value(text.decimal_places(F.lit(number))) == places


@pytest.mark.parametrize(
    "given, valid", [("usd", "USD"), (" eur ", "EUR"), ("XYZ", None), ("US", None), (None, None)]
)
def test_currency(value, given, valid):
    assert value(fields.parse_currency(F.lit(given).cast("string"))) == valid


@pytest.mark.parametrize(
    "given, number, valid, parsed",
    [
        ("91", 91.0, False, True), ("-90", -90.0, True, True), ("12abc", 12.0, True, True),
        ("abc", None, False, False), (None, None, False, False), ("Infinity", None, False, False),
    ],
)
def test_latitude(value, given, number, valid, parsed):
    row = value(fields.parse_latitude(F.lit(given).cast("string")))
    assert (row["value"], row["valid"], row["parsed"]) == (number, valid, parsed)


@pytest.mark.parametrize(
    "match, complete, score",
    [(True, True, 1.0), (False, True, 0.7), (True, False, 0.6), (False, False, 0.3)],
)
def test_initial_confidence(value, match, complete, score):
    assert value(initial_confidence(F.lit(match), F.lit(complete))) == pytest.approx(score)


def test_later_column_wins_a_shared_name(value):
    data = F.create_map(*[F.lit(x) for x in ("asset_name", "a", "owner", "o", "name", "b")])
    assert value(fields.canonical_keys(data)) == {"asset_name": "b", "owner": "o"}


def test_parsed_values(value):
    data = F.create_map(
        F.lit("a"), F.lit(" x "), F.lit("b"), F.lit(""), F.lit("c"), F.lit("  "),
        F.lit("d"), F.lit(None).cast("string"),
    )
    assert value(fields.parsed_values(data)) == {"a": "x", "b": None, "c": "", "d": None}


def test_json_object_keeps_nulls_and_numbers(value):
    data = F.create_map(
        F.lit("latitude"), F.lit("12.5"), F.lit("name"), F.lit('say "hi"'),
        F.lit("owner"), F.lit(None).cast("string"),
    )
    stored = json.loads(value(text.json_object(data, ["latitude"])))
    assert stored == {"latitude": 12.5, "name": 'say "hi"', "owner": None}


@pytest.mark.parametrize(
    "old, expected",
    [
        ('{"a":1,"b":null}', {"a": 2, "b": None, "c": [1]}),
        ("broken", {"a": 2, "c": [1]}),
        (None, {"a": 2, "c": [1]}),
    ],
)
def test_merged_object(value, old, expected):
    merged = text.merged_object(F.lit(old).cast("string"), F.lit('{"a":2,"c":[1]}'))
    assert json.loads(value(merged)) == expected


def test_row_name_fallback(value):
    data = F.create_map(F.lit("asset_name"), F.lit(""), F.lit("Asset Name"), F.lit("Mill"))
    assert value(fields.row_name(data, F.lit(4))) == "Mill"
    bare = F.create_map(F.lit("x"), F.lit("y"))
    assert value(fields.row_name(bare, F.lit(4))) == "asset_5"


@pytest.mark.parametrize(
    "name, kind", [("a.CSV", "csv"), ("b.tar.xlsx", "xlsx"), ("c.txt", None), ("csv", "csv")]
)
def test_file_type(value, name, kind):
    assert value(fields.file_type(F.lit(name))) == kind


@pytest.mark.parametrize(
    "field, given, score",
    [
        ("asset_name", "x", 0.9), ("latitude", "91", 0.3), ("longitude", "91", 0.85),
        ("latitude", "n/a", 0.3), ("currency", "usd", 0.5), ("currency", "USD", 0.95),
        ("owner", "me", 0.7), ("owner", "", 0.0), ("owner", None, 0.0),
    ],
)
def test_field_confidence(value, field, given, score):
    got = fields.field_confidence(F.lit(field), F.lit(given).cast("string"))
    assert value(got) == pytest.approx(score)
