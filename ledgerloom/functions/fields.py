"""Column functions on fields: aliases, value normalisers, parsers, checks, confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import (
    blank_to_null,
    decimal_places,
    finite,
    is_blank,
    let,
    number_as_text,
    number_text,
    plain_number,
    prefix_float,
    trimmed,
)


def literal_map(pairs: dict[str, str]) -> Column:
    """Constant map; written as SQL text because one expression per entry is slow to build."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")")


def value_of(data: Column, key: Column) -> Column:
    """Map lookup that gives null for a missing or null key."""
    return F.try_element_at(data, key)


def canonical_name(column: Column) -> Column:
    """Canonical field for a source column; unknown names pass through."""
    return F.coalesce(value_of(literal_map(vocab.COLUMN_ALIASES), column), column)


def canonical_keys(data: Column) -> Column:
    """Rename the keys of a row; when two columns share a field, the last one wins."""
    return F.transform_keys(data, lambda k, v: canonical_name(k))


def normalized_value(field: Column, value: Column) -> Column:
    """Field value in stored form: numbers for coordinates and amounts, trimmed text otherwise."""
    amount = field.isin(vocab.AMOUNT_FIELDS)
    digits = F.when(amount, F.translate(value, ",$", "")).otherwise(value)
    numeric = amount | field.isin(vocab.COORDINATE_FIELDS)
    return F.when(numeric, number_as_text(digits)).otherwise(trimmed(value))


def normalized_row(data: Column) -> Column:
    """Alias the keys, then normalise every value by its field."""
    return F.transform_values(canonical_keys(data), normalized_value)


def field_confidence(field: Column, value: Column) -> Column:
    """Confidence of one raw value in its field."""
    limit = F.when(field == "latitude", 90.0).otherwise(180.0)
    coordinate = F.when(F.abs(prefix_float(value)) <= limit, 0.85).otherwise(0.3)
    return (
        F.when(value.isNull() | (value == ""), 0.0)
        .when(field == "asset_name", 0.9)
        .when(field.isin("latitude", "longitude"), coordinate)
        .when(field == "currency", F.when(value.rlike("^[A-Z]{3}$"), 0.95).otherwise(0.5))
        .otherwise(0.7)
    )


def mean_confidence(data: Column) -> Column:
    """Mean field confidence over the non-null values of a raw row; 0 when there is none."""
    present = F.filter(F.map_entries(data), lambda e: e["value"].isNotNull())
    scores = F.transform(
        present, lambda e: field_confidence(canonical_name(e["key"]), e["value"])
    )
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(0.0)


def parse_coordinate(value: Column, limit: int) -> Column:
    """``struct<value, valid, parsed>`` of a coordinate in ``[-limit, limit]``."""

    def parsed(number: Column) -> Column:
        return F.struct(
            finite(number).alias("value"),
            F.coalesce(finite(number).between(-limit, limit), F.lit(False)).alias("valid"),
            finite(number).isNotNull().alias("parsed"),
        )

    return let(prefix_float(value), parsed)


def off_limits(value: Column, limit: int) -> Column:
    """True for a coordinate that parses but lies outside ``[-limit, limit]``."""
    size = F.abs(prefix_float(value))
    return F.coalesce((size > limit) & (size != float("inf")), F.lit(False))


def parse_latitude(value: Column) -> Column:
    return parse_coordinate(value, 90)


def parse_longitude(value: Column) -> Column:
    return parse_coordinate(value, 180)


def parse_currency(value: Column, codes: list[str] | None = None) -> Column:
    """Upper-case three-letter code from the accepted list, else null."""
    known = codes or vocab.CURRENCIES
    return let(F.upper(trimmed(value)), lambda code: F.when(code.isin(known), code))


def parse_amount(value: Column) -> Column:
    """Finite number from text that may hold separators and dollar signs."""
    return let(plain_number(value), finite)


def normalized_by_role(data: Column, roles: Column) -> Column:
    """Normalise each value by the role its column has in ``roles`` (column -> role)."""

    def convert(key: Column, value: Column) -> Column:
        role = F.coalesce(value_of(roles, key), F.lit(""))
        lat, lng = parse_latitude(value), parse_longitude(value)
        return (
            F.when(role == "latitude", number_text(F.when(lat["valid"], lat["value"])))
            .when(role == "longitude", number_text(F.when(lng["valid"], lng["value"])))
            .when(role == "currency", parse_currency(value))
            .when(role == "value", number_text(parse_amount(value)))
            .otherwise(value)
        )

    return F.transform_values(data, convert)


def coordinate_precision_ok(value: Column) -> Column:
    return decimal_places(value) <= vocab.COORDINATE_DECIMALS


def amount_precision_ok(value: Column) -> Column:
    return decimal_places(value) <= vocab.AMOUNT_DECIMALS


def bare_name(column: Column) -> Column:
    """Lower-case name with everything but letters and digits removed."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def matches_role(column: Column, slot: str) -> Column:
    """Two-way containment between a column name and the slot's keywords."""
    name = bare_name(column)
    hits = [
        name.contains(word) | F.lit(word).contains(name) for word in vocab.FUZZY_KEYWORDS[slot]
    ]
    result = hits[0]
    for hit in hits[1:]:
        result = result | hit
    return result


def is_numeric_text(value: Column) -> Column:
    return let(prefix_float(value), finite).isNotNull()


def is_date_text(value: Column) -> Column:
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in vocab.DATE_FORMATS])
    return F.coalesce(parsed.isNotNull(), F.lit(False))


def is_profile_currency(value: Column) -> Column:
    return F.coalesce(F.upper(value).isin(vocab.PROFILE_CURRENCIES), F.lit(False))


def is_falsy(value: Column, numeric: bool = False) -> Column:
    """Missing in the loose sense: null, empty text, and zero for numeric fields."""
    missing = value.isNull() | (value == "")
    return missing | (prefix_float(value) == 0) if numeric else missing


def row_name(data: Column, ordinal: Column) -> Column:
    """First non-empty name key, else ``asset_<ordinal + 1>``."""
    names = [blank_to_null(value_of(data, F.lit(k))) for k in vocab.NAME_KEYS]
    return F.coalesce(*names, F.concat(F.lit("asset_"), (ordinal + 1).cast("string")))


def without_meta_keys(data: Column) -> Column:
    """Row data without row-description keys and blank keys."""
    return F.map_filter(data, lambda k, v: ~k.isin(vocab.META_KEYS) & ~is_blank(k))


def parsed_values(data: Column) -> Column:
    """Empty text becomes null, everything else is trimmed (whitespace-only becomes empty text)."""
    return F.transform_values(data, lambda k, v: trimmed(blank_to_null(v)))


def job_status_label(status: Column) -> Column:
    return (
        F.when(status == "queued", "waiting").when(status == "running", "processing")
        .otherwise(status)
    )


def job_progress(status: Column) -> Column:
    return F.when(status == "running", 50).when(status == "completed", 100).otherwise(0)


def client_status(label: Column) -> Column:
    """Labels the client view knows; anything else shows as waiting."""
    known = label.isin("waiting", "processing", "completed", "failed")
    return F.when(known, label).otherwise("waiting")


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot (the whole name when there is none)."""
    return F.lower(F.substring_index(name, ".", -1))


def file_type(name: Column) -> Column:
    """Supported type of a file name, null when unsupported."""
    extension = file_extension(name)
    return F.when(extension.isin(vocab.FILE_TYPES), extension)


def mime_for_type(extension: Column) -> Column:
    return F.coalesce(
        value_of(literal_map(vocab.MIME_BY_TYPE), extension), F.lit(vocab.DEFAULT_MIME)
    )
