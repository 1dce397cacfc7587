"""Column functions on cell text: trimming, number reading, number writing, JSON objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import CELL_WHITESPACE

LEADING_NUMBER = r"^([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
WHITESPACE_CLASS = f"[{CELL_WHITESPACE}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside higher-order functions Spark does not share common subexpressions, so an expression used
    several times is bound to a lambda argument instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(value: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(value, F.lit(CELL_WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for null and for whitespace-only text."""
    return value.isNull() | (trimmed(value) == "")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def prefix_float(value: Column) -> Column:
    """Longest leading number of the text; trailing text is ignored, no number gives null."""
    return F.regexp_extract(trimmed(value), LEADING_NUMBER, 1).try_cast("double")


def finite(value: Column) -> Column:
    """The number, or null when it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def plain_number(value: Column) -> Column:
    """Numeric text with thousands separators and dollar signs removed, read as a number."""
    return prefix_float(F.translate(value, ",$", ""))


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double: no trailing ``.0``, plain digits from 1e-6 up to 1e21."""
    return let(value, _number_text)


def _number_text(value: Column) -> Column:
    exact = value.cast("string")
    # Java 17 may print a 17th digit that is not needed to read the same number back.
    rounded = F.format_string("%.15e", value)
    spare = (F.length(exact) >= 18) & (rounded.try_cast("double") == value)
    return let(F.when(spare, rounded).otherwise(exact), lambda text: _layout(value, text))


def _layout(value: Column, text: Column) -> Column:
    """Digits of ``text`` written plainly, or with an exponent for very small and large numbers."""
    size = F.abs(value)

    def digits(kind: str) -> Column:
        return F.regexp_replace(text.try_cast(kind).cast("string"), r"\.?0+$", "")

    mantissa = F.regexp_replace(F.substring_index(F.lower(text), "e", 1), r"\.?0+$", "")
    power = F.regexp_replace(F.substring_index(F.lower(text), "e", -1), r"^(\+|-)?0*", "")
    sign = F.when(size < 1, "e-").otherwise("e+")
    return (
        F.when(value == 0, "0")
        .when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2))
        .when(~(text.contains("E") | text.contains("e")), text)
        .when((size >= 1e7) & (size < 1e21), digits("decimal(38,10)"))
        .when((size >= 1e-6) & (size < 1e7), digits("decimal(38,25)"))
        .otherwise(F.concat(mantissa, sign, power))
    )


PLAIN_NUMBER = r"^(?:0|-?[1-9]\d{0,14}|-?(?:0|[1-9]\d{0,6})\.\d{0,5}[1-9])$"


def number_as_text(value: Column) -> Column:
    """``number_text`` of the leading number; text that already has that form is kept as it is."""

    def form(text: Column) -> Column:
        return F.when(text.rlike(PLAIN_NUMBER), text).otherwise(number_text(prefix_float(text)))

    return let(trimmed(value), form)


def decimal_places(value: Column) -> Column:
    """Digits after the decimal point in the number's shortest text."""
    return let(
        number_text(value),
        lambda t: F.when(t.contains("."), F.length(F.substring_index(t, ".", -1))).otherwise(0),
    )


def percent_text(score: Column) -> Column:
    """Score in percent without decimals."""
    return F.round(score * 100, 0).cast("int").cast("string")


def json_object(data: Column, numeric_keys: list[str] | None = None) -> Column:
    """JSON text of a string map; nulls are kept, the named keys are written as numbers."""
    if not numeric_keys:
        return F.to_json(data, {"ignoreNullFields": "false"})
    typed = F.transform_values(
        data,
        lambda k, v: F.when(
            k.isin(numeric_keys) & prefix_float(v).isNotNull(), F.try_parse_json(v)
        ).otherwise(v.cast("variant")),
    )
    return F.to_json(typed, {"ignoreNullFields": "false"})


def parsed_object(text: Column) -> Column:
    """JSON object text as a map of typed values; anything else is an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    return F.coalesce(F.from_json(text, "map<string,variant>"), empty)


def merged_object(existing: Column, update: Column) -> Column:
    """Shallow merge of two JSON objects; keys of ``update`` win, bad JSON counts as empty."""
    merged = F.map_concat(parsed_object(existing), parsed_object(update))
    return F.to_json(merged, {"ignoreNullFields": "false"})
