"""Header names: normalisers over header arrays, required-header test, data-start index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE_CLASS, let, trimmed


def _numbered(names: Column) -> Column:
    """Append ``_<n>`` to the n-th repeat of a name.

    The names are bound, for they are read once for every name and would be made anew each time.
    """

    def marked(bound: Column) -> Column:
        def mark(name: Column, i: Column) -> Column:
            earlier = F.filter(F.slice(bound, F.lit(1), i), lambda other: other == name)
            numbered = lambda n: F.when(
                n > 0, F.concat(name, F.lit("_"), (n + 1).cast("string"))
            ).otherwise(name)
            return let(F.size(earlier), numbered)

        different = F.size(F.array_distinct(bound)) == F.size(bound)
        return F.when(different, bound).otherwise(F.transform(bound, mark))

    return let(names, marked)


def _named(names: Column) -> Column:
    """Blank names become ``column_<position>``."""
    return F.transform(
        names,
        lambda name, i: F.when(
            name == "", F.concat(F.lit("column_"), (i + 1).cast("string"))
        ).otherwise(name),
    )


def csv_header_name(header: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(header), WHITESPACE_CLASS + "+", "_"))


def sheet_header_name(header: Column) -> Column:
    text = F.regexp_replace(F.lower(trimmed(F.coalesce(header, F.lit("")))), "[^a-z0-9]+", "_")
    return F.btrim(text, F.lit("_"))


def strict_header_name(header: Column) -> Column:
    spaced = F.regexp_replace(F.lower(trimmed(header)), WHITESPACE_CLASS + "+", "_")
    return F.regexp_replace(spaced, "[^a-z0-9_]", "")


def csv_headers(headers: Column) -> Column:
    """Names of a CSV header line: lower case, whitespace runs as ``_``, unique."""
    return _numbered(_named(F.transform(headers, csv_header_name)))


def sheet_headers(headers: Column) -> Column:
    """Names of a sheet header row: lower case letters and digits joined by ``_``, unique."""
    return _numbered(_named(F.transform(headers, sheet_header_name)))


def strict_headers(headers: Column) -> Column:
    """Names reduced to ``[a-z0-9_]``, unique; blank names stay blank."""
    return _numbered(F.transform(headers, strict_header_name))


def strict_duplicates(headers: Column) -> Column:
    """The numbered names that ``strict_headers`` had to give to repeats."""

    def repeats(plain: Column) -> Column:
        pairs = F.arrays_zip(plain.alias("plain"), _numbered(plain).alias("unique"))
        return F.transform(F.filter(pairs, lambda p: p["plain"] != p["unique"]), lambda p: p["unique"])

    return let(F.transform(headers, strict_header_name), repeats)


def has_required_headers(headers: Column, required: list[str]) -> Column:
    wanted = F.array(*[F.lit(r) for r in required]).cast("array<string>")
    return F.size(F.array_except(wanted, strict_headers(headers))) == 0


def filled_index(min_columns: int = 2) -> Column:
    """0-based index of a sample row that has enough values, null for other rows."""
    filled = F.size(F.filter(F.map_values("data"), lambda v: v.isNotNull() & (v != "")))
    return F.when(filled >= min_columns, F.col("sample_pos") - 1)


def data_start(sample: DataFrame, min_columns: int = 2) -> DataFrame:
    """0-based index, per document, of the first sample row with enough values; 0 if none has.

    ``sample`` holds ``document_id``, 1-based ``sample_pos`` and the row map ``data``.
    """
    first = F.coalesce(F.min(filled_index(min_columns)), F.lit(0))
    return sample.groupBy("document_id").agg(first.alias("start"))
