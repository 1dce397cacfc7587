"""Row checks, warnings and row candidates.

Fixed values: the messages of errors and warnings are those that stored data carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fields import row_name, without_meta_keys
from ..functions.text import is_blank


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _all_blank(values: Column) -> Column:
    return F.forall(values, is_blank)


def row_errors(
    headers: Column, values: Column, header_count: int = 0, required: list[str] | None = None
) -> Column:
    """Problems of a row: wrong number of values, required headers missing, empty row."""
    wanted = F.array(*[F.lit(r) for r in required or []]).cast("array<string>")
    absent = F.array_except(wanted, headers)
    count = F.size(values)
    return F.array_compact(
        F.array(
            F.when(
                (F.lit(header_count) > 0) & (count != header_count),
                _text(f"Column count mismatch: expected {header_count}, got ", count.cast("string")),
            ),
            F.when(
                F.size(absent) > 0,
                _text("Missing required headers: ", F.array_join(absent, ", ")),
            ),
            F.when(_all_blank(values), F.lit("Empty row")),
        )
    )


def strict_csv_errors(headers: Column, values: Column, raw: Column, extra: Column) -> Column:
    """Problems of a CSV row: empty, columns missing from it, values beyond the header."""
    absent = F.array_except(headers, F.map_keys(raw))
    return F.array_compact(
        F.array(
            F.when(_all_blank(values) & (F.size(extra) == 0), F.lit("Row is empty.")),
            F.when(
                F.size(absent) > 0, _text("Missing columns: ", F.array_join(absent, ", "), ".")
            ),
            F.when(
                F.size(extra) > 0,
                _text("Extra columns detected: ", F.size(extra).cast("string"), "."),
            ),
        )
    )


def strict_sheet_errors(values: Column, extra: Column) -> Column:
    """Problems of a sheet row: empty, filled cells beyond the header."""
    filled = F.size(F.filter(extra, lambda v: ~is_blank(v)))
    return F.array_compact(
        F.array(
            F.when(_all_blank(values) & _all_blank(extra), F.lit("Row is empty.")),
            F.when(filled > 0, _text("Extra columns detected: ", filled.cast("string"), ".")),
        )
    )


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without problems, and one row per problem of the others (``reason``)."""
    checked = rows.withColumn("errors", errors)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    bad = checked.filter(F.size("errors") > 0).withColumn("reason", F.explode("errors"))
    return good, bad.drop("errors")


def warning_text(row_index: Column, reason: Column, sheet_name: Column | None = None) -> Column:
    """``Row <n>: <reason>``, or ``sheet <s>, row <n>: <reason>`` for a sheet."""
    number = row_index.cast("string")
    if sheet_name is None:
        return _text("Row ", number, ": ", reason)
    return _text("sheet ", sheet_name, ", row ", number, ": ", reason)


def row_candidates(rows: DataFrame) -> DataFrame:
    """Rows ready to store: row data without meta keys, and a name for every row."""
    return rows.withColumns(
        {
            "raw_asset_name": row_name(F.col("data"), F.col("row_index") - 1),
            "raw": without_meta_keys(F.col("raw")),
            "data": without_meta_keys(F.col("data")),
        }
    ).withColumn("base_confidence", F.lit(vocab.DEFAULT_CONFIDENCE))
