"""Spreadsheet cells to rows: header detection, header width, row assembly, row filters.

Cells come as ``document_id, sheet_name, row_num, col_num, str_value, num_value`` with 0-based
positions, and ``sheet_no``, the sheet's place in its workbook, where that is known. A sheet may
hold most of the cells, so sheets are only ever reduced by partial aggregates, joined as tables, or
cut into blocks of rows.

``cell_rows`` reads the cells once and groups them into rows; ranges, census, header and data all
come from that narrower table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import is_blank, number_text, trimmed
from ..session import write_through
from .headers import sheet_headers
from .spread import gap_starts, join_measured

SHEET = ["document_id", "sheet_name"]


def cell_text(text: str = "str_value", number: str = "num_value") -> Column:
    return F.coalesce(F.col(text), number_text(F.col(number)))


def is_filled() -> Column:
    """The cell holds a number or non-blank text."""
    return F.col("num_value").isNotNull() | ~is_blank(F.col("str_value"))


def _is_text() -> Column:
    return F.col("num_value").isNull() & ~is_blank(F.col("str_value"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row, written: ``cells``, the filled ones by column, ``first_filled`` and
    ``last_filled``, their ends, ``first_length``, the text length of the first of them, and
    ``first_any``, the first column of all cells.

    Sheets keep their place in the workbook (``sheet_no``), where the cells have one.
    """
    numbered = [F.min("sheet_no").alias("sheet_no")] if "sheet_no" in cells.columns else []
    cell = F.struct(
        "col_num", F.struct(cell_text().alias("text"), F.col("str_value").isNotNull().alias("is_str"), "num_value"))
    filled = F.when(is_filled(), F.col("col_num"))
    length = F.when(_is_text(), F.length(trimmed(F.col("str_value"))))
    # A row has few cells: they meet first, for lists that are begun before the shuffle save nothing.
    dealt = cells.repartition(*SHEET, "row_num")
    rows = dealt.groupBy(*SHEET, "row_num").agg(
        F.map_from_entries(F.collect_list(F.when(is_filled(), cell))).alias("cells"),
        F.min(filled).alias("first_filled"), F.max(filled).alias("last_filled"),
        F.min(F.when(is_filled(), F.struct("col_num", length.alias("n"))))["n"].alias("first_length"),
        F.min("col_num").alias("first_any"), *numbered,
    )
    return write_through(rows, "sheet-rows")


def used_range(rows: DataFrame) -> DataFrame:
    """First row and column of each sheet's used range, from ``cell_rows``."""
    return rows.groupBy(*SHEET).agg(
        F.min("row_num").alias("first_row"), F.min("first_any").alias("first_col")
    )


def top_cells_of(rows: DataFrame) -> DataFrame:
    """Filled cells of the first rows of each sheet, with ``offset`` from its first row.

    Written out, since every header rule reads them; their number is bounded per sheet.
    """
    ranges = write_through(used_range(rows), "ranges")
    offset = F.col("row_num") - F.col("first_row")
    near = join_measured(rows.select(*SHEET, "row_num", "cells"), ranges, SHEET, "inner")
    top = near.withColumn("offset", offset).filter(F.col("offset") < vocab.HEADER_SCAN_ROWS)
    each = top.select("*", F.explode("cells").alias("col_num", "_cell")).drop("cells")
    return write_through(each.select(
        *[c for c in each.columns if c != "_cell"],
        F.when(F.col("_cell.is_str"), F.col("_cell.text")).alias("str_value"), "_cell.num_value",
    ), "top-cells")


def top_cells(cells: DataFrame) -> DataFrame:
    """As ``top_cells_of``, from the cells."""
    return top_cells_of(cell_rows(cells))


def row_census(top: DataFrame) -> DataFrame:
    """Filled, text and number cells per row of ``top_cells``."""
    return top.groupBy(*SHEET, "first_col", "row_num", "offset").agg(
        F.count("*").alias("filled"),
        F.count_if(_is_text()).alias("texts"),
        F.count_if(F.col("num_value").isNotNull()).alias("numbers"),
    )


def _first_best(score: Column) -> Column:
    """Row with the highest score, the earliest on a tie; rows without a score do not count."""
    return -F.max(F.when(score.isNotNull(), F.struct(score, -F.col("row_num"))))["col2"]


def header_votes(census: DataFrame) -> DataFrame:
    """Header row of each sheet by the rules that need only row counts.

    ``by_transition``: text-heavy row followed by a more numeric one, scored; the last candidate
    cannot win. ``by_text``: first row that is mostly text and has nearly as many texts as the
    average candidate. ``by_first``: first row with two cells. ``by_fallback``: first row.
    """
    candidate = F.col("filled") >= 2
    alike = W.partitionBy(*SHEET, "candidate")
    step = alike.orderBy("row_num")
    rows = census.withColumn("candidate", candidate).withColumns(
        {
            "next_numbers": F.lead("numbers").over(step),
            "next_filled": F.lead("filled").over(step),
            "mean_texts": F.avg("texts").over(alike),
        }
    )
    texts, filled, row = F.col("texts"), F.col("filled"), F.col("row_num")
    score = F.when(
        F.col("candidate") & F.col("next_filled").isNotNull(),
        texts / filled * 40
        + F.when(F.col("next_numbers") > F.col("numbers"), 25).otherwise(0)
        + F.when(F.col("next_numbers") / F.col("next_filled") > 0.3, 15).otherwise(0)
        + filled * 5
        - F.col("offset") * 2,
    )
    like_header = (texts / filled > 0.6) & (texts > F.col("mean_texts") * 0.8)
    return rows.groupBy(*SHEET, "first_col").agg(
        _first_best(score).alias("by_transition"),
        F.min(F.when(F.col("candidate") & like_header, row)).alias("by_text"),
        F.min(F.when(F.col("candidate"), row)).alias("by_first"),
        F.min(row).alias("by_fallback"),
    )


def header_by_columns(top: DataFrame, census: DataFrame) -> DataFrame:
    """Row whose text cells stand over columns that hold mostly text."""
    step = W.partitionBy(*SHEET).orderBy("row_num")
    rows = census.filter(F.col("filled") >= 2).select(
        *SHEET,
        "row_num",
        F.row_number().over(step).alias("nth"),
        F.lead("row_num").over(step).isNull().alias("is_last"),
    )
    cells = top.join(rows, [*SHEET, "row_num"])
    below = cells.filter(F.col("nth") > 1)
    columns = below.groupBy(*SHEET, "col_num").agg(
        F.count_if(_is_text()).alias("texts"), F.count("*").alias("total")
    )
    fits = _is_text() & (F.col("texts") > F.col("total") * 0.5)
    scored = (
        cells.filter(~F.col("is_last"))
        .join(columns, [*SHEET, "col_num"], "left")
        .groupBy(*SHEET, "row_num")
        .agg((F.count_if(fits) * 10 - F.min("offset") * 2).alias("score"))
    )
    return scored.groupBy(*SHEET).agg(_first_best(F.col("score")).alias("by_columns"))


def header_rows(top: DataFrame) -> DataFrame:
    """Header row of every sheet with the verdict of each rule, from ``top_cells``."""
    census = row_census(top)
    votes = header_votes(census).join(header_by_columns(top, census), SHEET, "left")
    order = ["by_transition", "by_text", "by_columns", "by_first", "by_fallback"]
    return votes.withColumn("header_row", F.coalesce(*order))


def layout_of(top: DataFrame) -> DataFrame:
    """Header row, width and normalised header names of each sheet, written out.

    The width ends at the last non-blank header cell; columns beyond it do not exist. The header is
    among the first rows (``top_cells``), so the other rows are not read.
    """
    found = header_rows(top).select(*SHEET, F.col("header_row").alias("row_num"))
    at = (F.col("col_num") - F.col("first_col")).cast("int")
    grouped = top.join(found, [*SHEET, "row_num"]).groupBy(
        *SHEET, F.col("row_num").alias("header_row"), "first_col"
    )
    names = grouped.agg(
        F.max(at + 1).alias("width"),
        F.map_from_entries(F.collect_list(F.struct(at, cell_text()))).alias("names"),
    )
    places = F.sequence(F.lit(0), F.col("width") - 1)
    texts = F.transform(places, lambda i: F.try_element_at(F.col("names"), i))
    layout = names.withColumn("headers", sheet_headers(texts)).drop("names")
    return write_through(layout, "layout")


def sheet_layout(cells: DataFrame) -> DataFrame:
    """As ``layout_of``, from the cells."""
    return layout_of(top_cells(cells))


def data_cells(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Filled cells below the header and within its width; ``at`` counts columns from 0."""
    placed = join_measured(
        cells.filter(is_filled()), layout.drop("headers"), SHEET, "inner"
    )
    at = (F.col("col_num") - F.col("first_col")).cast("int")
    return placed.withColumn("at", at).filter(
        (F.col("row_num") > F.col("header_row")) & F.col("at").between(0, F.col("width") - 1)
    )


def rows_before_long_gap(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Last row to keep, for sheets where a long run of empty rows ends the data (one row each)."""
    filled = rows.select(*SHEET, "row_num")
    starts = layout.select(*SHEET, F.col("header_row").alias("row_num"))
    return gap_starts(filled.unionByName(starts), SHEET, "row_num", vocab.EMPTY_ROW_LIMIT)


def rows_of(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Data rows of every sheet: ``row_index`` (1-based), ``headers``, ``values``, ``raw``.

    Empty rows, rows after a long empty run, and single-cell note rows are left out. A row has
    data if its first filled cell lies within the header's width, so the runs of empty rows are
    found without reading the cells.
    """
    numbered = [c for c in ("sheet_no",) if c in rows.columns]
    placed = join_measured(rows, layout, SHEET, "inner")
    within = F.col("first_filled") < F.col("first_col") + F.col("width")
    data = placed.filter((F.col("row_num") > F.col("header_row")) & within)
    ends = write_through(rows_before_long_gap(data, layout), "ends")
    kept = join_measured(data, ends, SHEET).filter(
        F.col("gap_after").isNull() | (F.col("row_num") <= F.col("gap_after"))
    )
    end = F.col("first_col") + F.col("width")
    within_width = F.when(F.col("last_filled") < end, F.size("cells")).otherwise(
        F.size(F.map_filter("cells", lambda at, _: at < end)))
    first_is_long = (F.col("first_filled") == F.col("first_col")) & (
        F.col("first_length") > vocab.NOTE_MIN_LENGTH)
    note = F.coalesce(first_is_long, F.lit(False)) & (within_width == 1)
    values = F.transform(
        "headers",
        lambda h, i: F.try_element_at(F.col("cells"), (F.col("first_col") + i).cast(
            rows.schema["cells"].dataType.keyType))["text"])
    return kept.filter(~note).withColumn("values", values).select(
        *SHEET,
        *numbered,
        (F.col("row_num") + 1).alias("row_index"),
        "headers",
        "values",
        F.map_from_arrays("headers", "values").alias("raw"),
    )


def sheet_rows(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """As ``rows_of``, from the cells."""
    return rows_of(cell_rows(cells), layout)


def read_sheets(cells: DataFrame) -> DataFrame:
    """Data rows of all sheets from one pass over the cells."""
    rows = cell_rows(cells)
    return rows_of(rows, layout_of(top_cells_of(rows)))
