"""Header detection and row assembly on spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import sheets

from .registry import query
from .views import SHEET_SQL, sheet_cells

# Sheet s as given; in sheet t the second half of the suppliers follows 150 empty rows later and the
# header stands in columns 1 to 3.
CELLS_SQL = f"""
SELECT * FROM ({SHEET_SQL}) a
UNION ALL
SELECT 't', row_num + CASE WHEN row_num > 40 THEN 150 ELSE 0 END, col_num + 1, str_value, num_value FROM ({SHEET_SQL}) b
"""
CENSUS_SQL = f"""
SELECT sheet_name, row_num, min(row_num - first_row) AS off, count(*) AS filled,
       count(str_value) AS texts, count(num_value) AS numbers
FROM (SELECT *, min(row_num) OVER (PARTITION BY sheet_name) AS first_row FROM ({CELLS_SQL})) c
WHERE (num_value IS NOT NULL OR trim(str_value) <> '') AND row_num < first_row + 100
GROUP BY sheet_name, row_num
"""


def two_sheets(spark, folder):
    cells = sheet_cells(spark, folder)
    moved = cells.select(
        F.lit("t").alias("sheet_name"),
        (F.col("row_num") + F.when(F.col("row_num") > 40, 150).otherwise(0)).alias("row_num"),
        (F.col("col_num") + 1).alias("col_num"),
        "str_value", "num_value", "document_id",
    )
    return cells.unionByName(moved)


def census_of(cells):
    top = sheets.top_cells(cells)
    return top, sheets.row_census(top)


@query(
    "sheet_row_census",
    f"SELECT sheet_name, row_num, off AS \"offset\", filled, texts, numbers FROM ({CENSUS_SQL}) c",
)
def sheet_row_census(spark, folder):
    return census_of(two_sheets(spark, folder))[1].drop("document_id", "first_col")


TRANSITION_SQL = f"""
SELECT sheet_name, row_num AS by_transition FROM (
  SELECT *, row_number() OVER (PARTITION BY sheet_name ORDER BY score DESC, row_num) AS best FROM (
    SELECT sheet_name, row_num, texts / filled * 40 + CASE WHEN next_numbers > numbers THEN 25 ELSE 0 END
      + CASE WHEN next_numbers / next_filled > 0.3 THEN 15 ELSE 0 END + 5 * filled - 2 * off AS score
    FROM (SELECT *, lead(numbers) OVER w AS next_numbers, lead(filled) OVER w AS next_filled
          FROM ({CENSUS_SQL}) c WHERE filled >= 2 WINDOW w AS (PARTITION BY sheet_name ORDER BY row_num)) n
    WHERE next_filled IS NOT NULL) s) r WHERE best = 1
"""
TEXT_SQL = f"""
SELECT sheet_name, min(row_num) FILTER (texts / filled > 0.6 AND texts > 0.8 * mean_texts) AS by_text
FROM (SELECT *, avg(texts) OVER (PARTITION BY sheet_name) AS mean_texts FROM ({CENSUS_SQL}) c WHERE filled >= 2) m
GROUP BY sheet_name
"""
COLUMNS_SQL = f"""
WITH candidates AS (
  SELECT *, row_number() OVER (PARTITION BY sheet_name ORDER BY row_num) AS nth,
    lead(row_num) OVER (PARTITION BY sheet_name ORDER BY row_num) IS NULL AS last_one
  FROM ({CENSUS_SQL}) c WHERE filled >= 2),
used AS (SELECT c.*, k.nth, k.last_one, k.off FROM ({CELLS_SQL}) c JOIN candidates k ON c.sheet_name = k.sheet_name AND c.row_num = k.row_num),
columns_below AS (SELECT sheet_name, col_num, count(str_value) AS texts, count(*) AS total FROM used WHERE nth > 1 GROUP BY ALL),
scores AS (
  SELECT u.sheet_name, u.row_num, 10 * count(*) FILTER (u.str_value IS NOT NULL AND b.texts > b.total * 0.5) - 2 * min(u.off) AS score
  FROM used u LEFT JOIN columns_below b ON u.sheet_name = b.sheet_name AND u.col_num = b.col_num
  WHERE NOT last_one GROUP BY ALL)
SELECT sheet_name, row_num AS by_columns FROM (
  SELECT *, row_number() OVER (PARTITION BY sheet_name ORDER BY score DESC, row_num) AS best FROM scores) r WHERE best = 1
"""
HEADER_ROW_SQL = f"""
SELECT t.sheet_name, by_transition, by_text, by_columns, by_first, by_fallback,
       coalesce(by_transition, by_text, by_columns, by_first, by_fallback) AS header_row
FROM ({TRANSITION_SQL}) t JOIN ({TEXT_SQL}) x ON t.sheet_name = x.sheet_name
JOIN ({COLUMNS_SQL}) c ON t.sheet_name = c.sheet_name
JOIN (SELECT sheet_name, min(row_num) FILTER (filled >= 2) AS by_first, min(row_num) AS by_fallback
      FROM ({CENSUS_SQL}) f GROUP BY sheet_name) f ON t.sheet_name = f.sheet_name
"""


@query("header_by_transition", TRANSITION_SQL)
def header_by_transition(spark, folder):
    votes = sheets.header_votes(census_of(two_sheets(spark, folder))[1])
    return votes.select("sheet_name", "by_transition")


@query("header_by_text", TEXT_SQL)
def header_by_text(spark, folder):
    votes = sheets.header_votes(census_of(two_sheets(spark, folder))[1])
    return votes.select("sheet_name", "by_text")


@query("header_by_columns", COLUMNS_SQL)
def header_by_columns(spark, folder):
    top, census = census_of(two_sheets(spark, folder))
    return sheets.header_by_columns(top, census).drop("document_id")


@query("header_rows", HEADER_ROW_SQL)
def header_rows(spark, folder):
    found = sheets.header_rows(sheets.top_cells(two_sheets(spark, folder)))
    return found.drop("document_id", "first_col")


@query(
    "sheet_layout",
    f"""SELECT c.sheet_name, h.header_row, max(col_num - first_col + 1)::BIGINT AS width,
        string_agg(trim(regexp_replace(lower(str_value), '[^a-z0-9]+', '_', 'g'), '_'), ',' ORDER BY col_num) AS headers
        FROM (SELECT *, min(col_num) OVER (PARTITION BY sheet_name) AS first_col FROM ({CELLS_SQL})) c
        JOIN ({HEADER_ROW_SQL}) h ON c.sheet_name = h.sheet_name AND c.row_num = h.header_row
        GROUP BY c.sheet_name, h.header_row""",
)
def sheet_layout(spark, folder):
    layout = sheets.sheet_layout(two_sheets(spark, folder))
    return layout.select(
        "sheet_name", "header_row", "width", F.array_join("headers", ",").alias("headers")
    )


@query(
    "sheet_rows",
    f"""WITH cells AS (SELECT * FROM ({CELLS_SQL}) WHERE row_num > 2),
        filled AS (SELECT DISTINCT sheet_name, row_num FROM cells UNION ALL SELECT DISTINCT sheet_name, 2 FROM cells),
        gaps AS (SELECT sheet_name, min(row_num) AS gap_after FROM (
          SELECT *, lead(row_num) OVER (PARTITION BY sheet_name ORDER BY row_num) - row_num - 1 AS empty_rows FROM filled) g
          WHERE empty_rows >= 100 GROUP BY sheet_name)
        SELECT c.sheet_name, c.row_num + 1 AS row_index, max(str_value) AS supplier_name,
          max(num_value) FILTER (c.col_num = CASE c.sheet_name WHEN 's' THEN 1 ELSE 2 END) AS balance,
          max(num_value) FILTER (c.col_num = CASE c.sheet_name WHEN 's' THEN 2 ELSE 3 END)::BIGINT AS nation
        FROM cells c LEFT JOIN gaps g ON c.sheet_name = g.sheet_name
        WHERE g.gap_after IS NULL OR c.row_num <= g.gap_after
        GROUP BY c.sheet_name, c.row_num HAVING count(*) > 1""",
)
def sheet_rows(spark, folder):
    rows = sheets.read_sheets(two_sheets(spark, folder))
    cell = lambda n: F.try_element_at(F.col("raw"), F.lit(n))
    return rows.select(
        "sheet_name", "row_index", cell("supplier_name").alias("supplier_name"),
        cell("balance").cast("double").alias("balance"), cell("nation").cast("bigint").alias("nation"),
    )


@query(
    "empty_row_stop",
    f"""WITH filled AS (SELECT DISTINCT sheet_name, row_num FROM ({CELLS_SQL}) WHERE row_num >= 2)
        SELECT sheet_name, min(row_num) AS gap_after FROM (
          SELECT *, lead(row_num) OVER (PARTITION BY sheet_name ORDER BY row_num) - row_num - 1 AS empty_rows FROM filled) g
        WHERE empty_rows >= 100 GROUP BY sheet_name""",
)
def empty_row_stop(spark, folder):
    cells = two_sheets(spark, folder)
    layout = sheets.sheet_layout(cells)
    data = sheets.data_cells(cells, layout)
    return sheets.rows_before_long_gap(data, layout).drop("document_id")
