"""Header normalisers, row checks and row candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.fields import parsed_values
from ledgerloom.functions.text import is_blank
from ledgerloom.operators import headers, rows
from ledgerloom.session import spread_small
from ledgerloom.sources.records import row_records, storable
from ledgerloom.plans.extraction import normalize_rows, settled_and_ambiguous

from .registry import query
from .views import CLEAN_SQL, REGISTER_SQL, ROUTED_SQL, register_rows, table

# Header lines made from part columns: repeats, blanks, symbols, mixed case.
HEADER_SQL = """
SELECT p_partkey, unnest(generate_series(1, 6))::BIGINT AS pos,
       unnest([concat(' ', p_name, ' '), p_brand, p_type, concat(p_brand, ' '), '', concat(p_type, chr(9), '(', p_size::VARCHAR, ')!')]) AS header
FROM part
"""
NUMBERED_SQL = """
SELECT p_partkey, pos, CASE WHEN nth > 1 THEN concat(plain, '_', nth::VARCHAR) ELSE plain END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_partkey, plain ORDER BY pos) AS nth FROM (
    SELECT p_partkey, pos, {plain} AS plain FROM ({source}) h) p) n
"""
TRIMMED = "trim(header, ' ' || chr(9))"
CSV_PLAIN = f"lower(regexp_replace({TRIMMED}, '\\s+', '_', 'g'))"
SHEET_PLAIN = f"trim(regexp_replace(lower({TRIMMED}), '[^a-z0-9]+', '_', 'g'), '_')"
STRICT_PLAIN = (
    f"regexp_replace(regexp_replace(lower({TRIMMED}), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
)


def named(plain):
    return f"coalesce(nullif({plain}, ''), concat('column_', pos::VARCHAR))"


def header_lines(spark, folder):
    part = spread_small(table(spark, folder, "part"))
    tail = F.concat(
        F.col("p_type"), F.lit("\t("), F.col("p_size").cast("string"), F.lit(")!")
    )
    line = F.array(
        F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_brand"), F.col("p_type"),
        F.concat("p_brand", F.lit(" ")), F.lit(""), tail,
    )
    return part.select("p_partkey", line.alias("line"))


def numbered_names(lines, names):
    exploded = lines.select("p_partkey", F.posexplode(names).alias("pos", "name"))
    return exploded.withColumn("pos", F.col("pos") + 1)


@query("csv_headers", NUMBERED_SQL.format(plain=named(CSV_PLAIN), source=HEADER_SQL))
def csv_headers(spark, folder):
    return numbered_names(header_lines(spark, folder), headers.csv_headers(F.col("line")))


@query("sheet_headers", NUMBERED_SQL.format(plain=named(SHEET_PLAIN), source=HEADER_SQL))
def sheet_headers(spark, folder):
    return numbered_names(header_lines(spark, folder), headers.sheet_headers(F.col("line")))


STRICT_SQL = NUMBERED_SQL.format(plain=STRICT_PLAIN, source=HEADER_SQL)


@query("strict_headers", STRICT_SQL)
def strict_headers(spark, folder):
    return numbered_names(header_lines(spark, folder), headers.strict_headers(F.col("line")))


@query(
    "duplicate_headers",
    f"""SELECT p_partkey, string_agg(CASE WHEN nth > 1 THEN concat(plain, '_', nth::VARCHAR) END, ',' ORDER BY pos) AS duplicates
        FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, plain ORDER BY pos) AS nth FROM (
          SELECT p_partkey, pos, {STRICT_PLAIN} AS plain FROM ({HEADER_SQL}) h) p) n GROUP BY p_partkey""",
)
def duplicate_headers(spark, folder):
    found = F.array_join(headers.strict_duplicates(F.col("line")), ",")
    return header_lines(spark, folder).select("p_partkey", found.alias("duplicates"))


@query(
    "required_headers",
    f"""SELECT p_partkey, count(DISTINCT name) FILTER (name IN ('brand11', 'brand11_2', '')) = 3 AS complete
        FROM ({STRICT_SQL}) s GROUP BY p_partkey""",
)
def required_headers(spark, folder):
    test = headers.has_required_headers(F.col("line"), ["brand11", "brand11_2", ""])
    return header_lines(spark, folder).select("p_partkey", test.alias("complete"))


@query(
    "blank_cells",
    f"""SELECT count(*) FILTER (coalesce(trim(name), '') = '') AS name,
        count(*) FILTER (coalesce(trim(value), '') = '') AS value,
        count(*) FILTER (coalesce(trim(currency), '') = '') AS currency,
        count(*) FILTER (coalesce(trim(country), '') = '') AS country,
        count(*) FILTER (coalesce(trim(type), '') = '') AS type FROM ({REGISTER_SQL}) r""",
)
def blank_cells(spark, folder):
    raw = register_rows(spark, folder)
    names = ["name", "value", "currency", "country", "type"]
    return raw.agg(
        *[F.count_if(is_blank(F.try_element_at(F.col("raw"), F.lit(n)))).alias(n) for n in names]
    )


def uneven_rows(spark, folder):
    """Rows with three to five values under four headers, some blank, some with other headers."""
    c, key = table(spark, folder, "customer"), F.col("c_custkey")
    text = F.array(
        F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"),
        F.lit("x"), F.lit(" "),
    )
    given = F.slice(text, F.lit(1), (3 + key % 3).cast("int"))
    blank = F.transform(given, lambda v: F.lit("  "))
    names = F.array(
        F.lit("name"), F.lit("segment"), F.lit("nation"),
        F.when(key % 4 == 0, "code").otherwise("type"),
    )
    return c.select(
        F.lit("doc").alias("document_id"), key.alias("row_index"), names.alias("headers"),
        F.when(key % 17 == 0, blank).otherwise(given).alias("values"),
    )


COUNT_ERROR = "CASE WHEN c_custkey % 3 <> 1 THEN concat('Column count mismatch: expected 4, got ', (3 + c_custkey % 3)::VARCHAR) END"
MISSING_ERROR = "CASE WHEN c_custkey % 4 = 0 THEN 'Missing required headers: type' END"
EMPTY_ERROR = "CASE WHEN c_custkey % 17 = 0 THEN 'Empty row' END"


@query(
    "row_checks",
    f"""SELECT c_custkey AS row_index, concat_ws('; ', {COUNT_ERROR}, {MISSING_ERROR}, {EMPTY_ERROR}) AS errors
        FROM customer""",
)
def row_checks(spark, folder):
    errors = rows.row_errors(F.col("headers"), F.col("values"), 4, ["name", "type"])
    return uneven_rows(spark, folder).select("row_index", F.array_join(errors, "; ").alias("errors"))


@query(
    "row_warnings",
    f"""SELECT concat('Row ', c_custkey::VARCHAR, ': ', reason) AS warning,
          concat('sheet s, row ', c_custkey::VARCHAR, ': ', reason) AS sheet_warning FROM (
        SELECT c_custkey, unnest([{COUNT_ERROR}, {MISSING_ERROR}, {EMPTY_ERROR}]) AS reason FROM customer) w
        WHERE reason IS NOT NULL""",
)
def row_warnings(spark, folder):
    errors = rows.row_errors(F.col("headers"), F.col("values"), 4, ["name", "type"])
    _, bad = rows.split_valid(uneven_rows(spark, folder), errors)
    row, reason = F.col("row_index"), F.col("reason")
    return bad.select(
        rows.warning_text(row, reason).alias("warning"),
        rows.warning_text(row, reason, F.lit("s")).alias("sheet_warning"),
    )


@query(
    "kept_rows",
    "SELECT c_custkey AS row_index, c_name AS name, 4::BIGINT AS n FROM customer "
    "WHERE c_custkey % 3 = 1 AND c_custkey % 4 <> 0 AND c_custkey % 17 <> 0",
)
def kept_rows(spark, folder):
    errors = rows.row_errors(F.col("headers"), F.col("values"), 4, ["name", "type"])
    good, _ = rows.split_valid(uneven_rows(spark, folder), errors)
    return good.select(
        "row_index", F.get("values", F.lit(0)).alias("name"), F.size("values").alias("n")
    )


@query(
    "strict_csv_checks",
    """SELECT c_custkey AS row_index, concat_ws('|',
          CASE WHEN c_custkey % 17 = 0 AND c_custkey % 3 <> 2 THEN 'Row is empty.' END,
          CASE WHEN c_custkey % 3 = 0 THEN concat('Missing columns: ', CASE WHEN c_custkey % 4 = 0 THEN 'code' ELSE 'type' END, '.') END,
          CASE WHEN c_custkey % 3 = 2 THEN 'Extra columns detected: 1.' END) AS errors,
          CASE WHEN c_custkey % 3 = 2 AND c_custkey % 17 = 0 THEN 'Extra columns detected: 1.'
               WHEN c_custkey % 17 = 0 THEN 'Row is empty.' ELSE '' END AS sheet_errors
        FROM customer""".replace(
        "CASE WHEN c_custkey % 3 = 2 AND c_custkey % 17 = 0 THEN 'Extra columns detected: 1.'\n"
        "               WHEN c_custkey % 17 = 0",
        "CASE WHEN c_custkey % 17 = 0",
    ),
)
def strict_csv_checks(spark, folder):
    data = uneven_rows(spark, folder)
    count = F.size("values")
    width = F.least(count, F.lit(4))
    values, extra = F.slice("values", F.lit(1), width), F.slice("values", width + 1, F.lit(9))
    raw = F.map_from_arrays(F.slice("headers", F.lit(1), width), values)
    csv = rows.strict_csv_errors(F.col("headers"), values, raw, extra)
    return data.select(
        "row_index",
        F.array_join(csv, "|").alias("errors"),
        F.array_join(rows.strict_sheet_errors(values, extra), "|").alias("sheet_errors"),
    )


@query(
    "strict_sheet_checks",
    """SELECT c_custkey AS row_index, concat_ws('|',
          CASE WHEN c_custkey % 17 = 0 THEN 'Row is empty.' END,
          CASE WHEN c_custkey % 17 <> 0 THEN concat('Extra columns detected: ', CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END, '.') END) AS errors
        FROM customer""",
)
def strict_sheet_checks(spark, folder):
    values, extra = F.slice("values", F.lit(1), F.lit(2)), F.slice("values", F.lit(3), F.lit(9))
    errors = rows.strict_sheet_errors(values, extra)
    return uneven_rows(spark, folder).select("row_index", F.array_join(errors, "|").alias("errors"))


@query(
    "parsed_rows",
    f"""SELECT document_id, row_index, trim(nullif(currency, '')) AS currency,
        trim(nullif(country, '')) AS country, trim(nullif(type, '')) AS type FROM ({REGISTER_SQL}) r""",
)
def parsed_rows(spark, folder):
    data = register_rows(spark, folder).withColumn("p", parsed_values(F.col("raw")))
    cells = [F.try_element_at(F.col("p"), F.lit(n)).alias(n) for n in ("currency", "country", "type")]
    return data.select("document_id", "row_index", *cells)


@query(
    "row_candidates",
    f"""SELECT document_id, row_index, coalesce(nullif(name, ''), concat('asset_', row_index::VARCHAR)) AS raw_asset_name,
        'name,value,currency,country,type,lat,lng' AS keys, 0.8::DOUBLE AS base_confidence FROM ({REGISTER_SQL}) r""",
)
def row_candidates(spark, folder):
    data = normalize_rows(register_rows(spark, folder))
    meta = F.create_map(
        F.lit("sourceRowIndex"), F.col("row_index").cast("string"), F.lit(" "), F.lit("blank key"),
        F.lit("sheetName"), F.lit("s"),
    )
    data = data.withColumn("raw", F.map_concat("raw", meta))
    found = rows.row_candidates(data)
    return found.select(
        "document_id", "row_index", "raw_asset_name",
        F.array_join(F.map_keys("raw"), ",").alias("keys"), "base_confidence",
    )


@query(
    "row_records",
    f"""SELECT r.document_id, r.row_index, coalesce(nullif(r.name, ''), concat('asset_', r.row_index::VARCHAR)) AS raw_asset_name,
        'row_data' AS field_name, 'TABLE_EXTRACTION' AS extraction_method, 'pending' AS review_status,
        FALSE AS is_inferred, r.currency AS raw_currency, r.lat AS raw_lat,
        c.currency AS stored_currency, regexp_replace(c.value::VARCHAR, '\\.0$', '') AS stored_value,
        CASE WHEN t.ambiguous THEN 0.8 ELSE 0.5 + CASE WHEN t.matched THEN 0.3 ELSE 0 END + CASE WHEN t.complete THEN 0.2 ELSE -0.2 END END::DOUBLE AS confidence_score
        FROM ({REGISTER_SQL}) r JOIN ({CLEAN_SQL}) c ON r.document_id = c.document_id AND r.row_index = c.row_index
        JOIN ({ROUTED_SQL}) t ON r.document_id = t.document_id AND r.row_index = t.row_index""",
)
def stored_rows(spark, folder):
    records = storable(row_records(settled_and_ambiguous(register_rows(spark, folder))))
    return records.select(
        "document_id", "row_index", "raw_asset_name", "field_name", "extraction_method",
        "review_status", "is_inferred",
        F.get_json_object("raw_value", "$.currency").alias("raw_currency"),
        F.get_json_object("raw_value", "$.lat").alias("raw_lat"),
        F.get_json_object("normalized_value", "$.currency").alias("stored_currency"),
        F.get_json_object("normalized_value", "$.asset_value").alias("stored_value"),
        "confidence_score",
    )
