"""Profiling, schema inference and routing over the register."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerloom.functions import vocab
from ledgerloom.operators import profiling, routing
from ledgerloom.operators.headers import data_start
from ledgerloom.plans import extraction
from ledgerloom.plans.extraction import normalize_rows, settled_and_ambiguous

from .registry import query
from .views import CLEAN_SQL, ROUTED_SQL, SHORT_CODES, register_rows, table

PLAIN = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"
COLUMNS = {
    "asset_name": "name", "asset_value": PLAIN.format("value"), "currency": "currency",
    "jurisdiction": "country", "asset_type": "type", "latitude": PLAIN.format("lat"),
    "longitude": PLAIN.format("lng"),
}
# Every cell of the first 20 rows of a document.
CELLS_SQL = (
    "WITH placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY row_index) AS pos "
    f"FROM ({CLEAN_SQL}) c) "
    + " UNION ALL ".join(
        f"SELECT document_id, row_index, pos, {i + 1} AS column_pos, '{name}' AS \"column\", {value} AS v "
        "FROM placed WHERE pos <= 20"
        for i, (name, value) in enumerate(COLUMNS.items())
    )
)
PROFILE_SQL = f"""
SELECT document_id, "column", column_pos::BIGINT AS column_pos,
  count(*) FILTER (pos <= 10 AND v <> '') = 0 AS is_empty,
  CASE WHEN coalesce(bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (pos <= 10 AND v <> ''), FALSE)
       THEN 'number' ELSE 'string' END AS value_type,
  coalesce(bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (pos <= 10 AND v <> ''), FALSE)
    AND (contains("column", 'lat') OR contains("column", 'lng') OR contains("column", 'lon')) AS is_coordinate,
  contains("column", 'curr') OR coalesce(bool_or(upper(v) IN ({SHORT_CODES})) FILTER (pos <= 10 AND v <> ''), FALSE) AS is_currency,
  coalesce(string_agg(v, '|' ORDER BY pos) FILTER (pos <= 5), '') AS sample_values
FROM ({CELLS_SQL}) s GROUP BY document_id, "column", column_pos
"""
# Keywords of each slot in the order they are tried.
KEYWORDS_SQL = """VALUES
  (0, 0, 'asset_name', 'asset'), (0, 1, 'asset_name', 'name'), (0, 2, 'asset_name', 'property'),
  (0, 3, 'asset_name', 'building'), (0, 4, 'asset_name', 'facility'), (0, 5, 'asset_name', 'site'),
  (0, 6, 'asset_name', 'location'),
  (1, 0, 'value', 'value'), (1, 1, 'value', 'amount'), (1, 2, 'value', 'price'), (1, 3, 'value', 'valuation'),
  (1, 4, 'value', 'cost'), (1, 5, 'value', 'total'), (1, 6, 'value', 'market'),
  (2, 0, 'currency', 'currency'), (2, 1, 'currency', 'curr'),
  (3, 0, 'jurisdiction', 'jurisdiction'), (3, 1, 'jurisdiction', 'location'), (3, 2, 'jurisdiction', 'country'),
  (3, 3, 'jurisdiction', 'state'), (3, 4, 'jurisdiction', 'province'), (3, 5, 'jurisdiction', 'region'),
  (3, 6, 'jurisdiction', 'city'), (3, 7, 'jurisdiction', 'address'),
  (4, 0, 'latitude', 'lat'), (4, 1, 'latitude', 'latitude'),
  (5, 0, 'longitude', 'lng'), (5, 1, 'longitude', 'lon'), (5, 2, 'longitude', 'longitude'),
  (6, 0, 'asset_type', 'type'), (6, 1, 'asset_type', 'category'), (6, 2, 'asset_type', 'classification'),
  (6, 3, 'asset_type', 'kind')"""
ROLES_SQL = f"""
WITH profile AS ({PROFILE_SQL}), kw(slot_ord, word_ord, slot, word) AS ({KEYWORDS_SQL}),
hits AS (
  SELECT p.document_id, p."column", k.slot, k.word,
    row_number() OVER (PARTITION BY p.document_id, p."column" ORDER BY slot_ord, word_ord) AS rn
  FROM profile p JOIN kw k ON contains(regexp_replace(lower(p."column"), '[^a-z0-9]', '', 'g'), k.word)
  WHERE NOT p.is_empty AND NOT p.is_coordinate AND NOT p.is_currency)
SELECT p.document_id, p."column", p.column_pos,
  CASE WHEN is_empty THEN 'empty' ELSE value_type END AS detected_type,
  CASE WHEN is_empty THEN 'irrelevant'
       WHEN is_coordinate THEN CASE WHEN contains(p."column", 'lat') THEN 'latitude' ELSE 'longitude' END
       WHEN is_currency THEN 'currency' WHEN h.slot = 'asset_type' THEN 'metadata'
       ELSE coalesce(h.slot, 'unknown') END AS role,
  CASE WHEN is_empty OR is_coordinate OR is_currency THEN 1.0 WHEN h.slot IS NOT NULL THEN 0.8 ELSE 0.1 END::DOUBLE AS confidence,
  CASE WHEN is_empty THEN 'Column is empty' WHEN is_coordinate THEN 'Coordinate pattern detected'
       WHEN is_currency THEN 'Currency pattern detected'
       WHEN h.slot IS NOT NULL THEN concat('Keyword match: ', h.word) ELSE 'No pattern detected' END AS reasoning,
  h.slot AS slot
FROM profile p LEFT JOIN hits h ON h.rn = 1 AND h.document_id = p.document_id AND h."column" = p."column"
"""
MAPPING_SQL = f"""
SELECT document_id, {', '.join(f"min_by(CASE WHEN slot = '{s}' THEN {chr(34)}column{chr(34)} END, CASE WHEN slot = '{s}' THEN column_pos END) AS {s}" for s in vocab.SLOTS)}
FROM ({ROLES_SQL}) r GROUP BY document_id
"""
MAPPED = " + ".join(f"({s} IS NOT NULL)::INT" for s in vocab.SLOTS)
REQUIRED = " + ".join(f"({s} IS NOT NULL)::INT" for s in vocab.REQUIRED_SLOTS)


def sample_of(spark, folder):
    """First rows of each document, normalised."""
    return normalize_rows(profiling.head_sample(register_rows(spark, folder)))


def rows_of(spark, folder):
    return normalize_rows(register_rows(spark, folder))


@query(
    "route_documents",
    f"""SELECT document_id, count(*) AS total_rows,
       count(*) FILTER (NOT ambiguous) AS deterministic_rows,
       count(*) FILTER (ambiguous) AS ambiguous_rows,
       round(avg(CASE WHEN NOT ambiguous THEN
             0.5 + CASE WHEN matched THEN 0.3 ELSE 0 END + CASE WHEN complete THEN 0.2 ELSE -0.2 END
             END), 6) AS mean_confidence
FROM ({ROUTED_SQL}) GROUP BY document_id""",
)
def route_documents(spark, folder):
    return routing.route_counts(settled_and_ambiguous(register_rows(spark, folder)))


@query(
    "head_sample",
    f"""SELECT document_id, row_index, pos AS sample_pos FROM (
        SELECT document_id, row_index, row_number() OVER (PARTITION BY document_id ORDER BY row_index) AS pos
        FROM ({CLEAN_SQL})) p WHERE pos <= 20""",
)
def head_sample(spark, folder):
    sample = sample_of(spark, folder)
    return sample.select("document_id", "row_index", "sample_pos")


@query(
    "distinct_columns",
    f'SELECT DISTINCT document_id, "column", column_pos::BIGINT AS column_pos FROM ({CELLS_SQL}) c',
)
def distinct_columns(spark, folder):
    sample = sample_of(spark, folder)
    return profiling.distinct_columns(profiling.sample_cells(sample))


@query("column_profile", PROFILE_SQL)
def column_profile(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    return profile.withColumn("sample_values", F.array_join("sample_values", "|"))


@query(
    "column_types",
    f"""SELECT document_id, "column",
        CASE WHEN count(v) = 0 THEN 'unknown'
             WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN
               CASE WHEN "column" IN ('latitude', 'longitude') THEN 'coordinate' ELSE 'number' END
             WHEN bool_and(length(v) = 3) THEN 'currency' ELSE 'string' END AS column_type
        FROM (SELECT *, CASE WHEN v IS NOT NULL THEN v END AS w FROM ({CELLS_SQL}) WHERE pos <= 5) c
        WHERE v IS NOT NULL OR TRUE GROUP BY document_id, "column" """.replace(
        "bool_and(try_cast(v AS DOUBLE) IS NOT NULL)",
        "bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (v IS NOT NULL)",
    ),
)
def column_types(spark, folder):
    return profiling.column_types(sample_of(spark, folder))


@query(
    "data_start",
    """WITH cells AS (
         SELECT concat('n', c_nationkey::VARCHAR) AS document_id,
           row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos,
           (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 5 = 0)::INT AS filled
         FROM customer)
       SELECT document_id, coalesce(min(pos - 1) FILTER (filled >= 2 AND pos <= 20), 0) AS start
       FROM cells GROUP BY document_id""",
)
def data_start_rows(spark, folder):
    customers = table(spark, folder, "customer")
    key = F.col("c_custkey")
    data = F.create_map(
        F.lit("a"), F.when(key % 3 == 0, F.col("c_name")),
        F.lit("b"), F.when(key % 4 == 0, F.col("c_mktsegment")).otherwise(""),
        F.lit("c"), F.when(key % 5 == 0, F.col("c_acctbal").cast("string")),
    )
    rows = customers.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("document_id"),
        F.lit("").alias("sheet_name"), key.alias("row_index"), data.alias("data"),
    )
    return data_start(profiling.head_sample(rows))


@query("column_roles", ROLES_SQL)
def column_roles(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    return profiling.assign_roles(profile).drop("sample_values")


@query("slot_mapping", MAPPING_SQL)
def slot_mapping(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    mapping = profiling.slot_mapping(profiling.assign_roles(profile))
    return mapping.select("document_id", "slots.*")


@query(
    "filled_slots",
    f"""SELECT DISTINCT document_id, 'asset_name' AS asset_name, 'asset_value' AS value, 'currency' AS currency,
        'jurisdiction' AS jurisdiction, 'latitude' AS latitude, 'longitude' AS longitude,
        'asset_type' AS asset_type FROM ({CLEAN_SQL}) c""",
)
def filled_slots(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    mapping = profiling.slot_mapping(profiling.assign_roles(profile))
    return mapping.select("document_id", "filled.*")


@query(
    "schema_quality",
    f"""SELECT document_id, ({MAPPED}) / 4.0::DOUBLE AS completeness,
        CASE WHEN {MAPPED} > 0 THEN 0.3 ELSE 0.9 END::DOUBLE AS ambiguity_score,
        1.0::DOUBLE AS deterministic_coverage, {MAPPED} < 2 AS needs_review FROM ({MAPPING_SQL}) m""",
)
def schema_quality(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    mapping = profiling.slot_mapping(profiling.assign_roles(profile))
    return profiling.schema_quality(mapping).drop("slots", "filled")


PROPOSED_SQL = """
SELECT document_id, "column", CASE column_pos % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'asset_name' ELSE 'value' END AS role,
       'string' AS detected_type, 0.5 AS confidence, 'proposed' AS reasoning,
       CASE "column" WHEN 'latitude' THEN 'latitude' WHEN 'longitude' THEN 'latitude' WHEN 'currency' THEN 'currency'
            WHEN 'asset_name' THEN 'asset_name' END AS slot, 0.6 AS slot_confidence
FROM profile
"""


@query(
    "merged_schema",
    f"""WITH profile AS ({PROFILE_SQL}), proposed AS ({PROPOSED_SQL})
        SELECT p.document_id, p."column",
          CASE WHEN is_currency THEN 'currency'
               WHEN is_coordinate THEN CASE WHEN contains(p."column", 'lat') THEN 'latitude' ELSE 'longitude' END
               WHEN is_empty THEN 'irrelevant' ELSE role END AS role,
          CASE WHEN is_empty THEN 'empty' ELSE detected_type END AS detected_type,
          CASE WHEN is_empty OR is_coordinate OR is_currency THEN 1.0 ELSE confidence END::DOUBLE AS confidence,
          CASE WHEN is_currency THEN 'Deterministic match: column name or values match currency pattern'
               WHEN is_coordinate THEN concat('Deterministic match: column name matches ', CASE WHEN contains(p."column", 'lat') THEN 'latitude' ELSE 'longitude' END, ' pattern')
               WHEN is_empty THEN 'Column contains only empty values' ELSE reasoning END AS reasoning,
          slot, CASE WHEN (is_coordinate AND p."column" = slot) OR (is_currency AND slot = 'currency') THEN 1.0 ELSE slot_confidence END::DOUBLE AS slot_confidence
        FROM proposed p JOIN profile f ON p.document_id = f.document_id AND p."column" = f."column" """,
)
def merged_schema(spark, folder):
    profile = profiling.column_profile(sample_of(spark, folder))
    role = (
        F.when(F.col("column_pos") % 3 == 0, "unknown")
        .when(F.col("column_pos") % 3 == 1, "asset_name").otherwise("value")
    )
    column = F.col("column")
    slot = (
        F.when(column.isin("latitude", "longitude"), "latitude")
        .when(column.isin("currency", "asset_name"), column)
    )
    proposed = profile.select(
        "document_id", "column", role.alias("role"), F.lit("string").alias("detected_type"),
        F.lit(0.5).alias("confidence"), F.lit("proposed").alias("reasoning"),
        slot.alias("slot"), F.lit(0.6).alias("slot_confidence"),
    )
    return profiling.merge_with_profile(proposed, profile)


INFERRED_SQL = f"""
SELECT document_id, asset_name AS name_column, value AS value_column,
  ({MAPPED}) / 4.0::DOUBLE AS completeness, {MAPPED} < 2 AS needs_review,
  concat_ws('; ', CASE WHEN ({MAPPED}) / 4.0 < 0.5 THEN concat('low completeness: ', printf('%.2f', ({MAPPED}) / 4.0)) END,
    CASE WHEN {MAPPED} = 0 THEN 'high ambiguity: 0.90' END,
    CASE WHEN {MAPPED} < 2 THEN 'marked as needs review' END,
    CASE WHEN {REQUIRED} < 2 THEN concat('only ', ({REQUIRED})::VARCHAR, '/4 required fields mapped') END) AS reasons
FROM {{mapping}} m
"""


@query("inferred_schema", INFERRED_SQL.format(mapping=f"({MAPPING_SQL})"))
def inferred_schema(spark, folder):
    schema = profiling.infer_schema(sample_of(spark, folder))
    return schema.select(
        "document_id", F.col("slots.asset_name").alias("name_column"),
        F.col("slots.value").alias("value_column"), "completeness", "needs_review",
        F.array_join("reasons", "; ").alias("reasons"),
    )


BARE_MAPPING_SQL = """
(SELECT concat('n', c_nationkey::VARCHAR) AS document_id, NULL::VARCHAR AS asset_name, NULL::VARCHAR AS value, NULL::VARCHAR AS currency,
        CASE WHEN c_nationkey % 2 = 0 THEN 'city' END AS jurisdiction, NULL AS latitude, NULL AS longitude,
        NULL AS asset_type FROM customer GROUP BY c_nationkey)
"""


@query("verified_schema", INFERRED_SQL.format(mapping=BARE_MAPPING_SQL))
def verified_schema(spark, folder):
    """Documents whose columns hardly map: two unknown columns, and a city in every other one."""
    customers = table(spark, folder, "customer")
    city = F.when(F.col("c_nationkey") % 2 == 0, "city").otherwise("zone")
    data = F.map_from_arrays(
        F.array(F.lit("note"), city), F.array(F.col("c_name"), F.col("c_mktsegment"))
    )
    rows = customers.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("document_id"),
        F.lit("").alias("sheet_name"), F.col("c_custkey").alias("row_index"), data.alias("data"),
    )
    schema = profiling.infer_schema(profiling.head_sample(rows))
    return schema.select(
        "document_id", F.col("slots.asset_name").alias("name_column"),
        F.col("slots.value").alias("value_column"), "completeness", "needs_review",
        F.array_join("reasons", "; ").alias("reasons"),
    )


SLOT_LIST = "concat_ws(',', " + ", ".join(f"coalesce({s}, '-')" for s in vocab.SLOTS) + ")"


@query(
    "attached_schema",
    f"""SELECT d.original_file_name, m.completeness, m.ambiguity_score, m.deterministic_coverage, m.needs_review, m.slots, m.notes, r.columns, r.unmapped FROM
        (SELECT concat('doc-', (c_custkey - 1)::VARCHAR) AS document_id, c_name AS original_file_name FROM customer) d
        LEFT JOIN (SELECT document_id, ({MAPPED}) / 4.0::DOUBLE AS completeness, CASE WHEN {MAPPED} > 0 THEN 0.3 ELSE 0.9 END::DOUBLE AS ambiguity_score,
                     1.0::DOUBLE AS deterministic_coverage, {MAPPED} < 2 AS needs_review, {SLOT_LIST} AS slots,
                     'Schema created via manual inference (LLM failed or timed out)' AS notes
                   FROM ({MAPPING_SQL})) m ON d.document_id = m.document_id
        LEFT JOIN (SELECT document_id, string_agg(concat_ws(':', "column", role, detected_type, confidence::VARCHAR, reasoning), '|' ORDER BY column_pos) AS columns,
                     coalesce(string_agg(concat("column", ':', reasoning), '|' ORDER BY column_pos) FILTER (role = 'unknown'), '') AS unmapped
                   FROM ({ROLES_SQL}) GROUP BY document_id) r ON d.document_id = r.document_id""",
)
def attached_schema(spark, folder):
    """Documents with the whole schema of their rows; those without rows keep none."""
    documents = table(spark, folder, "customer").select(
        F.concat(F.lit("doc-"), (F.col("c_custkey") - 1).cast("string")).alias("document_id"),
        F.col("c_name").alias("original_file_name"),
    )
    sample = sample_of(spark, folder)
    attached = profiling.attach_schema(
        documents, profiling.infer_schema(sample), profiling.schema_roles(sample))
    whole = F.from_json(
        "inferred_schema",
        "slots map<string,string>, completeness double, ambiguity_score double, deterministic_coverage double, needs_review boolean, "
        "inference_notes array<string>, columns array<struct<name string, semantic_role string, detected_type string, confidence string, reasoning string>>, "
        "unmapped_columns array<struct<name string, reason string>>")
    read = attached.withColumn("s", whole)
    slots = [F.coalesce(F.try_element_at("s.slots", F.lit(s)), F.lit("-")) for s in vocab.SLOTS]

    def joined(column, *names):
        text = F.transform(column, lambda c: F.concat_ws(":", *[c[n] for n in names]))
        return F.when(F.col("s").isNotNull(), F.array_join(text, "|"))

    return read.select(
        "original_file_name", "s.completeness", "s.ambiguity_score", "s.deterministic_coverage", "s.needs_review",
        F.when(F.col("s").isNotNull(), F.concat_ws(",", *slots)).alias("slots"),
        F.when(F.col("s").isNotNull(), F.array_join("s.inference_notes", "|")).alias("notes"),
        joined("s.columns", "name", "semantic_role", "detected_type", "confidence", "reasoning").alias("columns"),
        joined("s.unmapped_columns", "name", "reason").alias("unmapped"))


def sample_schema_provider(columns, rows):
    """Stand-in for a model: accepts, is late, fails, or answers nonsense, as the rows say."""
    mode = rows[0]["mode"]
    if mode == "m1":
        time.sleep(4)
    if mode == "m2":
        raise RuntimeError("busy")
    if mode == "m3":
        return "no schema at all"
    told = [
        {"name": c, "detectedType": "string", "semanticRole": "asset_name" if c == "title" else "unknown",
         "confidence": 0.7, "reasoning": f"{len(rows)} rows"} for c in [*columns, "ghost"]
    ]
    return {
        "columns": told, "unmappedColumns": [],
        "fieldMapping": {"assetNameColumn": {"column": "title", "confidence": 0.9},
                         "valueColumn": {"column": "ghost", "confidence": 0.4},
                         "currencyColumn": {"column": "", "confidence": 0}},
        "schemaQuality": {"completeness": 0.75, "ambiguityScore": 0.2, "deterministicCoverage": 0.6,
                          "needsReview": False},
        "inferenceNotes": ["read by the provider"],
    }


def moody_documents(spark, folder):
    """Documents of customers by nation, whose rows tell a mode, and one without rows per region."""
    customers, region = table(spark, folder, "customer"), table(spark, folder, "region")
    mode = F.concat(F.lit("m"), (F.col("c_nationkey") % 4).cast("string"))
    name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    raw = F.map_from_arrays(F.array(F.lit("title"), F.lit("mode")), F.array(F.col("c_name"), mode))
    rows = customers.select(
        name.alias("document_id"), F.lit("").alias("sheet_name"), F.col("c_custkey").alias("row_index"),
        raw.alias("raw"))
    empty = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("document_id"))
    return rows, rows.select("document_id").distinct().unionByName(empty)


MOODS_SQL = """
SELECT *, CASE mood WHEN 0 THEN 'accepted' WHEN -1 THEN 'empty' ELSE 'rules' END AS came FROM (
  SELECT concat('n', c_nationkey::VARCHAR) AS document_id, c_nationkey % 4 AS mood, least(20, count(*)) AS n FROM customer GROUP BY c_nationkey
  UNION ALL SELECT concat('r', r_regionkey::VARCHAR), -1, 0 FROM region)
"""


@query(
    "proposed_schemas",
    f"""SELECT document_id, CASE came WHEN 'accepted' THEN 'title' END AS name_column, CASE came WHEN 'accepted' THEN 'ghost' END AS value_column,
          CASE came WHEN 'accepted' THEN 0.75 ELSE 0 END::DOUBLE AS completeness,
          CASE came WHEN 'accepted' THEN 0.2 WHEN 'rules' THEN 0.9 ELSE 0 END::DOUBLE AS ambiguity_score,
          CASE came WHEN 'accepted' THEN 0.6 WHEN 'rules' THEN 1 ELSE 0 END::DOUBLE AS deterministic_coverage,
          came <> 'accepted' AS needs_review, came = 'accepted' AS passed,
          CASE came WHEN 'accepted' THEN '' ELSE concat('low completeness: 0.00; ', CASE came WHEN 'rules' THEN 'high ambiguity: 0.90; ' ELSE 'low deterministic coverage: 0.00; ' END,
            'marked as needs review; only 0/4 required fields mapped') END AS reasons,
          CASE came WHEN 'accepted' THEN 'read by the provider' WHEN 'rules' THEN 'Schema created via manual inference (LLM failed or timed out)' ELSE '' END AS notes,
          CASE mood WHEN 1 THEN 'LLM schema inference timeout' WHEN 2 THEN 'RuntimeError: busy' WHEN 3 THEN 'not a schema' END AS error,
          CASE came WHEN 'accepted' THEN 'title,mode,ghost' WHEN 'rules' THEN 'title,mode' ELSE '' END AS columns,
          CASE came WHEN 'accepted' THEN concat(n::VARCHAR, ' rows') WHEN 'rules' THEN 'No pattern detected' END AS why
        FROM ({MOODS_SQL}) m""",
)
def proposed_schemas(spark, folder):
    """Proposals that are accepted, late, failed or nonsense, and documents without rows."""
    rows, documents = moody_documents(spark, folder)
    schema, roles, failed = extraction.proposed_schemas(rows, documents, sample_schema_provider, 0.5)
    attached = profiling.attach_schema(documents, schema, roles).join(
        schema.select("document_id", "reasons", "passed"), "document_id"
    ).join(failed, "document_id", "left")
    whole = F.from_json(
        "inferred_schema",
        "slots map<string,string>, completeness double, ambiguity_score double, deterministic_coverage double, "
        "needs_review boolean, inference_notes array<string>, columns array<struct<name string, reasoning string>>")
    read = attached.withColumn("s", whole)
    return read.select(
        "document_id", F.col("s.slots")["asset_name"].alias("name_column"), F.col("s.slots")["value"].alias("value_column"),
        *[F.col(f"s.{c}").alias(c) for c in ("completeness", "ambiguity_score", "deterministic_coverage", "needs_review")],
        "passed", F.array_join("reasons", "; ").alias("reasons"), F.array_join("s.inference_notes", "|").alias("notes"),
        "error", F.array_join(F.transform("s.columns", lambda c: c["name"]), ",").alias("columns"),
        F.get(F.transform("s.columns", lambda c: c["reasoning"]), F.lit(0)).alias("why"))


@query(
    "workbook_order_sample",
    """SELECT document_id, sheet_name, row_index, sample_pos FROM (
         SELECT concat('d', (s_nationkey % 3)::VARCHAR) AS document_id, concat(chr(90 - s_nationkey::INT), 'heet') AS sheet_name, s_suppkey AS row_index,
           row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_nationkey, s_suppkey) AS sample_pos FROM supplier) p WHERE sample_pos <= 20""",
)
def workbook_order_sample(spark, folder):
    """Sheets whose names run against their order in the workbook."""
    supplier = table(spark, folder, "supplier")
    letter = F.char(F.lit(90) - F.col("s_nationkey"))
    rows = supplier.select(
        F.concat(F.lit("d"), (F.col("s_nationkey") % 3).cast("string")).alias("document_id"),
        F.concat(letter, F.lit("heet")).alias("sheet_name"), F.col("s_nationkey").alias("sheet_no"),
        F.col("s_suppkey").alias("row_index"), F.create_map(F.lit("a"), F.col("s_name")).alias("raw"))
    return profiling.head_sample(rows).select("document_id", "sheet_name", "row_index", "sample_pos")


@query(
    "ambiguity_reasons",
    f"""SELECT document_id, row_index, concat_ws(',',
          CASE WHEN code IS NULL THEN 'missing_or_invalid_currency' END,
          CASE WHEN coalesce(country, '') = '' THEN 'missing_jurisdiction' END,
          CASE WHEN coalesce(type, '') = '' THEN 'missing_asset_type' END,
          CASE WHEN abs(lat) > 90 OR abs(lng) > 180 THEN 'invalid_coordinates' END) AS reasons,
          CASE WHEN ambiguous THEN 'ambiguous' ELSE 'deterministic' END AS route,
          CASE WHEN NOT ambiguous THEN 0.5 + CASE WHEN matched THEN 0.3 ELSE 0 END + CASE WHEN complete THEN 0.2 ELSE -0.2 END END::DOUBLE AS overall_confidence
        FROM ({ROUTED_SQL}) r""",
)
def ambiguity_reasons(spark, folder):
    routed = settled_and_ambiguous(register_rows(spark, folder))
    return routed.select(
        "document_id", "row_index", F.array_join("reasons", ",").alias("reasons"), "route",
        "overall_confidence",
    )


@query(
    "first_confidence",
    f"""SELECT document_id, row_index, matched, complete,
        greatest(0, least(1, 0.5 + CASE WHEN matched THEN 0.3 ELSE 0 END + CASE WHEN complete THEN 0.2 ELSE -0.2 END))::DOUBLE AS confidence
        FROM ({ROUTED_SQL}) r""",
)
def first_confidence(spark, folder):
    routed = settled_and_ambiguous(register_rows(spark, folder))
    match, complete = routing.has_schema_match(), routing.has_critical_fields()
    return routed.select(
        "document_id", "row_index", match.alias("matched"), complete.alias("complete"),
        routing.initial_confidence(match, complete).alias("confidence"),
    )


@query(
    "fallback_ambiguity",
    f"""SELECT document_id, row_index,
          (coalesce(currency, '') <> '' AND length(currency) <> 3)
            OR (coalesce(type, '') = '') AS by_fallback,
          coalesce(lat, 0) = 0 OR coalesce(lng, 0) = 0 AS asks
        FROM ({CLEAN_SQL}) c""",
)
def fallback_ambiguity(spark, folder):
    """Both alternate tests, with the type and the coordinate slots left open."""
    rows = rows_of(spark, folder)
    slots = F.struct(
        *[
            F.lit(None if s in ("asset_type", "latitude", "longitude") else vocab.SLOT_CANONICAL[s])
            .cast("string").alias(s)
            for s in vocab.SLOTS
        ]
    )
    rows = rows.withColumn("slots", slots)
    return rows.select(
        "document_id", "row_index", routing.is_ambiguous_by_fallback().alias("by_fallback"),
        routing.needs_enrichment().alias("asks"),
    )


@query(
    "row_batches",
    f"""SELECT document_id, route, batch_id, count(*) AS n, min(row_index) AS first_row, max(row_index) AS last_row FROM (
          SELECT document_id, row_index, CASE WHEN ambiguous THEN 'ambiguous' ELSE 'deterministic' END AS route,
            ((row_number() OVER (PARTITION BY document_id, ambiguous ORDER BY row_index) - 1)
              // CASE WHEN ambiguous THEN 50 ELSE 5000 END) AS batch_id
          FROM ({ROUTED_SQL})) b GROUP BY ALL""",
)
def row_batches(spark, folder):
    batched = routing.with_batches(settled_and_ambiguous(register_rows(spark, folder)))
    return batched.groupBy("document_id", "route", "batch_id").agg(
        F.count("*").alias("n"), F.min("row_index").alias("first_row"),
        F.max("row_index").alias("last_row"),
    )
