"""Sampling, column profiles, role assignment and schema checks.

Rows come as ``document_id, sheet_name, row_index, data`` where ``data`` maps column to text. Only
the first rows of each document are read into a profile, so everything after ``head_sample`` is
bounded by documents times sampled rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fields import (
    bare_name,
    is_date_text,
    is_numeric_text,
    is_profile_currency,
    literal_map,
    matches_role,
)
from ..functions.text import prefix_float
from ..session import write_through
from .headers import filled_index
from .spread import first_rows, join_measured

ROW_KEY = ["document_id", "sheet_name", "row_index"]
#: Parts of a document whose first rows are found apart before they are compared.
SAMPLE_PARTS = 64


def row_order(rows: DataFrame) -> list[str]:
    """Sheets in the order of the workbook, where the rows tell it, else by name."""
    return [*(["sheet_no"] if "sheet_no" in rows.columns else []), "sheet_name", "row_index"]


def head_sample(rows: DataFrame, n: int = vocab.SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows of each document, numbered by ``sample_pos``.

    Only keys are ranked: first within parts of a document, so that a huge one is spread, then
    what is left of the parts. The keys found, ``n`` for a document, then pick their rows.
    """
    order = row_order(rows)
    keys = rows.select("document_id", *order)
    part = F.pmod(F.xxhash64("row_index"), F.lit(SAMPLE_PARTS)).alias("_part")
    near = first_rows(
        keys.select("*", part), ["document_id", "_part"], order, n, "_nth").drop("_part", "_nth")
    first = first_rows(near, ["document_id"], order, n, "sample_pos")
    chosen = write_through(first.select(*ROW_KEY, "sample_pos"), "sample-keys")
    return join_measured(rows, chosen, ROW_KEY, "inner")


def sample_cells(sample: DataFrame) -> DataFrame:
    """One row per sampled cell, with the cell's place in its row."""
    return sample.select(
        "document_id", "sample_pos", F.posexplode("data").alias("key_pos", "column", "value")
    )


def distinct_columns(cells: DataFrame) -> DataFrame:
    """Columns of each document in first-seen order (``column_pos`` from 1)."""
    seen = cells.groupBy("document_id", "column").agg(
        F.min(F.struct("sample_pos", "key_pos")).alias("first_seen")
    )
    order = W.partitionBy("document_id").orderBy("first_seen")
    return seen.withColumn("column_pos", F.row_number().over(order)).drop("first_seen")


def column_profile(sample: DataFrame) -> DataFrame:
    """Type and hints of every column from the first rows of data in the sample."""
    start = F.coalesce(F.min(filled_index()).over(W.partitionBy("document_id")), F.lit(0))
    cells = sample.withColumn("start", start).select(
        "document_id", "sample_pos", "start",
        F.posexplode("data").alias("key_pos", "column", "value"),
    )
    at = F.col("sample_pos") - F.col("start")
    used = at.between(1, vocab.PROFILE_ROWS) & F.col("value").isNotNull() & (F.col("value") != "")
    shown = at.between(1, vocab.TYPE_ROWS) & F.col("value").isNotNull()
    value, column = F.when(used, F.col("value")), F.lower("column")
    grouped = cells.groupBy("document_id", "column").agg(
        F.min(F.struct("sample_pos", "key_pos")).alias("first_seen"),
        F.count(value).alias("filled"),
        F.bool_and(F.when(used, is_numeric_text(value))).alias("all_numbers"),
        F.bool_and(F.when(used, is_date_text(value))).alias("all_dates"),
        F.bool_or(F.when(used, is_profile_currency(value))).alias("any_code"),
        F.collect_list(F.when(shown, F.struct("sample_pos", "value"))).alias("shown"),
    )
    number = F.coalesce("all_numbers", F.lit(False))
    named_lat = column.contains("lat") | (column == "y")
    named_lng = column.contains("lng") | column.contains("lon") | (column == "x")
    order = W.partitionBy("document_id").orderBy("first_seen")
    return grouped.select(
        "document_id",
        "column",
        F.row_number().over(order).alias("column_pos"),
        (F.col("filled") == 0).alias("is_empty"),
        F.when(number, "number").when(F.col("all_dates"), "date").otherwise("string")
        .alias("value_type"),
        ((named_lat | named_lng) & number).alias("is_coordinate"),
        (column.contains("curr") | F.coalesce("any_code", F.lit(False))).alias("is_currency"),
        F.transform(F.array_sort("shown"), lambda s: s["value"]).alias("sample_values"),
    )


def column_types(sample: DataFrame) -> DataFrame:
    """Coarse column types from five rows: unknown, coordinate, number, currency, string."""
    cells = sample_cells(sample).filter(F.col("sample_pos") <= vocab.TYPE_ROWS)
    value, code = F.col("value"), F.upper("value")
    present = value.isNotNull()
    like_code = code.isin(vocab.CURRENCIES) | (F.length(code) == 3)
    grouped = cells.groupBy("document_id", "column").agg(
        F.count(value).alias("filled"),
        F.bool_and(F.when(present, prefix_float(value).isNotNull())).alias("all_numbers"),
        F.bool_and(F.when(present, like_code)).alias("all_codes"),
    )
    coordinate = matches_role(F.col("column"), "latitude") | matches_role(
        F.col("column"), "longitude"
    )
    return grouped.select(
        "document_id",
        "column",
        F.when(F.col("filled") == 0, "unknown")
        .when(F.col("all_numbers") & coordinate, "coordinate")
        .when(F.col("all_numbers"), "number")
        .when(F.col("all_codes"), "currency")
        .otherwise("string")
        .alias("column_type"),
    )


def _keyword_hit() -> Column:
    """First keyword, in slot order, contained in the bare column name (``bare``)."""
    entries = ", ".join(
        f"struct('{slot}' AS slot, '{word}' AS word)"
        for slot, words in vocab.ROLE_KEYWORDS.items()
        for word in words
    )
    return F.expr(f"get(filter(array({entries}), entry -> contains(bare, entry.word)), 0)")


def assign_roles(profile: DataFrame) -> DataFrame:
    """Rule-based role of every profiled column; ``slot`` is set when a keyword decided."""
    bare, hit = F.col("bare"), F.col("_hit")
    latitude = bare.contains("lat") | (bare == "y")
    slot_role = literal_map(vocab.SLOT_ROLE)
    by_rule = F.col("is_empty") | F.col("is_coordinate") | F.col("is_currency")
    named = profile.withColumn("bare", bare_name(F.col("column"))).withColumn(
        "_hit", F.when(~by_rule, _keyword_hit())
    )
    return named.select(
        "document_id",
        "column",
        "column_pos",
        F.when(F.col("is_empty"), "empty").otherwise(F.col("value_type")).alias("detected_type"),
        "sample_values",
        F.when(F.col("is_empty"), "irrelevant")
        .when(F.col("is_coordinate"), F.when(latitude, "latitude").otherwise("longitude"))
        .when(F.col("is_currency"), "currency")
        .when(hit.isNotNull(), slot_role[hit["slot"]])
        .otherwise("unknown")
        .alias("role"),
        F.when(by_rule, 1.0).when(hit.isNotNull(), 0.8).otherwise(0.1).alias("confidence"),
        F.when(F.col("is_empty"), "Column is empty")
        .when(F.col("is_coordinate"), "Coordinate pattern detected")
        .when(F.col("is_currency"), "Currency pattern detected")
        .when(hit.isNotNull(), F.concat(F.lit("Keyword match: "), hit["word"]))
        .otherwise("No pattern detected")
        .alias("reasoning"),
        hit["slot"].alias("slot"),
    )


def slot_mapping(roles: DataFrame) -> DataFrame:
    """One row per document with the column chosen for each slot.

    ``slots``: the first column that hit a slot's keywords takes it. ``filled``: an open slot is
    also given to the column with the canonical name, else to the first column with the slot's role.
    """
    picks = []
    for slot in vocab.SLOTS:
        canonical = vocab.SLOT_CANONICAL[slot]
        picks += [
            F.expr(
                f"min(CASE WHEN slot = '{slot}' THEN struct(column_pos, column) END).column"
            ).alias(slot),
            F.expr(
                f"""min(CASE WHEN role = 'irrelevant' THEN NULL
                    WHEN column = '{canonical}' THEN struct(0 AS rank, column_pos, column)
                    WHEN role = '{slot}' THEN struct(1 AS rank, column_pos, column) END).column"""
            ).alias(f"spare_{slot}"),
        ]
    wide = roles.groupBy("document_id").agg(*picks)
    both = ", ".join(f"coalesce({slot}, spare_{slot}) AS {slot}" for slot in vocab.SLOTS)
    return wide.select(
        "document_id",
        F.struct(*vocab.SLOTS).alias("slots"),
        F.expr(f"struct({both})").alias("filled"),
    )


def mapped_slots(names: list[str] | None = None) -> Column:
    """Number of slots that have a column, of all or of the named ones."""
    return F.expr(" + ".join(f"int(slots.{slot} IS NOT NULL)" for slot in names or vocab.SLOTS))


def schema_quality(mapping: DataFrame) -> DataFrame:
    """Completeness, ambiguity and coverage of each document's slot mapping."""
    mapped = mapped_slots()
    return mapping.select(
        "document_id",
        "slots",
        "filled",
        (mapped / 4).alias("completeness"),
        F.when(mapped > 0, 0.3).otherwise(0.9).alias("ambiguity_score"),
        F.lit(1.0).alias("deterministic_coverage"),
        (mapped < 2).alias("needs_review"),
    )


def merge_with_profile(proposed: DataFrame, profile: DataFrame) -> DataFrame:
    """Override a proposed schema where the profile is certain.

    ``proposed`` holds ``document_id, column, role, detected_type, confidence, reasoning, slot,
    slot_confidence`` with one row per proposed column.
    """
    facts = profile.select("document_id", "column", "is_empty", "is_coordinate", "is_currency")
    joined = proposed.join(facts, ["document_id", "column"], "left")
    no = F.lit(False)
    empty = F.coalesce("is_empty", no)
    coordinate, currency = F.coalesce("is_coordinate", no), F.coalesce("is_currency", no)
    name = F.lower("column")
    latitude = name.contains("lat") | (name == "y")
    axis = F.when(latitude, "latitude").otherwise("longitude")
    agreed = (coordinate & (F.col("slot") == axis)) | (currency & (F.col("slot") == "currency"))
    return joined.select(
        "document_id",
        "column",
        F.when(currency, "currency").when(coordinate, axis).when(empty, "irrelevant")
        .otherwise(F.col("role")).alias("role"),
        F.when(empty, "empty").otherwise(F.col("detected_type")).alias("detected_type"),
        F.when(empty | coordinate | currency, 1.0).otherwise(F.col("confidence"))
        .alias("confidence"),
        F.when(
            currency, "Deterministic match: column name or values match currency pattern"
        )
        .when(
            coordinate,
            F.concat(F.lit("Deterministic match: column name matches "), axis, F.lit(" pattern")),
        )
        .when(empty, "Column contains only empty values")
        .otherwise(F.col("reasoning"))
        .alias("reasoning"),
        "slot",
        F.when(agreed, 1.0).otherwise(F.col("slot_confidence")).alias("slot_confidence"),
    )


def verify_schema(quality: DataFrame) -> DataFrame:
    """Reasons why a schema is not good enough; ``passed`` when there are none."""
    mapped = mapped_slots(vocab.REQUIRED_SLOTS)

    def two(name: str) -> Column:
        return F.format_string("%.2f", F.col(name))

    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("completeness") < 0.5,
                F.concat(F.lit("low completeness: "), two("completeness")),
            ),
            F.when(
                F.col("ambiguity_score") > 0.5,
                F.concat(F.lit("high ambiguity: "), two("ambiguity_score")),
            ),
            F.when(
                F.col("deterministic_coverage") < 0.3,
                F.concat(
                    F.lit("low deterministic coverage: "), two("deterministic_coverage")
                ),
            ),
            F.when(F.col("needs_review"), F.lit("marked as needs review")),
            F.when(
                mapped < 2,
                F.concat(F.lit("only "), mapped.cast("string"), F.lit("/4 required fields mapped")),
            ),
        )
    )
    return quality.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


# Fixed value: note on a schema that rules made.
RULES_NOTE = "Schema created via manual inference (LLM failed or timed out)"
QUALITY = ["completeness", "ambiguity_score", "deterministic_coverage", "needs_review"]


def schema_roles(
    sample: DataFrame, proposed: DataFrame | None = None
) -> DataFrame:
    """Role of every column: as proposed and merged with the profile, where a document has a
    proposal, else by the rules. Proposed columns that the sample lacks stay.

    ``proposed`` is what ``merge_with_profile`` takes; its ``column_pos`` orders the columns, else
    their order in the sample does.
    """
    profile = column_profile(sample)
    roles = assign_roles(profile)
    if proposed is None:
        return roles
    merged = merge_with_profile(proposed, profile)
    seen = profile.select("document_id", "column", F.col("column_pos").alias("_seen"), "sample_values")
    places = F.col("_seen")
    if "column_pos" in proposed.columns:
        given = proposed.select("document_id", "column", "column_pos").distinct()
        merged = merged.join(given, ["document_id", "column"])
        places = F.coalesce("column_pos", "_seen")
    columns = [c for c in roles.columns if c != "column_pos"]
    merged = merged.join(seen, ["document_id", "column"], "left").withColumn(
        "column_pos", F.coalesce(places, F.lit(1 << 30)).cast("int"))
    answered = proposed.select("document_id").distinct()
    return roles.join(answered, "document_id", "left_anti").select(*columns, "column_pos").unionByName(
        merged.select(*columns, "column_pos"))


def infer_schema(
    sample: DataFrame, proposed: DataFrame | None = None, mapping: DataFrame | None = None
) -> DataFrame:
    """Schema of every document from its ``head_sample`` with normalised ``data``.

    Profile, proposal or rules, slot mapping, quality, checks.

    A document that has a proposal takes it (merged with the profile); the others take the rules.
    ``slots`` is the mapping as inferred, ``filled`` the one with open slots filled from roles.
    With the ``mapping`` of proposals (``proposed_mapping``) a document that has one keeps the
    slots, quality and notes that were proposed; the rules leave a note of their own.
    """
    schema = schema_quality(slot_mapping(schema_roles(sample, proposed)))
    schema = schema.withColumn("inference_notes", F.array(F.lit(RULES_NOTE)))
    if mapping is not None:
        given = mapping.drop("proposed_unmapped").withColumnsRenamed(
            {c: f"_{c}" for c in [*QUALITY, "inference_notes"]})
        schema = schema.join(given, "document_id", "left")
        has = F.col("proposed_slots").isNotNull()
        slot = {
            name: F.struct(*[
                F.coalesce(F.col("proposed_slots")[x], F.when(keep, F.col(name)[x])).alias(x)
                for x in vocab.SLOTS])
            for name, keep in (("slots", ~has), ("filled", F.lit(True)))
        }
        told = {c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c)) for c in [*QUALITY, "inference_notes"]}
        schema = schema.withColumns(slot | told).drop(
            "proposed_slots", *[f"_{c}" for c in [*QUALITY, "inference_notes"]])
    return verify_schema(schema)


def with_empty_documents(schema: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the schema of documents without rows: no column, quality nothing, to be reviewed."""
    none = F.lit(None).cast("string")
    slots = F.struct(*[none.alias(slot) for slot in vocab.SLOTS])
    empty = documents.select("document_id").distinct().join(
        schema.select("document_id"), "document_id", "left_anti"
    ).select(
        "document_id", slots.alias("slots"), slots.alias("filled"),
        *[F.lit(0.0).alias(c) for c in QUALITY[:3]], F.lit(True).alias("needs_review"),
        F.array().cast("array<string>").alias("inference_notes"))
    return schema.unionByName(verify_schema(empty))


def _column_lists(roles: DataFrame) -> DataFrame:
    """All columns of a document in order, and those without a role; as many as it has columns."""
    column = F.struct(
        "column_pos", F.col("column").alias("name"), "detected_type", "sample_values",
        F.col("role").alias("semantic_role"), "confidence", "reasoning",
    )
    listed = roles.groupBy("document_id").agg(
        F.array_sort(F.array_distinct(F.collect_list(column))).alias("columns"))
    open_columns = F.filter("columns", lambda c: c["semantic_role"] == "unknown")
    return listed.withColumn(
        "unmapped_columns",
        F.transform(open_columns, lambda c: F.struct(c["name"], c["reasoning"].alias("reason"))),
    )


def attach_schema(
    documents: DataFrame, schema: DataFrame, roles: DataFrame | None = None
) -> DataFrame:
    """Documents with their inferred schema as JSON; a document without one keeps its old value.

    With the ``roles`` of its columns, the schema also lists every column and those without a role.
    How it came about is in its ``inference_notes``.
    """
    parts = ["slots", *QUALITY]
    if roles is not None:
        schema = schema.join(_column_lists(roles), "document_id", "left")
        for name in ("columns", "unmapped_columns"):
            kind = schema.schema[name].dataType
            schema = schema.withColumn(name, F.coalesce(name, F.array().cast(kind)))
        parts += ["columns", "unmapped_columns"]
    if "inference_notes" in schema.columns:
        parts.append("inference_notes")
    text = F.to_json(F.struct(*parts))
    fresh = schema.select("document_id", text.alias("_schema"))
    joined = documents.join(fresh, "document_id", "left")
    old = F.col("inferred_schema") if "inferred_schema" in documents.columns else F.lit(None)
    return joined.withColumn("inferred_schema", F.coalesce("_schema", old)).drop("_schema")
