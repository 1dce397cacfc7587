"""Stored tables: their columns, and scans with pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the stored tables. Scores are rounded to two decimals when stored.
SCHEMAS = {
    "documents": (
        "document_id string, original_file_name string, storage_key string, mime_type string, "
        "file_size bigint, checksum_sha256 string, ingestion_status string, "
        "inferred_schema string, session_id string, created_at timestamp"
    ),
    "processing_jobs": (
        "job_id string, document_id string, session_id string, job_type string, status string, "
        "attempt_count int, started_at timestamp, completed_at timestamp, error_summary string"
    ),
    "extracted_asset_fields": (
        "record_id string, document_id string, extraction_job_id string, raw_asset_name string, "
        "overall_confidence decimal(5,2), review_status string, field_name string, "
        "raw_value string, normalized_value string, confidence_score decimal(5,2), "
        "extraction_method string, is_inferred boolean, inference_explanation string, "
        "validation_status string, source_row_index bigint, source_sheet_name string, "
        "created_at timestamp"
    ),
    "validation_flags": (
        "entity_type string, entity_id string, flag_type string, severity string, "
        "explanation string, created_at timestamp"
    ),
    "review_queue": (
        "review_id string, entity_type string, entity_id string, review_reason string, "
        "priority int, "
        "assigned_to string, status string, resolution_notes string, resolved_by string, "
        "resolved_at timestamp, created_at timestamp"
    ),
    "sessions": (
        "session_id string, name string, created_by string, updated_by string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "document_pages": (
        "document_id string, page_number int, has_text_layer boolean, ocr_required boolean, "
        "detected_layout string, page_classification string, confidence_score decimal(5,2)"
    ),
}

# Columns that rows carry under another name before they are stored.
ROW_NAMES = {"source_row_index": "row_index", "source_sheet_name": "sheet_name"}
# What a new row holds where nothing else is said.
DEFAULTS = {
    "documents": {"ingestion_status": "processing"},
    "processing_jobs": {"attempt_count": 0},
    "extracted_asset_fields": {"review_status": "pending"},
    "review_queue": {"status": "pending"},
}


def table_row(df: DataFrame, name: str, created_at: Column | None = None) -> DataFrame:
    """``df`` with exactly the columns of a stored table, in their order and types.

    Row position and sheet go under their stored names, an empty sheet name is null, and
    ``created_at`` is the given time or now, except for rows that have one. A review without an id
    gets one from what it is about. Columns the table doesn't have are dropped, missing ones null.
    """
    now = created_at if created_at is not None else F.current_timestamp()
    columns = []
    for field in T.StructType.fromDDL(SCHEMAS[name]).fields:
        known = next((c for c in (field.name, ROW_NAMES.get(field.name)) if c in df.columns), None)
        value = F.col(known) if known else F.lit(None)
        if field.name == "source_sheet_name":
            value = F.nullif(value, F.lit(""))
        elif field.name == "created_at":
            value = F.coalesce(value, now)
        elif field.name == "review_id" and not known:
            value = F.sha2(F.concat_ws("|", F.lit("review"), "entity_type", "entity_id"), 256)
        elif field.name in DEFAULTS.get(name, {}):
            value = F.coalesce(value, F.lit(DEFAULTS[name][field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def read_table(
    spark: SparkSession, root: str, name: str, where: Column | None = None
) -> DataFrame:
    """Scan of a stored table: rows of committed batches; a filter on plain columns reaches the files."""
    from .commits import committed

    columns = [f.name for f in T.StructType.fromDDL(SCHEMAS[name]).fields]
    return committed(spark, root, name, where).select(*columns)
