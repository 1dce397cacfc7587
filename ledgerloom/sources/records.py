"""Record, flag and review sinks, and the result summary of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import json_object
from ..operators.enrichment import merge_into_stored
from ..operators.maintenance import apply_changes, delete_rows
from ..operators.rows import row_candidates
from ..operators.scoring import entity_id
from .commits import commit, rewrite

NUMERIC_KEYS = vocab.COORDINATE_FIELDS + vocab.AMOUNT_FIELDS


def row_records(rows: DataFrame, job_id: Column | None = None) -> DataFrame:
    """Stored form of settled rows; rows without data are left out."""
    candidates = row_candidates(rows).filter(F.size("raw") > 0)
    given = F.col("overall_confidence") if "overall_confidence" in rows.columns else F.lit(None)
    score = F.coalesce(given.cast("double"), F.lit(vocab.DEFAULT_CONFIDENCE))
    return candidates.select(
        "document_id",
        "sheet_name",
        "row_index",
        entity_id().alias("record_id"),
        (job_id if job_id is not None else F.lit(None).cast("string")).alias("extraction_job_id"),
        "raw_asset_name",
        score.alias("overall_confidence"),
        F.lit("pending").alias("review_status"),
        F.lit("row_data").alias("field_name"),
        json_object(F.col("raw")).alias("raw_value"),
        json_object(F.col("data"), NUMERIC_KEYS).alias("normalized_value"),
        score.alias("confidence_score"),
        F.lit("TABLE_EXTRACTION").alias("extraction_method"),
        F.lit(False).alias("is_inferred"),
        F.lit(None).cast("string").alias("inference_explanation"),
    )


def storable(records: DataFrame) -> DataFrame:
    """Records that may be stored: a field name is required."""
    return records.filter(F.col("field_name").isNotNull() & (F.trim("field_name") != ""))


def write_rows(
    df: DataFrame, root: str, name: str, created_at: Column | None = None,
    batch_id: str | None = None,
) -> None:
    """Add rows to a stored table as one batch; a batch id that was used before is replaced."""
    commit(df.sparkSession, root, {name: df}, batch_id, created_at)


def append_batch(
    records: DataFrame, root: str, created_at: Column | None = None, batch_id: str | None = None
) -> DataFrame:
    """Store a batch whole or not at all. Result: no rows, or one error per record when it failed.

    A batch repeated under its id, as after a lost reply, replaces itself instead of adding rows.
    """
    spark = records.sparkSession
    try:
        write_rows(storable(records), root, "extracted_asset_fields", created_at, batch_id)
    except Exception as error:  # without a mark nothing of it counts; report every row
        reason = f"Batch transaction failed: {str(error).splitlines()[0]}"
        return records.select("document_id", "row_index", F.lit(reason).alias("reason"))
    return spark.createDataFrame([], "document_id string, row_index bigint, reason string")


def write_enrichment(
    result, root: str, created_at: Column | None = None, batch_id: str | None = None
) -> None:
    """Write enriched records, flags and review items as one batch over three tables."""
    tables = {
        "extracted_asset_fields": result.records, "validation_flags": result.flags,
        "review_queue": result.reviews,
    }
    commit(result.records.sparkSession, root, tables, batch_id, created_at)


def merge_enrichment(spark: SparkSession, root: str, enriched: DataFrame) -> list[int]:
    """Merge enrichment into the stored records; only the buckets of its documents are rewritten."""
    return rewrite(
        spark, root, "extracted_asset_fields", enriched,
        lambda stored: merge_into_stored(stored, enriched))


def change_reviews(spark: SparkSession, root: str, changes: DataFrame, columns: list[str]) -> list[int]:
    """Apply partial changes (``review_id, changed_at`` and ``columns``) to the stored queue."""
    return rewrite(
        spark, root, "review_queue", changes,
        lambda stored: apply_changes(stored, changes, "review_id", columns))


def delete_documents(spark: SparkSession, root: str, doomed: DataFrame) -> list[int]:
    """Remove the stored records of the documents listed in ``doomed``."""
    return rewrite(
        spark, root, "extracted_asset_fields", doomed,
        lambda stored: delete_rows(stored, doomed, ["document_id"]))


def extraction_summary(documents: DataFrame, counts: DataFrame, warnings: DataFrame) -> DataFrame:
    """Result of each document: source file, type, row counts, number of warnings.

    ``counts`` is ``route_counts``; ``warnings`` has one row per warning and stays a table of its
    own, since one file can have any number of them.
    """
    per_document = warnings.groupBy("document_id").agg(F.count("*").alias("warning_count"))
    joined = documents.join(counts, "document_id", "left").join(per_document, "document_id", "left")
    zero = F.lit(0)
    return joined.select(
        "document_id",
        F.col("original_file_name").alias("source_file"),
        "file_type",
        F.coalesce("total_rows", zero).alias("row_count"),
        F.coalesce("warning_count", zero).alias("warning_count"),
        F.coalesce("deterministic_rows", zero).alias("persisted_count"),
        F.coalesce("ambiguous_rows", zero).alias("enriched_count"),
    )
