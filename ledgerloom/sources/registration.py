"""Uploaded files: type routing, admission, document and job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.fields import file_extension, file_type, mime_for_type
from ..operators.spread import join_per_key
from ..session import write_through
from .tables import table_row

# Error codes of rejected files.
VALIDATION_FAILED = "VALIDATION_FAILED"
UNSUPPORTED = "UNSUPPORTED_FILE_TYPE"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes under ``path``; the content column is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("original_file_name"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("created_at"),
    )


def strategy(name: Column) -> Column:
    """Extraction family of a file name: csv, sheet or pdf; null when unsupported."""
    kind = file_type(name)
    return F.when(kind == "csv", "csv").when(kind == "pdf", "pdf").when(kind.isNotNull(), "sheet")


def admission_error(
    types: list[str] = vocab.FILE_TYPES, mimes: list[str] = vocab.MIME_TYPES
) -> Column:
    """``struct<code, reason>`` of the first rule a file breaks, null for an accepted file.

    Files have ``original_file_name, mime_type, file_size``.
    """

    def error(code: str, reason: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    size = F.coalesce(F.col("file_size"), F.lit(0))
    allowed = F.coalesce(file_type(F.col("original_file_name")).isin(types), F.lit(False))
    return (
        F.when(size > vocab.MAX_FILE_BYTES, error(VALIDATION_FAILED, "File too large"))
        .when(size <= 0, error(VALIDATION_FAILED, "Each file must have content."))
        .when(~allowed, error(UNSUPPORTED, "The uploaded file type is not supported."))
        .when(
            ~F.coalesce(F.col("mime_type").isin(mimes), F.lit(False)),
            error(UNSUPPORTED, "The uploaded file type is not supported."),
        )
    )


def admit(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Add ``error``, ``accepted`` and ``batch_ok`` (no file of the batch fails, not too many)."""
    checked = files.withColumn("error", admission_error())
    checked = checked.withColumn("accepted", F.col("error").isNull())
    batches = checked.groupBy(batch).agg(
        (F.bool_and("accepted") & (F.count("*") <= vocab.MAX_BATCH_FILES)).alias("batch_ok")
    )
    return join_per_key(checked, write_through(batches, "batches"), [batch], "inner")


def document_key(path: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string")), 256)


def register_documents(files: DataFrame) -> DataFrame:
    """Rows of the documents table for accepted files.

    Files have ``path, original_file_name, file_size, session_id`` and, where known,
    ``checksum_sha256`` and ``created_at``.
    """
    known = [c for c in ("checksum_sha256", "created_at") if c in files.columns]
    rows = files.select(
        *known,
        document_key(F.col("path"), F.col("file_size")).alias("document_id"),
        "original_file_name",
        F.col("path").alias("storage_key"),
        mime_for_type(file_extension(F.col("original_file_name"))).alias("mime_type"),
        "file_size",
        F.lit("processing").alias("ingestion_status"),
        F.col("session_id").cast("string").alias("session_id"),
    )
    return table_row(rows, "documents")


def register_jobs(documents: DataFrame) -> DataFrame:
    """One queued extraction job per document, as rows of the jobs table."""
    rows = documents.select(
        F.sha2(F.concat(F.lit("job|"), "document_id"), 256).alias("job_id"),
        "document_id",
        "session_id",
        F.lit("extraction").alias("job_type"),
        F.lit("queued").alias("status"),
    )
    return table_row(rows, "processing_jobs")
