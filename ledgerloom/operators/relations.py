"""Joins between documents, jobs and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import client_status, job_progress, job_status_label
from ..session import write_through
from .spread import join_per_key, with_order, with_position

NEST_ROWS = 1000


def documents_for_jobs(ids: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested jobs with their documents, in request order (``pos``); misses are dropped."""
    found = ids.join(jobs.filter(F.col("document_id").isNotNull()), "job_id")
    joined = join_per_key(found, documents, ["document_id"], "inner")
    return joined.withColumns(
        {"label": job_status_label(F.col("status")), "progress": job_progress(F.col("status"))}
    )


def session_documents(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Every session with its documents, one row each; a session without documents has one row."""
    return join_per_key(
        documents, sessions, ["session_id"], "inner"
    ).unionByName(
        sessions.join(documents, "session_id", "left_anti"), allowMissingColumns=True
    )


def nested_session_documents(
    sessions: DataFrame, documents: DataFrame, nest_rows: int = NEST_ROWS
) -> DataFrame:
    """Sessions with nested document lists of at most ``nest_rows`` each.

    A session holding any number of documents spreads over several rows (``part`` from 0), so no
    list outgrows a task. Lists are in the order of ``document_id``, a number or a text.
    """
    rows = session_documents(sessions, documents)
    present = rows.filter(F.col("document_id").isNotNull())
    placed = with_position(
        with_order(present, ["session_id", "document_id"], "_order"), ["session_id"], "_order", "_pos"
    ).drop("_order")
    part = F.floor((F.col("_pos") - 1) / nest_rows)
    columns = [c for c in documents.columns if c != "session_id"]
    lists = (
        placed.withColumn("part", part)
        .groupBy("session_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("documents"))
    )
    return sessions.join(lists, "session_id", "left").withColumn(
        "part", F.coalesce("part", F.lit(0))
    )


def documents_of_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents that at least one job refers to."""
    wanted = jobs.filter(F.col("document_id").isNotNull()).select("document_id").distinct()
    return documents.join(wanted, "document_id", "left_semi")


def fresh_and_cached(fresh: DataFrame, cached: DataFrame, key: str = "job_id") -> DataFrame:
    """Fresh jobs, and the cached ones that are not among them; jobs without an id are left out."""
    fresh = fresh.filter(F.col(key).isNotNull())
    old = cached.filter(F.col(key).isNotNull()).join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(old)


def jobs_with_documents(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploaded jobs with document name and status, falling back to the job's own."""
    extra = documents.select(
        "document_id",
        F.col("original_file_name").alias("_name"),
        F.col("document_status").alias("_status"),
    )
    joined = join_per_key(jobs, extra, ["document_id"], "left")
    status = F.coalesce(F.nullif("_status", F.lit("")), F.col("status"))
    return joined.select(
        "job_id",
        "document_id",
        F.coalesce(F.nullif("_name", F.lit("")), F.col("filename")).alias("filename"),
        client_status(job_status_label(status)).alias("status"),
    )


def not_yet_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (document, sheet, row) has no stored record yet; a repeated load adds nothing."""
    known = stored.select("document_id", *row_place()).distinct()
    return rows.join(known, ["document_id", "sheet_name", "row_index"], "left_anti")


def row_place() -> list[Column]:
    """Sheet and row of a stored record under the names that rows carry."""
    return [
        F.coalesce("source_sheet_name", F.lit("")).alias("sheet_name"),
        F.col("source_row_index").alias("row_index"),
    ]


def with_first_copy(files: DataFrame, content: str, order: str) -> DataFrame:
    """Add the content checksum and the earliest file with the same content (``first_copy``)."""
    sums = F.sha2(F.col(content).cast("binary"), 256)
    checked = write_through(files.withColumn("checksum", sums).drop(content), "checksums")
    first = checked.groupBy("checksum").agg(F.min(order).alias("first_copy"))
    return join_per_key(checked, write_through(first, "first-copies"), ["checksum"], "inner")


def first_by_name(uploads: DataFrame, existing: DataFrame, name: str, order: str) -> DataFrame:
    """Uploads whose name is new, keeping the first of each name."""
    others = [c for c in uploads.columns if c not in (name, order)]
    first = uploads.groupBy(name).agg(F.min(F.struct(order, *others)).alias("_first"))
    return first.select(name, "_first.*").join(
        existing.select(name).distinct(), name, "left_anti"
    )
