"""Table changes as snapshot transforms: each function returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_job_state(events: DataFrame) -> DataFrame:
    """State of every job from its events (``job_id, state, ts, event_id, error``)."""
    last = events.groupBy("job_id").agg(
        F.max(F.struct("ts", "event_id", "state", "error")).alias("_last")
    )
    state, done = F.col("_last.state"), F.col("_last.state").isin("completed", "failed")
    return last.select(
        "job_id",
        state.alias("status"),
        F.when(done, F.col("_last.ts")).alias("completed_at"),
        F.when(state == "failed", F.col("_last.error")).alias("error_summary"),
        F.when(state == "completed", "processed").when(state == "failed", "failed")
        .otherwise("processing").alias("document_status"),
    )


def _timed(changes: DataFrame) -> None:
    if "changed_at" not in changes.columns:
        raise ValueError("changes need changed_at, which tells their order")


def folded_changes(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The partial changes of each key, applied in turn: the last non-null value of every column.

    Of two values with one ``changed_at`` the greater counts.
    """
    _timed(changes)
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("changed_at", c))).alias(c)
        for c in columns
    ]
    return changes.groupBy(key).agg(*last)


def apply_changes(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Snapshot with partial updates: a non-null value in ``changes`` replaces the old one.

    A key may have any number of changes, each of other columns; ``changed_at`` orders them. No
    row of the table is doubled.
    """
    fresh = folded_changes(changes, key, columns).select(
        key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(fresh, key, "left")
    updates = {c: F.coalesce(f"_{c}", c) for c in columns}
    return joined.withColumns(updates).drop(*[f"_{c}" for c in columns])


def assign_reviews(queue: DataFrame, assignments: DataFrame) -> DataFrame:
    """Give reviews to people (``review_id, assigned_to, changed_at``) and mark them in review."""
    changes = assignments.withColumn("status", F.lit("in_review"))
    return apply_changes(queue, changes, "review_id", ["assigned_to", "status"])


def resolve_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Close reviews (``review_id, status, resolved_by, resolved_at, resolution_notes, changed_at``).

    Who and when are set together: without a resolver both become null, as do missing notes. Of
    several decisions on a review the last one counts as a whole.
    """
    columns = ["status", "resolved_by", "resolved_at", "resolution_notes"]
    _timed(decisions)
    last = F.max(F.struct("changed_at", *columns)).alias("_change")
    fresh = decisions.groupBy("review_id").agg(last).select("review_id", "_change.*").select(
        "review_id",
        F.lit(True).alias("_hit"),
        F.col("status").alias("_status"),
        F.nullif("resolved_by", F.lit("")).alias("_by"),
        F.when(F.nullif("resolved_by", F.lit("")).isNotNull(), F.col("resolved_at")).alias("_at"),
        F.nullif("resolution_notes", F.lit("")).alias("_notes"),
    )
    joined = queue.join(fresh, "review_id", "left")

    def pick(new: str, old: str):
        return F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old))

    return joined.withColumns(
        {
            "status": pick("_status", "status"),
            "resolved_by": pick("_by", "resolved_by"),
            "resolved_at": pick("_at", "resolved_at"),
            "resolution_notes": pick("_notes", "resolution_notes"),
        }
    ).drop("_hit", "_status", "_by", "_at", "_notes")


def reprioritise_reviews(queue: DataFrame, priorities: DataFrame) -> DataFrame:
    return apply_changes(queue, priorities, "review_id", ["priority"])


def update_validation_status(records: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_changes(records, changes, "record_id", ["validation_status"])


def delete_rows(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot without the rows whose keys are listed (documents, entities, pages)."""
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def detach_jobs(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Jobs of deleted documents stay, without their document."""
    gone = deleted.select("document_id").distinct().withColumn("_gone", F.lit(True))
    joined = jobs.join(gone, "document_id", "left")
    kept = F.when(F.col("_gone").isNull(), F.col("document_id"))
    return joined.withColumn("document_id", kept).drop("_gone")
