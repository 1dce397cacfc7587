"""Reads over stored tables: review pages, grids, queues, lists with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import job_progress, job_status_label
from ..session import write_through
from .spread import first_rows, join_per_key

#: Up to so many rows a page and what stands before it are sorted as one short list.
SHALLOW_ROWS = 10_000


def slice_of(
    table: DataFrame, order: list[str | Column], key: str, skip: int, take: int
) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` of a table in an order that ``key``, unique, completes.

    Near the beginning a list of the first rows does. Further on, the keys alone are sorted by
    range; the sizes of the parts tell which of them hold the page, and only these are read. No
    task gets the rows before the page, however many they are.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if skip + take <= SHALLOW_ROWS:
        return table.orderBy(*columns, key).offset(skip).limit(take)
    ranged = table.repartitionByRange(*columns, F.col(key)).sortWithinPartitions(*columns, key)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = write_through(
        ranged.select(key, F.spark_partition_id().alias("_part"), local.alias("_nth")), "sorted-keys")
    # One row per part of the sort.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    first, wanted = 0, F.lit(False)
    position = F.lit(None).cast("long")
    for row in sizes:
        if first < skip + take and first + row["n"] > skip:
            here = F.col("_part") == row["_part"]
            wanted |= here & F.col("_nth").between(skip - first, skip + take - first - 1)
            position = F.when(here, F.col("_nth") + first).otherwise(position)
        first += row["n"]
    page = write_through(placed.filter(wanted).select(key, position.alias("_position")), "page-keys")
    return table.join(page, key).orderBy("_position").drop("_position")



def review_page(
    records: DataFrame, document_id, page: int = 1, page_size: int = 10
) -> DataFrame:
    """One page of a document's records, newest first, with the total."""
    mine = records.filter(F.col("document_id") == document_id)
    total = mine.agg(F.count("*").alias("total"))
    shown = slice_of(mine, [F.desc("created_at")], "record_id", (page - 1) * page_size, page_size)
    return _with_total(shown, total)


def _with_total(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the single value of a one-row total."""
    return rows.withColumn("total", total.scalar())


def review_pages(records: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """The same page of every document, with totals."""
    upto = first_rows(
        records, ["document_id"], [F.desc("created_at"), "record_id"], page * page_size, "position"
    )
    totals = records.groupBy("document_id").agg(F.count("*").alias("total"))
    return upto.filter(F.col("position") > (page - 1) * page_size).join(totals, "document_id")


def grid_headers(records: DataFrame, order: str, value: str = "normalized_value") -> DataFrame:
    """Column names of each document's grid: the keys of its first record with a value."""
    valued = records.filter(F.col(value).isNotNull())
    first = valued.groupBy("document_id").agg(F.min(F.struct(order, value)).alias("_first"))
    keys = F.map_keys(F.from_json(F.col("_first")[value], "map<string,string>"))
    return first.select("document_id", keys.alias("grid_headers"))


def review_grid(records: DataFrame, order: str, value: str = "normalized_value") -> DataFrame:
    """Records as grid rows: one display text per header, ``-`` for a missing value."""
    heads = write_through(grid_headers(records, order, value), "grid-headers")
    rows = join_per_key(
        records.filter(F.col(value).isNotNull()), heads, ["document_id"], "inner"
    )
    data = F.from_json(F.col(value), "map<string,string>")
    shown = rows.withColumn("_data", data).withColumn(
        "cells",
        F.transform(
            "grid_headers",
            lambda h: F.coalesce(F.try_element_at(F.col("_data"), h), F.lit("-")),
        ),
    )
    return shown.drop("_data")


def pending_reviews(queue: DataFrame, limit: int = 10) -> DataFrame:
    """Most urgent pending reviews: priority first, then age."""
    pending = queue.filter(F.col("status") == "pending")
    return pending.orderBy(F.desc("priority"), "created_at", "review_id").limit(limit)


def reviews_where(queue: DataFrame, condition: Column) -> DataFrame:
    """Reviews by status, assignee or entity; the order is by priority, then age."""
    return queue.filter(condition).orderBy(F.desc("priority"), "created_at", "review_id")


def review_queue_page(queue: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of the whole queue by priority, then age, with the total."""
    total = queue.agg(F.count("*").alias("total"))
    order = [F.desc("priority"), "created_at"]
    rows = slice_of(queue, order, "review_id", (page - 1) * page_size, page_size)
    return _with_total(rows, total)


def pages_of_document(pages: DataFrame, document_id) -> DataFrame:
    """Pages of a document by page number."""
    return pages.filter(F.col("document_id") == document_id).orderBy("page_number")


def records_where(
    records: DataFrame, document_id=None, field_name: str | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """Records of a document, of a field, or above a score."""
    if document_id is not None:
        records = records.filter(F.col("document_id") == document_id)
    if field_name is not None:
        records = records.filter(F.col("field_name") == field_name)
    if min_score is not None:
        records = records.filter(F.col("confidence_score") >= min_score)
    return records


def flags_where(
    flags: DataFrame, entity: tuple | None = None, severity: str | None = None,
    flag_type: str | None = None,
) -> DataFrame:
    """Flags of an entity, of a severity, or of a type."""
    if entity is not None:
        flags = flags.filter((F.col("entity_type") == entity[0]) & (F.col("entity_id") == entity[1]))
    if severity is not None:
        flags = flags.filter(F.col("severity") == severity)
    if flag_type is not None:
        flags = flags.filter(F.col("flag_type") == flag_type)
    return flags


def list_with_total(table: DataFrame, key: str, skip: int = 0, take: int = 10) -> DataFrame:
    """A slice of a table, newest first, with the table's row count on each row."""
    total = table.agg(F.count("*").alias("total"))
    return _with_total(slice_of(table, [F.desc("created_at")], key, skip, take), total)


def newest_first(table: DataFrame, condition: Column, key: str) -> DataFrame:
    """Rows that meet a condition (session, document, status), newest first."""
    return table.filter(condition).orderBy(F.desc("created_at"), key)


def job_status_view(jobs: DataFrame) -> DataFrame:
    """Status label, progress and error of jobs."""
    return jobs.select(
        "job_id",
        job_status_label(F.col("status")).alias("status"),
        job_progress(F.col("status")).alias("progress"),
        F.col("error_summary").alias("error"),
    )
