"""Stored tables: registration, joins, lists, queues, snapshots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.fields import file_extension, file_type, mime_for_type
from ledgerloom.operators import maintenance, pages, relations, routing
from ledgerloom.plans.extraction import settled_and_ambiguous
from ledgerloom.session import shared_folder
from ledgerloom.sources import commits, records, registration
from ledgerloom.sources.tables import read_table, table_row

from .registry import query
from .views import (
    DOCS_SQL,
    JOB_EVENTS_SQL,
    JOBS_SQL,
    REGISTER_SQL,
    ROUTED_SQL,
    SESSIONS_SQL,
    docs,
    job_events,
    jobs,
    register_rows,
    sessions,
    table,
)



def stored_at():
    return F.to_timestamp(F.lit("2024-05-01 12:00:00"))


EXTENSION = "lower(regexp_extract(original_file_name, '[^.]*$'))"
SUPPORTED = f"{EXTENSION} IN ('csv', 'xls', 'xlsx', 'pdf')"


@query(
    "file_routing",
    f"""SELECT document_id, {EXTENSION} AS extension, CASE WHEN {SUPPORTED} THEN {EXTENSION} END AS file_type,
        CASE {EXTENSION} WHEN 'csv' THEN 'csv' WHEN 'pdf' THEN 'pdf' WHEN 'xls' THEN 'sheet' WHEN 'xlsx' THEN 'sheet' END AS strategy,
        CASE {EXTENSION} WHEN 'csv' THEN 'text/csv' WHEN 'pdf' THEN 'application/pdf'
             WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
             ELSE 'application/octet-stream' END AS mime_type FROM ({DOCS_SQL}) d""",
)
def file_routing(spark, folder):
    name = F.col("original_file_name")
    return docs(spark, folder).select(
        "document_id", file_extension(name).alias("extension"), file_type(name).alias("file_type"),
        registration.strategy(name).alias("strategy"),
        mime_for_type(file_extension(name)).alias("mime_type"),
    )


ADMITTED_SQL = f"""
SELECT *, CASE WHEN file_size > 26214400 OR file_size <= 0 THEN 'VALIDATION_FAILED'
               WHEN NOT {SUPPORTED} OR document_id % 7 = 0 THEN 'UNSUPPORTED_FILE_TYPE' END AS error_code,
  document_id // 8 AS batch_id
FROM ({DOCS_SQL}) d
"""


def uploads(spark, folder):
    """Documents as uploads: batches of eight, every seventh with a MIME type that is not allowed."""
    mime = F.when(F.col("document_id") % 7 == 0, "application/json").otherwise("text/plain")
    return docs(spark, folder).withColumns(
        {"mime_type": mime, "batch_id": F.floor(F.col("document_id") / 8)}
    )


@query(
    "admission",
    f"""SELECT document_id, error_code, error_code IS NULL AS accepted,
        bool_and(error_code IS NULL) OVER (PARTITION BY batch_id) AND count(*) OVER (PARTITION BY batch_id) <= 10 AS batch_ok
        FROM ({ADMITTED_SQL}) a""",
)
def admission(spark, folder):
    admitted = registration.admit(uploads(spark, folder))
    return admitted.select(
        "document_id", F.col("error.code").alias("error_code"), "accepted", "batch_ok"
    )


@query(
    "registered_documents",
    f"""SELECT sha256(concat_ws('|', original_file_name, file_size::VARCHAR)) AS document_id,
        sha256(concat('job|', sha256(concat_ws('|', original_file_name, file_size::VARCHAR)))) AS job_id,
        original_file_name, file_size, session_id::VARCHAR AS session_id, 'processing' AS ingestion_status,
        'extraction' AS job_type, 'queued' AS status FROM ({ADMITTED_SQL}) a WHERE error_code IS NULL""",
)
def registered_documents(spark, folder):
    accepted = registration.admit(uploads(spark, folder)).filter("accepted")
    files = accepted.withColumn("path", F.col("original_file_name"))
    documents = registration.register_documents(files)
    queued = registration.register_jobs(documents).drop("session_id")
    return documents.join(queued, "document_id").select(
        "document_id", "job_id", "original_file_name", "file_size", "session_id",
        "ingestion_status", "job_type", "status",
    )


@query(
    "extraction_summary",
    f"""WITH w AS (SELECT document_id, count(*) AS warning_count FROM ({REGISTER_SQL}) WHERE name IS NULL GROUP BY document_id),
        c AS (SELECT document_id, count(*) AS total, count(*) FILTER (NOT ambiguous) AS settled, count(*) FILTER (ambiguous) AS asked FROM ({ROUTED_SQL}) GROUP BY document_id)
        SELECT d.document_id, d.source_file, 'csv' AS file_type, coalesce(total, 0) AS row_count,
          coalesce(warning_count, 0) AS warning_count, coalesce(settled, 0) AS persisted_count, coalesce(asked, 0) AS enriched_count
        FROM (SELECT concat('doc-', c_custkey::VARCHAR) AS document_id, c_name AS source_file FROM customer) d
        LEFT JOIN c ON d.document_id = c.document_id LEFT JOIN w ON d.document_id = w.document_id""",
)
def extraction_summary(spark, folder):
    documents = table(spark, folder, "customer").select(
        F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("document_id"),
        F.col("c_name").alias("original_file_name"), F.lit("csv").alias("file_type"),
    )
    rows = register_rows(spark, folder)
    counts = routing.route_counts(settled_and_ambiguous(rows))
    unnamed = rows.filter(F.try_element_at(F.col("raw"), F.lit("name")).isNull())
    return records.extraction_summary(documents, counts, unnamed)


@query(
    "stored_record_scan",
    f"""SELECT document_id, row_index AS source_row_index, NULL::VARCHAR AS source_sheet_name, 'row_data' AS field_name,
        CASE WHEN matched THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence_score, 'pending' AS review_status, '2024-05-01 12:00:00' AS created_at
        FROM ({ROUTED_SQL}) r WHERE NOT ambiguous AND document_id = 'doc-3' AND complete""",
)
def stored_record_scan(spark, folder):
    """Settled rows through the record sink, then a filtered scan of the stored table."""
    root = shared_folder(spark, "stored")
    settled = settled_and_ambiguous(register_rows(spark, folder)).filter("route = 'deterministic'")
    errors = records.append_batch(records.row_records(settled), root, stored_at())
    assert errors.isEmpty()
    where = (F.col("document_id") == "doc-3") & (F.col("confidence_score") >= 0.7)
    stored = read_table(spark, root, "extracted_asset_fields", where)
    return stored.select(
        "document_id", "source_row_index", "source_sheet_name", "field_name", "confidence_score",
        "review_status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query(
    "documents_for_jobs",
    f"""SELECT r.pos, j.job_id, d.document_id, d.original_file_name,
        CASE j.status WHEN 'queued' THEN 'waiting' WHEN 'running' THEN 'processing' ELSE j.status END AS label,
        CASE j.status WHEN 'running' THEN 50 WHEN 'completed' THEN 100 ELSE 0 END::BIGINT AS progress
        FROM (SELECT event_id AS pos, user_id * 7 AS job_id FROM events) r
        JOIN ({JOBS_SQL}) j ON r.job_id = j.job_id JOIN ({DOCS_SQL}) d ON j.document_id = d.document_id""",
)
def documents_for_jobs(spark, folder):
    asked = table(spark, folder, "events").select(
        F.col("event_id").alias("pos"), (F.col("user_id") * 7).alias("job_id")
    )
    found = relations.documents_for_jobs(
        asked, jobs(spark, folder).drop("created_at"), docs(spark, folder)
    )
    return found.select("pos", "job_id", "document_id", "original_file_name", "label", "progress")


@query(
    "session_documents",
    f"""SELECT s.session_id, s.name, d.document_id, d.original_file_name
        FROM ({SESSIONS_SQL}) s LEFT JOIN ({DOCS_SQL}) d ON s.session_id = d.session_id""",
)
def session_documents(spark, folder):
    found = relations.session_documents(sessions(spark, folder), docs(spark, folder))
    return found.select("session_id", "name", "document_id", "original_file_name")


@query(
    "nested_session_documents",
    f"""SELECT session_id, any_value(name) AS name, part, string_agg(original_file_name, ',' ORDER BY document_id::VARCHAR) AS files FROM (
          SELECT s.session_id, s.name, d.document_id, d.original_file_name,
            coalesce((row_number() OVER (PARTITION BY s.session_id ORDER BY d.document_id::VARCHAR) - 1) // 20, 0) AS part
          FROM ({SESSIONS_SQL}) s LEFT JOIN ({DOCS_SQL}) d ON s.session_id = d.session_id) n GROUP BY session_id, part""",
)
def nested_session_documents(spark, folder):
    documents = docs(spark, folder).withColumn("document_id", F.col("document_id").cast("string"))
    nested = relations.nested_session_documents(sessions(spark, folder), documents, nest_rows=20)
    files = F.array_join(F.transform("documents", lambda d: d["original_file_name"]), ",")
    return nested.select("session_id", "name", "part", files.alias("files"))


@query(
    "documents_of_jobs",
    f"""SELECT document_id, original_file_name FROM ({DOCS_SQL}) d
        WHERE document_id IN (SELECT document_id FROM ({JOBS_SQL}) WHERE status = 'failed')""",
)
def documents_of_jobs(spark, folder):
    failed = jobs(spark, folder).filter("status = 'failed'")
    return relations.documents_of_jobs(docs(spark, folder), failed).select(
        "document_id", "original_file_name"
    )


@query(
    "fresh_and_cached_jobs",
    """SELECT o_orderkey AS job_id, o_orderstatus AS status, 'fresh' AS origin FROM orders WHERE o_orderpriority <> '5-LOW'
       UNION ALL SELECT o_orderkey, 'cached', 'cache' FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def fresh_and_cached_jobs(spark, folder):
    orders = table(spark, folder, "orders")
    fresh = orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"),
        F.lit("fresh").alias("origin"),
    )
    cached = orders.select(
        F.col("o_orderkey").alias("job_id"), F.lit("cached").alias("status"),
        F.lit("cache").alias("origin"),
    )
    return relations.fresh_and_cached(fresh, cached)


@query(
    "jobs_with_documents",
    f"""SELECT j.job_id, j.document_id, coalesce(d.original_file_name, concat('upload-', j.job_id::VARCHAR)) AS filename,
        CASE coalesce(CASE WHEN d.document_id % 2 = 0 THEN 'completed' END, j.status)
             WHEN 'running' THEN 'processing' WHEN 'queued' THEN 'waiting' WHEN 'failed' THEN 'failed' ELSE 'completed' END AS status
        FROM ({JOBS_SQL}) j LEFT JOIN (SELECT * FROM ({DOCS_SQL}) WHERE file_size <= 26214400) d ON j.document_id = d.document_id""",
)
def jobs_with_documents(spark, folder):
    documents = docs(spark, folder).filter("file_size <= 26214400")
    documents = documents.withColumn(
        "document_status", F.when(F.col("document_id") % 2 == 0, "completed")
    )
    uploaded = jobs(spark, folder).withColumn(
        "filename", F.concat(F.lit("upload-"), F.col("job_id").cast("string"))
    )
    return relations.jobs_with_documents(uploaded, documents)


@query(
    "not_yet_stored",
    f"""SELECT document_id, row_index FROM ({REGISTER_SQL}) r WHERE row_index NOT IN
        (SELECT row_index FROM ({REGISTER_SQL}) s WHERE s.name IS NOT NULL AND s.document_id = r.document_id)""",
)
def not_yet_stored(spark, folder):
    rows = register_rows(spark, folder)
    stored = rows.filter(F.try_element_at(F.col("raw"), F.lit("name")).isNotNull())
    stored = table_row(stored, "extracted_asset_fields")
    return relations.not_yet_stored(rows, stored).select("document_id", "row_index")


@query(
    "duplicate_files",
    """SELECT doc_id, sha256(text) AS checksum, min(doc_id) OVER (PARTITION BY text) AS first_copy FROM documents""",
)
def duplicate_files(spark, folder):
    files = table(spark, folder, "documents").select("doc_id", "text")
    return relations.with_first_copy(files, "text", "doc_id")


@query(
    "first_upload_by_name",
    """WITH named AS (SELECT *, concat(p_brand, '-', p_size::VARCHAR) AS filename FROM part)
       SELECT filename, arg_min(p_type, p_partkey) AS kind, min(p_partkey) AS arrived FROM named
       WHERE filename NOT IN (SELECT filename FROM named WHERE p_retailprice > 990) GROUP BY filename""",
)
def first_upload_by_name(spark, folder):
    """Parts as uploads; the names of dear parts are already there."""
    name = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    part = table(spark, folder, "part").withColumn("filename", name)
    arrived = part.select(
        "filename", F.col("p_type").alias("kind"), F.col("p_partkey").alias("arrived")
    )
    existing = part.filter("p_retailprice > 990").select("filename")
    return relations.first_by_name(arrived, existing, "filename", "arrived")


# Records of a document: one per order of a customer; the score follows the price.
RECORDS_SQL = """
SELECT o_orderkey AS record_id, o_custkey AS document_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'enriched_asset_data' ELSE 'row_data' END AS field_name,
  round(o_totalprice % 100 / 100, 2) AS confidence_score, o_orderstatus AS status
FROM orders
"""


def order_records(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("document_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 3 == 0, "enriched_asset_data").otherwise("row_data")
        .alias("field_name"),
        F.round(F.col("o_totalprice") % 100 / 100, 2).alias("confidence_score"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "review_pages",
    f"""SELECT document_id, record_id, position, total FROM (
          SELECT document_id, record_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, record_id) AS position,
            count(*) OVER (PARTITION BY document_id) AS total FROM ({RECORDS_SQL}) r) p WHERE position BETWEEN 6 AND 10""",
)
def review_pages(spark, folder):
    shown = pages.review_pages(order_records(spark, folder), page=2, page_size=5)
    return shown.select("document_id", "record_id", "position", "total")


@query(
    "review_page",
    f"""SELECT record_id, (SELECT count(*) FROM orders WHERE o_custkey = 22) AS total FROM ({RECORDS_SQL}) r
        WHERE document_id = 22 ORDER BY created_at DESC, record_id LIMIT 5 OFFSET 5""",
)
def review_page(spark, folder):
    shown = pages.review_page(order_records(spark, folder), 22, page=2, page_size=5)
    return shown.select("record_id", "total")


@query(
    "review_grid",
    """WITH r AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, event_type, value FROM events),
       f AS (SELECT user_id, arg_min(event_type = 'error', event_id) AS short_first FROM r GROUP BY user_id)
       SELECT r.event_id, CASE WHEN short_first THEN 'k' ELSE 'k,kind' END AS headers,
         CASE WHEN short_first THEN r.k WHEN event_type = 'error' THEN concat(r.k, '|-') ELSE concat(r.k, '|', event_type) END AS cells
       FROM r JOIN f ON r.user_id = f.user_id""",
)
def review_grid(spark, folder):
    """Event properties as records of a user; error events lack the second key."""
    events = table(spark, folder, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    value = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), kind.alias("kind")))
    rows = events.select(
        F.col("user_id").alias("document_id"), "event_id", value.alias("normalized_value")
    )
    grid = pages.review_grid(rows, "event_id")
    return grid.select(
        "event_id", F.array_join("grid_headers", ",").alias("headers"),
        F.array_join("cells", "|").alias("cells"),
    )


QUEUE_SQL = """
SELECT o_orderkey AS review_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'in_review' ELSE 'pending' END AS status,
  o_orderkey % 4 AS priority, concat('u', (o_custkey % 9)::VARCHAR) AS assigned_to, o_custkey AS entity_id
FROM orders
"""


def review_queue(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "resolved")
        .when(F.col("o_orderstatus") == "P", "in_review").otherwise("pending").alias("status"),
        (F.col("o_orderkey") % 4).alias("priority"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")).alias("assigned_to"),
        F.col("o_custkey").alias("entity_id"),
    )


@query(
    "pending_reviews",
    f"""SELECT review_id, priority::BIGINT AS priority FROM ({QUEUE_SQL}) q WHERE status = 'pending'
        ORDER BY q.priority DESC, created_at, review_id LIMIT 10""",
)
def pending_reviews(spark, folder):
    return pages.pending_reviews(review_queue(spark, folder)).select("review_id", "priority")


@query(
    "reviews_by_status_and_assignee",
    f"""SELECT 'status' AS by, status AS key, count(*) AS n, min(review_id) AS first_id FROM ({QUEUE_SQL}) WHERE status = 'in_review' GROUP BY status
        UNION ALL SELECT 'assignee', assigned_to, count(*), min(review_id) FROM ({QUEUE_SQL}) WHERE assigned_to = 'u4' GROUP BY assigned_to
        UNION ALL SELECT 'entity', entity_id::VARCHAR, count(*), min(review_id) FROM ({QUEUE_SQL}) WHERE entity_id = 7 GROUP BY entity_id""",
)
def reviews_by_status_and_assignee(spark, folder):
    queue = review_queue(spark, folder)
    cases = [
        ("status", "status", F.col("status") == "in_review"),
        ("assignee", "assigned_to", F.col("assigned_to") == "u4"),
        ("entity", "entity_id", F.col("entity_id") == 7),
    ]
    parts = [
        pages.reviews_where(queue, test)
        .groupBy(F.lit(by).alias("by"), F.col(column).cast("string").alias("key"))
        .agg(F.count("*").alias("n"), F.min("review_id").alias("first_id"))
        for by, column, test in cases
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "records_where",
    f"""SELECT record_id, document_id, confidence_score FROM ({RECORDS_SQL}) r
        WHERE field_name = 'row_data' AND confidence_score >= 0.65""",
)
def records_where(spark, folder):
    kept = pages.records_where(
        order_records(spark, folder), field_name="row_data", min_score=0.65
    )
    return kept.select("record_id", "document_id", "confidence_score")


@query(
    "flags_where",
    """SELECT event_id AS flag_id, event_type AS flag_type FROM events
       WHERE event_type = 'error' AND user_id % 4 = 3""",
)
def flags_where(spark, folder):
    events = table(spark, folder, "events")
    severity = F.element_at(
        F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    flags = events.select(
        F.col("event_id").alias("flag_id"), F.lit("user").alias("entity_type"),
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("flag_type"),
        severity.alias("severity"),
    )
    found = pages.flags_where(flags, severity="critical", flag_type="error")
    return found.select("flag_id", "flag_type")


@query(
    "listed_jobs",
    f"""SELECT job_id, (SELECT count(*) FROM orders) AS total FROM ({JOBS_SQL}) j
        ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 50""",
)
def listed_jobs(spark, folder):
    listed = pages.list_with_total(jobs(spark, folder), "job_id", skip=50, take=25)
    return listed.select("job_id", "total")


@query(
    "jobs_of_document",
    f"""SELECT job_id, status, row_number() OVER (ORDER BY created_at DESC, job_id) AS place
        FROM ({JOBS_SQL}) j WHERE document_id = 22""",
)
def jobs_of_document(spark, folder):
    found = pages.newest_first(jobs(spark, folder), F.col("document_id") == 22, "job_id")
    newest = W.orderBy(F.desc("created_at"), "job_id")
    return found.select("job_id", "status", F.row_number().over(newest).alias("place"))


@query(
    "job_status_view",
    f"""SELECT job_id, CASE status WHEN 'queued' THEN 'waiting' WHEN 'running' THEN 'processing' ELSE status END AS status,
        CASE status WHEN 'running' THEN 50 WHEN 'completed' THEN 100 ELSE 0 END::BIGINT AS progress,
        CASE WHEN status = 'failed' THEN 'boom' END AS error FROM ({JOBS_SQL}) j""",
)
def job_status_view(spark, folder):
    failed = F.when(F.col("status") == "failed", "boom")
    return pages.job_status_view(jobs(spark, folder).withColumn("error_summary", failed))


@query(
    "latest_job_state",
    f"""SELECT job_id, arg_max(state, (ts, event_id)) AS status,
        strftime(CASE WHEN arg_max(state, (ts, event_id)) IN ('completed', 'failed') THEN max(ts) END, '%Y-%m-%d %H:%M:%S') AS completed_at,
        CASE arg_max(state, (ts, event_id)) WHEN 'completed' THEN 'processed' WHEN 'failed' THEN 'failed' ELSE 'processing' END AS document_status
        FROM ({JOB_EVENTS_SQL}) e GROUP BY job_id""",
)
def latest_job_state(spark, folder):
    events = job_events(spark, folder).withColumn("error", F.lit("boom"))
    state = maintenance.latest_job_state(events)
    return state.select(
        "job_id", "status",
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"),
        "document_status",
    )


@query(
    "review_changes",
    f"""SELECT review_id,
          CASE WHEN review_id % 5 = 1 THEN 'resolved' WHEN review_id % 5 = 0 THEN 'in_review' ELSE status END AS status,
          CASE WHEN review_id % 5 = 0 THEN 'u-new' ELSE assigned_to END AS assigned_to,
          CASE WHEN review_id % 5 = 2 THEN 9 ELSE priority END::BIGINT AS priority,
          CASE WHEN review_id % 5 = 1 AND review_id % 2 = 0 THEN 'boss' END AS resolved_by,
          review_id % 5 = 1 AND review_id % 2 = 0 AS has_time
        FROM ({QUEUE_SQL}) q""",
)
def review_changes(spark, folder):
    """Assignments, decisions and new priorities applied to the queue in turn."""
    queue = review_queue(spark, folder).withColumns(
        {
            "resolved_by": F.lit(None).cast("string"),
            "resolved_at": F.lit(None).cast("timestamp"),
            "resolution_notes": F.lit(None).cast("string"),
        }
    )
    chosen = lambda n: queue.filter(F.col("review_id") % 5 == n)
    now = F.col("created_at").alias("changed_at")
    assigned = chosen(0).select("review_id", F.lit("u-new").alias("assigned_to"), now)
    boss = F.when(F.col("review_id") % 2 == 0, "boss")
    decided = chosen(1).select(
        "review_id", F.lit("resolved").alias("status"), boss.alias("resolved_by"),
        F.col("created_at").alias("resolved_at"), F.lit("").alias("resolution_notes"), now,
    )
    ranked = chosen(2).select("review_id", F.lit(9).alias("priority"), now)
    changed = maintenance.reprioritise_reviews(
        maintenance.resolve_reviews(maintenance.assign_reviews(queue, assigned), decided), ranked
    )
    return changed.select(
        "review_id", "status", "assigned_to", "priority", "resolved_by",
        F.col("resolved_at").isNotNull().alias("has_time"),
    )


LINES_SQL = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice * 100)::BIGINT) AS line_id,
  l_shipdate AS created_at, l_quantity::INT % 4 AS priority FROM lineitem"""


def line_queue(spark, folder):
    """Line items as a long review queue: many rows of one priority and day."""
    line = table(spark, folder, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string"))
    return line.select(
        key.alias("review_id"),
        F.col("l_shipdate").alias("created_at"), (F.col("l_quantity").cast("int") % 4).alias("priority"),
    )


@query(
    "deep_queue_page",
    f"""SELECT line_id AS review_id, priority::BIGINT AS priority, created_at::VARCHAR AS created_at, (SELECT count(*) FROM lineitem) AS total
        FROM ({LINES_SQL}) l ORDER BY l.priority DESC, l.created_at, line_id LIMIT 5 OFFSET 49995""",
)
def deep_queue_page(spark, folder):
    """Page 10,000 of the whole queue."""
    page = pages.review_queue_page(line_queue(spark, folder), page=10_000, page_size=5)
    return page.withColumn("created_at", F.col("created_at").cast("string"))


@query(
    "queue_pages",
    f"""SELECT 1 AS page, * FROM (SELECT line_id AS review_id FROM ({LINES_SQL}) l ORDER BY priority DESC, created_at, line_id LIMIT 7) a
        UNION ALL SELECT 2, * FROM (SELECT line_id FROM ({LINES_SQL}) l ORDER BY priority DESC, created_at, line_id LIMIT 7 OFFSET 7) b""",
)
def queue_pages(spark, folder):
    queue = line_queue(spark, folder)
    first, second = (
        pages.review_queue_page(queue, n, 7).select(F.lit(n).alias("page"), "review_id") for n in (1, 2))
    return first.unionByName(second)


@query(
    "deep_list",
    f"""SELECT line_id, created_at::VARCHAR AS created_at, (SELECT count(*) FROM lineitem) AS total
        FROM ({LINES_SQL}) l ORDER BY l.created_at DESC, line_id LIMIT 100 OFFSET 23456""",
)
def deep_list(spark, folder):
    """A slice far down a list, newest first."""
    lines = line_queue(spark, folder).withColumnRenamed("review_id", "line_id").drop("priority")
    found = pages.list_with_total(lines, "line_id", 23_456, 100)
    return found.withColumn("created_at", F.col("created_at").cast("string"))


@query(
    "pages_of_document",
    """SELECT l_linenumber::BIGINT AS page_number, l_linestatus AS detected_layout, l_returnflag = 'N' AS ocr_required
       FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)""",
)
def pages_of_document(spark, folder):
    """Pages of one document out of all, by number."""
    line = table(spark, folder, "lineitem")
    every = line.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"),
        F.col("l_linestatus").alias("detected_layout"), (F.col("l_returnflag") == "N").alias("ocr_required"))
    last = line.agg(F.max("l_orderkey")).scalar()
    return pages.pages_of_document(every, last).drop("document_id")


@query(
    "partial_changes",
    f"""SELECT review_id::VARCHAR AS review_id,
          CASE WHEN review_id % 4 = 1 THEN 'ann' ELSE assigned_to END AS assigned_to,
          CASE WHEN review_id % 4 = 1 THEN 8 ELSE priority END::BIGINT AS priority,
          CASE WHEN review_id % 4 = 1 THEN 'dismissed' ELSE status END AS status,
          CASE WHEN review_id % 4 = 1 THEN 'seen' END AS resolution_notes
        FROM ({QUEUE_SQL}) q WHERE review_id % 7 <> 3""",
)
def partial_changes(spark, folder):
    """Stored reviews with four partial changes each, in any order; some reviews are deleted after."""
    root = shared_folder(spark, "reviews")
    queue = review_queue(spark, folder)
    records.write_rows(queue, root, "review_queue")
    key, none = F.col("review_id").cast("string").alias("review_id"), F.lit(None).cast("string")
    turns = [("status", "in_review", 1), ("assigned_to", "bob", 2), ("assigned_to", "ann", 3), ("status", "dismissed", 4)]
    changed = queue.filter("review_id % 4 = 1")
    changes = [
        changed.select(
            key, F.lit(at).alias("changed_at"),
            *[(F.lit(value) if name == c else none).alias(c) for c in ("assigned_to", "status")],
            F.when(F.lit(at == 2), F.lit(8)).alias("priority"),
            F.when(F.lit(at == 1), F.lit("seen")).alias("resolution_notes"))
        for name, value, at in turns
    ]
    every = changes[3].unionByName(changes[1]).unionByName(changes[2]).unionByName(changes[0])
    columns = ["assigned_to", "status", "priority", "resolution_notes"]
    records.change_reviews(spark, root, every, columns)
    doomed = queue.filter("review_id % 7 = 3").select(key)
    commits.rewrite(
        spark, root, "review_queue", doomed,
        lambda stored: maintenance.delete_rows(stored, doomed, ["review_id"]))
    return read_table(spark, root, "review_queue").select("review_id", *columns)


@query(
    "validation_status_update",
    f"""SELECT record_id, CASE WHEN confidence_score < 0.5 THEN 'invalid' ELSE 'pending' END AS validation_status
        FROM ({RECORDS_SQL}) r""",
)
def validation_status_update(spark, folder):
    stored = order_records(spark, folder).withColumn("validation_status", F.lit("pending"))
    changes = stored.filter("confidence_score < 0.5").select(
        "record_id", F.lit("invalid").alias("validation_status"),
        F.current_timestamp().alias("changed_at"),
    )
    updated = maintenance.update_validation_status(stored, changes)
    return updated.select("record_id", "validation_status")


@query(
    "deleted_documents",
    f"""SELECT 'records' AS kind, count(*) AS n, count(document_id) AS attached FROM ({RECORDS_SQL}) r
          WHERE document_id NOT IN (SELECT document_id FROM ({DOCS_SQL}) WHERE {EXTENSION} = 'txt')
        UNION ALL SELECT 'jobs', count(*), count(*) FILTER (document_id NOT IN (SELECT document_id FROM ({DOCS_SQL}) WHERE {EXTENSION} = 'txt'))
          FROM ({JOBS_SQL}) j""",
)
def deleted_documents(spark, folder):
    """Deleting the text files removes their records and detaches their jobs."""
    doomed = docs(spark, folder).filter(file_extension(F.col("original_file_name")) == "txt")
    kept = maintenance.delete_rows(order_records(spark, folder), doomed, ["document_id"])
    detached = maintenance.detach_jobs(jobs(spark, folder), doomed)
    count = [F.count("*").alias("n"), F.count("document_id").alias("attached")]
    return kept.agg(F.lit("records").alias("kind"), *count).unionByName(
        detached.agg(F.lit("jobs").alias("kind"), *count)
    )
