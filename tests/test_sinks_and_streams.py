import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import maintenance, pages
from ledgerloom.operators.relations import not_yet_stored
from ledgerloom.session import scratch, shared_folder, write_through
from ledgerloom.sources import commits, records, registration
from ledgerloom.sources.tables import read_table
from ledgerloom.streaming import ingest, metrics


def rows(spark, n=10):
    data = F.create_map(F.lit("name"), F.concat(F.lit("n"), F.col("id").cast("string")))
    empty = F.create_map().cast("map<string,string>")
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("document_id"),
        F.lit("").alias("sheet_name"), F.col("id").alias("row_index"),
        F.when(F.col("id") == 5, empty).otherwise(data).alias("raw"), data.alias("data"),
    )


def test_records_skip_rows_without_data_and_default_the_score(spark):
    got = records.row_records(rows(spark)).collect()
    assert len(got) == 9
    assert {r["confidence_score"] for r in got} == {0.8}
    assert {r["field_name"] for r in got} == {"row_data"}


def test_append_and_repeat(spark, tmp_path):
    path = str(tmp_path)
    fresh = records.row_records(rows(spark))
    assert records.append_batch(fresh.withColumn("field_name", F.lit(" ")), path).count() == 0
    assert records.append_batch(fresh, path).count() == 0
    stored = read_table(spark, path, "extracted_asset_fields")
    assert stored.count() == 9
    first = stored.orderBy("source_row_index").first()
    assert first["source_row_index"] == 0 and first["source_sheet_name"] is None
    assert first["created_at"] is not None and first["review_status"] == "pending"
    assert dict(stored.dtypes)["confidence_score"] == "decimal(5,2)"
    again = not_yet_stored(fresh, stored)
    assert records.append_batch(again, path).count() == 0
    assert read_table(spark, path, "extracted_asset_fields").count() == 9


def test_failed_batch_saves_nothing_and_reports_every_row(spark, tmp_path):
    path = str(tmp_path)
    broken = records.row_records(rows(spark)).withColumn(
        "raw_value", F.when(F.col("row_index") == 8, F.raise_error(F.lit("boom"))).otherwise("x")
    )
    errors = records.append_batch(broken, path)
    assert errors.count() == 9
    assert "Batch transaction failed" in errors.first()["reason"]
    assert read_table(spark, path, "extracted_asset_fields").count() == 0


@pytest.mark.parametrize(
    "name, mime, size, code",
    [
        ("assets.txt", "application/json", 9, "UNSUPPORTED_FILE_TYPE"),
        ("empty.csv", "text/csv", 0, "VALIDATION_FAILED"),
        ("a.xlsx", "text/plain", 10, None), ("a.csv", "image/png", 10, "UNSUPPORTED_FILE_TYPE"),
        ("a.csv", "text/csv", 25 * 1024 * 1024, None),
        ("a.csv", "text/csv", 25 * 1024 * 1024 + 1, "VALIDATION_FAILED"),
    ],
)
def test_admission(spark, name, mime, size, code):
    schema = "batch_id int, original_file_name string, mime_type string, file_size bigint"
    row = registration.admit(spark.createDataFrame([(1, name, mime, size)], schema)).first()
    assert (row["error"]["code"] if row["error"] else None) == code
    assert row["accepted"] is row["batch_ok"] is (code is None)


def test_eleven_files_are_too_many(spark):
    schema = "batch_id int, original_file_name string, mime_type string, file_size bigint"
    files = spark.createDataFrame([(1, f"{i}.csv", "text/csv", 5) for i in range(11)], schema)
    assert {r["batch_ok"] for r in registration.admit(files).collect()} == {False}


def test_listed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.pdf").write_text("yy")
    files = registration.list_files(spark, str(tmp_path)).withColumn("session_id", F.lit(7))
    documents = registration.register_documents(files)
    assert {(r["original_file_name"], r["file_size"], r["mime_type"]) for r in documents.collect()} == {
        ("a.csv", 1, "text/csv"), ("b.pdf", 2, "application/pdf"),
    }
    assert registration.register_jobs(documents).select("job_id").distinct().count() == 2


SCHEMA = "id bigint, name string"


def add_file(folder, name, first, n):
    body = "".join(f"{i},v{i}\n" for i in range(first, first + n))
    (folder / name).write_text("id,name\n" + body)


def test_files_are_loaded_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        add_file(folder, f"{i}.csv", i * 10, 10)

    def load():
        stream = ingest.stream_files(spark, source, SCHEMA, files_per_trigger=3, header="true")
        return ingest.run_available(stream, target, state)

    load()
    counts = ingest.progress_metrics(ingest.batch_log(spark, state)).first().asDict()
    assert counts == {"queued": 2, "completed": 2, "failed": 0}
    load()
    add_file(folder, "late.csv", 40, 5)
    load()
    loaded = ingest.loaded(spark, target, SCHEMA)
    assert sorted(r["id"] for r in loaded.collect()) == list(range(45))
    assert {r["rows"] for r in ingest.batch_metrics(loaded).collect()} == {30, 10, 5}


def test_failed_batch_is_retried_without_duplicates(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        add_file(folder, f"{i}.csv", i * 10, 10)
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("once")
        return df

    stream = ingest.stream_files(spark, source, SCHEMA, files_per_trigger=3, header="true")
    ingest.run_available(stream, target, state, flaky, pause=0.1)
    assert len(calls) == 3
    loaded = ingest.loaded(spark, target, SCHEMA)
    assert sorted(r["id"] for r in loaded.collect()) == list(range(60))


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")


def test_two_changes_for_one_row_count_once(spark):
    table = spark.createDataFrame([("r1", "a", 1), ("r2", "b", 2)], "review_id string, assigned_to string, priority int")
    changes = spark.createDataFrame([("r1", 5, 1), ("r1", 3, 2)], "review_id string, priority int, changed_at int")
    with pytest.raises(ValueError):
        maintenance.reprioritise_reviews(table, changes.drop("changed_at"))
    out = {r["review_id"]: r["priority"] for r in maintenance.reprioritise_reviews(table, changes).collect()}
    assert out == {"r1": 3, "r2": 2} and maintenance.reprioritise_reviews(table, changes).count() == 2


def test_a_bad_file_does_not_stop_the_others(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(5):
        add_file(tmp_path / "in", f"{i}.csv", i * 10, 10)

    def refuse(df):
        bad = F.when(F.col("id") == 23, F.raise_error(F.lit("bad value"))).otherwise(F.col("id"))
        return df.withColumn("id", bad)

    def load():
        stream = ingest.stream_files(spark, source, SCHEMA, files_per_trigger=2, header="true")
        ingest.run_available(stream, target, state, refuse, attempts=2)

    load()
    loaded = sorted(r["id"] for r in ingest.loaded(spark, target, SCHEMA).collect())
    assert loaded == [i for i in range(50) if i // 10 != 2]
    log = ingest.batch_log(spark, state)
    failed = log.filter("status = 'failed' and source_file is not null").collect()
    assert len(failed) == 1 and failed[0]["source_file"].endswith("2.csv")
    assert "bad value" in failed[0]["reason"]
    assert ingest.progress_metrics(log).first().asDict() == {"queued": 3, "completed": 2, "failed": 1}
    add_file(tmp_path / "in", "late.csv", 50, 5)
    load()
    assert ingest.loaded(spark, target, SCHEMA).count() == 45


def test_partial_changes_are_applied_in_turn(spark):
    """As if each change had been applied by itself: what later changes leave out stays."""
    schema = "review_id string, assigned_to string, priority int, status string"
    table = spark.createDataFrame([("r1", "a", 1, "x"), ("r2", None, None, None), ("r3", "c", 3, "z")], schema)
    changes = spark.createDataFrame(
        [("r1", None, 9, None, 3), ("r1", "b", None, None, 1), ("r1", "d", None, "y", 2), ("r1", None, None, None, 4),
         ("r2", "e", None, None, 1), ("r2", "f", None, None, 1), ("r9", "g", 1, "q", 1)], schema + ", changed_at int")
    out = maintenance.apply_changes(table, changes, "review_id", ["assigned_to", "priority", "status"])
    assert sorted(tuple(r) for r in out.collect()) == [
        ("r1", "d", 9, "y"), ("r2", "f", None, None), ("r3", "c", 3, "z")]


def test_the_last_decision_counts_as_a_whole(spark):
    queue = spark.createDataFrame(
        [("r1", "pending", None, None, None)],
        "review_id string, status string, resolved_by string, resolved_at string, resolution_notes string")
    decisions = spark.createDataFrame(
        [("r1", "resolved", "ann", "t1", "fine", 1), ("r1", "dismissed", "", "t2", "", 2)],
        "review_id string, status string, resolved_by string, resolved_at string, resolution_notes string, changed_at int")
    assert tuple(maintenance.resolve_reviews(queue, decisions).first()) == ("r1", "dismissed", None, None, None)


def reviews(spark, values, status="pending"):
    rows = [(f"r{k}", "record", f"e{k}", "why", v, status) for k, v in values]
    return spark.createDataFrame(
        rows, "review_id string, entity_type string, entity_id string, review_reason string, priority int, status string")


def stored(spark, path, name="review_queue"):
    return sorted((r["review_id"], r["priority"]) for r in read_table(spark, path, name).collect())


def test_a_batch_counts_once_it_is_marked_and_a_repeated_one_replaces(spark, tmp_path):
    path = str(tmp_path)
    assert stored(spark, path) == []
    records.write_rows(reviews(spark, [(1, 1), (2, 2)]), path, "review_queue", batch_id="a")
    records.write_rows(reviews(spark, [(3, 3)]), path, "review_queue")
    assert stored(spark, path) == [("r1", 1), ("r2", 2), ("r3", 3)]
    records.write_rows(reviews(spark, [(1, 7), (4, 4)]), path, "review_queue", batch_id="a")
    assert stored(spark, path) == [("r1", 7), ("r3", 3), ("r4", 4)]
    # An attempt that broke off after its rows were written.
    rows = commits.table_row(reviews(spark, [(5, 5)]), "review_queue").withColumn("batch_id", F.lit("b"))
    commits._append(rows, path, "review_queue", "lost")
    assert stored(spark, path) == [("r1", 7), ("r3", 3), ("r4", 4)]
    before = set((tmp_path / "review_queue").rglob("*.parquet"))
    assert commits.remove_replaced(spark, path, "review_queue", files_at_once=1) > 0
    assert set((tmp_path / "review_queue").rglob("*.parquet")) < before
    assert stored(spark, path) == [("r1", 7), ("r3", 3), ("r4", 4)]


def test_a_batch_over_several_tables_counts_in_all_or_none(spark, tmp_path):
    path = str(tmp_path)
    flags = spark.createDataFrame([("record", "e1", "T", "low", "x")],
                                  "entity_type string, entity_id string, flag_type string, severity string, explanation string")
    broken = reviews(spark, [(1, 1)]).withColumn("status", F.raise_error(F.lit("full")).cast("string"))
    with pytest.raises(Exception, match="full"):
        commits.commit(spark, path, {"validation_flags": flags, "review_queue": broken}, "a")
    assert read_table(spark, path, "validation_flags").count() == 0
    commits.commit(spark, path, {"validation_flags": flags, "review_queue": reviews(spark, [(1, 1)])}, "a")
    assert read_table(spark, path, "validation_flags").count() == 1 and stored(spark, path) == [("r1", 1)]


def test_rewrites_touch_only_their_buckets(spark, tmp_path):
    path, folder = str(tmp_path), tmp_path / "review_queue"
    records.write_rows(reviews(spark, [(k, k) for k in range(60)]), path, "review_queue", batch_id="a")
    before = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    changes = spark.createDataFrame([("r7", 70, 1), ("r8", 80, 1), ("r7", 71, 2)], "review_id string, priority int, changed_at int")
    buckets = records.change_reviews(spark, path, changes, ["priority"])
    assert stored(spark, path) == sorted((f"r{k}", {7: 71, 8: 80}.get(k, k)) for k in range(60))
    after = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    assert before.items() <= after.items() and len(buckets) <= 2
    assert {f.parent.name for f in set(after) - set(before)} == {f"bucket={b}" for b in buckets}
    gone = reviews(spark, [(7, 0), (9, 0)])
    commits.rewrite(spark, path, "review_queue", gone, lambda old: maintenance.delete_rows(old, gone, ["review_id"]))
    assert len(stored(spark, path)) == 58
    # The batch is written again after all that: its rows, changed ones too, are replaced.
    records.write_rows(reviews(spark, [(7, 1)]), path, "review_queue", batch_id="a")
    assert stored(spark, path) == [("r7", 1)]
    commits.remove_replaced(spark, path, "review_queue")
    assert stored(spark, path) == [("r7", 1)] and len(list(folder.rglob("*.parquet"))) == 1


def test_merging_enrichment_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    records.write_rows(records.row_records(rows(spark)), path, "extracted_asset_fields", batch_id="a")
    fresh = spark.createDataFrame(
        [("1", "", 1, '{"currency":"EUR"}', 0.9, "auto_approved", "why", 2), ("1", "", 1, '{"currency":"XXX"}', 0.99, "pending", "no", 1)],
        "document_id string, sheet_name string, row_index bigint, normalized_value string, confidence_score double, "
        "review_status string, inference_explanation string, enriched_at int")
    for _ in range(2):
        records.merge_enrichment(spark, path, fresh)
        out = read_table(spark, path, "extracted_asset_fields").filter("document_id = '1'").collect()
        assert [(r["normalized_value"], float(r["confidence_score"]), r["review_status"]) for r in out] == [
            ('{"name":"n1","currency":"EUR"}', 0.9, "auto_approved")]
    assert read_table(spark, path, "extracted_asset_fields").count() == 9
    records.delete_documents(spark, path, spark.createDataFrame([("hot",)], "document_id string"))
    assert {r["document_id"] for r in read_table(spark, path, "extracted_asset_fields").collect()} == {"1", "2", "4", "7", "8"}


def failing(df):
    df.write.format("noop").mode("overwrite").save()


def test_faults_of_data_and_of_machines_are_told_apart(spark, tmp_path):
    cases = {
        "cast": lambda: failing(spark.range(3).select(F.concat(F.lit("x"), "id").cast("int"))),
        "raised": lambda: failing(spark.range(3).select(F.raise_error(F.lit("bad")).cast("string").alias("e"))),
        "division": lambda: failing(spark.range(3).select(F.lit(1) / F.col("id"))),
    }
    for name, run in cases.items():
        with pytest.raises(Exception) as caught:
            run()
        assert ingest.is_data_fault(caught.value), name
    (tmp_path / "broken.parquet").write_bytes(b"no parquet at all")
    spark.range(5).write.parquet(str(tmp_path / "gone"))
    gone = spark.read.parquet(str(tmp_path / "gone"))
    for f in (tmp_path / "gone").glob("*.parquet"):
        f.unlink()

    def worker_dies(parts):
        import os

        os._exit(3)
        yield from parts

    others = {
        "missing": lambda: failing(gone), "plain": lambda: (_ for _ in ()).throw(OSError("no answer")),
        "value": lambda: (_ for _ in ()).throw(ValueError("a mistake in the code")),
        "path": lambda: spark.read.parquet(str(tmp_path / "nowhere")),
        "worker": lambda: failing(spark.range(3).mapInArrow(worker_dies, "id long")),
    }
    for name, run in others.items():
        with pytest.raises(Exception) as caught:
            run()
        assert not ingest.is_data_fault(caught.value), name
    with pytest.raises(Exception) as caught:
        failing(spark.read.schema("id long").parquet(str(tmp_path / "broken.parquet")))
    assert ingest.is_data_fault(caught.value)


def test_storage_that_fails_loses_no_file(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(4):
        add_file(tmp_path / "in", f"{i}.csv", i * 10, 10)
    down = [True]

    def transform(df):
        if down[0]:
            raise OSError("storage does not answer")
        return df

    def load():
        stream = ingest.stream_files(spark, source, SCHEMA, files_per_trigger=2, header="true")
        ingest.run_available(stream, target, state, transform, attempts=2, pause=0.1)

    with pytest.raises(Exception, match="does not answer"):
        load()
    waiting = ingest.progress_metrics(ingest.batch_log(spark, state)).first().asDict()
    assert waiting == {"queued": 1, "completed": 0, "failed": 0}
    down[0] = False
    load()
    assert sorted(r["id"] for r in ingest.loaded(spark, target, SCHEMA).collect()) == list(range(40))
    assert ingest.progress_metrics(ingest.batch_log(spark, state)).first().asDict() == {
        "queued": 2, "completed": 2, "failed": 0}


def test_failed_files_are_kept_and_loaded_later(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(9):
        add_file(tmp_path / "in", f"{i}.csv", i * 10, 10)

    def refuse(*bad):
        def transform(df):
            refused = F.when(F.col("id").isin(*bad), F.raise_error(F.lit("bad value"))).otherwise(F.col("id"))
            return df.withColumn("id", refused)
        return transform

    stream = ingest.stream_files(spark, source, SCHEMA, header="true")
    ingest.run_available(stream, target, state, refuse(5, 33, 88))
    assert ingest.loaded(spark, target, SCHEMA).count() == 60
    failed = ingest.batch_log(spark, state).filter("status = 'failed' and source_file is not null")
    assert {r["source_file"][-5:] for r in failed.collect()} == {"0.csv", "3.csv", "8.csv"}

    def read(session, paths):
        return session.read.schema(SCHEMA).option("header", True).csv(paths)

    assert ingest.retry_failed(spark, target, state, read, refuse(33), files_at_once=2) == 2
    assert ingest.loaded(spark, target, SCHEMA).count() == 80
    assert ingest.progress_metrics(ingest.batch_log(spark, state)).first()["failed"] == 1
    assert ingest.retry_failed(spark, target, state, read) == 1
    assert ingest.retry_failed(spark, target, state, read) == 0
    assert sorted(r["id"] for r in ingest.loaded(spark, target, SCHEMA).collect()) == list(range(90))
    assert ingest.progress_metrics(ingest.batch_log(spark, state)).first().asDict() == {
        "queued": 1, "completed": 1, "failed": 0}


@pytest.mark.parametrize("shallow", [10_000, 0])
def test_pages_are_slices_of_the_order(spark, monkeypatch, shallow):
    monkeypatch.setattr(pages, "SHALLOW_ROWS", shallow)
    rows = [(k, k % 3, None if k % 7 == 0 else k % 5) for k in range(500)]
    queue = spark.createDataFrame(rows, "review_id int, priority int, created_at int").repartition(6)
    order = sorted(rows, key=lambda r: (-r[1], r[2] is not None, r[2] or 0, r[0]))
    for page, size in ((1, 10), (7, 13), (50, 10), (51, 10), (3, 200)):
        got = pages.review_queue_page(queue, page, size).collect()
        assert [r["review_id"] for r in got] == [r[0] for r in order[(page - 1) * size : page * size]]
        assert all(r["total"] == 500 for r in got)


def test_intermediate_tables_go_with_their_block(spark, tmp_path):
    frame = spark.range(5).withColumnRenamed("id", "a")
    with scratch(spark):
        inner = write_through(frame, "inner")
        place = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        inner.write.parquet(str(tmp_path / "result"))
        assert os.path.isdir(place)
    outer = write_through(frame, "outer")
    assert not os.path.exists(place) and outer.count() == 5
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(ZeroDivisionError), scratch(spark):
        place = write_through(frame, "inner").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        1 / 0
    assert not os.path.exists(place)


def test_listener_writes_what_a_stream_does(spark, tmp_path):
    source, target, state, told = (str(tmp_path / n) for n in ("in", "out", "state", "told"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        add_file(tmp_path / "in", f"{i}.csv", i * 10, 10)
    listener = metrics.ProgressTable(spark, told)
    spark.streams.addListener(listener)
    try:
        for transform in (lambda df: df, lambda df: (_ for _ in ()).throw(OSError("down"))):
            stream = ingest.stream_files(spark, source, SCHEMA, files_per_trigger=2, header="true")
            try:
                ingest.run_available(stream, target, state, transform, attempts=1)
            except Exception:
                pass
            add_file(tmp_path / "in", "late.csv", 90, 5)
        for _ in range(60):
            totals = metrics.stream_totals(metrics.progress_rows(spark, told)).collect()
            if len(totals) == 2 and not any(r["running"] for r in totals):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    done, failed = sorted(totals, key=lambda r: -r["rows"])
    assert (done["batches"], done["rows"], done["error"]) == (2, 30, None)
    assert failed["rows"] == 0 and "down" in failed["error"] and not failed["running"]


def test_a_batch_that_broke_off_among_its_portions_is_written_once(spark, tmp_path):
    """A bad file makes halves; storage fails between them; the next attempt finds the file mended."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(6):
        add_file(tmp_path / "in", f"{i}.csv", i * 10, 10)
    calls = []

    def transform(df):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("storage does not answer")
        if len(calls) < 4:
            bad = F.when(F.col("id") == 23, F.raise_error(F.lit("bad"))).otherwise(F.col("id"))
            return df.withColumn("id", bad)
        return df

    stream = ingest.stream_files(spark, source, SCHEMA, header="true")
    ingest.run_available(stream, target, state, transform, pause=0.1)
    assert len(calls) == 5
    assert sorted(r["id"] for r in ingest.loaded(spark, target, SCHEMA).collect()) == list(range(60))
    assert ingest.progress_metrics(ingest.batch_log(spark, state)).first().asDict() == {
        "queued": 1, "completed": 1, "failed": 0}
