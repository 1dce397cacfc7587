import hashlib
import re

import pytest

from helpers import documents, rng, sentence
from ledgerloom.llm import exactdup


def plain(rows):
    """One tuple per row: id, id that stays, group size, digest, and how many of a group are kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out.append((i, min(known, default=None), len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    rows = frame.collect()
    for digest in {r["text_sha256"] for r in rows}:
        kept = [r for r in rows if r["text_sha256"] == digest and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]
    return sorted(
        ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr)


def mixed_rows(seed=3):
    r = rng(seed)
    texts = [sentence(r, 6, 3) for _ in range(60)] + [sentence(r, 3, 2) for _ in range(80)]
    texts += ["same text over"] * 120 + ["same\t text\r\nover", " same text over", "same text over "]
    texts += ["", None, "\n", " ", " ", " ", "é", "é", "A", "a", "x" * 500_000, "x" * 500_000]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts)) + [(None, "same text over"), (None, "nobody"), (None, "nobody"), (7, "again"), (7, "again")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_against_plain_version(spark, tmp_path, digest_bytes):
    rows = mixed_rows()
    path = f"{tmp_path}/documents.parquet"
    documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5).write.parquet(path)
    # A digest of one byte clashes all the time; the texts then decide.
    assert result(exactdup.deduplicate(spark, path, digest_bytes=digest_bytes)) == plain(rows)


def test_state_lasts_over_batches_and_calls(spark, tmp_path):
    path, home = f"{tmp_path}/documents.parquet", f"{tmp_path}/home"
    rows, seen = mixed_rows(), []
    for k in range(3):
        some = rows[k::3]
        documents(spark, [t for _, t in some], [i for i, _ in some]).repartition(3).write.mode(
            "append").parquet(path)
        seen += some
        out = exactdup.deduplicate(spark, path, home, batch_bytes=1)
        assert result(out) == plain(seen)
    entries = spark.read.parquet(f"{home}/entries")
    # Nine files, a batch each; the text of a third of all rows has one entry in each.
    assert entries.select("batch").distinct().count() == 9
    known = exactdup.known(spark, path, home).orderBy("_members", ascending=False).first()
    assert known["_members"] == 122 and known["_first"]["arrived"] is not None


def test_locator_is_the_first_row_that_came(spark, tmp_path):
    path, home = f"{tmp_path}/documents.parquet", f"{tmp_path}/home"
    documents(spark, ["one", "two"], [50, 60]).coalesce(1).write.parquet(path)
    exactdup.ingest(spark, path, home)
    before = {bytes(r["_digest"]): r["_first"] for r in exactdup.known(spark, path, home).collect()}
    documents(spark, ["two", "one", "new"], [1, 2, 3]).coalesce(1).write.mode("append").parquet(path)
    exactdup.ingest(spark, path, home)
    after = {bytes(r["_digest"]): r for r in exactdup.known(spark, path, home).collect()}
    assert {d: after[d]["_first"] for d in before} == before and len(after) == 3
    assert sorted(r["_least"]["id"] for r in after.values()) == [1, 2, 3]


def test_one_file_and_empty_table(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({
        "doc_id": pa.array([3, 1], pa.int64()), "text": ["a  b", "a b"], "_metadata": ["x", "y"],
        "_digest": ["p", "q"], "batch": [1, 2], "_text": ["", ""]})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    out = result(exactdup.deduplicate(spark, f"{tmp_path}/documents.parquet"))
    assert out == plain([(3, "a  b"), (1, "a b")])
    pq.write_table(table.slice(0, 0), f"{tmp_path}/none.parquet")
    empty = exactdup.deduplicate(spark, f"{tmp_path}/none.parquet")
    assert empty.collect() == [] and empty.columns == exactdup.deduplicate(
        spark, f"{tmp_path}/documents.parquet").columns


def test_settings_are_put_back(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    documents(spark, ["a"]).write.parquet(f"{tmp_path}/d.parquet")
    exactdup.deduplicate(spark, f"{tmp_path}/d.parquet").collect()
    assert spark.conf.get(key) == before


def test_no_python_touches_rows(spark, tmp_path):
    documents(spark, ["a", "a", "b"]).write.parquet(f"{tmp_path}/d.parquet")
    plan = exactdup.deduplicate(spark, f"{tmp_path}/d.parquet")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
