import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import documents, rng, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import decontamination, neardup, private, queries
from test_llm_decontamination import plain as plain_hits
from test_llm_neardup import plain as plain_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before each stage and after the last."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.orderBy("doc_id").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        made = stage(spark, docs, FOLDER)
        if k < 4:
            assert made.dtypes == docs.dtypes
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.orderBy("doc_id").collect())
    return out


def test_toxic_documents_go(spark, steps):
    before, after = steps[0], steps[1]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stay = {r["doc_id"]: r for r in after}
    assert all(stay[r["doc_id"]] == r for r in before if r["doc_id"] in stay)
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    toxic = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert np.mean([d in stay for d in clean]) > 0.97 and np.mean([d in stay for d in toxic]) < 0.3


def test_one_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    groups = plain_groups([r["doc_id"] for r in before], [r["text"] for r in before],
                          corpus_pipeline.NEAR_PERCENT)
    kept = {d for d, _, _, k in groups if k}
    assert after == [r for r in before if r["doc_id"] in kept]
    assert len(after) < len(before)


def test_benchmark_passages_are_cut(spark, steps):
    before, after = steps[2], {r["doc_id"]: r for r in steps[3]}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for r, hit in zip(before, plain_hits([r["text"] for r in before], items)):
        if not hit[4]:
            assert after[r["doc_id"]] == r
        elif hit[1] > decontamination.MAX_COVERAGE * hit[0]:
            assert r["doc_id"] not in after
    left = [r["text"] for r in after.values()]
    assert not any(h[4] for h in plain_hits(left, items))


def test_private_data_is_replaced(steps):
    before, after = {r["doc_id"]: r for r in steps[3]}, {r["doc_id"]: r for r in steps[4]}
    assert before.keys() == after.keys()
    old = {r["text"][a:b] for r in before.values() for a, b, _ in private.find_entities(r["text"])}
    assert old
    for d, r in after.items():
        assert not any(x in r["text"] for x in old)
        if not private.find_entities(before[d]["text"]):
            assert r == before[d]


def test_everything_left_is_packed(steps):
    before, after = steps[4], steps[5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for r in before:
        tokens = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        for k in range(0, len(tokens), 4096):
            part = np.array(tokens[k : k + 4096], dtype="<u4")
            ids[r["doc_id"], k // 4096] = (len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in after} == ids
    assert len({r["sequence_id"] for r in after}) <= 1 + sum(n for n, _ in ids.values()) // 4000


def test_run_applies_all_stages(spark, steps):
    out = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect()
    assert {tuple(r) for r in out} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in steps[5]}
    assert set(queries.QUERIES) > {"pipeline"} and neardup.SHINGLE == 5


def odd_tables(spark, folder):
    """Null, empty, repeated and very long texts, null ids, and columns that stages use themselves."""
    r = rng(77)
    bench = [(k, sentence(r, 30, 50)) for k in range(6)] + [(None, "q w e r"), (9, None), (10, "")]
    long = sentence(r, 30_000, 5000)
    texts = [None, "", " \n", "ab", long, long + " end", long.replace("w1 ", "v1 ")]
    texts += [f"{sentence(r, 60, 900)} {bench[k % 6][1]} {sentence(r, 60, 900)}" for k in range(20)]
    texts += [f"call +49 30 {5550000 + k} or Mr John Smith {sentence(r, 50, 900)}" for k in range(20)]
    texts += [sentence(r, 80, 900) + (" scum trash moron" if k % 3 == 0 else "") for k in range(90)]
    ids = [*range(len(texts)), 3, 60, None, None]
    texts += ["ab", texts[60], "nobody's text with some words here", texts[0]]
    docs = documents(spark, texts, ids).withColumns({"_llm_tag": F.lit("x"), "sketch": F.lit(1)})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    first = len(texts) - 94
    labels = [(first + k, None if k % 5 == 0 else 1, int(k % 3 == 0), "x") for k in range(70)]
    spark.createDataFrame(labels + [(None, 1, 1, "x"), (10**9, 0, 1, "x")],
                          "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_odd_rows_through_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    bench = odd_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds, seen = docs.dtypes, [sorted(docs.collect(), key=repr)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert k == 4 or docs.dtypes == kinds
        seen.append(sorted(docs.collect(), key=repr))
    texts = [[r["text"] for r in rows] for rows in seen[:5]]
    assert 25 <= len(seen[0]) - len(seen[1]) <= 34 and None in texts[1] and "" in texts[1]
    groups = plain_groups([r["doc_id"] if r["doc_id"] is not None else 10**12 + k for k, r in enumerate(seen[1])],
                          texts[1], corpus_pipeline.NEAR_PERCENT)
    wordless = sum(n == 0 for _, n, _, _ in groups)
    worded = {c for _, n, c, _ in groups if n}
    assert len(seen[2]) == wordless + len(worded)
    assert not any(h[4] for h in plain_hits(texts[3], bench))
    assert texts[3].count(None) == texts[2].count(None) == 2
    assert not any("Smith" in t or "+49 30 555" in t and t in texts[3] for t in texts[4] if t)
    assert [t for t in texts[4] if t is None] == [None, None]
    pieces = {}
    for r in seen[5]:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
    assert sum(r["piece"] == 0 for r in seen[5]) == len(seen[4])


def test_empty_tables_through_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    odd_tables(spark, folder)
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        frame.limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{folder}/none")
    assert out.collect() == [] and "sequence_id" in out.columns
    # Documents without labels or benchmark pass on to the other stages.
    few = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40")
    few.write.parquet(f"{folder}/some/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/none/{name}.parquet").write.parquet(f"{folder}/some/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/some").select("doc_id").distinct().count() > 30
