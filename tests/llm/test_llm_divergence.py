import re

import numpy as np
import pyarrow as pa

from helpers import documents, rng, sentence
from ledgerloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, top=200):
    docs = [(t or "", g or "", s or "") for t, g, s in rows]
    count, held, groups = {}, {}, {}
    for k, (text, lang, source) in enumerate(docs):
        groups.setdefault(lang, set()).add(source)
        for m in TERM.findall(text):
            term = re.sub("[A-Z]", lambda c: c[0].lower(), m)
            count[lang, source, term] = count.get((lang, source, term), 0) + 1
            held.setdefault((lang, term), set()).add(k)
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), d in held.items() if g == lang and len(d) >= 3]
        per = {s: {t: count.get((lang, s, t), 0) for t in kept} for s in sources}
        per[None] = {t: sum(per[s][t] for s in sources) for t in kept}
        p = {
            s: {t: 1 + 10**9 * (c + 1) // (sum(n.values()) + len(kept)) for t, c in n.items()}
            for s, n in per.items()
        }
        for s in sources:
            pairs = [
                (sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [
                ((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept
                if per[s][t] and p[s][t] > p[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found[:limit], 1)]
    return sorted(out)


def table(spark, rows):
    frame = documents(spark, [t for t, _, _ in rows], langs=[g for _, g, _ in rows])
    frame = frame.drop("source").join(
        spark.createDataFrame([(k, s, "p", 1, 2) for k, (_, _, s) in enumerate(rows)],
                              "doc_id long, source string, term string, n int, docs int"), "doc_id")
    return frame


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    r = rng(8)
    rows = [(sentence(r, 30, 40), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, ""])) for _ in range(90)]
    rows += [("Äpfel ÄPFEL äpfel İstanbul ſ K Straße", "de", "b")] * 4
    rows += [("7 - 8 !!", "xx", "only"), (None, "xx", "none"), ("", "yy", "é"), ("one rare term", "zz", "q"), ("x", "zz", "Q")]
    rows += [("big " * 30_000, "en", "hot")] * 2 + [("nothing shared", "en", "lonely"), ("12", "en", "mute")]
    rows += [("tie one two", "tt", s) for s in "pqrs" for _ in range(3)]
    return rows


def test_against_plain_version(spark, monkeypatch):
    rows = corpus()
    assert result(divergence.audit(table(spark, rows), top=5)) == plain(rows, 5)
    for name, value in (("SHARD_ROWS", 20), ("HELD_ROWS", 30), ("BLOCK_CELLS", 12), ("TEXT_BYTES", 100)):
        monkeypatch.setattr(divergence, name, value)
    assert result(divergence.audit(table(spark, rows).repartition(3))) == plain(rows)


def test_no_kept_terms_and_empty_table(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, "en", None)]
    out = result(divergence.audit(table(spark, rows)))
    assert out == plain(rows) and {r[4] for r in out} == {0} and len(out) == 6
    assert divergence.audit(table(spark, rows).filter("doc_id < 0")).collect() == []
    assert result(divergence.audit(table(spark, [("a a", "en", "x")] * 3))) == []


def test_sums_of_a_block_against_all_terms():
    r = np.random.default_rng(2)
    count = r.poisson(0.4, (6, 50))
    absent = r.integers(1, 1000, 6)
    p = np.where(count > 0, 1 + r.integers(1, 10**9, (6, 50)), absent[:, None])
    truth = [[((p[s] - p[t]) ** 2 // p[t]).sum() for t in range(6)] for s in range(6)]
    assert divergence.block_sums(p, count > 0, absent).tolist() == np.array(truth).tolist()


def test_a_task_passes_counts_on(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 100)

    def batch(k):
        text = " ".join(["Common"] * (k + 1) + [f"a{chr(97 + k)}{chr(97 + j)}" for j in range(20)])
        return pa.RecordBatch.from_arrays(
            [pa.array(["en"]), pa.array(["s"]), pa.array([text])], names=["lang", "source", "text"])

    parts = list(divergence.count_terms(batch(k) for k in range(20)))
    rows = [r for part in parts for r in part.to_pylist()]
    common = [r for r in rows if r["term"] == "common"]
    assert len(common) > 1 and max(p.num_rows for p in parts) < 130
    assert sum(r["n"] for r in common) == 210 and sum(r["docs"] for r in common) == 20
    assert sorted(r["term"] for r in rows if r["term"] != "common") == sorted(
        f"a{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20))
