import math
import re

import numpy as np
import pytest
from helpers import documents, lower, rng, rows_of, sentence

from ledgerloom.llm import neardup
from ledgerloom.llm.graph import components


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain(ids, texts, percent=85):
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                label[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, i in enumerate(ids):
        least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), least[root(x)], i == least[root(x)])
                   for x, (i, s) in enumerate(zip(ids, sets))), key=repr)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def case(seed, groups=12, most=12):
    r = rng(seed)
    texts = [None, "", "\t", "One two", "one TWO", "one two three four five", sentence(r, 20000)]
    for _ in range(groups):
        base = sentence(r, r.choice([30, 90, 200])).split()
        for _ in range(r.randrange(1, most)):
            texts.append(edited(r, base, r.randrange(4)))
    passage = sentence(r, 60)
    texts += [f"{sentence(r, 40)} {passage} {sentence(r, 40)}" for _ in range(30)]
    texts += [texts[-1]] * 5 + [texts[6] + " end"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return ids, texts


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_are_those_of_all_links(spark):
    ids, texts = case(1)
    assert rows_of(neardup.near_groups(documents(spark, texts, ids)), *COLUMNS) == plain(ids, texts)


def test_large_branches_and_groups(spark, monkeypatch):
    """Small limits send branches down to the blocks, and groups through their branches."""
    for name, value in (("NODE_ROWS", 8), ("GROUP_ROWS", 6)):
        monkeypatch.setattr(neardup, name, value)
    r = rng(2)
    base = sentence(r, 120).split()
    texts = [edited(r, base, r.randrange(1, 4)) for _ in range(90)]
    ids = list(range(len(texts)))
    out = rows_of(neardup.near_groups(documents(spark, texts, ids)), *COLUMNS)
    assert out == plain(ids, texts)


def test_one_row_of_each_group_stays(spark):
    ids, texts = case(3, groups=6)
    texts += ["same row here to see again"] * 4
    ids += [1000] * 4
    docs = documents(spark, texts, ids)
    kept = neardup.first_of_groups(docs, 80)
    assert kept.columns == docs.columns
    expected = sorted({i for i, n, c, k in plain(ids, texts, 80) if k})
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_rows_without_words_and_null_ids_stay(spark):
    docs = documents(spark, [None, "", "a b", "a b", "c"], [1, 1, None, 2, None])
    out = neardup.near_groups(docs).collect()
    assert sum(r["component_id"] == 2 for r in out) == 2
    assert neardup.near_groups(documents(spark, [])).collect() == []
    assert neardup.first_of_groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(70, 71)],
    [(5, 3), (3, 5), (9, 3), (8, 7)],
])
def test_components_of_links(spark, links):
    out = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert out == label


def test_more_trees_for_less_loss():
    assert neardup.trees_for(0.8) >= neardup.trees_for(0.9) >= 8


@pytest.mark.parametrize("threshold", [0.8, 0.85, 1.0])
def test_losses_are_below_the_stated_one(threshold):
    level = 1 - (1 - threshold) ** neardup.BRANCHES
    trees = neardup.trees_for(threshold)
    assert (1 - threshold * level**neardup.DEPTH) ** trees <= neardup.LOSS
    # A pair whose sketch is rarer than one in 10^8 may go, one with a likelier sketch may not.
    size = neardup.SKETCH
    tail, k = 0.0, 0
    while tail + (step := math.comb(size, k) * threshold**k * (1 - threshold) ** (size - k)) <= 1e-8:
        tail, k = tail + step, k + 1
    sketches = np.zeros((2, size), "<u2")
    for equal, tied in ((k, True), (k - 1, False)):
        sketches[1] = np.arange(size) >= equal
        labels = neardup.alike_sketches(sketches, np.array([100, 100]), threshold)
        assert (labels[0] == labels[1]) == tied


def test_sketches_of_long_texts_tell_them_apart(spark):
    """Of 128 places unrelated texts of 100,000 words share hardly one, and near copies most."""
    r = rng(21)
    long = [sentence(r, 100_000, 10**6) for _ in range(3)]
    words = long[0].split()
    for k in range(0, 100_000, 400):
        words[k] = "changed"
    texts = [*long, " ".join(words)]
    rows = neardup.signatures(documents(spark, texts), 4).orderBy("doc_id").collect()
    sketches = np.frombuffer(b"".join(bytes(x["sketch"]) for x in rows), "<u2").reshape(4, -1)
    equal = [[int((a == b).sum()) for a in sketches] for b in sketches]
    assert max(equal[0][1], equal[0][2], equal[1][2]) <= 3 and equal[0][3] > 110
    assert all(len(np.unique(x)) > 120 for x in sketches)
    sizes = np.array([x["n_shingles"] for x in rows])
    assert sizes.min() > 99_000
    assert neardup.alike_sketches(sketches, sizes, 0.85).tolist() == [0, 1, 2, 0]


def test_groups_are_bounded_in_shingles(spark, monkeypatch):
    """No task gets more shingles than the bound but for two sets that are larger together."""
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 600)
    r = rng(22)
    base = sentence(r, 200).split()
    texts = [edited(r, base, r.randrange(1, 5)) for _ in range(40)] + [edited(r, base[:40], 1) for _ in range(9)]
    ids = list(range(len(texts)))
    out = rows_of(neardup.near_groups(documents(spark, texts, ids)), *COLUMNS)
    assert out == plain(ids, texts)


def test_two_blocks_meet_once(spark):
    rows = [(p, n) for p in (1, 2) for n in range(30)]
    members = spark.createDataFrame(rows, "path long, node long")
    met = neardup.in_blocks(members, neardup.F.lit(4)).groupBy("path").agg(
        neardup.F.collect_list("node").alias("nodes")).collect()
    pairs = {(a, b) for x in met for a in x["nodes"] for b in x["nodes"] if a < b}
    assert len(pairs) == 30 * 29 // 2 and max(len(x["nodes"]) for x in met) < 60
