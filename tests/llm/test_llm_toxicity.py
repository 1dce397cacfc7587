import math

import numpy as np
import pytest
from helpers import documents, rng, sentence

from ledgerloom.llm import toxicity


def case(n=400):
    r = rng(8)
    texts, labels = [], []
    for k in range(n):
        words = sentence(r, r.randrange(20, 200)).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["Idiot", "scum!", "trash", "réeux" + words[0]])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def labelled(spark, labels):
    rows = [(k, 1, v) for k, v in enumerate(labels) if k < len(labels) // 2]
    rows += [(rows[0][0], 0, 0), (None, 1, 1), (1, 1, None), (10**6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    texts, labels = case()
    docs = documents(spark, texts)
    model = toxicity.train(docs, labelled(spark, labels))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    half = range(len(texts) // 2, len(texts))
    assert np.mean([out[k]["toxic"] == bool(labels[k]) for k in half]) > 0.95
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, r in out.items() if not r["toxic"]}


def counted(texts):
    lists = [t.lower().encode().split() for t in texts]
    return [(sorted(set(w)), [w.count(x) for x in sorted(set(w))]) for w in lists]


def test_later_models_see_earlier_probabilities():
    texts, labels = case(200)
    y = np.array(labels, float)
    first = y.copy()
    first[::7] = np.nan
    model = toxicity.fit_chain(counted(texts), np.column_stack([first, y, y]))
    assert [len(e) for e in model["chain"]] == [0, 1, 2]
    assert model["chain"][1][0] > 0.1


def test_scores_are_those_of_a_plain_chain(spark):
    """Words, weights, features, bias and earlier probabilities added up one by one."""
    texts, labels = case(120)
    texts += ["", "Idiot idiot IDIOT", "é" * 40]
    docs = documents(spark, texts)
    model = toxicity.train(docs, labelled(spark, labels))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for k, text in enumerate(texts):
        words = text.encode().translate(toxicity.ALNUM_ONLY).split()
        number = {w: words.count(w) for w in words}
        weight = {w: 1 + math.log(n) for w, n in number.items()}
        norm = math.sqrt(sum(v * v for v in weight.values())) or 1.0
        p = []
        for c in range(len(model["bias"])):
            margin = model["bias"][c] + sum(x * e for x, e in zip(p, model["chain"][c]))
            for w, v in weight.items():
                features = toxicity.word_features([w])[0]
                margin += v / norm * sum(float(model["weights"][f, c]) for f in features)
            p.append(1 / (1 + math.exp(-min(30, max(-30, margin)))))
        p = [x if words else 0.0 for x in p]
        assert [out[k]["p_low_quality"], out[k]["p_toxic"]] == pytest.approx(p, rel=1e-5, abs=1e-6)
        if abs(p[-1] - model["threshold"]) > 1e-5:
            assert out[k]["toxic"] == (p[-1] >= model["threshold"])


def test_quality_is_learned_before_toxicity(spark):
    r = rng(4)
    texts = [sentence(r, 40) + (" junk junk spam" if k % 3 == 0 else "") + (
        " scum" if k % 4 == 0 else "") for k in range(300)]
    rows = [(k, None if k % 10 == 7 else int(k % 3 != 0), int(k % 4 == 0)) for k in range(200)]
    model = toxicity.train(
        documents(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    out = {x["doc_id"]: x for x in toxicity.score(documents(spark, texts), model).collect()}
    held = range(200, 300)
    assert np.mean([(out[k]["p_low_quality"] > 0.5) == (k % 3 == 0) for k in held]) > 0.95
    assert np.mean([out[k]["toxic"] == (k % 4 == 0) for k in held]) > 0.95
    # Without quality the chain has nothing to learn there, and still decides.
    bare = toxicity.train(
        documents(spark, texts), spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int"))
    out = {x["doc_id"]: x for x in toxicity.score(documents(spark, texts), bare).collect()}
    assert np.mean([out[k]["toxic"] == (k % 4 == 0) for k in held]) > 0.95


def test_the_fitting_task_gets_a_bounded_number_of_words(spark, monkeypatch):
    texts, labels = case()
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 6000)
    model = toxicity.train(documents(spark, texts), labelled(spark, labels))
    out = {r["doc_id"]: r for r in toxicity.score(documents(spark, texts), model).collect()}
    half = range(len(texts) // 2, len(texts))
    assert np.mean([out[k]["toxic"] == bool(labels[k]) for k in half]) > 0.85


def test_a_whole_text_counts(spark):
    texts, labels = case(200)
    docs = documents(spark, texts)
    model = toxicity.train(docs, labelled(spark, labels))
    r = rng(3)
    long = sentence(r, 20000).split()
    for k in range(19000, 20000, 2):
        long[k] = r.choice(["idiot", "scum", "trash"])
    odd = [None, "", "...", " ".join(long), texts[0], texts[0]]
    out = toxicity.score(documents(spark, odd), model).orderBy("doc_id").collect()
    assert [r["toxic"] for r in out] == [False, False, False, True, True, True]
    assert out[0]["p_toxic"] == 0.0 and out[4]["p_toxic"] == out[5]["p_toxic"]


def test_without_labels_or_rows(spark):
    docs = documents(spark, ["idiot", "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert model is None and not any(r["toxic"] for r in toxicity.score(docs, model).collect())
    assert toxicity.score(documents(spark, []), model).collect() == []
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
