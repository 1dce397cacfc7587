import math

import numpy as np
import pytest
from helpers import documents, rng

from ledgerloom.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = queries.op6(spark, FOLDER)
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = out.join(known, "doc_id").filter("held_out").collect()
    assert len(rows) > 250
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 20):
        code = language.codewords(k)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(k, dtype=bool)].min() >= max(1, code.shape[1] // 4)


def test_a_wrong_bit_is_corrected():
    code = language.codewords(5)
    model = {"code": code, "reliability": np.full(code.shape[1], 1 / code.shape[1])}
    margins = 4 * code.copy()
    margins[:, 0] *= -1
    best, score, unsure = language.decode(margins, model)
    assert best.tolist() == [0, 1, 2, 3, 4] and not unsure.any()
    assert language.decode(0 * margins, model)[2].all()


def test_defined_results_for_odd_texts(spark):
    german, english = "der die das und ist nicht " * 20, "the and of with this that " * 20
    texts = [german, english] * 10 + [None, "", "12 !!", "...", english * 900, german, german]
    langs = ["de", "en"] * 10 + ["de", None, "en", "en", None, None, None]
    docs = documents(spark, texts, langs=langs)
    out = language.predict(docs, language.train(docs)).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["de", "en"] * 10 + ["und"] * 4 + ["en", "de", "de"]
    assert out[20]["score"] == 0.0 and out[25]["score"] == out[26]["score"]
    alone = documents(spark, ["uno dos", None], langs=["es", "es"])
    assert [r["lang_pred"] for r in language.predict(alone, language.train(alone)).orderBy(
        "doc_id").collect()] == ["es", "und"]
    none = documents(spark, ["uno"], langs=[None])
    assert language.predict(none, language.train(none)).first()["lang_pred"] == "und"
    empty = documents(spark, [])
    assert language.predict(empty, language.train(empty)).collect() == []


def test_predictions_are_those_of_a_plain_decoder(spark):
    """Trigrams one by one, margins by sums, and the codeword with the least weighted loss."""
    r = rng(15)
    alphabets = {"aa": "abcde ", "bb": "defgh ", "cc": "ghijéü "}
    langs = [r.choice(list(alphabets)) for _ in range(150)]
    texts = ["".join(r.choice(alphabets[g]) for _ in range(r.randrange(5, 200))) for g in langs]
    docs = documents(spark, texts, langs=langs)
    model = language.train(docs.filter("doc_id < 100"))
    unit = 2.0**30 / np.abs(model["weights"]).max()
    weights = [[round(float(x) * unit) for x in row] for row in model["weights"].T]
    for row in language.predict(docs, model).collect():
        text = b"  " + texts[row["doc_id"]].encode().translate(language.LETTERS) + b" "
        grams = [int(language.trigrams(np.frombuffer((text + b"  ")[k : k + 3], np.uint8))[0]) for k in range(len(text) - 2)]
        tail = [int(g) for g in language.trigrams(np.frombuffer(text, np.uint8))[len(text) - 2:]]
        grams += tail
        seen = max(1, sum(g > 0 for g in grams))
        margins = [sum(w[g] for g in grams) / (seen * unit) + b for w, b in zip(weights, model["bias"])]
        losses = []
        for word in model["code"]:
            losses.append(len(word) * sum(
                math.log1p(math.exp(-m * c)) * q for m, c, q in zip(margins, word, model["reliability"])))
        shares = [math.exp(min(losses) - x) for x in losses]
        best = losses.index(min(losses))
        assert row["lang_pred"] == model["languages"][best]
        assert row["score"] == pytest.approx(1 / sum(shares), rel=1e-6)
