"""Toxicity by a classifier chain.

The categories, all from given labels, are predicted in a fixed order: low quality, then toxic.
Each has a linear model on hashed words and word beginnings that also sees the probabilities of the
categories before it. While fitting, those
probabilities come from models that have not seen the document (out-of-fold), so a later model
learns how far an earlier one can be trusted on new text. The last category, ``toxic``, decides;
its threshold is the one with the best F1 on out-of-fold predictions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_ONLY, CACHED_WORDS, batches, byte_texts, packed, written

#: Categories before the last, as conditions on the labels; null where a label says nothing.
CATEGORIES = {"low_quality": "quality = 0"}
DECISION = "toxic"
#: At most about so many labelled documents of either label are fitted on, with at most about so
#: many different words, each counted once per document.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
TRAIN_WORDS = 4_000_000
FOLDS = 3
BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
STEPS = 60
PENALTY = 2e-4


def word_features(words: list[bytes]) -> np.ndarray:
    """Hashed features of each word: the whole word and its first 4 to 8 bytes; 0 for none."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    head = np.array(words, dtype="S8").astype("S8").view("<u8") if words else np.zeros(0, "<u8")
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    columns = [whole >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        part = head & np.uint64((1 << 8 * k) - 1)
        part = (part ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        columns.append(np.where(sizes >= k, part >> np.uint64(64 - BITS), np.uint64(0)))
    return np.stack(columns, axis=1).astype(np.int64)


class Vocabulary(dict):
    """Number of each word, in the order of first sight."""

    def __init__(self):
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def counted(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and weight of each distinct word; a document's weights have norm 1."""
        doc, word, count = self.counts(texts)
        return doc, word, _weights(doc, count, len(texts))

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and number of each distinct word."""
        lists = [(t or b"").translate(ALNUM_ONLY).split() for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.concatenate([
            np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in lists
        ]) if lists else np.zeros(0, np.int64)
        keys, count = np.unique(
            np.repeat(np.arange(len(lists)), sizes) << 32 | numbers, return_counts=True)
        return keys >> 32, keys & (2**32 - 1), count


def _weights(doc: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    weight = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, weight**2, minlength=n))
    return weight / np.maximum(norm, 1e-9)[doc]


class _Fit:
    """Logistic regression on word features scaled by how much more often a class has them."""

    def __init__(self, doc, word, weight, features, n: int):
        self.doc, self.word, self.weight, self.features, self.n = doc, word, weight, features, n

    def forward(self, w: np.ndarray) -> np.ndarray:
        by_word = w[self.features].sum(1)
        return np.bincount(self.doc, self.weight * by_word[self.word], minlength=self.n)

    def backward(self, pull: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.word, self.weight * pull[self.doc], minlength=len(self.features))
        spread = np.repeat(by_word, self.features.shape[1])
        return np.bincount(self.features.ravel(), spread, minlength=1 << BITS)

    def run(self, y: np.ndarray, use: np.ndarray, earlier: np.ndarray):
        """Weights, bias and weights of the earlier probabilities, learned where ``use``."""
        if not use.any():
            return np.zeros(1 << BITS), -8.0, np.zeros(earlier.shape[1])
        share = use / use.sum()
        rate = float((y * share).sum())
        if rate in (0.0, 1.0):
            return np.zeros(1 << BITS), -8.0 if rate == 0 else 8.0, np.zeros(earlier.shape[1])
        present = np.minimum(self.backward(use * y), 1e9), self.backward(use * (1 - y))
        a, b = ((x + 0.5) / (x.sum() + 1) for x in present)
        scale = np.clip(np.log(a / b), -6, 6)
        scale[0] = 0

        def margin(w, c, e):
            return self.forward(scale * w) + c + earlier @ e

        v = np.random.default_rng(0).normal(size=1 << BITS)
        for _ in range(5):
            v /= np.linalg.norm(v)
            v = scale * self.backward(share * self.forward(scale * v))
        step = 1 / (0.25 * (np.linalg.norm(v) + 2 + earlier.shape[1]) + PENALTY)
        w, c, e = np.zeros(1 << BITS), float(np.log(rate / (1 - rate))), np.zeros(earlier.shape[1])
        pw, pc, pe = w, c, e
        for t in range(STEPS):
            m = t / (t + 3)
            lw, lc, le = w + m * (w - pw), c + m * (c - pc), e + m * (e - pe)
            pull = share * (1 / (1 + np.exp(-np.clip(margin(lw, lc, le), -30, 30))) - y)
            pw, pc, pe = w, c, e
            w = lw - step * (scale * self.backward(pull) + PENALTY * lw)
            c = lc - step * pull.sum()
            e = le - step * (earlier.T @ pull)
        return scale * w, c, e


def fit_chain(lists: list[tuple[list[bytes], list[int]]], labels: np.ndarray) -> dict:
    """The chain for label columns in their order, the deciding category last.

    A document comes as its distinct words and their numbers. A label that is NaN says nothing:
    its document isn't used for that category, but gets a probability like all others.
    """
    vocabulary = Vocabulary()
    n, categories = labels.shape
    sizes = [len(words) for words, _ in lists]
    doc = np.repeat(np.arange(n), sizes)
    word = np.fromiter((vocabulary[w] for words, _ in lists for w in words), np.int64, sum(sizes))
    count = np.fromiter((c for _, counts in lists for c in counts), np.int64, sum(sizes))
    fit = _Fit(doc, word, _weights(doc, count, n), word_features(vocabulary.words), n)
    fold = np.arange(n) % FOLDS
    earlier = np.zeros((n, 0))
    weights, biases, chain = [], [], []
    for k in range(categories):
        said = ~np.isnan(labels[:, k])
        y = np.where(said, labels[:, k], 0.0)
        fresh = np.zeros(n)
        for f in range(FOLDS):
            at = fold == f
            if at.any() and (~at).any():
                w, c, e = fit.run(y, (~at & said).astype(float), earlier)
                fresh[at] = _sigmoid(fit.forward(w) + c + earlier @ e)[at]
        w, c, e = fit.run(y, said.astype(float), earlier)
        weights.append(w.astype(np.float32))
        biases.append(c)
        chain.append(e)
        earlier = np.column_stack([earlier, fresh])
    return {"weights": np.stack(weights, axis=1), "bias": biases, "chain": chain,
            "threshold": _threshold(fresh[said], y[said])}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the neighbouring probabilities where F1 is best."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(hit[-1], 1))
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2) if hit[-1] else 1.0


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of whole texts and how often each occurs."""
    for batch in parts:
        words, counts, offsets = [], [], [0]
        for some in _slices(byte_texts(batch["text"])):
            vocabulary = Vocabulary()
            doc, word, count = vocabulary.counts(some)
            offsets += (offsets[-1] + np.cumsum(np.bincount(doc, minlength=len(some)))).tolist()
            words.append(pa.array(vocabulary.words, pa.binary()).take(pa.array(word)))
            counts.append(count)
        at = pa.array(offsets, pa.int32())
        flat = pa.concat_arrays(words) if words else pa.array([], pa.binary())
        number = pa.array(np.concatenate(counts or [[]]), pa.int64())
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in rest), pa.ListArray.from_arrays(at, flat),
             pa.ListArray.from_arrays(at, number)], names=[*rest, "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, seed: int = 17) -> dict | None:
    """A chain from the labelled documents; None if none is labelled.

    Rows of a bounded sample of labels meet the texts by a broadcast of that sample. A document
    with several labels is in a category if one says so; of rows that share a doc_id one text is
    used. The one fitting task gets words and their numbers, whole texts being counted where they
    lie; if the sample has more than ``TRAIN_WORDS`` of them, so much fewer documents are used.
    """
    batches(docs.sparkSession)
    kinds = {
        name: F.expr(rule) if "quality" in labels.columns else F.lit(None).cast("boolean")
        for name, rule in CATEGORIES.items()
    }
    said = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"),
        *[F.max(kind.cast("int")).alias(f"_{name}") for name, kind in kinds.items()])
    said = written(said, "labels")
    counts = {r["toxic"]: r["count"] for r in said.groupBy("toxic").count().collect()}
    most = {0: TRAIN_CLEAN, 1: TRAIN_TOXIC}
    share = {k: min(1.0, most[k] / n) for k, n in counts.items() if k in most}
    if not share:
        return None
    drawn = said.sampleBy("toxic", share, seed)
    names = [*(f"_{name}" for name in CATEGORIES), "toxic"]
    texts = docs.select("doc_id", "text").filter("text is not null")
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", *names).agg(
        F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} int" for name in names)
    counted = written(sample.mapInArrow(
        _word_counts, f"doc_id {kind}, {fields}, words array<binary>, counts array<long>"),
        "counted-sample")
    total = counted.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > TRAIN_WORDS:
        counted = counted.sample(TRAIN_WORDS / total, seed)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").sample(frac=1, random_state=seed)
        lists = list(zip(rows["words"], rows["counts"]))
        return pd.DataFrame({"model": [packed(fit_chain(lists, rows[names].to_numpy(float)))]})

    one = counted.withColumn("_all", F.lit(0)).groupBy("_all")
    model = one.applyInPandas(fit, "model binary").first()
    return pickle.loads(model["model"]) if model else None


class Scorer:
    """Probabilities of the categories for whole texts."""

    def __init__(self, model: dict):
        self.model, self.vocabulary = model, Vocabulary()
        self.by_word = np.zeros((0, len(model["bias"])))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """A column of probabilities for each category, and which texts have words at all."""
        if len(self.vocabulary) > CACHED_WORDS:
            self.vocabulary, self.by_word = Vocabulary(), self.by_word[:0]
        known = self.vocabulary
        doc, word, weight = known.counted(texts)
        if new := known.words[len(self.by_word):]:
            more = self.model["weights"][word_features(new)].sum(1)
            self.by_word = np.concatenate([self.by_word, more])
        p = np.zeros((len(texts), 0))
        for k, (c, e) in enumerate(zip(self.model["bias"], self.model["chain"])):
            margin = np.bincount(doc, weight * self.by_word[word, k], minlength=len(texts))
            p = np.column_stack([p, _sigmoid(margin + c + p @ e)])
        return p, np.bincount(doc, minlength=len(texts)) > 0


def _slices(texts: list[bytes | None], limit: int = 8_000_000) -> Iterator[list[bytes | None]]:
    """Whole texts in portions of bounded size, so that long ones don't add up."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"")
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id``, ``p_<category>`` for each category, and ``toxic``.

    Texts that are null or have no word are not toxic, with probabilities 0; so is everything if
    no document was labelled. Repeated rows get the same result each.
    """
    return _judged(docs.select("doc_id", "text"), model, only_clean=False)


def without_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` without the rows judged toxic; all columns stay as they are."""
    return _judged(docs, model, only_clean=True)


def _judged(docs: DataFrame, model: dict | None, only_clean: bool) -> DataFrame:
    batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))
    names = [*CATEGORIES, DECISION]

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        scorer = Scorer(known) if known else None
        for batch in parts:
            p = np.zeros((batch.num_rows, len(names)))
            if scorer and batch.num_rows:
                made = [scorer(part) for part in _slices(byte_texts(batch["text"]))]
                p = np.concatenate([x * has[:, None] for x, has in made])
            toxic = p[:, -1] >= (known["threshold"] if known else 2)
            if only_clean:
                yield batch.filter(pa.array(~toxic))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *(pa.array(x) for x in p.T), pa.array(toxic)],
                    names=["doc_id", *(f"p_{n}" for n in names), "toxic"],
                )

    if only_clean:
        return docs.mapInArrow(judge, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "".join(f", p_{n} double" for n in names)
    return docs.mapInArrow(judge, f"doc_id {kind}{columns}, toxic boolean")
