"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a linear classifier on hashed byte trigrams. A text's
bit margins are compared with every codeword by a loss weighted with the bits' reliability, and
the nearest codeword wins. With up to five languages the code is exhaustive, beyond that it is the
random code with the largest least distance among ``CODE_DRAWS`` draws.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_texts, packed, written

#: Documents the classifiers are fitted on, at most about so many, shared evenly by the languages.
TRAIN_DOCS = 3000
FEATURES = 4096
CODE_DRAWS = 200
STEPS = 120
PENALTY = 1e-3
AMBIGUOUS = 0.2
CHUNK = 4_000_000
#: Letters in lower case; every other ASCII byte counts as a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else (b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Feature of the trigram that starts at each byte; 0 for three spaces."""
    a = data.astype(np.uint32) - np.uint32(32)
    a = np.concatenate([a, np.zeros(2, np.uint32)])
    mix = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B)
    mix += a[2:] * np.uint32(0xC2B2AE35)
    mix ^= mix >> np.uint32(15)
    return ((mix * np.uint32(0x2C1B3C6D)) >> np.uint32(20)).astype(np.uint16)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram features of some whole texts in a row, and where each text starts."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        part.append(_padded(text or b""))
        size += len(part[-1])
        if size > CHUNK:
            yield _joined(part)
            part, size = [], 0
    if part:
        yield _joined(part)


def _padded(text: bytes) -> bytes:
    """No trigram of two neighbouring texts has letters of both."""
    return b"  " + text.translate(LETTERS) + b" "


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, part)])[:-1]
    return trigrams(np.frombuffer(b"".join(part), np.uint8)), starts


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each of ``k`` languages."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        n = np.arange(1, 2 ** (k - 1))
        bits = np.array([np.zeros_like(n), *((n >> i) & 1 for i in range(k - 1))])
        return 2.0 * bits - 1
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, least = None, -1
    for _ in range(CODE_DRAWS):
        code = rng.choice([-1.0, 1.0], (k, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(k)
        if np.abs(code.sum(0)).max() < k and apart.min() > least:
            best, least = code, apart.min()
    return best


def fit_bits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic classifiers for all bits: weights by feature, biases, reliability of each bit."""
    scale = 1 / (x.std(0) + 1e-4)
    scale[0] = 0
    centre = x.mean(0)
    z = (x - centre) * scale
    w, b = np.zeros((z.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 4.0 / (1 + (z * z).sum(1).mean())
    for _ in range(STEPS):
        pull = -y / (1 + np.exp(np.clip(y * (z @ w + b), -30, 30))) / len(z)
        vw = 0.9 * vw - rate * (z.T @ pull + PENALTY * w)
        vb = 0.9 * vb - rate * pull.sum(0)
        w, b = w + vw.astype(np.float32), b + vb.astype(np.float32)
    right = (np.sign(z @ w + b) == y).mean(0)
    w = w * scale[:, None]
    return w.astype(np.float32), b - centre @ w, np.maximum(right - 0.5, 0.01)


def train(docs: DataFrame, seed: int = 3) -> dict:
    """A model from ``text`` and ``lang``; rows where either is null take no part.

    At most about ``TRAIN_DOCS`` rows, drawn evenly by language, reach the one fitting task, each
    as a row of ``FEATURES`` numbers; texts of any length weigh the same there.
    """
    batches(docs.sparkSession)
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    known = known.filter(F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return {"languages": languages}
    share = TRAIN_DOCS / len(languages)
    drawn = known.sampleBy("lang", {k: min(1.0, share / n) for k, n in counts.items()}, seed)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for text in byte_texts(batch["text"]):
                grams, _ = _joined([_padded(text)])
                seen = np.bincount(grams, minlength=FEATURES).astype(np.float32)
                seen[0] = 0
                rows.append((seen / max(seen.sum(), 1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], pa.array(rows, pa.binary())], names=["lang", "x"]
            )

    code = codewords(len(languages))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "x"])
        x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, FEATURES)
        y = code[[languages.index(v) for v in rows["lang"]]].astype(np.float32)
        return pd.DataFrame({"model": [packed(fit_bits(x, y))]})

    sample = written(drawn.mapInArrow(features, "lang string, x binary"), "language-sample")
    one = sample.withColumn("_all", F.lit(0)).groupBy("_all")
    model = one.applyInPandas(fit, "model binary").first()
    if model is None:
        return {"languages": []}
    weights, bias, reliability = pickle.loads(model["model"])
    return {"languages": languages, "code": code, "weights": weights, "bias": bias,
            "reliability": reliability / reliability.sum()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of the likelihood, and whether the next one is nearly as near."""
    code, weight = model["code"], model["reliability"]
    losses = np.stack(
        [np.logaddexp(0, -margins * word) @ weight for word in code], axis=1
    ) * code.shape[1]
    near = np.exp(losses.min(1, keepdims=True) - losses)
    share = near / near.sum(1, keepdims=True)
    order = np.sort(share, axis=1)
    best = share.argmax(1)
    return best, share[np.arange(len(share)), best], order[:, -1] - order[:, -2] < AMBIGUOUS


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` from whole texts; nothing else is looked at.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language
    was learned; with one language known, every other text gets it with score 1.
    """
    batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        names = known["languages"]
        if len(names) > 1:
            # Whole numbers add up to the same in any order, so equal texts get equal scores.
            unit = 2.0**30 / max(float(np.abs(known["weights"]).max()), 1e-9)
            weights = np.round(known["weights"].T * unit).astype(np.int64)
        for batch in parts:
            n, has = batch.num_rows, np.array(batch["_lettered"].to_pylist(), dtype=bool)
            best, score, unsure = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
            if len(names) > 1 and n:
                margins = []
                for grams, starts in chunks(byte_texts(batch["text"])):
                    seen = np.maximum(np.add.reduceat((grams > 0).astype(np.int64), starts), 1)
                    margins.append(np.stack(
                        [np.add.reduceat(w[grams], starts) / (seen * unit) for w in weights],
                        axis=1))
                best, score, unsure = decode(np.concatenate(margins) + known["bias"], known)
            has &= bool(names)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"],
                 pa.array([names[b] if h else "und" for b, h in zip(best, has)], pa.string()),
                 pa.array(np.where(has, score, 0.0)), pa.array(unsure & has)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", lettered.alias("_lettered")).mapInArrow(
        judge, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )
