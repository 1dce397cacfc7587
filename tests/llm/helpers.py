"""Rows and plain versions that several tests use."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", tag string, row string, start string, toxic string, sequence_id string, _part string"


def documents(spark, texts, ids=None, langs=None):
    """A documents table with extra columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [
        (i, t, g, None, None if t is None else len(t), "a", None, "b", "c", "d", "e")
        for i, t, g in zip(ids, texts, langs)
    ]
    return spark.createDataFrame(rows, SCHEMA + EXTRA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rng(seed=1):
    return random.Random(seed)


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
