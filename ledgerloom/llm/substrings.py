"""Removal of passages that an earlier document has, by seed and extend.

Seeds are winnowed anchors: of the ``ANCHOR``-word sequences inside a window of ``WINDOW`` words,
the one with the least hash (the first of equals). Equal windows have equal anchors at the same
place, so documents with a window in common meet at an anchor; an anchor that occurs in one
document only is given up at once. Around each remaining anchor the match is extended both ways as
far as windows with this anchor reach. This is done against all partners together: each window is
looked up by its hash and the anchor's, and the earliest document that has it is the partner. So
an anchor that a third of all documents share costs one row per occurrence and window, never one
per pair. Overlapping matched windows join into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, byte_texts, mixed, written

WINDOW = 50
ANCHOR = 16
CHUNK_WORDS = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.uint64(26)


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * CHUNK_WORDS)
            ones = np.ones(n, np.uint64)
            ones[1:] = _BASE
            cls.up = np.multiply.accumulate(ones)
            ones[1:] = _INVERSE
            cls.down = np.multiply.accumulate(ones)
        return cls.up[:n], cls.down[:n]


class Windows:
    """All windows of some texts in a row: where they start, their anchors and hashes."""

    def __init__(self, lists: list[list[bytes]], hashes: WordHashes):
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        h = np.concatenate([hashes.of(words) for words in lists]) if n else np.zeros(0, np.uint64)
        up, self.down = _Powers.to(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
        left = np.repeat(self.first[1:], sizes) - np.arange(n)
        #: Starts of windows that end inside their document.
        self.start = np.flatnonzero(left >= WINDOW)
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.grams = mixed(self.of(np.arange(max(n - ANCHOR + 1, 0)), ANCHOR))
        key = (self.grams >> _PLACE << _PLACE) | np.arange(len(self.grams), dtype=np.uint64)
        width = WINDOW - ANCHOR + 1
        pad = -len(key) % width + width
        rows = np.concatenate([key, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[self.start], ahead[self.start + width - 1])
        self.anchor = (least & np.uint64(2 ** int(_PLACE) - 1)).astype(np.int64)

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of whole texts, about ``CHUNK_WORDS`` at a time, and the row of the first text."""
    part, size, at = [], 0, 0
    for k, text in enumerate(byte_texts(batch["text"])):
        part.append(text.split() if text else [])
        size += len(part[-1])
        if size > CHUNK_WORDS:
            yield at, part
            part, size, at = [], 0, k + 1
    if part:
        yield at, part


def _summaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the number of words, the checksum of all of them, and its anchors."""
    hashes = WordHashes()
    for batch in parts:
        counts, sums, offsets, values = [], [], [0], []
        for _, lists in _portions(batch):
            windows = Windows(lists, hashes)
            pairs = np.unique(windows.doc << 32 | windows.anchor)
            doc, gram = pairs >> 32, windows.grams[pairs & (2**32 - 1)].view(np.int64)
            values.append(gram)
            per = np.bincount(doc, minlength=len(lists))
            offsets += (offsets[-1] + np.cumsum(per)).tolist()
            counts += map(len, lists)
            sums += [hashlib.sha256(b" ".join(words)).hexdigest() for words in lists]
        anchors = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.array(np.concatenate(values or [[]]), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["tag"], batch["copy"], pa.array(counts, pa.int64()),
             pa.array(sums, pa.string()), anchors],
            names=["doc_id", "tag", "copy", "n_words", "all_sha256", "anchors"])


def _extended(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows around the shared anchors of each document."""
    hashes = WordHashes()
    for batch in parts:
        shared = batch["anchors"].to_pylist()
        for at, lists in _portions(batch):
            windows = Windows(lists, hashes)
            place, back = np.unique(windows.anchor, return_inverse=True)
            doc = np.searchsorted(windows.first, place, side="right") - 1
            salt = mixed(np.arange(len(lists), dtype=np.uint64))
            wanted = [np.array(shared[at + k], np.int64).view(np.uint64) ^ salt[k]
                      for k in range(len(lists))]
            keep = np.isin(windows.grams[place] ^ salt[doc], np.concatenate(wanted))[back]
            start, doc = windows.start[keep], windows.doc[keep]
            rows = pa.array(doc + at)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(rows), batch["tag"].take(rows),
                 pa.array(windows.grams[windows.anchor[keep]].view(np.int64)),
                 pa.array(windows.of(start, WINDOW).view(np.int64)),
                 pa.array((start - windows.first[doc]).astype(np.int32))],
                names=["doc_id", "tag", "anchor", "hash", "start"])


def spans_of(starts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows that start at ``starts``."""
    spans: list[list[int]] = []
    for s in sorted(starts):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = s + WINDOW
        else:
            spans.append([s, s + WINDOW])
    return [(a, b) for a, b in spans]


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    for batch in parts:
        removed, sums, repeats = [], [], []
        for text, starts in zip(byte_texts(batch["text"]), batch["starts"].to_pylist()):
            words, spans, kept, at = text.split(), spans_of(starts), [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            removed.append(len(words) - len(kept))
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            repeats.append([{"from": a, "to": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["tag"], pa.array(removed, pa.int64()),
             pa.array(sums, pa.string()), pa.array(repeats, span)],
            names=["doc_id", "tag", "n_removed", "kept_sha256", "repeats"])


def _beside_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with the list that belongs to them."""
    return docs.select("doc_id", "tag", "text").join(lists, ["doc_id", "tag"])


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several documents have, with the smallest doc_id.

    Joins read it as a table: both sides then come straight from their shuffle, which is what
    Spark needs to split the partition of a hot key.
    """
    return rows.groupBy(*keys).agg(
        F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")
    ).filter("_first < _last").drop("_last")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, repeats`` for every row.

    A word goes if a window that covers it also starts in a document with a smaller doc_id.
    ``repeats`` has the removed spans of words ``[from, to)``. Texts that are null, empty or
    shorter than a window are kept whole, and so are rows with a null doc_id, which are nobody's
    partner either. Rows that share a doc_id are judged each by itself and never by one another.
    Exact copies are settled by one comparison of checksums; only the first goes on.
    """
    batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("tag"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"))
    summed = written(rows.mapInArrow(
        _summaries,
        f"doc_id {kind}, tag long, copy binary, n_words long, all_sha256 string, "
        "anchors array<long>"), "summaries")
    known = summed.filter("doc_id is not null")
    originals = written(_shared(known, ["copy"]), "originals")
    marked = summed.join(originals, "copy", "left").withColumn(
        "_copied", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    seeds = marked.filter(f"not _copied and doc_id is not null and n_words >= {WINDOW}").select(
        "doc_id", "tag", F.explode("anchors").alias("anchor"))
    shared = written(_shared(seeds, ["anchor"]).select("anchor"), "anchors")
    lists = written(
        seeds.join(shared, "anchor").groupBy("doc_id", "tag").agg(
            F.collect_set("anchor").alias("anchors")), "shared-anchors")
    near = _beside_texts(rows, lists)
    windows = written(near.mapInArrow(
        _extended, f"doc_id {kind}, tag long, anchor long, hash long, start int"), "windows")
    partners = written(_shared(windows, ["anchor", "hash"]), "partners")
    hits = windows.join(partners, ["anchor", "hash"]).filter("doc_id > _first")
    starts = written(
        hits.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts")), "hits")
    cut = _beside_texts(rows, starts).mapInArrow(
        _cut,
        f"doc_id {kind}, tag long, n_removed long, kept_sha256 string, "
        "repeats array<struct<from:int,to:int>>").dropDuplicates(["doc_id", "tag"])
    gone = F.col("_copied") & (F.col("n_words") >= WINDOW)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    nothing = F.array().cast("array<struct<from:int,to:int>>")
    return marked.drop("copy", "anchors", "_first").join(cut, ["doc_id", "tag"], "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(
            F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.coalesce("repeats", nothing)).alias("repeats"),
    )
