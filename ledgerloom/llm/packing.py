"""Best-fit packing of tokenised documents into sequences of a fixed length.

Large-item matching: pieces above a third of the capacity meet at most two to a sequence, the
largest with the largest partner that fits; smaller pieces then go, longest first, where the
smallest sufficient gap is. Both steps work on the table of lengths, which has at most
``CAPACITY`` rows whatever the number of documents: equal lengths are placed in whole runs. What
comes out is a table of runs (length, ranks from-to, first sequence, pieces a sequence, offset).
Each piece has a rank among those of its length, so it finds its run, and with it its sequence
and offset, by itself. Only the length table and the runs pass the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, batches, byte_texts, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks whose ids a worker remembers, about 200 bytes each.
CACHED_CHUNKS = 700_000
#: Bytes of the texts that are cut into chunks at once (one text may have more).
GROUP_BYTES = 1 << 22
#: First bytes of U+0300 to U+037F, where all marks are that the tokenizer composes with A-Z.
_MARK = re.compile(rb"[\xcc\xcd]")
#: What a byte is for the chunks: white space, letter or digit, punctuation, apostrophe, other.
_SPACE, _LETTER, _POINT, _APOSTROPHE, _OTHER = range(5)
_state: dict = {}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and which pairs of bytes are a letter that stays one in lower case."""
    kinds, letters = np.full(256, _OTHER, np.uint8), np.zeros(1 << 16, bool)
    for b in range(32, 127):
        kinds[b] = _LETTER if chr(b).isalnum() else _POINT
    kinds[[32, *range(9, 14)]] = _SPACE
    kinds[ord("'")] = _APOSTROPHE
    for c in map(chr, [*range(0xC0, 0x250), *range(0x400, 0x460)]):  # Latin, Cyrillic
        if c.isalpha() and len(c.lower()) == 1:
            letters[int.from_bytes(c.encode(), "big")] = True
    return kinds, letters


def _breaks() -> np.ndarray:
    """Where a chunk begins, by 5 times the kind before and the kind of its first byte."""
    found = np.zeros((5, 5), bool)
    found[_SPACE, _SPACE + 1 :] = True
    found[_LETTER, [_POINT, _APOSTROPHE]] = True
    found[_POINT, _LETTER] = True
    return found.ravel()


_KINDS, _LETTERS = _kinds()
_BREAKS = _breaks()


def chunked(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All chunks of the texts in order, and at which chunk each text begins (and the last ends)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    kind = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xD1))
    lead = lead[_LETTERS[data[lead].astype(np.uint16) << 8 | data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    first = np.zeros(len(data), bool)
    first[1:] = _BREAKS[kind[:-1] * 5 + kind[1:]]
    kept = kind != _SPACE
    body = data[kept]
    starts = np.append(np.flatnonzero(first[kept]), len(body)).astype(np.int32)
    chunks = pa.Array.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(body)])
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return chunks, np.searchsorted(np.flatnonzero(first), begins)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Token ids (little-endian 32-bit) of whole texts by a tokenizer that never joins words.

    The tokenizer lower-cases, drops white space and splits there and between letters and
    punctuation, so the ids of a text are those of its chunks, and chunks repeat. A chunk ends at
    white space and where letters or digits and ASCII punctuation meet, but an apostrophe stays
    with what follows it. Letters beyond ASCII count where they are surely one, so not with
    combining marks. A text with a mark that could be a special token goes to the tokenizer whole.
    A-Z are lower-cased here, so that more chunks repeat, but not in texts with combining marks:
    the tokenizer composes before it lower-cases, and some small letters have a composed form that
    the capital lacks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        encode = self.tokenizer.encode_batch_fast
        return [x.ids for x in encode([t.decode() for t in texts], add_special_tokens=False)]

    def _slots(self, chunks: np.ndarray) -> np.ndarray:
        """Where the ids of each chunk are remembered, after those of new ones were made."""
        if len(self.known) > CACHED_CHUNKS:
            self._forget()
        slots = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = chunks[missing].tolist()
            found = self._encode(new)
            slots[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, slots[missing].tolist()))
            ends = self.ends[-1] + np.cumsum([len(x) for x in found])
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), "<u4"))
            self.ends = np.append(self.ends, ends)
        return slots

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        chunks, begins = chunked(
            [t if _MARK.search(t) else t.translate(LOWER) for t in texts])
        coded = chunks.dictionary_encode()
        slots = self._slots(coded.dictionary.to_numpy(zero_copy_only=False))
        slots = slots[coded.indices.to_numpy()]
        starts = self.ends[slots]
        sizes = self.ends[slots + 1] - starts
        ids = self.ids[_ranges(starts, sizes)].tobytes()
        at = np.append(0, 4 * np.cumsum(sizes))[begins].tolist()
        for a, b in pairwise(at):
            yield ids[a:b]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            if text and b"<|" in text:
                yield from self._group(group)
                group, size = [], 0
                yield np.array(self._encode([text])[0], dtype="<u4").tobytes()
                continue
            group.append(text or b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def tokenizer_at(path: str | None) -> WordTokenizer:
    """One tokenizer per Python worker, kept from task to task."""
    if path not in _state:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _state[path] = WordTokenizer(path or public_tokenizers.path(TOKENIZER))
    return _state[path]


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and where the piece was made: ``_task, _nth``.

    ``_nth`` counts the pieces of one length in one task. With ``keep_ids`` the ids come along.
    A null or empty text is the end id alone.
    """
    batches(docs.sparkSession)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer_at(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([END_ID], dtype="<u4").tobytes(), [0] * (capacity + 1)
        for batch in parts:
            rows: list[tuple] = []
            at: list[int] = []
            for k, ids in enumerate(encode(byte_texts(batch["text"]))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    rows.append((piece, start // 4, n, zlib.crc32(part), seen[n],
                                 part if keep_ids else None))
                    seen[n] += 1
                    at.append(k)
            piece, start, n, crc, nth, kept = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([task] * len(rows), pa.int32()), pa.array(nth, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(
        cut,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _task int, "
        "_nth long, ids binary",
    )
    return made if keep_ids else made.drop("ids")


class _Bins:
    """Runs of equal sequences by gap, and the placements made so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []
        self.used: dict[int, int] = {}
        self.placed: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, base: int, bins: int, each: int, offset: int) -> None:
        """``each`` pieces of a length into each of ``bins`` sequences from ``base`` on."""
        rank = self.used.get(length, 0)
        self.placed.append((length, rank, rank + bins * each, base, each, offset))
        self.used[length] = rank + bins * each

    def leave(self, gap: int, base: int, bins: int) -> None:
        if gap > 0 and bins > 0:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((base, bins))

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run with the smallest gap of at least ``least``."""
        k = bisect_left(self.gaps, least)
        if k == len(self.gaps):
            return None
        gap = self.gaps[k]
        base, bins = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.pop(k)
        return gap, base, bins


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Placements ``(length, rank from, rank to, sequence, each, offset)``, and how many sequences."""
    left, bins = dict(counts), _Bins(capacity)
    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        top = a
        while left[a]:
            k = bisect_left(large, min(top, capacity - a) + 1) - 1
            while k >= 0 and not left[large[k]]:
                k -= 1
            b = large[k] if k >= 0 else None
            if b is None:
                base = bins.open(left[a])
                bins.put(a, base, left[a], 1, 0)
                bins.leave(capacity - a, base, left[a])
                left[a] = 0
            elif b == a and left[a] < 2:
                top = a - 1
            else:
                m = left[a] // 2 if a == b else min(left[a], left[b])
                base = bins.open(m)
                if a == b:
                    bins.put(a, base, m, 2, 0)
                else:
                    bins.put(a, base, m, 1, 0)
                    bins.put(b, base, m, 1, a)
                left[a] -= m
                left[b] -= m
                bins.leave(capacity - a - b, base, m)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[s]
        while c:
            run = bins.take(s)
            if run is None:
                each = capacity // s
                n = -(-c // each)
                run = capacity, bins.open(n), n
            gap, base, n = run
            each = gap // s
            full = min(n, c // each)
            rest = min(c - full * each, each - 1) if full < n else 0
            if full:
                bins.put(s, base, full, each, capacity - gap)
                bins.leave(gap - each * s, base, full)
            if rest:
                bins.put(s, base + full, 1, rest, capacity - gap)
                bins.leave(gap - rest * s, base + full, 1)
            after = full + bool(rest)
            bins.leave(gap, base + after, n - after)
            c -= full * each + rest
    table = np.array(sorted(bins.placed), dtype=np.int64).reshape(-1, 6)
    return table, bins.sequences


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    Documents up to ``capacity`` tokens stay whole, longer ones are cut into pieces of it. Ties
    and repeated rows are pieces like others; an empty table gives an empty result. The ranks need
    no sort: each task has numbered its pieces by length, and the counts of the tasks add up.
    """
    pieces = written(token_pieces(docs, capacity, tokenizer, keep_ids), "pieces")
    counts = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count("*").alias("n")).collect()}
    runs, _ = pack_lengths(lengths, capacity)
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    ranked = pieces.join(offsets, ["length", "_task"]).withColumn(
        "_rank", F.col("_nth") + F.col("_before")
    )
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    starts = runs[:, 0] << 44 | runs[:, 1]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = runs[np.searchsorted(starts, n << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in keep]
                + [pa.array(run[:, 3] + nth // run[:, 4]),
                   pa.array(run[:, 5] + nth % run[:, 4] * n)],
                names=[*keep, "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return ranked.select(*keep, "_rank").mapInArrow(
        place, schema + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences from pieces packed with ``keep_ids``; a sequence is bounded by capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.transform(parts, lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"),
        F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("ids_hex"),
    )
