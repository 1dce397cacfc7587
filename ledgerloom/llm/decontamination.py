"""Benchmark decontamination with a suffix automaton of the test items.

The automaton recognises every run of words that occurs in any item. Document words stream through
it; the length of the longest match that ends at each word tells which windows occur there, and
the state tells in which items. The items are dealt into groups of about ``GROUP_WORDS`` words,
each with an automaton of its own, and each group is a pass over the documents: driver and workers
hold one automaton at a time. Longer items are cut into pieces that overlap by a window, so a
group's size doesn't depend on them. A benchmark of one group needs one pass and no join; with
more, the later passes give only the documents that they hit, and what the passes found is united
per document.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_ONLY, batches, byte_texts, free_name, matched, packed, written

WINDOW = 10
GROUP_WORDS = 100_000
MAX_COVERAGE = 0.8
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word lists.

    ``items_at[state]`` has the items of the window that a match of at least ``window`` words ends
    with; ``short_at[state]`` the items shorter than a window that end there, longest first.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lists = [(key, [self.ids[w] for w in words]) for key, words in items if words]
        for _, word_ids in lists:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(x) for _, x in lists)], default=window)
        self._mark(lists)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state that holds only the words up to length of ``p`` plus one, taken out of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w, self.step[last][w])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def _mark(self, lists: list[tuple[object, list[int]]]) -> None:
        # The states are visited by length, so a state's link is done before the state itself.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short_at: list[tuple] = [()] * len(self.link)
        self.window_state = [-1] * len(self.link)
        short: dict[int, list] = {}
        for key, word_ids in lists:
            if len(word_ids) < self.window:
                state = 0
                for w in word_ids:
                    state = self.step[state][w]
                short.setdefault(state, []).append((len(word_ids), key))
        for state in order[1:]:
            up = self.link[state]
            own = tuple(sorted(short.get(state, ()), key=lambda x: -x[0]))
            self.short_at[state] = own + self.short_at[up]
            if self.length[state] >= self.window:
                self.window_state[state] = (
                    self.window_state[up] if self.length[up] >= self.window else state
                )
        self.items_at: dict[int, set] = {}
        for key, word_ids in lists:
            for _, _, state in self._run(word_ids, 0):
                if self.window_state[state] >= 0:
                    self.items_at.setdefault(self.window_state[state], set()).add(key)

    def _run(self, word_ids, at: int) -> Iterator[tuple[int, int, int]]:
        """Position, longest match that ends there, and its state."""
        state = n = 0
        step, link, length = self.step, self.link, self.length
        for i, w in enumerate(word_ids, at):
            while state and w not in step[state]:
                state = link[state]
                n = length[state]
            if w in step[state]:
                state = step[state][w]
                n += 1
            else:
                state = n = 0
            yield i, n, state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Mask of the words inside occurring windows (None without any), and the items met."""
        met: set = set()
        if len(words) < self.shortest or not self.ids:
            return None, met
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        mask = None
        for a, b in edges.reshape(-1, 2):
            if b - a < self.shortest:
                continue
            for i, n, state in self._run(ids[a:b].tolist(), int(a)):
                cover = 0
                if n >= self.window:
                    cover = self.window
                    met |= self.items_at[self.window_state[state]]
                for k, key in self.short_at[state]:
                    if k <= n:
                        met.add(key)
                        cover = max(cover, k)
                if cover:
                    if mask is None:
                        mask = np.zeros(len(words), dtype=bool)
                    mask[i + 1 - cover : i + 1] = True
        return mask, met


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_ONLY).split() if text else []


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """``item, words``: the items' words, in pieces of at most ``most`` words.

    Neighbouring pieces share ``window - 1`` words, so every window is in one of them.
    """
    step = max(1, most - window + 1)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            items, words = [], []
            for name, text in zip(batch["item"].to_pylist(), byte_texts(batch["text"])):
                own = words_of(text)
                for at in range(0, max(1, len(own) - window + 1) if own else 0, step):
                    items.append(name)
                    words.append(own[at : at + step + window - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(words, pa.list_(pa.binary()))],
                names=["item", "words"])

    known = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return known.filter("text is not null").mapInArrow(cut, "item string, words array<binary>")


def automata(
    benchmark: DataFrame, window: int = WINDOW, group_words: int | None = None
) -> Iterator[Automaton]:
    """Automata of the groups of items, at least one. The driver holds one group at a time.

    Items with a null text or without words have no window and take no part.
    """
    most = GROUP_WORDS if group_words is None else group_words
    pieces = written(_pieces(benchmark, window, max(window, most // 4)), "benchmark")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    groups = max(1, -(-total // most))
    for g in range(groups):
        part = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == g)
        yield Automaton([(r["item"], list(map(bytes, r["words"]))) for r in part.collect()], window)


def _passes(
    docs: DataFrame, benchmark: DataFrame, window: int
) -> Iterator[tuple[DataFrame, object]]:
    """``doc_id, tag, n_words, spans, items`` of every group's pass, and its broadcast.

    The first pass has all documents, the others those with a hit.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), "text")
    for number, automaton in enumerate(automata(benchmark, window)):
        shared = context.broadcast(packed(automaton))
        yield rows.mapInArrow(
            _judge(shared, only_hit=number > 0),
            f"doc_id {kind}, tag long, n_words long, spans array<struct<from:int,to:int>>, "
            "items array<string>"), shared


def _judge(shared, only_hit: bool):
    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = pickle.loads(shared.value)
        for batch in parts:
            rows = []
            for k, text in enumerate(byte_texts(batch["text"])):
                words = words_of(text)
                mask, met = finder.hits(words)
                if met or not only_hit:
                    spans = [{"from": a, "to": b} for a, b in _runs(mask)]
                    rows.append((k, len(words), spans, list(met)))
            at, n, spans, items = zip(*rows) if rows else [()] * 4
            some = batch.take(pa.array(at, pa.int64()))
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [some["doc_id"], some["tag"], pa.array(n, pa.int64()), pa.array(spans, span),
                 pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "tag", "n_words", "spans", "items"])

    return judge


def _united_spans(spans: Column) -> Column:
    """Runs of words that lie in any of the spans."""
    start = F.array().cast("array<struct<from:int,to:int>>")

    def add(out, span):
        last = F.element_at(out, -1)
        joined = F.struct(last["from"].alias("from"), F.greatest(last["to"], span["to"]).alias("to"))
        meets = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["to"] >= span["from"])
        return F.when(
            meets, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        ).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(F.array_sort(spans), start, add)


def _hit_rows(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``doc_id, tag, n_words, spans, items`` of every row, all groups of items together."""
    batches(docs.sparkSession)
    first, more = None, []
    for found, shared in _passes(docs, benchmark, window):
        if first is None:
            first = found
        else:
            more.append(written(found, "benchmark-hits"))
            shared.unpersist()
    if not more:
        return first
    rest = more[0]
    for found in more[1:]:
        rest = rest.unionByName(found)
    # Equal rows have equal hits; they are one here and find each other again in the join.
    rest = rest.groupBy("doc_id", "tag").agg(
        F.flatten(F.collect_list("spans")).alias("_spans"),
        F.flatten(F.collect_list("items")).alias("_items"))
    rest = rest.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    same = (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    both = matched(first, rest, same, "left")
    spans = _united_spans(F.concat("spans", "_spans"))
    return both.select(
        "doc_id", "tag", "n_words",
        F.when(F.col("_spans").isNull(), F.col("spans")).otherwise(spans).alias("spans"),
        F.when(F.col("_items").isNull(), F.col("items")).otherwise(
            F.array_distinct(F.concat("items", "_items"))).alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` has the word positions ``[from, to)`` of each run of hit words. Null and empty texts
    have no words; repeated rows are judged row by row; an empty benchmark hits nothing. Items
    without an item_id are one item that has no name: it counts in ``n_items``, and
    ``items_sha256`` leaves it out.
    """
    found = _hit_rows(docs, benchmark, window)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans")


def _runs(mask: np.ndarray | None) -> list[tuple[int, int]]:
    if mask is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORDS.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join(kept) + text[at:]


def cut_text(text: bytes, finder: Automaton, min_words: int, max_coverage: float) -> bytes | None:
    """The text without its hit spans of at least ``min_words`` words; None if too much is hit.

    Shorter hit spans exist only where an item has fewer words than a window; they go as well, for
    they cover that item whole. What a cut brings together is looked at again.
    """
    while True:
        words = words_of(text)
        mask, _ = finder.hits(words)
        if mask is None:
            return text
        if mask.sum() > max_coverage * len(words):
            return None
        spans = [(a, b) for a, b in _runs(mask) if b - a >= min_words]
        if not spans:
            return text
        text = without_spans(text, spans)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_words: int = 1,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """``docs`` without benchmark passages; all columns stay, ``text`` and ``n_chars`` follow.

    Hit spans of at least ``min_words`` words are cut out; a document of whose words more than
    ``max_coverage`` are hit goes as a whole. Documents without a hit stay byte for byte.
    """
    batches(docs.sparkSession)
    first = automata(benchmark, window)
    automaton, second = next(first), next(first, None)
    if second is not None:
        return _cut_by_groups(docs, benchmark, window, min_words, max_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(packed(automaton))

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = pickle.loads(shared.value)
        for batch in parts:
            old = byte_texts(batch["text"])
            new = [t and cut_text(t, finder, min_words, max_coverage) for t in old]
            stay = [k for k, (t, u) in enumerate(zip(old, new)) if u is not None or t is None]
            if changed := [k for k in stay if new[k] != old[k]]:
                batch = with_texts(batch, {k: new[k].decode() for k in changed})
            yield batch if len(stay) == len(old) else batch.take(pa.array(stay, pa.int64()))

    return docs.mapInArrow(clean, docs.schema)


def _cut_by_groups(docs, benchmark, window: int, min_words: int, max_coverage: float) -> DataFrame:
    """``decontaminate`` where the items are several groups: what was cut is looked at again in
    further rounds, which have only the documents that the round before has changed."""
    done = None
    left = docs
    while True:
        found = _hit_rows(left, benchmark, window).filter(F.size("spans") > 0)
        words = F.aggregate("spans", F.lit(0), lambda n, s: n + (s["to"] - s["from"]))
        long = F.filter("spans", lambda s: s["to"] - s["from"] >= min_words)
        go = words > F.lit(max_coverage) * F.col("n_words")
        # Equal rows are one here; a row that stays as it is needs no cut.
        found = written(found.select(
            F.col("doc_id").alias("_llm_id"), F.col("tag").alias("_llm_tag"), go.alias("_llm_go"),
            long.alias("_llm_cut")).filter("_llm_go or size(_llm_cut) > 0").dropDuplicates(
            ["_llm_id", "_llm_tag"]), "benchmark-cuts")
        mine = free_name(left, "_llm_own")
        own = left.withColumn(mine, F.xxhash64("doc_id", "text"))
        same = (own[mine] == found["_llm_tag"]) & own["doc_id"].eqNullSafe(found["_llm_id"])
        clean = matched(own, found, same, "left_anti").drop(mine)
        done = clean if done is None else done.unionByName(clean)
        if found.isEmpty():
            return done
        again = found.filter("not _llm_go")
        cut = matched(own, again, (own[mine] == again["_llm_tag"])
                      & own["doc_id"].eqNullSafe(again["_llm_id"])).select(
            *[own[c] for c in docs.columns], again["_llm_cut"])
        left = written(cut.mapInArrow(_cut_spans, docs.schema), "cut-texts")


def _cut_spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        spans = [[(s["from"], s["to"]) for s in row] for row in batch["_llm_cut"].to_pylist()]
        new = {
            k: without_spans(text, own).decode()
            for k, (text, own) in enumerate(zip(byte_texts(batch["text"]), spans))
        }
        rest = batch.select([c for c in batch.schema.names if c != "_llm_cut"])
        yield with_texts(rest, new) if new else rest


def with_texts(batch: pa.RecordBatch, new: dict[int, str]) -> pa.RecordBatch:
    """The batch with other texts in some rows; ``n_chars``, where there is one, follows."""
    texts = batch["text"].to_pylist()
    for k, text in new.items():
        texts[k] = text
    columns = {"text": pa.array(texts, batch.schema.field("text").type)}
    if "n_chars" in batch.schema.names:
        sizes = batch["n_chars"].to_pylist()
        for k, text in new.items():
            sizes[k] = len(text)
        columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(
        [columns.get(n, batch[n]) for n in batch.schema.names], schema=batch.schema
    )
