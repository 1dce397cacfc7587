"""Near-duplicates by a chosen-path set similarity join.

A document's set are its distinct 5-word shingles; equal sets are one node from the start. Each of
several independent trees sends a node down a path of minwise tokens: the root branches by the
least shingle under the tree's own hash; a branch that is still large branches again, into
``BRANCHES`` children by further minwise tokens. Similar sets choose the same token with a chance
equal to their similarity, so a pair at the threshold is lost by one tree with a chance of about
``1 - threshold`` and by all trees with less than ``LOSS``. Branches of at most ``NODE_ROWS``
members are compared exhaustively, by sketches of minwise values. What stays large down to
``DEPTH`` is compared in blocks, all of them, so no pair depends on a cap.

Pairs that the sketches can't rule out only tie their nodes to a candidate group. Inside the
groups the full sets decide: a group of at most ``GROUP_ROWS`` nodes and ``GROUP_SHINGLES``
shingles in one task, a larger one branch by branch again, and what is too large of these in
blocks of which every two meet. So a task holds a bounded number of bytes, whatever the length of
the texts. Only ties to the least node are written, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    LOWER, WordHashes, batches, byte_texts, free_name, matched, mixed, odd_numbers, written,
)
from .graph import components

SHINGLE = 5
SKETCH = 128
#: Chance to lose a pair that just reaches the threshold, once by the trees and once by the sketch.
LOSS = 1e-8
NODE_ROWS = 2048
GROUP_ROWS = 2048
#: Shingles of the full sets that meet in one task; two sets that are larger meet all the same.
GROUP_SHINGLES = 4_000_000
BRANCHES = 2
DEPTH = 3
BLOCK = 1024


def trees_for(threshold: float) -> int:
    """Trees that bring the loss under ``LOSS`` if a pair has to pass all ``DEPTH`` lower levels."""
    kept = threshold * (1 - (1 - threshold) ** BRANCHES) ** DEPTH
    return math.ceil(math.log(LOSS) / math.log(max(LOSS, 1 - kept)))


def least_equal(threshold: float) -> int:
    """Fewer equal sketch values have a chance of at most ``LOSS`` at the threshold (binomial)."""
    below, k = 0.0, 0
    while True:
        below += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if below > LOSS:
            return k
        k += 1


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of all words as one if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h, size = hashes.of(words), min(SHINGLE, len(words))
    turn, n = odd_numbers(SHINGLE, 99), len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += mixed(h[k : k + n] ^ turn[k])
    return np.unique(mixed(total))


def least_values(shingles: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The least value of a set under each of several hashes."""
    best = None
    for at in range(0, len(shingles), BLOCK):
        part = (turns[:, None] * shingles[None, at : at + BLOCK]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def _portions(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for text in byte_texts(batch["text"]):
        yield text.translate(LOWER).split() if text else []


def tag() -> Column:
    """With the doc_id it tells rows apart; equal rows share it."""
    return F.xxhash64("doc_id", "text").alias("tag")


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """``doc_id, tag, n_shingles, set_id, roots, sketch`` of every row; null sets are empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, turns = WordHashes(), odd_numbers(trees + SKETCH, 7)
        for batch in parts:
            sizes, ids, roots, sketches = [], [], [], []
            for words in _portions(batch):
                own = shingle_set(words, hashes)
                sizes.append(len(own))
                if not len(own):
                    ids.append(None)
                    roots.append(None)
                    sketches.append(None)
                    continue
                least = least_values(own, turns)
                ids.append(xxhash.xxh3_128_digest(own.tobytes()))
                roots.append(least[:trees].view(np.int64))
                # The low bits: the high ones of the least of many values are mostly zeros.
                sketches.append((least[trees:] & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tag"], pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(roots, pa.list_(pa.int64())),
                 pa.array(sketches, pa.binary())],
                names=["doc_id", "tag", "n_shingles", "set_id", "roots", "sketch"])

    return docs.select("doc_id", "text", tag()).mapInArrow(
        sign, f"doc_id {kind}, tag long, n_shingles long, set_id binary, roots array<long>, "
        "sketch binary")


def whole_groups(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted column, and where each group starts (and the end)."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy()
        last = int(np.searchsorted(values, values[-1], side="left"))
        if held and (last > 0 or held[-1][key][-1].as_py() != values[0]):
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            yield table, _bounds(table[key].to_numpy())
            held = [batch.slice(last)]
        elif last > 0:
            table = pa.Table.from_batches([batch.slice(0, last)])
            yield table, _bounds(values[:last])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _bounds(table[key].to_numpy())


def _bounds(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _merge(labels: np.ndarray, x: int, others: np.ndarray) -> None:
    """``x`` and ``others`` get the least of their labels, and so does who shares one of these."""
    if len(others):
        roots = np.unique(np.append(labels[others], labels[x]))
        if len(roots) > 1:
            labels[np.isin(labels, roots)] = roots[0]


def alike_sketches(sketches: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the groups tied by pairs whose sketches don't rule the threshold out."""
    least = least_equal(threshold)
    labels = np.arange(len(sizes))
    for x in range(1, len(sizes)):
        small, big = np.minimum(sizes[:x], sizes[x]), np.maximum(sizes[:x], sizes[x])
        near = np.flatnonzero((small >= threshold * big - 1e-9) & (labels[:x] != labels[x]))
        if len(near):
            same = np.count_nonzero(sketches[near] == sketches[x], axis=1)
            _merge(labels, x, near[same >= least])
    return labels


def alike_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels of the groups linked by pairs of sets whose similarity reaches ``percent``."""
    sizes = np.array([len(s) for s in sets])
    labels = np.arange(len(sets))
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(shingle, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    for x in range(1, len(sets)):
        own = shingle[first[x] : first[x + 1]]
        count = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        both = np.bincount(holder[at + np.arange(count.sum())], minlength=len(sets))[:x]
        either = sizes[:x] + sizes[x] - both
        _merge(labels, x, np.flatnonzero((both > 0) & (100 * both >= percent * either)))
    return labels


def _ties(nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of a group to the group's least node."""
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, nodes)
    at = least[labels]
    tied = nodes != at
    return nodes[tied], at[tied]


def _linked(rows: DataFrame, key: str, judge, columns: list[str]) -> DataFrame:
    """Links ``a, b`` inside the groups of ``key``; ``judge`` labels the rows of a group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(parts, key):
            node, a, b = table["node"].to_numpy(), [], []
            values = [table[c].to_pylist() for c in columns]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo > 1:
                    x, y = _ties(node[lo:hi], judge(*(v[lo:hi] for v in values)))
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    sorted_rows = rows.repartition(key).sortWithinPartitions(key)
    return sorted_rows.select(key, "node", *columns).mapInArrow(run, "a long, b long")


def branches(nodes: DataFrame) -> DataFrame:
    """``path, node``: the branches to compare exhaustively, of at most about ``NODE_ROWS`` nodes."""
    members = nodes.select("node", F.posexplode("roots").alias("tree", "token")).select(
        F.xxhash64("tree", "token").alias("path"), "node")
    ready = None
    for depth in range(DEPTH + 1):
        sizes = members.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = written(sizes, "branch-sizes")
        members = written(matched(members, sizes, "path"), "branches")
        small = members.filter(f"n <= {NODE_ROWS}").select("path", "node")
        ready = small if ready is None else ready.unionByName(small)
        large = members.filter(f"n > {NODE_ROWS}")
        if large.isEmpty():
            return ready
        if depth < DEPTH:
            pick = F.explode(F.sequence(F.lit(1), F.lit(BRANCHES))).alias("branch")
            chosen = matched(large, nodes.select("node", "sketch"), "node").select(
                "path", "node", "sketch", pick)
            at = F.pmod(F.xxhash64("path", "branch"), F.lit(SKETCH)).cast("int")
            token = F.substring("sketch", 2 * at + 1, F.lit(2))
            members = chosen.select(F.xxhash64("path", "branch", token).alias("path"), "node")
    # What no token parts any more meets block by block.
    return ready.unionByName(in_blocks(large, F.ceil(F.col("n") / (NODE_ROWS // 2))))


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """``path, node`` such that every two of the ``blocks`` of a path's members meet once."""
    placed = members.withColumn("_blocks", F.greatest(blocks.cast("int"), F.lit(1))).withColumn(
        "_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    ends = F.least("_own", "_other"), F.greatest("_own", "_other")
    return placed.select(F.xxhash64("path", F.lit("blocks"), *ends).alias("path"), "node")


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``row, doc_id, tag, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows are linked if ``100 * shared >= percent * united`` shingles; ``component_id`` is the
    smallest doc_id reachable by links and ``kept`` says whether it is the row's own. Texts that
    are null or without words link with nothing and are kept. Repeated rows share a component.
    ``tag`` is a checksum of doc_id and text by which a row is found again.
    """
    spark = docs.sparkSession
    batches(spark)
    threshold = percent / 100
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(
        signatures(docs, trees_for(threshold)).withColumn("row", F.monotonically_increasing_id()),
        "signatures")
    sets = written(signed.filter("set_id is not null").groupBy("set_id").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("first_doc")), "sets")
    keys = sets.select("node")
    nodes = written(
        matched(signed.withColumnRenamed("row", "node"), keys, "node").select(
            "node", "doc_id", "tag", "n_shingles", "roots", "sketch"), "nodes")
    paths = written(branches(nodes), "paths")

    def by_sketch(sketches, sizes):
        return alike_sketches(
            np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SKETCH), np.array(sizes), threshold)

    compared = matched(paths, nodes.select("node", "sketch", "n_shingles"), "node")
    candidates = components(_linked(compared, "path", by_sketch, ["sketch", "n_shingles"]))
    candidates = written(
        matched(candidates, nodes.select("node", "doc_id", "tag", "n_shingles"), "node"), "candidates")
    sized = written(candidates.groupBy("component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "group-sizes")
    wanted = matched(candidates, sized, "component").withColumn(
        "small", (F.col("n") <= GROUP_ROWS) & (F.col("shingles") <= GROUP_SHINGLES))
    wanted = written(wanted.select("node", "doc_id", "tag", "component", "small"), "wanted")

    # The full sets of all candidates, made again from the texts.
    texts = matched(
        docs.select(tag(), F.col("doc_id").alias("_id"), "text"), wanted, "tag"
    ).filter(F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "component", "small", "text")

    def to_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts:
            made = [shingle_set(words, hashes).tobytes() for words in _portions(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["component"], batch["small"], pa.array(made, pa.binary())],
                names=["node", "component", "small", "shingles"])

    full = written(texts.mapInArrow(
        to_sets, "node long, component long, small boolean, shingles binary"
    ), "full-sets")

    def by_set(raw):
        return alike_sets([np.frombuffer(s, np.uint64) for s in raw], percent)

    links = _linked(full.filter("small"), "component", by_set, ["shingles"])
    large = full.filter("not small").select("node", "shingles")
    if not large.isEmpty():
        # The same branches as before, those with too many shingles in blocks.
        size = large.select("node", (F.octet_length("shingles") / 8).cast("long").alias("size"))
        met = written(matched(paths, size, "node"), "large-branches")
        total = met.groupBy("path").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
        total = written(total.filter("n > 1"), "large-branch-sizes")
        blocks = F.ceil(F.col("total") * 2 / GROUP_SHINGLES)
        placed = in_blocks(matched(met, total, "path"), F.when(
            F.col("total") <= GROUP_SHINGLES, 1).otherwise(blocks))
        links = links.unionByName(
            _linked(matched(placed, large, "node"), "path", by_set, ["shingles"]))
    linked = components(links)

    first = sets.select("node", "first_doc")
    least = linked.join(first, "node").groupBy("component").agg(F.min("first_doc").alias("least"))
    least = written(least, "least-documents")
    named = linked.join(least, "component").select("node", "least")
    by_id = matched(sets, named, "node", "left").select(
        "set_id", F.coalesce("least", "first_doc").alias("_component"))
    rows = signed.select("row", "doc_id", "tag", "n_shingles", "set_id")
    out = matched(rows, by_id, "set_id", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "row", "doc_id", "tag", "n_shingles", component.cast(kind).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay as they are.

    The row with the smallest doc_id stays; of several with that doc_id, the one read first. Rows
    without words stay. The list of rows to go meets the texts by a shuffle, whatever its size.
    """
    found = near_groups(docs, percent)
    rank = F.min(F.when(F.col("kept"), F.col("row"))).alias("_first")
    worded = written(found.filter("n_shingles > 0"), "groups")
    first = written(worded.groupBy("component_id").agg(rank), "first-rows")
    go = worded.join(first, worded["component_id"].eqNullSafe(first["component_id"])).filter(
        "row != _first").groupBy("doc_id", "tag").agg(F.count("*").alias("_gone"))
    go = written(go, "duplicates")
    stays = written(
        worded.join(first, F.col("row") == F.col("_first"), "left_semi").select("doc_id", "tag"),
        "kept")
    mine = free_name(docs, "_llm_tag")
    own = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    gone = go.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_gone_tag"))
    match = (own[mine] == gone["_gone_tag"]) & own["doc_id"].eqNullSafe(gone["_id"])
    kept = matched(own, gone, match, "left_anti").drop(mine)
    # A kept row that has equal rows went with them above; one of these comes back.
    twice = stays.join(go, ["tag"], "left_semi").select("tag")
    if twice.isEmpty():
        return kept
    again = matched(own, twice, own[mine] == twice["tag"], "left_semi")
    return kept.unionByName(again.dropDuplicates(["doc_id", mine]).drop(mine))
