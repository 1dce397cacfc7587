"""How far the sources of a language are from one another, term by term, in exact integers.

A pipeline of Arrow kernels inside ``mapInArrow`` lower-cases A-Z, splits texts at what is no term,
encodes terms as a dictionary and counts by hash: partial counts of (language, source, term), of
occurrences and of documents. Spark adds them up. The terms that enough documents of the language
have are kept and dealt by hash into shards; a shard is a column block (sources by terms) that
gives its part of every divergence between two sources, and Spark adds the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, matched, written

#: What stands between terms once A-Z are lower-cased.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
#: Partial counts that a task holds before it passes them on, and rows of a shard, about.
HELD_ROWS = 400_000
SHARD_ROWS = 200_000
#: Numbers in a block of sources by terms.
BLOCK_CELLS = 1 << 21
#: Bytes of text that one pass of the kernels splits.
TEXT_BYTES = 1 << 26
KEYS = ["lang", "source", "term"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of one batch."""
    group = pa.Table.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
    pieces = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BETWEEN)
    row, term = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.not_equal(term, "")
    coded = pc.dictionary_encode(term.filter(real))
    pairs = pa.Table.from_arrays([row.filter(real), coded.indices], ["row", "term"])
    pairs = pairs.group_by(["row", "term"]).aggregate([([], "count_all")])
    group = group.take(pairs["row"])
    each = pa.Table.from_arrays(
        [group["lang"], group["source"], pairs["term"], pairs["count_all"]], [*KEYS, "n"])
    each = each.group_by(KEYS).aggregate([("n", "sum"), ("n", "count")])
    return pa.Table.from_arrays(
        [each["lang"], each["source"], coded.dictionary.take(each["term"].combine_chunks()),
         each["n_sum"], each["n_count"]], [*KEYS, "n", "docs"])


def _added(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return both.rename_columns([*KEYS, "n", "docs"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``TEXT_BYTES`` of text each, one row at least."""
    size = pc.cumulative_sum(pc.binary_length(batch["text"]).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + TEXT_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def count_terms(portions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task; it holds ``HELD_ROWS`` of them, about, and passes on the rest."""
    held, rows = [], 0
    for batch in portions:
        for part in _slices(batch):
            held.append(_counted(part))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_added(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if rows:
        yield from _added(held).to_batches(max_chunksize=50_000)


def _spread(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``; p and q are at most ``UNIT + 1``, so 64 bits hold the square."""
    apart = own - other
    return apart * apart // other


def block_sums(p: np.ndarray, present: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Sums over the block's terms of the spread between every two sources.

    ``p`` is sources x terms, ``absent`` what a source has for a term that it lacks. Only terms
    that one of two sources has differ from the constant of two sources that lack it, so the work
    follows the counts above zero and not all sources times all sources times all terms.
    """
    both_lack = _spread(absent[:, None], absent[None, :])
    total = both_lack * p.shape[1]
    for k in range(len(p)):
        at = np.flatnonzero(present[k])
        if not len(at):
            continue
        total[k] += (_spread(p[k, at], p[:, at]) - both_lack[k][:, None]).sum(1)
        lack = ~present[:, at]
        rest = _spread(absent[:, None], p[k, at][None, :]) - both_lack[:, k][:, None]
        total[:, k] += (rest * lack).sum(1)
    return total


def shard_sums(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """``lang, source, other, part``: one shard's part of the divergences of a language."""
    names = groups["source"].to_pylist()
    absent = groups["absent"].to_numpy()
    total = np.zeros((len(names), len(names)), np.int64)
    if terms.num_rows:
        line = pc.index_in(terms["source"], pa.array(names)).to_numpy()
        coded = terms["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        column, p = coded.indices.to_numpy(), terms["p"].to_numpy()
        order = np.argsort(column, kind="stable")
        line, column, p = line[order], column[order], p[order]
        width = max(1, BLOCK_CELLS // len(names))
        for first in range(0, int(column[-1]) + 1, width):
            last = min(first + width, int(column[-1]) + 1)
            own = slice(*np.searchsorted(column, [first, last]))
            block = np.repeat(absent[:, None], last - first, axis=1)
            present = np.zeros(block.shape, bool)
            block[line[own], column[own] - first] = p[own]
            present[line[own], column[own] - first] = True
            total += block_sums(block, present, absent)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    source = pa.array(names, pa.string())
    return pa.Table.from_arrays(
        [pa.array([key[0].as_py()] * len(a), pa.string()), source.take(pa.array(a)),
         source.take(pa.array(b)), pa.array(total[a, b])], ["lang", "source", "other", "part"])


def _p(count: str, total: str, kept: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + kept))`` in decimals; null without kept terms."""
    return F.expr(
        f"CASE WHEN {kept} > 0 THEN 1L + (CAST({UNIT} AS DECIMAL(10,0)) * "
        f"(CAST({count} AS DECIMAL(19,0)) + 1)) DIV (CAST({total} AS DECIMAL(19,0)) + {kept}) END")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences between sources, and telling terms.

    Every row of ``docs`` counts as a document, repeated ones too; null text, lang and source are
    empty. Part ``pair`` has a row for every other source of the language, also where no term is
    kept (value 0). Part ``term`` has the ``top`` terms that a source uses more than its language.
    Ties in value go by the bytes of the item. Other columns play no part. No rows, no result.
    """
    spark = docs.sparkSession
    batches(spark)
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sources = named.select("lang", "source").distinct()
    partial = named.mapInArrow(
        count_terms, "lang string, source string, term string, n long, docs long")
    counts = written(
        partial.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    in_lang = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    in_lang = written(in_lang.drop("docs"), "kept-terms")
    langs = in_lang.groupBy("lang").agg(
        F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    kept = written(matched(counts.drop("docs"), in_lang, ["lang", "term"]), "kept-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = matched(matched(sources, totals, ["lang", "source"], "left"), langs, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("total", zero).alias("total"),
        F.coalesce("kept", zero).alias("kept"), "lang_total")
    groups = written(groups.withColumn("absent", _p("0", "total", "kept")), "source-totals")
    placed = written(matched(kept, groups, ["lang", "source"]).select(
        *KEYS, _p("n", "total", "kept").alias("p"), _p("lang_n", "lang_total", "kept").alias("q"),
    ), "term-shares")

    shards = max(1, -(-placed.count() // SHARD_ROWS))
    dealt = placed.select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"),
        "source", "term", "p")
    # A language's sources meet each of its shards; shards hold disjoint terms.
    every = groups.filter("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "source", "absent")
    parts = dealt.groupBy("lang", "shard").cogroup(every.groupBy("lang", "shard")).applyInArrow(
        shard_sums, "lang string, source string, other string, part long")
    other = sources.select("lang", F.col("source").alias("other"))
    pairs = matched(sources, other, "lang").filter("source <> other")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("part").alias("value"))
    pairs = matched(pairs, sums, ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
        F.coalesce("value", zero).alias("value"))
    terms = placed.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr("((p - q) * (p - q)) DIV q").alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        rows.withColumn("rank", F.row_number().over(best)) for rows in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
