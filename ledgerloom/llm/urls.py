"""URL verdicts: rules by host suffix and path, gradient-boosted trees for what no rule decides.

The trees see lexical features only (length, depth, digit ratio, entropy, parameters, statistics
of the host's suffixes). They learn from labelled URLs; in the query those that a rule decides.
Suffix statistics are counts of labels, so for the rows that the trees learn from they come from
the other folds: no row's own label, nor that of an equal URL, is in its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_texts, written

#: Labelled rows the trees are fitted on, at most about so many.
TRAIN_ROWS = 20_000
SUFFIX_BUCKETS = 4096
PRIOR_ROWS = 20
FOLDS = 5
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "entropy",
    "parameters", "suffix_1", "suffix_2",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``host``, ``path`` and ``rule``, the longest rule that fits or null.

    A rule such as ``example.net/en/`` fits its host and every subdomain where the path starts
    with the rule's path. The rules are few and fixed, so they are one expression.
    """
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, path = text.partition("/")
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        rule = F.when(fits & F.startswith(F.col("path"), F.lit(slash + path)), text).otherwise(rule)
    return rows.withColumn("rule", rule)


def _entropy(text: bytes) -> float:
    n = np.bincount(np.frombuffer(text, np.uint8))
    p = n[n > 0] / max(len(text), 1)
    return float(-(p * np.log2(p)).sum())


def lexical(rows: DataFrame) -> DataFrame:
    """The lexical features of ``url, host, path`` beside the columns of ``rows``.

    Only the entropy of a URL's bytes needs Python; lengths count bytes.
    """
    batches(rows.sparkSession)
    url = F.coalesce("url", F.lit(""))

    def size(text: Column) -> Column:
        return F.octet_length(text).cast("double")

    def without(text: Column, what: str) -> Column:
        return size(text) - size(F.translate(text, what, ""))

    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    measured = rows.withColumns({
        "url_length": size(url), "host_length": size(F.col("host")), "path_length": size(F.col("path")),
        "depth": without(F.col("path"), "/"), "labels": without(F.col("host"), ".") + 1,
        "digits": without(url, "0123456789") / F.greatest(size(url), F.lit(1.0)),
        "parameters": F.size(F.filter(F.split(query, "[&;]", -1), lambda x: x != "")).cast("double"),
    })

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            entropy = pa.array([_entropy(u or b"") for u in byte_texts(batch["url"])], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, entropy], names=[*batch.schema.names, "entropy"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields)
    return measured.mapInArrow(add, f"{schema}, entropy double")


def _bucket(labels: int) -> Column:
    suffix = F.substring_index("host", ".", -labels)
    return F.pmod(F.xxhash64(suffix, F.lit(labels)), F.lit(SUFFIX_BUCKETS)).cast("int")


def _fold() -> Column:
    """Equal URLs share a fold."""
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Trees and suffix statistics learned from ``host, path, url`` and a 0/1 ``label`` (1: block)."""

    def __init__(self, labelled: DataFrame, seed: int = 11):
        counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(
            F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        self.rate = counts.get(1, 0) / total if total else 0.0
        self.trees = None
        if len(counts) < 2:
            return
        # At most SUFFIX_BUCKETS * FOLDS rows for either length of suffix, whatever the number of hosts.
        self.counts = [
            {(r["bucket"], r["fold"]): (r["n"], r["blocked"]) for r in labelled.groupBy(
                _bucket(k).alias("bucket"), _fold().alias("fold")).agg(
                F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()}
            for k in (1, 2)
        ]
        drawn = labelled.select("url", "host", "path", "label").sample(
            False, min(1.0, TRAIN_ROWS / total), seed)
        ready = written(self._features(drawn, learning=True), "labelled-urls")
        boosting = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=15, maxDepth=4, stepSize=0.3,
            minInstancesPerNode=5, seed=seed,
        )
        parts = max(1, min(8, ready.count() // 2000))
        self.trees = boosting.fit(self._assembled(ready.coalesce(parts)))

    def suffix_rates(self, k: int) -> list[tuple[int, int, float]]:
        """``bucket, fold, rate``: the rate of blocked URLs outside the fold; fold -1 is all of them."""
        known = self.counts[k - 1]
        whole: dict[int, list[int]] = {}
        for (bucket, _), (n, blocked) in known.items():
            sums = whole.setdefault(bucket, [0, 0])
            sums[0] += n
            sums[1] += blocked

        def rate(n: int, blocked: int) -> float:
            return float((blocked + PRIOR_ROWS * self.rate) / (n + PRIOR_ROWS))

        out = [(bucket, -1, rate(*sums)) for bucket, sums in whole.items()]
        for (bucket, fold), (n, blocked) in known.items():
            sums = whole[bucket]
            out.append((bucket, fold, rate(sums[0] - n, sums[1] - blocked)))
        return out

    def _features(self, rows: DataFrame, learning: bool = False) -> DataFrame:
        fold = _fold() if learning else F.lit(-1)
        measured = lexical(rows.withColumns({"_bucket_1": _bucket(1), "_bucket_2": _bucket(2), "_fold": fold}))
        for k in (1, 2):
            table = rows.sparkSession.createDataFrame(
                self.suffix_rates(k), f"_bucket_{k} int, _fold int, suffix_{k} double")
            measured = measured.join(F.broadcast(table), [f"_bucket_{k}", "_fold"], "left")
        known = {f"suffix_{k}": F.coalesce(f"suffix_{k}", F.lit(self.rate)) for k in (1, 2)}
        return measured.withColumns(known).drop("_bucket_1", "_bucket_2", "_fold")

    @staticmethod
    def _assembled(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``block_score``, the probability of ``block``; the labels' rate if it is one-sided."""
        if self.trees is None:
            return rows.withColumn("block_score", F.lit(self.rate))
        scored = self.trees.transform(self._assembled(self._features(rows)))
        score = vector_to_array("probability")[1]
        return scored.select(*rows.columns, score.alias("block_score"))


def judge_urls(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row of ``pages``.

    A null url or one without ``://`` has an empty host and path and fits no rule; its verdict
    comes from the trees as any other. Without labelled rows every verdict is ``allow``.
    """
    ruled = with_rules(pages.select("page_id", "url"), rules)
    verdict = F.lit(None).cast("string")
    for text, said in rules.items():
        verdict = F.when(F.col("rule") == text, said).otherwise(verdict)
    ruled = ruled.withColumn("_said", verdict)
    labelled = ruled.filter("rule is not null").select(
        "url", "host", "path", (F.col("_said") == "block").cast("int").alias("label"))
    scored = UrlModel(labelled).score(ruled)
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("_said", learned).alias("verdict"),
        "block_score",
    )
