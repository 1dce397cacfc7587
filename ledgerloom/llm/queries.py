"""Queries of this subpackage over the driver's tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    codes, decontamination, divergence, exactdup, language, neardup, neighbours, packing, private,
    sharding, substrings, toxicity, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op2_private")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return private.private_report(table(spark, folder, "documents"), private.key_of(spark))


@query(
    "op3_decontamination",
    r"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
      FROM documents
    ),
    item AS (
      SELECT item_id, ws, least(10, len(ws)) AS k FROM (
        SELECT item_id, list_filter(regexp_split_to_array(translate(text,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
        FROM benchmark) WHERE len(ws) > 0
    ),
    win AS (
      SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM item)
    ),
    seen AS (
      SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
            FROM w CROSS JOIN (SELECT DISTINCT k FROM win))
    ),
    hit AS (SELECT doc_id, item_id, k, i FROM seen JOIN win USING (k, g)),
    word AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
    ),
    met AS (
      SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
    )
    SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(word.n, 0) AS n_hit,
      coalesce(met.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
      coalesce(word.n, 0) > 0 AS contaminated
    FROM w LEFT JOIN word USING (doc_id) LEFT JOIN met USING (doc_id)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_hits(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("spans")


@query(
    "op4_substrings",
    r"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
      FROM documents
    ),
    word AS (
      SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0
    ),
    win AS (
      SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM word WHERE i + 49 <= n
    ),
    first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
    hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE doc_id > m),
    marked AS (
      SELECT word.doc_id, word.i, ws[word.i] AS x,
        max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY word.i
                         ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM word LEFT JOIN hit USING (doc_id, i)
    ),
    kept AS (
      SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r,
        coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS t
      FROM marked GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed,
      sha256(coalesce(t, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("repeats")


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


@query("op6_language")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    held_out = F.coalesce(held_out, F.lit(False))
    model = language.train(docs.filter(~held_out))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op7_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_urls")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rules = {
        "net/": "block", "example.net/en/": "allow", "example.com/de/": "block",
        "org/fr/": "allow",
    }
    return urls.judge_urls(table(spark, folder, "pages"), rules)


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query(
    "op10_minhash",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS ws
      FROM documents
    ),
    s AS (
      SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(ws[i:i + 4], ' ') END AS x
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i
            FROM w WHERE len(ws) > 0)
    ),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c
      FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
    ),
    link AS (
      SELECT p, q FROM pairs JOIN size u ON u.doc_id = p JOIN size v ON v.doc_id = q
      WHERE 100 * c >= 85 * (u.n + v.n - c)
    ),
    edge AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
    reach AS (
      SELECT doc_id, doc_id AS r FROM size
      UNION SELECT edge.q, reach.r FROM reach JOIN edge ON edge.p = reach.doc_id
      WHERE reach.r < edge.q
    )
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
      coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
    FROM documents d LEFT JOIN size USING (doc_id)
    LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(
    "op11_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
      FROM documents
    ),
    w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
    kept AS (
      SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
    ),
    per_lang AS (SELECT lang, sum(n)::HUGEINT AS n_all, count(*) AS v FROM kept GROUP BY lang),
    here AS (
      SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term)
      GROUP BY lang, source, term
    ),
    per_source AS (
      SELECT lang, source, sum(n)::HUGEINT AS n_all FROM here GROUP BY lang, source
    ),
    groups AS (SELECT DISTINCT lang, source FROM d),
    q AS (
      SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (n_all + v) AS q
      FROM kept JOIN per_lang USING (lang)
    ),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(here.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(here.n, 0) + 1)) // (coalesce(s.n_all, 0) + v) AS p
      FROM groups g JOIN kept k USING (lang) JOIN per_lang USING (lang)
      LEFT JOIN here ON here.lang = g.lang AND here.source = g.source AND here.term = k.term
      LEFT JOIN per_source s ON s.lang = g.lang AND s.source = g.source
    ),
    summed AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source
    ),
    rows_of AS (
      SELECT g.lang, g.source, 'pair' AS part, o.source AS item,
        coalesce(summed.value, 0)::BIGINT AS value
      FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
      LEFT JOIN summed
        ON summed.lang = g.lang AND summed.source = g.source AND summed.item = o.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    ),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows_of
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query(
    "op12_exact",
    r"""
    WITH t AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x
      FROM documents
    )
    SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id,
      count(*) OVER (PARTITION BY x) AS group_size,
      doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
    FROM t
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = exactdup.deduplicate(spark, f"{folder}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _code_rounds(rounds: int) -> str:
    """SQL of each round: every part goes to its nearest entry, entries become floored means."""
    out = []
    for k in range(rounds):
        out.append(f"""
    near{k} AS (
      SELECT r, part.p, arg_min(e, struct_pack(far := list_sum(list_transform(range(1, len(x) + 1),
        lambda i: (x[i] - y[i]) * (x[i] - y[i]))), e := e)) AS e
      FROM part JOIN book{k} ON part.p = book{k}.p GROUP BY r, part.p
    ),
    total{k} AS (
      SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
      FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i
            FROM near{k} JOIN part USING (r, p)) GROUP BY p, e, i
    ),
    mean{k} AS (
      SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS y FROM total{k} GROUP BY p, e
    ),
    book{k + 1} AS (
      SELECT p, e, coalesce(mean{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN mean{k} USING (p, e)
    ),""")
    return "".join(out)


@query(
    "op13_codes",
    r"""
    WITH good AS (
      SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    part AS (
      SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x
      FROM (SELECT r, v, unnest(range(0, 16)) AS p FROM good)
    ),
    book0 AS (SELECT p, r - 1 AS e, x AS y FROM part WHERE r <= 64),"""
    + _code_rounds(2)
    + r"""
    far AS (
      SELECT r, part.p, e, list_sum(list_transform(range(1, len(x) + 1),
        lambda i: (x[i] - y[i]) * (x[i] - y[i])))::HUGEINT AS far
      FROM part JOIN book2 ON part.p = book2.p
    ),
    best AS (
      SELECT r, p, min(far) AS far, arg_min(e, struct_pack(far := far, e := e)) AS e
      FROM far GROUP BY r, p
    ),
    coded AS (
      SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code,
        sum(far)::BIGINT AS error FROM best GROUP BY r
    ),
    print AS (
      SELECT sha256(string_agg(y[i]::VARCHAR, ',' ORDER BY p, e, i)) AS h
      FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS i FROM book2)
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      h AS codebooks_sha256
    FROM good JOIN coded USING (r) CROSS JOIN print
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings")).drop("label")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
