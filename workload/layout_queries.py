"""Page layout on positioned items, and text rules on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import layout

from .registry import query
from .views import ITEMS_SQL, table, text_items

# Bands by walking down the distinct y values of a page, each band anchored at its first y.
BANDS_SQL = f"""
WITH RECURSIVE items AS ({ITEMS_SQL}),
starts(page, y) AS (
  SELECT page, min(y) FROM items GROUP BY page
  UNION ALL
  SELECT page, y FROM (
    SELECT s.page, (SELECT min(i.y) FROM items i WHERE i.page = s.page AND i.y > s.y + 12) AS y FROM starts s) n
  WHERE y IS NOT NULL)
SELECT i.*, (SELECT count(*) FROM starts s WHERE s.page = i.page AND s.y <= i.y) - 1 AS band FROM items i
"""
CLUSTERS_SQL = """
SELECT *, sum(CASE WHEN x - before > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY page, band ORDER BY x, item ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster
FROM (SELECT *, lag(x) OVER (PARTITION BY page, band ORDER BY x, item) AS before FROM ({banded}) b) l
"""
BLOCKS_SQL = """
SELECT page, band, cluster, count(*) AS items, string_agg(text, ' ' ORDER BY x, y, item, text) AS text,
  CASE WHEN count(*) >= 3 AND var_pop(x) > 5000 AND var_pop(y) < 100 THEN 'table' ELSE 'paragraph' END AS block_type,
  min(x) AS x_min, max(x + width) AS x_max, min(y) AS y_min, max(y + height) AS y_max
FROM ({clusters}) c GROUP BY page, band, cluster
"""
STEP_CLUSTERS = CLUSTERS_SQL.format(banded=BANDS_SQL)
STEP_BLOCKS = BLOCKS_SQL.format(clusters=STEP_CLUSTERS)


@query("y_bands", f"SELECT page, item, band FROM ({BANDS_SQL}) b")
def y_bands(spark, folder):
    return layout.with_bands(text_items(spark, folder)).select("page", "item", "band")


@query("x_clusters", f"SELECT page, item, band, cluster FROM ({STEP_CLUSTERS}) c")
def x_clusters(spark, folder):
    clustered = layout.with_clusters(layout.with_bands(text_items(spark, folder)))
    return clustered.select("page", "item", "band", "cluster")


@query("text_blocks", STEP_BLOCKS)
def text_blocks(spark, folder):
    blocks = layout.page_blocks(text_items(spark, folder))
    return blocks.drop("document_id", "blocks_before", "x_variance", "y_variance")


ONE_PAGE_SQL = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS item, l_extendedprice + l_linenumber AS y,
  (l_partkey * 7 + l_suppkey * 3)::DOUBLE AS x FROM lineitem
"""


@query(
    "hot_page_bands",
    f"""WITH RECURSIVE items AS MATERIALIZED (SELECT DISTINCT y FROM ({ONE_PAGE_SQL}) i),
        starts(y) AS (SELECT min(y) FROM items UNION ALL
          SELECT n.y FROM (SELECT (SELECT min(i.y) FROM items i WHERE i.y > s.y + 12) AS y FROM starts s) n WHERE n.y IS NOT NULL),
        banded AS (SELECT i.x, i.y, s.band FROM ({ONE_PAGE_SQL}) i
          ASOF JOIN (SELECT y AS y0, row_number() OVER (ORDER BY y) - 1 AS band FROM starts) s ON i.y >= s.y0),
        placed AS (SELECT DISTINCT band, x FROM banded),
        opened AS (SELECT *, x - lag(x) OVER (PARTITION BY band ORDER BY x) > 25 AS opens FROM placed),
        numbered AS (SELECT band, x, count(*) FILTER (opens) OVER (PARTITION BY band ORDER BY x) AS cluster FROM opened)
        SELECT band, cluster, count(*) AS items, min(b.x) AS x_min, max(b.x) AS x_max, min(y) AS y_min, max(y) AS y_max
        FROM banded b JOIN numbered n USING (band, x) GROUP BY band, cluster""",
)
def hot_page_bands(spark, folder):
    """All line items on one page: bands and clusters without a list for the page or a band."""
    line = table(spark, folder, "lineitem")
    items = line.select(
        F.lit("scan").alias("document_id"), F.lit(1).cast("bigint").alias("page"),
        (F.col("l_extendedprice") + F.col("l_linenumber")).alias("y"),
        (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3).cast("double").alias("x"),
    )
    clustered = layout.with_clusters(layout.with_bands(items.filter("y is not null")))
    return clustered.groupBy("band", "cluster").agg(
        F.count("*").alias("items"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query(
    "table_blocks",
    """SELECT 0::BIGINT AS page, c_nationkey::BIGINT AS band, CASE WHEN count(*) >= 3 AND var_pop(c_custkey * 10) > 5000 AND var_pop(c_nationkey) < 100 THEN 'table' ELSE 'paragraph' END AS block_type,
       count(*) AS items, string_agg(c_mktsegment, ' ' ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey""",
)
def table_blocks(spark, folder):
    """Customers set as wide lines, one per nation: line-sized blocks with many items."""
    c = table(spark, folder, "customer")
    placed = c.select(
        F.lit("scan").alias("document_id"), F.lit(0).cast("bigint").alias("page"),
        F.col("c_nationkey").alias("band"), F.lit(0).alias("cluster"),
        F.col("c_custkey").alias("item"), (F.col("c_custkey") * 10.0).alias("x"),
        F.col("c_nationkey").cast("double").alias("y"), F.lit(5.0).alias("width"),
        F.lit(5.0).alias("height"), F.col("c_mktsegment").alias("text"),
    )
    return layout.text_blocks(placed).select("page", "band", "block_type", "items", "text")


@query(
    "block_records",
    f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY band, cluster) AS block_number, block_type, text,
        x_min, x_max, y_min, y_max FROM ({STEP_BLOCKS}) b""",
)
def block_records(spark, folder):
    return layout.block_records(layout.page_blocks(text_items(spark, folder))).drop("document_id")


@query(
    "item_positions",
    """SELECT l_orderkey AS page, l_linenumber::BIGINT AS item, l_extendedprice AS x, 800 - l_quantity AS y,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL ELSE round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) END AS font_size
       FROM lineitem""",
)
def item_positions(spark, folder):
    glyphs = table(spark, folder, "lineitem").select(
        F.lit("scan").alias("document_id"), F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").alias("item"), F.col("l_discount").alias("a"),
        F.col("l_tax").alias("b"), F.col("l_extendedprice").alias("e"),
        F.col("l_quantity").alias("f"), F.lit(800.0).alias("page_height"),
        F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.col("l_returnflag").alias("text"),
    )
    return layout.text_items(glyphs).select("page", "item", "x", "y", "font_size")


CONTENT_SQL = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7', chr(10), text) WHEN 1 THEN concat('x ocr_text:  ', text)
  WHEN 2 THEN regexp_replace(text, '[ -~]', '', 'g') ELSE text END AS content FROM documents
"""


def contents(spark, folder):
    documents = table(spark, folder, "documents")
    kind, text = F.col("doc_id") % 4, F.col("text")
    content = (
        F.when(kind == 0, F.concat(F.lit("%PDF-1.7\n"), text))
        .when(kind == 1, F.concat(F.lit("x ocr_text:  "), text))
        .when(kind == 2, F.regexp_replace(text, "[ -~]", "")).otherwise(text)
    )
    return documents.select("doc_id", content.alias("content"))


@query(
    "scanned_or_digital",
    f"""SELECT doc_id, CASE WHEN regexp_matches(content, '(?i)SCANNED_PDF|OCR_TEXT:') THEN TRUE
          WHEN regexp_matches(content, '(?i)%PDF') AND regexp_matches(content, '[A-Za-z][A-Za-z][A-Za-z]') THEN FALSE
          ELSE length(trim(regexp_replace(content, '[^ -~]', '', 'g'))) < 25 END AS scanned FROM ({CONTENT_SQL}) c""",
)
def scanned_or_digital(spark, folder):
    return contents(spark, folder).select(
        "doc_id", layout.is_scanned(F.col("content")).alias("scanned")
    )


@query(
    "cleaned_texts",
    f"""SELECT doc_id, sha256(clean) AS clean_hash, length(clean)::BIGINT AS length, CASE WHEN clean <> '' THEN 0.9 ELSE 0 END::DOUBLE AS confidence
        FROM (SELECT doc_id, coalesce(nullif(trim(regexp_extract(content, '(?is)OCR_TEXT:\\s*(.*)', 1), ' ' || chr(10) || chr(9) || chr(13)), ''),
          trim(regexp_replace(regexp_replace(content, '[^ -~' || chr(10) || chr(13) || chr(9) || ']', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean FROM ({CONTENT_SQL}) c) t""",
)
def cleaned_texts(spark, folder):
    cleaned = contents(spark, folder).select(
        "doc_id", layout.clean_text(F.col("content")).alias("clean")
    )
    return cleaned.select(
        "doc_id", F.sha2("clean", 256).alias("clean_hash"), F.length("clean").alias("length"),
        layout.text_confidence(F.col("clean")).alias("confidence"),
    )


@query(
    "line_records",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_number, line FROM (
         SELECT doc_id, unnest(generate_series(1, len(parts))) AS n, trim(unnest(parts)) AS line FROM (
           SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents) s) l WHERE line <> ''""",
)
def line_records(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return layout.line_records(documents).select("doc_id", "line_number", "line")
