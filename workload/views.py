"""Inputs derived from the driver's tables, as DataFrames and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import configure, spread_small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def _cells(key, name, amount, segment, country):
    """The register's cells as expressions of an integer key and a few columns."""
    code = ["USD", " eur", "GBP", "XYZ", None, "Dollar"]
    currency = F.lit(None).cast("string")
    for i, value in enumerate(code):
        if value is not None:
            currency = F.when(key % 6 == i, value).otherwise(currency)
    odd_amount = F.concat(F.lit("$1,"), (100 + key % 900).cast("string"), F.lit(".50"))
    return {
        "name": F.when(key % 23 != 0, name),
        "value": F.when(key % 9 == 1, odd_amount).when(key % 9 != 0, amount.cast("string")),
        "currency": currency,
        "country": F.when(key % 8 == 0, " ").otherwise(country),
        "type": F.when(key % 10 == 0, "").otherwise(segment),
        "lat": F.when(key % 13 == 0, "n/a").otherwise((key * 37 % 200 - 100).cast("string")),
        "lng": (key * 53 % 400 - 200).cast("string"),
    }


def _as_rows(df: DataFrame, key, cells) -> DataFrame:
    return df.select(
        F.concat(F.lit("doc-"), (key % 5).cast("string")).alias("document_id"),
        F.lit("").alias("sheet_name"),
        (key + 2).alias("row_index"),
        F.create_map(*[x for name, c in cells.items() for x in (F.lit(name), c)]).alias("raw"),
    )


def register_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows: one asset per customer, spread over five documents."""
    c, n = spread_small(table(spark, folder, "customer")), table(spark, folder, "nation")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    key = F.col("c_custkey")
    cells = _cells(key, F.col("c_name"), F.col("c_acctbal"), F.col("c_mktsegment"), F.col("n_name"))
    return _as_rows(joined, key, cells)


def order_register_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Bench variant: one asset per order."""
    o, c = spread_small(table(spark, folder, "orders")), table(spark, folder, "customer")
    n = table(spark, folder, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    key = F.col("o_orderkey")
    cells = _cells(
        key, F.col("c_name"), F.col("o_totalprice"), F.col("o_orderpriority"), F.col("n_name")
    )
    return _as_rows(joined, key, cells)


REGISTER_SQL = """
SELECT concat('doc-', CAST(c.c_custkey % 5 AS STRING)) AS document_id,
       c.c_custkey + 2 AS row_index,
       CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE c.c_name END AS name,
       CASE WHEN c.c_custkey % 9 = 0 THEN NULL
            WHEN c.c_custkey % 9 = 1 THEN concat('$1,', CAST(100 + c.c_custkey % 900 AS STRING), '.50')
            ELSE CAST(c.c_acctbal AS STRING) END AS value,
       CASE c.c_custkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN ' eur' WHEN 2 THEN 'GBP'
            WHEN 3 THEN 'XYZ' WHEN 4 THEN NULL ELSE 'Dollar' END AS currency,
       CASE WHEN c.c_custkey % 8 = 0 THEN ' ' ELSE n.n_name END AS country,
       CASE WHEN c.c_custkey % 10 = 0 THEN '' ELSE c.c_mktsegment END AS type,
       CASE WHEN c.c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c.c_custkey * 37 % 200 - 100 AS STRING) END AS lat,
       CAST(c.c_custkey * 53 % 400 - 200 AS STRING) AS lng
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# The register with parsed numbers, trimmed text and a checked currency code.
# Currency codes, written out so that the SQL doesn't share the code's list.
SHORT_CODES = (
    "'USD', 'EUR', 'GBP', 'JPY', 'AUD', 'CAD', 'CHF', 'CNY', 'INR', 'BRL', "
    "'MXN', 'SGD', 'HKD', 'KRW'"
)
CODES = (
    "'USD','EUR','GBP','JPY','AUD','CAD','CHF','CNY','INR','BRL','MXN','SGD','HKD','KRW','SEK',"
    "'NOK','DKK','NZD','ZAR','RUB','IDR','MYR','PHP','THB','VND','AED','SAR','ILS','TRY'"
)
NUMBER_RE = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def number_sql(expression: str) -> str:
    return f"try_cast(nullif(regexp_extract({expression}, '{NUMBER_RE}', 1), '') AS DOUBLE)"


CLEAN_SQL = f"""
SELECT document_id, row_index, trim(name) AS name, {number_sql("translate(value, ',$', '')")} AS value,
       trim(currency) AS currency,
       CASE WHEN upper(trim(currency)) IN ({CODES}) THEN upper(trim(currency)) END AS code,
       trim(country) AS country, CASE WHEN type <> '' THEN trim(type) END AS type,
       {number_sql('lat')} AS lat, {number_sql('lng')} AS lng
FROM ({REGISTER_SQL}) r
"""

ROUTED_SQL = f"""
SELECT *, code IS NULL OR country IS NULL OR country = '' OR type IS NULL OR type = ''
          OR coalesce(abs(lat) > 90, FALSE) OR coalesce(abs(lng) > 180, FALSE) AS ambiguous,
       (CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END
        + CASE WHEN currency <> '' THEN 1 ELSE 0 END + CASE WHEN country <> '' THEN 1 ELSE 0 END)
          >= 4 AS matched,
       coalesce(currency <> '', FALSE) AND coalesce(type <> '', FALSE) AS complete
FROM ({CLEAN_SQL}) c
"""

# Cells of a sheet: title row, header row, data on every other row, a closing note.
SHEET_SQL = """
SELECT 's' AS sheet_name, CAST(0 AS BIGINT) AS row_num, 0 AS col_num, 'Supplier register' AS str_value, CAST(NULL AS DOUBLE) AS num_value
UNION ALL SELECT 's', CAST(2 AS BIGINT), 0, 'Supplier Name', CAST(NULL AS DOUBLE)
UNION ALL SELECT 's', CAST(2 AS BIGINT), 1, 'Balance ($)', CAST(NULL AS DOUBLE)
UNION ALL SELECT 's', CAST(2 AS BIGINT), 2, 'Nation', CAST(NULL AS DOUBLE)
UNION ALL SELECT 's', s_suppkey * 2 + 3, 0, s_name, CAST(NULL AS DOUBLE) FROM supplier
UNION ALL SELECT 's', s_suppkey * 2 + 3, 1, CAST(NULL AS STRING), s_acctbal FROM supplier
UNION ALL SELECT 's', s_suppkey * 2 + 3, 2, CAST(NULL AS STRING), CAST(s_nationkey AS DOUBLE) FROM supplier
UNION ALL SELECT 's', max(s_suppkey) * 2 + 9, 0, 'Balances are stated in local units of account', CAST(NULL AS DOUBLE) FROM supplier
"""

# Positioned text items: one page per order.
ITEMS_SQL = """
SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS item,
       CAST(l_partkey * 17 % 600 AS DOUBLE) AS x,
       CAST(l_linenumber * 7 + l_suppkey % 5 AS DOUBLE) AS y,
       CAST(l_quantity AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height,
       CAST(8 + l_partkey % 10 AS DOUBLE) AS font_size, l_returnflag AS text
FROM lineitem
"""

DOCS_SQL = """
SELECT c_custkey AS document_id,
       concat(c_name, CASE c_custkey % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls'
                      WHEN 3 THEN '.pdf' WHEN 4 THEN '.txt' ELSE '.CSV' END) AS original_file_name,
       CAST(c_nationkey AS BIGINT) AS session_id, c_custkey * 30000 AS file_size
FROM customer
"""
JOBS_SQL = """
SELECT o_orderkey AS job_id, o_custkey AS document_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'running' ELSE 'queued' END AS status,
       o_orderdate AS created_at
FROM orders
"""
SESSIONS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS session_id, n_name AS name FROM nation"
JOB_EVENTS_SQL = """
SELECT user_id AS job_id, ts, event_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
            ELSE 'running' END AS state
FROM events
"""


def from_sql(spark: SparkSession, folder: str, text: str, *names: str) -> DataFrame:
    """Run one of the view texts over the driver's tables."""
    frames = {name: table(spark, folder, name) for name in names}
    for name in names:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **frames)


def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = from_sql(spark, folder, SHEET_SQL, "supplier")
    return cells.withColumn("document_id", F.lit("book"))


def text_items(spark: SparkSession, folder: str) -> DataFrame:
    items = from_sql(spark, folder, ITEMS_SQL, "lineitem")
    document = F.concat(F.lit("scan-"), (F.col("page") % 7).cast("string"))
    return items.withColumn("document_id", document)


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, DOCS_SQL, "customer")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, JOBS_SQL, "orders")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, SESSIONS_SQL, "nation")


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, JOB_EVENTS_SQL, "events")
