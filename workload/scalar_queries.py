"""Scalar functions over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import fields, text, vocab
from ledgerloom.plans.extraction import normalize_rows

from .registry import query
from .views import CLEAN_SQL, CODES, JOBS_SQL, REGISTER_SQL, jobs, number_sql, register_rows, table

KEY = ["document_id", "row_index"]
PLAIN = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"


def raw(name):
    return F.try_element_at(F.col("raw"), F.lit(name))


@query(
    "column_aliases",
    f"""SELECT document_id, row_index, name AS asset_name, value AS asset_value, currency,
        country AS jurisdiction, type AS asset_type, lat AS latitude, lng AS longitude,
        'asset_name,asset_value,currency,jurisdiction,asset_type,latitude,longitude' AS keys
        FROM ({REGISTER_SQL}) r""",
)
def column_aliases(spark, folder):
    rows = register_rows(spark, folder).withColumn("m", fields.canonical_keys(F.col("raw")))
    names = [
        "asset_name", "asset_value", "currency", "jurisdiction", "asset_type", "latitude",
        "longitude",
    ]
    cells = [F.try_element_at(F.col("m"), F.lit(n)).alias(n) for n in names]
    return rows.select(*KEY, *cells, F.array_join(F.map_keys("m"), ",").alias("keys"))


@query(
    "normalized_values",
    f"""SELECT document_id, row_index, trim(name) AS asset_name, {PLAIN.format('value')} AS asset_value,
        trim(currency) AS currency, trim(country) AS jurisdiction, type AS asset_type,
        {PLAIN.format('lat')} AS latitude, {PLAIN.format('lng')} AS longitude
        FROM ({CLEAN_SQL}) c""",
)
def normalized_values(spark, folder):
    rows = normalize_rows(register_rows(spark, folder))
    names = [
        "asset_name", "asset_value", "currency", "jurisdiction", "asset_type", "latitude",
        "longitude",
    ]
    return rows.select(*KEY, *[F.try_element_at(F.col("data"), F.lit(n)).alias(n) for n in names])


@query(
    "leading_numbers",
    f"""SELECT o_orderkey, {number_sql('o_orderpriority')} AS priority,
        {number_sql("CAST(o_orderdate AS VARCHAR)")} AS year,
        {number_sql("concat('  -', CAST(o_custkey + 1 AS VARCHAR), 'e2kg')")} AS scaled
        FROM orders""",
)
def leading_numbers(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        text.prefix_float(F.col("o_orderpriority")).alias("priority"),
        text.prefix_float(F.col("o_orderdate").cast("string")).alias("year"),
        text.prefix_float(
            F.concat(F.lit("  -"), (F.col("o_custkey") + 1).cast("string"), F.lit("e2kg"))
        ).alias("scaled"),
    )


@query(
    "coordinates",
    f"""SELECT document_id, row_index, lat AS lat_value, lat IS NOT NULL AS lat_parsed,
        coalesce(abs(lat) <= 90, FALSE) AS lat_valid, lng AS lng_value,
        lng IS NOT NULL AS lng_parsed, coalesce(abs(lng) <= 180, FALSE) AS lng_valid
        FROM ({CLEAN_SQL}) c""",
)
def coordinates(spark, folder):
    rows = register_rows(spark, folder)
    lat, lng = fields.parse_latitude(raw("lat")), fields.parse_longitude(raw("lng"))
    rows = rows.select(*KEY, lat.alias("lat"), lng.alias("lng"))
    parts = [
        F.col(f"{axis}.{part}").alias(f"{axis}_{part}")
        for axis in ("lat", "lng") for part in ("value", "parsed", "valid")
    ]
    return rows.select(*KEY, *parts)


@query(
    "currency_codes",
    f"SELECT document_id, row_index, code, code IS NOT NULL AS valid FROM ({CLEAN_SQL}) c",
)
def currency_codes(spark, folder):
    code = fields.parse_currency(raw("currency"))
    rows = register_rows(spark, folder).select(*KEY, code.alias("code"))
    return rows.withColumn("valid", F.col("code").isNotNull())


@query("amounts", f"SELECT document_id, row_index, value AS amount FROM ({CLEAN_SQL}) c")
def amounts(spark, folder):
    return register_rows(spark, folder).select(
        *KEY, fields.parse_amount(raw("value")).alias("amount")
    )


@query(
    "values_by_role",
    f"""SELECT r.document_id, r.row_index, r.name, {PLAIN.format('c.value')} AS value,
        c.code AS currency, CASE WHEN abs(c.lat) <= 90 THEN {PLAIN.format('c.lat')} END AS lat,
        CASE WHEN abs(c.lng) <= 180 THEN {PLAIN.format('c.lng')} END AS lng
        FROM ({REGISTER_SQL}) r JOIN ({CLEAN_SQL}) c
          ON r.document_id = c.document_id AND r.row_index = c.row_index""",
)
def values_by_role(spark, folder):
    roles = {"value": "value", "currency": "currency", "lat": "latitude", "lng": "longitude"}
    data = fields.normalized_by_role(F.col("raw"), fields.literal_map(roles))
    rows = register_rows(spark, folder).withColumn("d", data)
    names = ["name", "value", "currency", "lat", "lng"]
    return rows.select(*KEY, *[F.try_element_at(F.col("d"), F.lit(n)).alias(n) for n in names])


@query(
    "decimal_places",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
        len(nullif(regexp_extract(regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', ''), '\\.(\\d+)$', 1), ''))::BIGINT AS found,
        coalesce(len(nullif(regexp_extract(regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', ''), '\\.(\\d+)$', 1), '')), 0) <= 2 AS amount_ok,
        coalesce(len(nullif(regexp_extract(regexp_replace(CAST(l_extendedprice / 7 AS VARCHAR), '\\.0$', ''), '\\.(\\d+)$', 1), '')), 0) <= 6 AS coordinate_ok
        FROM lineitem""",
)
def decimal_places(spark, folder):
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif(text.decimal_places(price), F.lit(0)).alias("found"),
        fields.amount_precision_ok(price).alias("amount_ok"),
        fields.coordinate_precision_ok(price / 7).alias("coordinate_ok"),
    )


@query(
    "field_confidence",
    f"""SELECT document_id, field, count(*) AS n, round(sum(score), 6) AS total FROM (
        SELECT document_id, 'asset_name' AS field, CASE WHEN name <> '' THEN 0.9 ELSE 0 END::DOUBLE AS score FROM ({REGISTER_SQL})
        UNION ALL SELECT document_id, 'currency', CASE WHEN coalesce(currency, '') = '' THEN 0 WHEN regexp_full_match(currency, '[A-Z][A-Z][A-Z]') THEN 0.95 ELSE 0.5 END FROM ({REGISTER_SQL})
        UNION ALL SELECT document_id, 'jurisdiction', CASE WHEN coalesce(country, '') = '' THEN 0 ELSE 0.7 END FROM ({REGISTER_SQL})
        UNION ALL SELECT document_id, 'asset_value', CASE WHEN value IS NULL THEN 0 ELSE 0.7 END FROM ({REGISTER_SQL})
        UNION ALL SELECT document_id, 'asset_type', CASE WHEN coalesce(type, '') = '' THEN 0 ELSE 0.7 END FROM ({REGISTER_SQL})
        UNION ALL SELECT document_id, 'latitude', CASE WHEN abs(lat) <= 90 THEN 0.85 ELSE 0.3 END FROM ({CLEAN_SQL})
        UNION ALL SELECT document_id, 'longitude', CASE WHEN abs(lng) <= 180 THEN 0.85 ELSE 0.3 END FROM ({CLEAN_SQL})
        ) s GROUP BY document_id, field""",
)
def field_confidence(spark, folder):
    cells = register_rows(spark, folder).select("document_id", F.explode("raw"))
    field = fields.canonical_name(F.col("key"))
    scored = cells.select(
        "document_id", field.alias("field"), fields.field_confidence(field, F.col("value")).alias("s")
    )
    return scored.groupBy("document_id", "field").agg(
        F.count("*").alias("n"), F.sum("s").alias("total")
    )


@query(
    "row_confidence",
    f"""SELECT r.document_id, r.row_index, round(
          (CASE WHEN r.name IS NULL THEN 0 WHEN r.name <> '' THEN 0.9 ELSE 0 END
         + CASE WHEN r.value IS NULL THEN 0 ELSE 0.7 END
         + CASE WHEN r.currency IS NULL THEN 0 WHEN regexp_full_match(r.currency, '[A-Z][A-Z][A-Z]') THEN 0.95 ELSE 0.5 END
         + 0.7 + CASE WHEN r.type = '' THEN 0 ELSE 0.7 END
         + CASE WHEN abs(c.lat) <= 90 THEN 0.85 ELSE 0.3 END
         + CASE WHEN abs(c.lng) <= 180 THEN 0.85 ELSE 0.3 END)::DOUBLE
        / (4 + (r.name IS NOT NULL)::INT + (r.value IS NOT NULL)::INT + (r.currency IS NOT NULL)::INT), 6) AS confidence
        FROM ({REGISTER_SQL}) r JOIN ({CLEAN_SQL}) c
          ON r.document_id = c.document_id AND r.row_index = c.row_index""",
)
def row_confidence(spark, folder):
    score = fields.mean_confidence(F.col("raw"))
    return register_rows(spark, folder).select(*KEY, score.alias("confidence"))


@query(
    "fuzzy_role_match",
    "WITH words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents), "
    "bare AS (SELECT word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS b FROM words), "
    # Fixed values: keywords of the fuzzy match.
    "kw(slot, k) AS (VALUES ('asset_name', 'asset'), ('asset_name', 'name'), ('asset_name', 'property'), "
    "('asset_name', 'facility'), ('asset_name', 'building'), ('asset_name', 'assetname'), "
    "('value', 'value'), ('value', 'amount'), ('value', 'price'), ('value', 'valuation'), ('value', 'cost'), "
    "('value', 'total_value'), ('value', 'market_value'), ('currency', 'currency'), ('currency', 'curr'), "
    "('jurisdiction', 'location'), ('jurisdiction', 'country'), ('jurisdiction', 'state'), "
    "('jurisdiction', 'province'), ('jurisdiction', 'region'), ('jurisdiction', 'city'), "
    "('jurisdiction', 'address'), ('latitude', 'lat'), ('latitude', 'latitude'), ('latitude', 'lat_deg'), "
    "('longitude', 'lng'), ('longitude', 'lon'), ('longitude', 'long'), ('longitude', 'longitude'), "
    "('longitude', 'lng_deg'), ('asset_type', 'type'), ('asset_type', 'category'), "
    "('asset_type', 'classification'), ('asset_type', 'property_type'), ('asset_type', 'kind'), "
    "('asset_type', 'subtype')) SELECT slot, count(DISTINCT word) AS words FROM bare JOIN kw "
    "ON contains(b, k) OR contains(k, b) GROUP BY slot",
)
def fuzzy_role_match(spark, folder):
    texts = table(spark, folder, "documents")
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    slots = F.array_compact(
        F.array(*[F.when(fields.matches_role(F.col("word"), s), F.lit(s)) for s in vocab.SLOTS])
    )
    hits = words.select("word", F.explode(slots).alias("slot"))
    return hits.groupBy("slot").agg(F.count("*").alias("words"))


@query(
    "value_kinds",
    f"""WITH cells AS (
          SELECT unnest(['name', 'value', 'currency', 'country', 'type', 'lat', 'lng']) AS kind,
            unnest([name, value, currency, country, type, lat, lng]) AS v FROM ({REGISTER_SQL})
          UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
          UNION ALL SELECT 'us_day', strftime(o_orderdate, '%m/%d/%Y') FROM orders)
        SELECT kind, count(v) AS n, count(*) FILTER ({number_sql('v')} IS NOT NULL) AS numbers,
          count(*) FILTER (regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_full_match(v, '\\d{{2}}/\\d{{2}}/\\d{{4}}')) AS dates,
          count(*) FILTER (upper(v) IN ({','.join(CODES.split(',')[:14])})) AS codes
        FROM cells GROUP BY kind""",
)
def value_kinds(spark, folder):
    rows, orders = register_rows(spark, folder), table(spark, folder, "orders")
    cells = rows.select(F.explode("raw").alias("kind", "v"))
    for kind, layout in (("day", "yyyy-MM-dd"), ("us_day", "MM/dd/yyyy")):
        day = F.date_format("o_orderdate", layout)
        cells = cells.unionByName(orders.select(F.lit(kind).alias("kind"), day.alias("v")))
    v = F.col("v")
    return cells.groupBy("kind").agg(
        F.count("v").alias("n"),
        F.count_if(fields.is_numeric_text(v)).alias("numbers"),
        F.count_if(fields.is_date_text(v)).alias("dates"),
        F.count_if(fields.is_profile_currency(v)).alias("codes"),
    )


@query(
    "merged_json",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k,
        event_type AS kind, user_id::VARCHAR AS user_id,
        CASE WHEN event_id % 7 <> 0 THEN 3 ELSE 2 END::BIGINT AS keys FROM events""",
)
def merged_json(spark, folder):
    events = table(spark, folder, "events")
    old = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("not json "), F.col("props"))).otherwise(
        F.col("props")
    )
    new = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id")))
    merged = events.select("event_id", text.merged_object(old, new).alias("j"))
    return merged.select(
        "event_id",
        *[F.get_json_object("j", f"$.{k}").alias(k) for k in ("k", "kind", "user_id")],
        F.size(F.map_keys(F.from_json("j", "map<string,string>"))).alias("keys"),
    )


@query(
    "job_labels",
    f"""SELECT status, CASE status WHEN 'queued' THEN 'waiting' WHEN 'running' THEN 'processing' ELSE status END AS label,
        CASE status WHEN 'running' THEN 50 WHEN 'completed' THEN 100 ELSE 0 END::BIGINT AS progress,
        CASE status WHEN 'retrying' THEN 'waiting' WHEN 'queued' THEN 'waiting' WHEN 'running' THEN 'processing' ELSE status END AS client_label,
        count(*) AS jobs FROM (SELECT CASE WHEN job_id % 13 = 0 THEN 'retrying' ELSE status END AS status FROM ({JOBS_SQL})) j
        GROUP BY ALL""",
)
def job_labels(spark, folder):
    status = F.when(F.col("job_id") % 13 == 0, "retrying").otherwise(F.col("status"))
    found = jobs(spark, folder).select(status.alias("status"))
    label = fields.job_status_label(F.col("status"))
    return found.groupBy("status").agg(F.count("*").alias("jobs")).withColumns(
        {
            "label": label,
            "progress": fields.job_progress(F.col("status")),
            "client_label": fields.client_status(label),
        }
    )
