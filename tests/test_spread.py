import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import spread
from ledgerloom.session import write_through


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key; order values have holes."""
    source = random.Random(3)
    rows = []
    for key, count in (("hot", 1000), *((f"k{i}", 40) for i in range(50))):
        for at in source.sample(range(count * 3), count):
            rows.append((key, "s" if at % 2 else "t", at))
    return spark.createDataFrame(rows, "key string, part string, at bigint"), rows


def test_position_equals_a_plain_rank(skewed):
    df, rows = skewed
    got = spread.with_position(df, ["key"], "at", "pos", within=["part"], block_rows=64).collect()
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        expected.update({r: i + 1 for i, r in enumerate(mine)})
    assert {(r["key"], r["part"], r["at"]): r["pos"] for r in got} == expected


@pytest.mark.parametrize("gap", [1, 5, 9, 200])
@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_first_long_gap(skewed, gap, block):
    df, rows = skewed
    got = {r["key"]: r["gap_after"] for r in spread.gap_starts(df, ["key"], "at", gap, block).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        values = sorted(r[2] for r in rows if r[0] == key)
        for low, high in zip(values, values[1:]):
            if high - low > gap:
                expected[key] = low
                break
    assert got == expected


def test_join_keeps_every_row(spark, skewed):
    df, rows = skewed
    per_key = df.groupBy("key").agg(F.max("at").alias("top")).filter("key <> 'k3'")
    left = spread.join_per_key(df, per_key, ["key"])
    assert left.count() == len(rows)
    assert left.filter("top IS NULL").count() == 40
    inner = spread.join_measured(df, per_key, ["key"], "inner", broadcast_rows=0)
    assert inner.count() == len(rows) - 40


def test_hot_key_is_shared_by_tasks(spark, tmp_path):
    """One key holds half of the rows; Spark splits its partition over several tasks."""
    hot = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000)
    spark.range(400_000).select(hot.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(
        str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        per_key = write_through(df.groupBy("key").agg(F.count("*").alias("n")), "per-key")
        joined = spread.join_per_key(df, per_key, ["key"])
        parts = joined.filter("n > 1000").groupBy(F.spark_partition_id()).agg(F.max("x"))
        assert len(parts.collect()) > 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_order_of_texts(spark):
    rows = spark.createDataFrame([("s", f"d{k:03}") for k in range(200)], "session_id string, id string")
    placed = spread.with_position(
        spread.with_order(rows, ["session_id", "id"], "_at"), ["session_id"], "_at", "pos", block_rows=16)
    assert all(int(r["id"][1:]) + 1 == r["pos"] for r in placed.collect())


def test_first_rows_uses_a_group_limit(spark, skewed):
    df, _ = skewed
    top = spread.first_rows(df, ["key"], ["at"], 3, "pos")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 51 * 3
