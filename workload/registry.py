"""Registration of queries and their SQL; results use 64-bit integers and rounded doubles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def tidy(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "double" or kind.startswith("decimal"):
            column = F.round(column.cast("double"), 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``sql`` is what DuckDB must return for the same tables."""

    def register(fn):
        @wraps(fn)
        def run(spark, folder):
            return tidy(fn(spark, folder))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
