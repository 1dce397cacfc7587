import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, digest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "route_documents", "column_roles", "row_batches", "answer_scores", "sheet_rows", "text_blocks",
    "nested_session_documents", "csv_scan_line_breaks", "streamed_files", "review_grid",
]


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return db


def test_every_query_has_sql():
    assert set(contract.ORACLES) == set(contract.QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    result = database.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = digest(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours[1] == digest(columns, result.fetchall())[1]


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 5
    assert sum(r["total_rows"] for r in frame.collect()) == 150


def test_routed_counts_add_up(spark):
    for row in contract.entry(spark).collect():
        assert row["deterministic_rows"] + row["ambiguous_rows"] == row["total_rows"]
