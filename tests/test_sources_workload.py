"""Queries over files that Spark writes or streams, on tables that are a file or a folder."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from ledgerloom.sources.csv import csv_rows

TEXTS = [(1, "one\n two\n\n"), (2, "three"), (3, None), (4, "x\r\ny\nz")]


def save(folder, name, rows, schema, parts):
    """A table of the driver's kind: one file, or a folder of several."""
    target = folder / f"{name}.parquet"
    if parts > 1:
        target.mkdir()
    for i in range(parts):
        some = [dict(zip(schema.names, r)) for r in rows[i::parts]]
        path = target / f"part-{i:04}.parquet" if parts > 1 else target
        pq.write_table(pa.Table.from_pylist(some, schema), path)


@pytest.mark.parametrize("parts", [1, 3])
def test_streamed_lines_of_a_file_and_of_a_folder(spark, tmp_path, parts):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    save(tmp_path, "documents", TEXTS, schema, parts)
    save(tmp_path, "documents_old", [(9, "not this one")], schema, 1)
    got = contract.queries()["streamed_lines"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["lines"]) for r in got) == [(1, 2), (2, 1), (4, 3)]


def many_parts(spark, run):
    """Results of a run in which shuffles keep all their parts and files are cut into small blocks."""
    wanted = {
        "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "2048",
    }
    old = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return run()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("broken", [False, True])
def test_rows_of_one_table_are_numbered_through_its_files(spark, tmp_path, broken):
    """Files of 700, no and 500 rows, with and without line breaks in the cells."""
    end, first = ("\nb,c" if broken else ""), 0
    for name, n in (("part-0", 700), ("part-1", 0), ("part-2", 500)):
        body = "".join(f'{i},"a{end}"\n' for i in range(first, first + n))
        (tmp_path / f"{name}.csv").write_text("id,text\n" + body, newline="")
        first += n
    got = many_parts(spark, lambda: csv_rows(spark, str(tmp_path), one_table=True).collect())
    assert sorted((r["row_index"], int(r["raw"]["id"])) for r in got) == [
        (i + 2, i) for i in range(1200)]
    assert {r["raw"]["text"] for r in got} == {"a" + end}
    apart = many_parts(spark, lambda: csv_rows(spark, str(tmp_path)).collect())
    assert max(r["row_index"] for r in apart) == 701


def test_csv_scan_numbers_the_rows_of_the_table(spark, tmp_path):
    names = ["p_partkey", "p_name", "p_brand", "p_type"]
    schema = pa.schema([(names[0], pa.int64()), *((n, pa.string()) for n in names[1:])])
    keys = [7 * i % 500 for i in range(500)]
    save(tmp_path, "part", [(k, f"n {k}", "b", "t") for k in keys], schema, 3)
    got = many_parts(spark, lambda: contract.queries()["csv_scan"](spark, str(tmp_path)).collect())
    assert sorted((r["row_index"], r["part_key"], r["description"]) for r in got) == [
        (k + 2, str(k), f'n {k}, "b"\x01') for k in range(500)]


def test_csv_scan_line_breaks_numbers_the_rows_of_the_table(spark, tmp_path):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = [(11 * i % 300, f"first\n\"{i}\",\nlast") for i in range(300)]
    save(tmp_path, "documents", rows, schema, 2)
    got = many_parts(
        spark, lambda: contract.queries()["csv_scan_line_breaks"](spark, str(tmp_path)).collect())
    texts = dict(rows)
    assert sorted((r["row_index"], r["doc_id"], r["length"]) for r in got) == [
        (k + 2, str(k), len(texts[k])) for k in range(300)]
