import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.csv import csv_rows, split_fields, valid_csv_rows


def save(folder, name, content):
    path = folder / name
    path.write_text(content, newline="")
    return path


@pytest.mark.parametrize(
    "line, expected",
    [
        ("a,b", ["a", "b"]), ("a,,", ["a", "", ""]), ('"a,b",c', ["a,b", "c"]),
        ('"say ""hi""",x', ['say "hi"', "x"]), ('"",y', ["", "y"]), ('""""', ['"']),
        ('a"b"c,d', ['a"b"c', "d"]), ("", []), ('x,"a","b,c"', ["x", "a", "b,c"]),
        ('"a\x01b",c', ["a\x01b", "c"]), ('"\x02a,\x02b\x01",\x01', ["\x02a,\x02b\x01", "\x01"]),
    ],
)
def test_split_fields(value, line, expected):
    assert value(split_fields(F.lit(line))) == expected


def test_plain_file(spark, tmp_path):
    save(tmp_path, "a.csv", "plotId,crop\nP7,Barley\nP9,Lupin\n")
    found = csv_rows(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["raw"] for r in found] == [
        {"plotid": "P7", "crop": "Barley"}, {"plotid": "P9", "crop": "Lupin"},
    ]
    assert [r["row_index"] for r in found] == [2, 3]


def test_repeated_header(spark, tmp_path):
    save(tmp_path, "a.csv", " Plot No , Crop Sown ,Plot No\nP7,Barley,again\n")
    row = csv_rows(spark, str(tmp_path)).first()
    assert row["raw"] == {"plot_no": "P7", "crop_sown": "Barley", "plot_no_2": "again"}


def test_rows_of_other_widths_than_the_header(spark, tmp_path):
    """Widths from none to five under a header of three; only rows of three stay."""
    widths = [3, 5, 1, 3, 2, 4, 3]
    body = "".join(",".join(f"{chr(97 + k)}{n}" for k in range(n)) + "\n" for n in widths)
    save(tmp_path, "w.csv", "one,two,three\n" + body)
    good, bad = valid_csv_rows(spark, str(tmp_path))
    kept = good.orderBy("row_index").collect()
    assert [r["row_index"] for r in kept] == [i for i, n in enumerate(widths, 2) if n == 3]
    assert all(r["raw"] == {"one": "a3", "two": "b3", "three": "c3"} for r in kept)
    names = ["one", "two", "three"]
    told = {
        n: f"Missing columns: {', '.join(names[n:])}." if n < 3 else f"Extra columns detected: {n - 3}."
        for n in widths
    }
    assert [r["warning"] for r in bad.orderBy("row_index").collect()] == [
        f"row {i}: {told[n]}" for i, n in enumerate(widths, 2) if n != 3]


def test_empty_line_is_a_row_with_problems(spark, tmp_path):
    save(tmp_path, "a.csv", "a,b\n1,2\n\n3,4\n")
    good, bad = valid_csv_rows(spark, str(tmp_path))
    assert [r["row_index"] for r in good.orderBy("row_index").collect()] == [2, 4]
    assert {r["reason"] for r in bad.collect()} == {"Row is empty.", "Missing columns: a, b."}


def test_huge_cell(spark, tmp_path):
    save(tmp_path, "a.csv", "a,b\n1," + "x" * (51 * 1024 * 1024) + "\n")
    sizes = csv_rows(spark, str(tmp_path)).select(F.length(F.get("values", F.lit(1))).alias("n"))
    assert sizes.first()["n"] == 51 * 1024 * 1024


@pytest.mark.parametrize("broken", [False, True])
def test_row_numbers_hold_across_small_blocks(spark, tmp_path, broken):
    """Files cut into many blocks keep their line numbers and headers."""
    for name, count in (("a.csv", 3000), ("b.csv", 1777)):
        save(tmp_path, name, f"id,{name[0]}\n" + "".join(f"{i},v{i}\n" for i in range(count)))
    if broken:
        save(tmp_path, "c.csv", 'id,c\n1,"one\ntwo"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = csv_rows(spark, str(tmp_path)).filter("document_id NOT LIKE '%c.csv'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4777
    assert all(int(r["raw"]["id"]) + 2 == r["row_index"] for r in rows)
    assert {tuple(r["headers"]) for r in rows} == {("id", "a"), ("id", "b")}


def test_quoted_line_breaks_across_small_blocks(spark, tmp_path):
    source = random.Random(7)
    cells = []
    for i in range(900):
        parts = ["w" * source.randint(0, 20) for _ in range(source.randint(1, 5))]
        cells.append("\n".join(parts) + source.choice(["", ',"', '""', "\n"]))
    body = "".join(f'{i},"{c.replace(chr(34), chr(34) * 2)}"\n' for i, c in enumerate(cells))
    save(tmp_path, "a.csv", "id,text\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = csv_rows(spark, str(tmp_path)).orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["raw"]["text"] for r in rows] == cells
    assert [r["row_index"] for r in rows] == list(range(2, 902))


def test_line_breaks_are_kept_by_default(spark, tmp_path):
    save(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n2,z\n')
    good, bad = valid_csv_rows(spark, str(tmp_path))
    assert [(r["row_index"], r["raw"]["b"]) for r in good.orderBy("row_index").collect()] == [
        (2, "x\ny"), (3, "z")]
    assert bad.count() == 0


def test_stray_quote_becomes_error_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerloom.sources.csv.UNCLOSED_LINES", 50)
    body = "".join(f"{i},v\n" for i in range(400))
    save(tmp_path, "a.csv", f'a,b\n0,"x\ny"\n1,"stray\n{body}')
    good, bad = valid_csv_rows(spark, str(tmp_path))
    assert [r["row_index"] for r in good.collect()] == [2]
    assert {(r["row_index"], r["reason"]) for r in bad.collect()} == {
        (3, "Quoted value is not closed.")}
    assert bad.count() == 9


def test_a_closed_value_of_very_many_lines_is_whole(spark, tmp_path):
    """Twice as many lines as an unclosed record may have, over many blocks, then further records."""
    value = "\n".join(f"line {i}" for i in range(200_000))
    save(tmp_path, "a.csv", f'id,text\n1,"{value}"\n2,"short\none"\n3,plain\n')
    save(tmp_path, "b.csv", f'id,text\n1,"never {value[:3000]}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        good, bad = valid_csv_rows(spark, str(tmp_path))
        found = {r["row_index"]: r["raw"]["text"] for r in good.collect()}
        assert found == {2: value, 3: "short\none", 4: "plain"}
        assert {(r["document_id"][-5:], r["reason"]) for r in bad.collect()} == {
            ("b.csv", "Quoted value is not closed.")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
