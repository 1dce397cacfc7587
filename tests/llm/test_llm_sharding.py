import zlib

import numpy as np
import pytest
from helpers import documents, rows_of

from ledgerloom.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096, 10007])
def test_places_are_a_permutation_with_an_inverse(n):
    row = np.arange(n)
    place = sharding.place_of(row, n, 5)
    assert sorted(place) == list(range(n))
    assert (sharding.row_at(place % 7, place // 7, n, 5, 7) == row).all()
    if n > 100:
        assert (sharding.place_of(row, n, 6) != place).mean() > 0.9
        assert abs(np.corrcoef(row, place)[0, 1]) < 0.2


def test_shards_are_even_gapless_and_reproducible(spark):
    texts = ["", None, "é", "x" * 100_000] + ["same"] * 60 + [f"t{k}" for k in range(40)]
    ids = [None, None, 0, 1] + [7] * 60 + list(range(100, 140))
    docs = documents(spark, texts, ids)
    out = sharding.assign_shards(docs, shards=6)
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(v) for v in by.values())[0] + 1 >= max(len(v) for v in by.values())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    again = sharding.assign_shards(docs.repartition(5, "text"), shards=6)
    assert rows_of(out, *columns) == rows_of(again, *columns)
    sizes = sorted((len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()))
                   for t in texts if t is not None)
    assert sizes == sorted((r["size"], r["text_crc32"]) for r in out.collect()
                           if r["text_crc32"] is not None)


def test_written_shards_have_their_rows_in_slot_order(spark, tmp_path):
    out = sharding.assign_shards(documents(spark, [f"t{k}" for k in range(50)]), shards=4)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 50


def test_empty_table(spark):
    assert sharding.assign_shards(documents(spark, [])).collect() == []


def plain_place(row, n, key):
    """The permutation with Python's integers, one number at a time."""
    size_a = next(a for a in range(1, n + 2) if a * a >= n)
    size_b = -(-n // size_a)
    mask = 2**64 - 1

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    while True:
        left, right, size, other = row % size_a, row // size_a, size_a, size_b
        for number in range(sharding.ROUNDS):
            salt = (key * 0x9E3779B97F4A7C15 + (number + 1) * 0xBF58476D1CE4E5B9) & mask
            left, right = right, (left + mix(right ^ salt) % size) % size
            size, other = other, size
        row = left + size_a * right
        if row < n:
            return row


def test_rows_shards_and_slots_of_a_table_by_plain_python(spark):
    """Row numbers by sorting, places by the plain permutation, shards and slots by division."""
    texts = [f"text {k * 7919 % 501}" if k % 9 else None for k in range(700)] + ["copy"] * 300
    ids = [k * 31 % 997 for k in range(1000)]
    rows = sorted(
        ((i, -1 if t is None else zlib.crc32(t.encode()), len((t or "").encode()) + 16) for i, t in zip(ids, texts)))
    expected = []
    for number, (i, crc, size) in enumerate(rows):
        place = plain_place(number, len(rows), 2024)
        expected.append((i, size, None if crc < 0 else crc, place % 40, place // 40, number))
    out = sharding.assign_shards(documents(spark, texts, ids).repartition(7))
    assert rows_of(out, "doc_id", "size", "text_crc32", "shard", "slot", "row_number") == sorted(expected, key=repr)
