import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, _label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "a", "b", 3) for i, v, g in rows], SCHEMA)


def plain(rows, rounds=2, entries=64):
    """The whole computation in Python's integers."""
    import math
    from fractions import Fraction

    good = [
        (i, [math.floor(Fraction(x) * 256) for x in v], g) for i, v, g in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(good[0][1])
    cuts = [size * k // 16 for k in range(17)]
    part = lambda v, k: v[cuts[k]:cuts[k + 1]]
    books = [[part(v, k) for _, v, _ in good[:entries]] for k in range(16)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k in range(16):
            members = {}
            for _, v, _ in good:
                members.setdefault(near(part(v, k), books[k])[0], []).append(part(v, k))
            for e, xs in members.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(part(v, k), books[k]) for k in range(16)] for _, v, _ in good]
    errors = [sum(f for _, f in line) for line in found]
    per_label = {}
    for (_, _, g), e in zip(good, errors):
        per_label[g] = per_label.get(g, 0) + e
    h = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    fit = lambda e: e if e < 1 << 63 else None
    return sorted(
        (i, "".join(f"{e:02x}" for e, _ in line), fit(err),
         fit(per_label[g]) if all(fit(e) is not None for (_, _, o), e in zip(good, errors) if o == g)
         else None, h)
        for (i, _, g), line, err in zip(good, found, errors)
    ) if all(i is not None for i, _, _ in good) else [
        (i, "".join(f"{e:02x}" for e, _ in line), err, per_label[g], h)
        for (i, _, g), line, err in zip(good, found, errors)]


def result(frame):
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("size,scale", [(32, 0.3), (48, 40.0), (384, 1.0), (20, 3e6), (16, 1e13)])
def test_against_plain_version(spark, size, scale):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(150, size)) * scale
    x[70:100] = x[:30]
    rows = [(int(i), v.tolist(), None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(x)]
    rng.shuffle(rows)
    rows = [(int(i), v, g) for i, v, g in rows]
    assert result(codes.compress(table(spark, rows).repartition(4))) == sorted(plain(rows), key=repr)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for width, top in ((4, 1 << 20), (24, 1 << 27), (1, 1 << 31), (300, 1 << 26)):
        a, b = rng.integers(-top, top, (40, width)), rng.integers(-top, top, (9, width))
        a[0], b[0] = -top, -top
        truth = a.astype(object) @ b.T.astype(object)
        assert (codes.products(a, b) == truth.astype(np.int64)).all()
        bits = (53 - int(np.ceil(np.log2(max(2, width))))) // 2
        for limb in codes.limbs(a, bits):
            assert width * np.abs(limb).max() ** 2 <= 2**53


def test_useless_vectors_ties_and_repeated_rows(spark):
    v = [0.5] * 16
    rows = [(4, v, None), (4, v, None), (2, [-0.001] * 16, 1), (1, None, 1), (3, [None] + v[1:], 1),
            (5, [float("nan")] + v[1:], 1), (6, [float("-inf")] + v[1:], 2), (9, v, 1)]
    out = result(codes.compress(table(spark, rows)))
    assert out == sorted(plain(rows), key=repr)
    # -0.001 goes down to -1; equal entries: the lower index.
    assert [(r[0], r[1][:2], r[2]) for r in out] == [(2, "00", 0), (4, "01", 0), (4, "01", 0), (9, "01", 0)]


def test_rows_without_id_and_other_lengths(spark):
    rows = [(None, [1.0] * 16, 1), (3, [2.0] * 16, 1), (4, [1.0] * 17, 1), (8, [], 1)]
    out = result(codes.compress(table(spark, rows)))
    assert [(r[0], r[1][:2]) for r in out] == [(3, "00"), (None, "01")]


def test_huge_components(spark):
    rows = [(i, [(-1.0) ** i * 1e300 * (i + 1)] + [0.1 * i] * 15, i % 2) for i in range(70)]
    assert result(codes.compress(table(spark, rows))) == sorted(plain(rows), key=repr)


def test_fewer_components_than_parts_and_empty_table(spark):
    rows = [(i, [float(i), 1.0, -float(i)], None) for i in range(5)]
    assert result(codes.compress(table(spark, rows))) == sorted(plain(rows), key=repr)
    empty = codes.compress(table(spark, rows).filter("vec_id < 0"))
    assert empty.collect() == [] and dict(empty.dtypes)["error"] == "bigint"
    nothing = codes.compress(table(spark, rows).withColumn("embedding", F.lit(None).cast("array<double>")))
    assert nothing.collect() == []
