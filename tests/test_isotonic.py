"""Isotonic calibration against a plain pool-adjacent-violators."""

import random

import pytest

from tidewatch.operators import isotonic


def plain(pairs):
    by = {}
    for p, y in pairs:
        if p is not None and p == p and y is not None:
            n, s = by.get(p, (0, 0.0))
            by[p] = n + 1, s + y
    blocks = []
    for p in sorted(by):
        blocks.append([p, p, *by[p]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2] - 1e-12:
            _, high, n, s = blocks.pop()
            blocks[-1][1:] = high, blocks[-1][2] + n, blocks[-1][3] + s
    return [(a, b, n, round(s / n, 9)) for a, b, n, s in blocks]


def fitted(df, keys, **kw):
    return [(*(r[k] for k in keys), r.low, r.high, r.n, round(r.value, 9)) for r in isotonic.isotonic_blocks(df, keys, **kw).orderBy(*keys, "low").collect()]


@pytest.mark.parametrize("most", [1000, 37, 5])
def test_ranges_give_the_fit_of_one_task(spark, most):
    rng = random.Random(7)
    pairs = [(round(rng.random(), 3), float(rng.random() < 0.3)) for _ in range(300)] + [(0.5, 1.0)] * 20 + [(None, 1.0), (float("nan"), 0.0), (0.25, None)]
    pairs += [(2 + k / 100, 1.0 - k / 100) for k in range(60)]  # falls all the way: one block over many ranges
    df = spark.createDataFrame(pairs, "p double, y double").repartition(3)
    assert fitted(df, [], range_blocks=most) == plain(pairs)


def test_keys_steps_and_edges(spark):
    rng = random.Random(2)
    rows = [(k, round(rng.random(), 2), float(rng.random() < 0.5)) for k in "ab" for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, p double, y double")
    assert fitted(df, ["k"]) == [("a", *b) for b in plain([r[1:] for r in rows if r[0] == "a"])] + [("b", *b) for b in plain([r[1:] for r in rows if r[0] == "b"])]
    blocks = spark.createDataFrame([("a", 0.2, 0.25), ("a", 0.6, 0.75)], "k string, low double, value double")
    asked = spark.createDataFrame([("a", p) for p in (0.1, 0.2, 0.59, 0.6, 9.0, None)] + [("c", 0.5)], "k string, p double")
    got = {(r.k, r.p): r.calibrated for r in isotonic.calibrated(asked, blocks, ("k",)).collect()}
    assert got == {("a", 0.1): 0.25, ("a", 0.2): 0.25, ("a", 0.59): 0.25, ("a", 0.6): 0.75, ("a", 9.0): 0.75, ("a", None): None, ("c", 0.5): None}
    assert isotonic.isotonic_blocks(df.limit(0), ["k"]).count() == 0
