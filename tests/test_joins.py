"""As-of and overlap joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import asof, intervals


def plain_asof(left, right, strict, lag, tolerance, forward):
    out = []
    for n, (k, t) in enumerate(left):
        best = None
        for rk, rt, v in right:
            if k is None or t is None or rk is None or rt is None or rk != k:
                continue
            at = rt + lag
            if forward:
                ok, key = (at > t if strict else at >= t) and (tolerance is None or at - t <= tolerance), (-at, v)
            else:
                ok, key = (at < t if strict else at <= t) and (tolerance is None or t - at <= tolerance), (at, v)
            if ok and (best is None or key > best):
                best = key
        out.append((n, k, t, None if best is None else abs(best[0]) if forward else best[0], None if best is None else best[1]))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize(("lag", "tolerance"), [(0, None), (3, 5)])
def test_asof_join(spark, strict, forward, lag, tolerance):
    rng = random.Random(strict + 2 * forward + lag)
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])  # noqa: E731  one key holds most rows
    left = [(key(), rng.choice([None, *range(1, 60)])) for _ in range(300)]
    right = [(key(), rng.choice([None, *range(1, 60)]), rng.randrange(50)) for _ in range(80)]
    left += left[:20]
    a = spark.createDataFrame([(n, *x) for n, x in enumerate(left)], "n int, k int, t long")
    b = spark.createDataFrame(right, "k int, t long, v int")
    got = asof.asof_join(a, b, "t", ("k",), strict=strict, lag=F.lit(lag), tolerance=None if tolerance is None else F.lit(tolerance), forward=forward, ranges=8)
    assert sorted(map(tuple, got.select("n", "k", "t", "t_right", "v").collect())) == plain_asof(left, right, strict, lag, tolerance, forward)


def test_asof_join_without_keys_spreads_over_ranges(spark):
    a = spark.range(4000).select((F.col("id") * 3 % 4000).alias("t"))
    b = spark.range(0, 4000, 7).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    got = asof.asof_join(a, b, "t")
    assert got.where("v <> 2 * (t - t % 7) OR v IS NULL").count() == 0 and got.count() == 4000
    sizes = [r[0] for r in asof.in_ranges(a, "t").groupBy("_range").count().select("count").collect()]
    assert len(sizes) == asof.RANGES and max(sizes) < 2 * min(sizes)


def test_asof_join_of_empty_sides_and_inner(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, t long")
    none = spark.createDataFrame([], "k int, t long, v int")
    assert sorted(map(tuple, asof.asof_join(a, none, "t", ("k",)).collect())) == [(1, 5, None, None), (2, 6, None, None)]
    assert asof.asof_join(a, none, "t", ("k",), how="inner").count() == 0
    assert asof.asof_join(none.select("k", "t"), none, "t", ("k",)).count() == 0
    with pytest.raises(ValueError, match="both"):
        asof.asof_join(a, a.withColumnRenamed("t", "k2"), "t", (), "k2")


def spans(rng, n, longest=40):
    out = []
    for _ in range(n):
        s = rng.choice([None, *range(200)]) if rng.random() < 0.1 else rng.randrange(200)
        length = rng.choice([0, 1, 3, 10, rng.randrange(longest), -2])
        out.append((rng.choice([None, "x", "x", "x", "y"]), s, None if s is None else s + length))
    return out


def meets(a, b):
    return None not in (*a, *b) and a[0] == b[0] and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]


@pytest.mark.parametrize(("width", "salts"), [(None, 16), (1, 2), (4, 1), (64, 3)])
def test_overlap_join_gives_each_pair_once(spark, width, salts):
    rng = random.Random(salts)
    left, right = spans(rng, 150) + [("x", 50, 51)] * 40, spans(rng, 150, 180)
    a = spark.createDataFrame([(n, *x) for n, x in enumerate(left)], "n int, k string, s long, e long")
    b = spark.createDataFrame([(n, *x) for n, x in enumerate(right)], "n int, k string, s long, e long")
    got = [tuple(r) for r in intervals.overlap_join(a, b, "s", "e", ("k",), width, salts).select("a.n", "b.n").collect()]
    assert sorted(got) == [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if meets(x, y)]


def test_overlap_counts_purge_merge_and_uniqueness(spark):
    rng = random.Random(5)
    left, right = spans(rng, 120), spans(rng, 100)
    a = spark.createDataFrame([(n, *x) for n, x in enumerate(left)], "n int, k string, s long, e long")
    b = spark.createDataFrame(right, "k string, s long, e long")
    want = {n: sum(meets(x, y) for y in right) for n, x in enumerate(left)}
    assert {r.n: r.n_overlaps for r in intervals.overlap_counts(a, b, "s", "e", ("k",)).collect()} == want
    few = b.where("s % 40 < 6")
    some = [tuple(r) for r in few.collect()]
    for embargo in (0, 3):
        wider = [(k, s - embargo, e + embargo) for k, s, e in some if None not in (k, s, e)]
        kept = sorted(r.n for r in intervals.purged(a, few, "s", "e", ("k",), embargo).collect())
        assert kept == [n for n, x in enumerate(left) if not any(meets(x, y) for y in wider)]
    points = {k: set() for k in "xy"}
    for k, s, e in right:
        if None not in (k, s, e) and s <= e:
            points[k] |= {2 * t for t in range(s, e + 1)} | {2 * t + 1 for t in range(s, e)}
    got = sorted(map(tuple, intervals.merged(b, "s", "e", ("k",)).collect()))
    assert got == sorted((k, t // 2, next(u for u in range(t, 2000) if u + 1 not in p) // 2) for k, p in points.items() for t in p if t - 1 not in p)
    cover = lambda k, t: sum(k == y[0] and y[1] <= t <= y[2] for y in left if None not in y)
    for r in intervals.uniqueness(a, "s", "e", ("k",)).collect():
        if None in (r.k, r.s, r.e) or r.s > r.e:
            assert r.uniqueness is None
        else:
            assert r.uniqueness == pytest.approx(sum(1 / cover(r.k, t) for t in range(r.s, r.e + 1)) / (r.e - r.s + 1))


def test_overlap_join_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, s long, e long")
    one = spark.createDataFrame([("x", 1, 2)], "k string, s long, e long")
    assert intervals.overlap_join(none, one, "s", "e", ("k",)).count() == 0 and intervals.overlap_join(one, none, "s", "e").count() == 0
    assert intervals.overlap_counts(one, none, "s", "e", ("k",)).collect()[0].n_overlaps == 0
    assert intervals.purged(one, none, "s", "e", ("k",)).count() == 1 and intervals.merged(none, "s", "e").count() == 0
