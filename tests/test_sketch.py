"""Quantile sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.windows import Over
from tidewatch.operators import sketch


def off(values, q, got):
    """How many rows the rank of ``got`` is from q * (n - 1)."""
    want = q * (len(values) - 1)
    low, high = (values < got).sum(), (values <= got).sum() - 1
    return max(0, low - want, want - high)


@pytest.mark.parametrize("kind", ["normal", "ties", "sorted"])
def test_a_sketch_keeps_its_bound_however_it_is_merged(kind):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=30_000), "ties": rng.integers(0, 20, 30_000).astype(float), "sorted": np.arange(30_000.0)}[kind]
    one, parts = sketch.Sketch(128).add(values), [sketch.Sketch(128).add(p) for p in np.array_split(values, 37)]
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    for s in (one, parts[0]):
        assert s.n == len(values) and s.bound < 0.1 * len(values) and len(s.weighted()[0]) < 128 * 10
        for q in (0.0, 0.1, 0.5, 0.75, 0.99, 1.0):
            assert off(values, q, sketch.quantile_of(*s.weighted(), q)) <= s.bound + 1


def test_quantiles_by_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x")).repartition(9)
    pdf = df.toPandas().dropna(subset=["x"])
    got = {r.k: r for r in sketch.approximate_quantiles(df, ["k"], "x", [0.05, 0.5, 0.95]).collect()}
    assert got.keys() == {"a", "b", None}
    for k, r in got.items():
        own = pdf[pdf.k.isna() if k is None else pdf.k == k].x.to_numpy()
        assert r.n == len(own) and r.rank_error < 0.05 * len(own)
        assert all(off(own, q, v) <= r.rank_error + 1 for q, v in zip((0.05, 0.5, 0.95), r.quantiles, strict=True))
    empty = sketch.approximate_quantiles(df.withColumn("x", F.lit(None).cast("double")), ["k"], "x", [0.5]).collect()
    assert [(r.quantiles, r.n) for r in empty] == [([], 0)] * 3


def test_trailing_quantiles_of_long_frames(spark):
    rng = np.random.default_rng(3)
    n, frame = 14_000, 10_240
    x = np.cumsum(rng.normal(size=n))
    rows = [("a", t, float(v)) for t, v in enumerate(x)] + [("b", t, None if t == 40 else float(t % 7)) for t in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(6)
    got = sketch.trailing_quantile(df, "x", 0.75, frame, Over("t", ("k",))).where("k = 'a'").orderBy("t").collect()
    assert len(got) == n and all(r.quantile is None for r in got[: frame - 1])
    for t in [*range(frame - 1, n, 97), n - 1]:
        assert got[t].rank_error < 0.1 * frame and off(x[t - frame + 1 : t + 1], 0.75, got[t].quantile) <= got[t].rank_error + 1
    short = {r.t: r.quantile for r in sketch.trailing_quantile(df.where("k = 'b'"), "x", 0.5, 64, Over("t", ("k",)), block=32).collect()}
    assert all(short[t] is None for t in [*range(63), *range(40, 104)]) and short[104] == np.quantile([u % 7 for u in range(41, 105)], 0.5, method="higher") and len(short) == 900
    with pytest.raises(ValueError, match="multiple"):
        sketch.trailing_quantile(df, "x", 0.5, 100, Over("t", ("k",)))


def test_exact_ranks_in_frames_that_cross_blocks(spark):
    rng = np.random.default_rng(4)
    n, frame = 1_000, 16  # blocks of 160 rows
    x = {k: rng.integers(0, 30, n).astype(float) for k in "ab"}
    lost = {("a", 40): None, ("a", 161): float("nan")}
    rows = [(k, t, lost.get((k, t), float(v)), None if t % 50 == 7 else float(t % 30)) for k in "ab" for t, v in enumerate(x[k])]
    df = spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0)], "k string, t long, x double, at double").repartition(5)
    got = {(r.k, r.t): (r.below, r.upto) for r in sketch.frame_ranks(df, "x", "at", frame, Over("t", ("k",))).collect()}
    assert len(got) == 2 * n + 1 and got["c", 0] == (None, None)
    for k in "ab":
        for t in range(n):
            own, at = x[k][t - frame + 1 : t + 1], float(t % 30)
            gone = t < frame - 1 or t % 50 == 7 or any((k, u) in lost for u in range(t - frame + 1, t + 1))
            assert got[k, t] == ((None, None) if gone else ((own < at).sum(), (own <= at).sum()))


def test_quantiles_of_sliding_edges_equal_those_of_each_frame():
    rng = np.random.default_rng(5)
    values, weights, edge, block = rng.integers(0, 50, 90).astype(float), 1 << rng.integers(0, 4, 90), rng.integers(0, 50, 63).astype(float), 32
    edge[40] = np.nan
    for held in (slice(0, 90), slice(0, 0)):
        got, full = sketch._slid(values[held], weights[held], edge, block, 0.75)
        assert full.tolist() == [not j <= 40 < j + block for j in range(32)]
        for j in np.flatnonzero(full):
            each, ones = np.concatenate((values[held], edge[j : j + block])), np.ones(block, np.int64)
            assert got[j] == sketch.quantile_of(each, np.concatenate((weights[held], ones)), 0.75)
