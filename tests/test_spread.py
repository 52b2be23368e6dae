"""One series over ranges gives the rows of one window."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import windows as w
from tidewatch.functions.windows import Over
from tidewatch.operators import align, asof, metrics, spread
from tidewatch.operators.labels import with_labels

OVER = Over("t", ("k",))


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(4)
    sizes = {"a": 900, "b": 40, None: 60}  # one holds most
    rows = [(k, t * 3 + rng.randrange(2), 100 + 10 * rng.random(), float(rng.random() < 0.6), float(rng.random() < 0.2)) for k, n in sizes.items() for t in range(n)]
    return spark.createDataFrame(rows, "k string, t long, close double, s double, y double").repartition(5).cache()


def look(df, *columns):
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("k", "t", *columns).collect()), key=lambda r: order([r[0] or "", *r[1:]]))


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_labels_and_windows(spark, walk, ranges):
    rows, over = spread.spread(walk, OVER, 60, 11, ranges)
    made = lambda df, o: with_labels(df, "close", o, trail=40).withColumns({"d": w.below_peak("close", 21, o), "next": w.return_ahead("close", 10, o)})
    columns = ("rv_trail", "rv_thresh", "rv_fwd", "mdd_fwd", "label", "d", "next")
    assert look(spread.core(made(rows, over)), *columns) == look(made(walk, OVER), *columns)
    if ranges == 7:
        assert rows.where("k = 'a'").groupBy("_spread").count().count() > 4  # the long series lies over ranges


@pytest.mark.parametrize("ranges", [1, 5, 64, 200])
def test_positions_and_running_values(spark, walk, ranges):
    got = spread.with_running(walk, OVER, {"total": (F.col("close"), "sum"), "top": (F.when(F.col("s") == 0, F.col("t")), "max"), "low": (F.col("close"), "min")}, ranges)
    frame = OVER.rows(-(10**9), 0)
    want = walk.select("*", F.sum("close").over(frame).alias("total"), F.max(F.when(F.col("s") == 0, F.col("t"))).over(frame).alias("top"), F.min("close").over(frame).alias("low"))
    assert [(*r[:2], round(r[2], 6), *r[3:]) for r in look(got, "total", "top", "low")] == [(*r[:2], round(r[2], 6), *r[3:]) for r in look(want, "total", "top", "low")]
    assert look(spread.positioned(walk, OVER, ranges), "i") == look(align.positioned(walk, OVER), "i")


def test_switches_and_leads(spark, walk):
    rows, over = spread.spread(walk, OVER, 11, 1, 16)
    made = lambda df, o: metrics.with_net_protection(df.withColumns({"r": F.col("close") / 1000 - 0.105, "lead": w.lead_time("s", "t", 4, o), "onset": w.onset("y", o)}), o)
    assert look(spread.core(made(rows, over)), "protection", "lead", "onset") == look(made(walk, OVER), "protection", "lead", "onset")


def test_ranges_by_number_of_rows_and_empty_tables(spark, walk):
    assert asof.ranges_of(0) == 64 and asof.ranges_of(10**9) == 500 and asof.ranges_of(10**12) == 4096
    many = asof.in_ranges(spark.range(200_000).select((F.col("id") * 7 % 200_000).alias("t")), "t", 1000).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_range").collect()
    assert len(many) == 1000 and max(r.n for r in many) < 400 and all(x.b < y.a for x, y in zip(many, many[1:]))
    none, over = spread.spread(walk.limit(0), OVER)
    assert none.count() == 0 and spread.positioned(walk.limit(0), OVER).count() == 0 and over.by == ("k", "_spread")
