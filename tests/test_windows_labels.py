import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import windows as w
from tidewatch.functions.windows import Over
from tidewatch.operators import baselines
from tidewatch.operators.labels import with_labels, with_returns

OVER = Over()


def prices(spark, values, series="X", start="2015-01-01"):
    days = pd.bdate_range(start, periods=len(values))
    rows = [(series, d.date(), None if v is None else float(v)) for d, v in zip(days, values, strict=True)]
    return spark.createDataFrame(rows, "series string, date date, close double")


def walk(returns):
    return 100 * np.exp(np.cumsum(returns))


def frame(df):
    return df.toPandas().sort_values(["series", "date"]).reset_index(drop=True)


def test_forward_sees_what_trailing_does_not(spark):
    rng = np.random.default_rng(0)
    got = frame(with_labels(prices(spark, walk(np.where(np.arange(300) < 200, 0.0, rng.normal(0, 0.03, 300))))))
    assert got.rv_fwd[195] > 0.1 and got.rv_trail[195] < 0.01 and got.rv_trail[215] > 0.1


def test_forward_tail_is_missing(spark):
    got = frame(with_labels(prices(spark, np.linspace(100, 110, 60))))
    assert got.rv_fwd[-10:].isna().all() and got.rv_fwd[1:50].notna().all()


def test_drawdown_by_hand(spark):
    got = frame(with_labels(prices(spark, [100] * 20 + [98, 96, 94, 92, 90] + [90] * 20)))
    assert got.mdd_fwd[19] == pytest.approx(-0.10) and got.mdd_fwd[30] == 0.0 and np.isnan(got.mdd_fwd[40])


def test_threshold_does_not_see_the_future(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 600)
    other = r.copy()
    other[401:] = rng.normal(0, 0.05, 199)
    a, b = (frame(with_labels(prices(spark, walk(x)))) for x in (r, other))
    assert a.rv_thresh[400] == b.rv_thresh[400] and not np.isnan(a.rv_thresh[400])


def test_label_rate_of_a_gaussian_walk(spark):
    got = frame(with_labels(prices(spark, walk(np.random.default_rng(2).normal(0, 0.01, 1500)))))
    assert 0.10 < got.label.mean() < 0.45


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(5)
    values = list(walk(rng.normal(0, 0.02, 200)))
    values[50] = None
    df = with_returns(prices(spark, values))
    df = df.withColumn("rv", w.volatility("lr", 10, OVER))
    got = frame(df.select("series", "date", "lr", "rv", w.rolling_skew("lr", 63, OVER).alias("skew"), w.below_peak("close", 63, OVER).alias("dd"), w.rolling_quantile("lr", 0.7, 126, OVER, 60).alias("q"), w.filled("close", 3, OVER).alias("f"),
                              w.rolling_deviation("lr", 21, OVER).alias("sd"), w.change("close", 5, OVER).alias("c5"), w.switches(F.when(F.col("lr") > 0, 1.0).otherwise(0.0), OVER).alias("sw")))
    p = pd.Series(values, dtype=float)
    lr = np.log(p).diff()
    want = {"lr": lr, "rv": lr.rolling(10).std(ddof=0) * 252**0.5, "skew": lr.rolling(63).skew(), "dd": p / p.rolling(63).max() - 1, "q": lr.rolling(126, min_periods=60).quantile(0.7), "f": p.ffill(limit=3), "sd": lr.rolling(21).std(), "c5": p / p.shift(5) - 1}
    for k, v in want.items():
        np.testing.assert_allclose(got[k].to_numpy(float), v.to_numpy(float), atol=1e-10, err_msg=k)
    on = (lr > 0).astype(float)
    np.testing.assert_allclose(got.sw, on.diff().abs().fillna(0))


def test_fill_limit(spark):
    got = frame(prices(spark, [1.0, None, None, None, None, 2.0]).withColumn("f", w.filled("close", 3, OVER)))
    assert got.f.tolist()[:4] == [1.0] * 4 and np.isnan(got.f[4]) and got.f[5] == 2.0


def test_beta_and_trailing_rank(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, 150), rng.normal(0, 1, 150)
    days = pd.bdate_range("2020-01-01", periods=150)
    df = spark.createDataFrame([("X", d.date(), float(a), float(b)) for d, a, b in zip(days, x, y, strict=True)], "series string, date date, x double, y double")
    got = frame(df.select("series", "date", w.rolling_beta("y", "x", 63, OVER).alias("beta"), w.trailing_rank("x", 126, OVER).alias("rank")))
    sx, sy = pd.Series(x), pd.Series(y)
    np.testing.assert_allclose(got.beta, sy.rolling(63).cov(sx) / sx.rolling(63).var(), atol=1e-10)
    assert got["rank"][:126].isna().all() and got["rank"][140] == pytest.approx((x[14:140] <= x[140]).mean())


def test_series_do_not_mix_and_empty_tables_work(spark):
    both = prices(spark, walk(np.full(30, 0.01)), "A").unionByName(prices(spark, walk(np.full(30, -0.01)), "B"))
    got = frame(with_returns(both))
    assert np.isnan(got.lr[0]) and np.isnan(got.lr[30])
    assert with_labels(both.limit(0)).count() == 0


def test_rules_are_off_where_inputs_miss(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 2.0, 2.0), (dt.date(2020, 1, 2), 1.0, 2.0), (dt.date(2020, 1, 3), None, 2.0)], "date date, VIX_close double, VIX3M_close double")
    assert [r.term_structure for r in baselines.with_term_structure(df).orderBy("date").collect()] == [1.0, 0.0, 0.0]
    flat = baselines.with_persistence(prices(spark, [100.0] * 20))
    assert {r.persistence for r in flat.collect()} == {0.0}
