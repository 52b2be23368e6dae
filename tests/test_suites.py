"""Whole evaluations on a synthetic panel, against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import bands
from tidewatch.plans import suites
from tidewatch.sources.panel import PANEL_COLUMNS

DAYS = 600


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(21)
    days = [d for k in range(DAYS * 2) if (d := dt.date(2019, 1, 1) + dt.timedelta(days=k)).weekday() < 5][:DAYS]
    vol = 0.006 + 0.02 * (np.sin(np.arange(DAYS) / 17) > 0.6)
    spy = 100 * np.exp(np.cumsum(rng.normal(0, 1, DAYS) * vol))
    other = [50 * np.exp(np.cumsum(rng.normal(0, 0.01, DAYS))) for _ in range(4)]
    vix, vix3 = 12 + 600 * vol + rng.normal(0, 1, DAYS), 18 + rng.normal(0, 1, DAYS)
    columns = [spy, spy * 1.01, spy * 0.99, *other, vix, vix3]
    rows = [(d, *(float(c[k]) for c in columns)) for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in PANEL_COLUMNS)).cache()
    df.count()
    return df


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else None


def plain_record(rows):
    """The record of one strategy from its rows in order."""
    y, p, s, r = (rows[c].to_numpy(float) for c in "ypsr")
    turns = np.abs(np.diff(s, prepend=s[0]))
    daily = s * np.maximum(0, -r) * 0.5 / 10 - 0.0002 * s - 0.001 * turns
    hit = (y * s).sum()
    return {
        "n": len(y), "base_rate": y.mean(), "hedge_on_frac": s.mean(), "brier": ((p - y) ** 2).mean(), "precision": hit / s.sum() if s.sum() else 0.0, "recall": hit / y.sum() if y.sum() else 0.0,
        "nps": 252 * daily.mean(), "auc": brute_auc(y, p),
    }


def same(record, want):
    for k, v in want.items():
        assert record[k] == pytest.approx(v, abs=6e-5) if v is not None else record[k] is None, k


def test_walk_forward_suite(spark, panel):
    got = {r.name: r for r in suites.walk_forward_suite(panel, runs=7).collect()}
    assert set(got) == {"persistence", "term_structure", "trailing_pctl", "logistic", "gbm"} and len({r.n for r in got.values()}) == 1
    rules = suites.baseline_rows(suites.market_dataset(panel)).toPandas()
    for name, rows in rules.groupby("name"):
        same(got[name], plain_record(rows.sort_values("i")))
        assert got[name].p_raw is None and got[name].brier_ci90[0] <= got[name].brier <= got[name].brier_ci90[1]
    for name in ("logistic", "gbm"):
        assert got[name].p_bonferroni == pytest.approx(min(1.0, 7 * got[name].p_raw)) and got[name].auc_ci90[0] <= got[name].auc_ci90[1]


def test_holdout_suite_trains_on_the_past_alone(spark, panel):
    got = {r.name: r for r in suites.holdout_suite(panel, "logistic").collect()}
    rows = suites.holdout_rows(panel, "logistic").toPandas()
    edge = panel.orderBy(F.desc("date")).limit(251).agg(F.min("date")).head()[0]
    assert rows.date.min() > edge and set(got) == set(rows.name)
    for name, own in rows.groupby("name"):
        same(got[name], plain_record(own.sort_values("i")))
    model = rows[rows.name == "logistic_small4_frozen"].sort_values("i")
    garbled = panel.withColumn("SPY_close", F.when(F.col("date") > F.lit(str(rows.date.max())), 1.0).otherwise(F.col("SPY_close")))
    again = suites.holdout_rows(garbled, "logistic").where("name = 'logistic_small4_frozen'").toPandas().sort_values("i")
    both = model.merge(again, on="date")
    assert len(both) > 100 and np.allclose(both.p_x, both.p_y)


def test_adaptive_and_book_suites(spark, panel):
    got = {r.name: r for r in suites.adaptive_suite(panel).collect()}
    assert set(got) == {"persistence", "logistic_small4_adaptive", "gbm_small4_adaptive"}
    assert all(got[k].p_bonferroni == pytest.approx(min(1.0, 3 * got[k].p_raw)) for k in got if k != "persistence")
    book = panel.select("date", F.col("QQQ_close").alias("BOOK_close"))
    got = {r.name: r for r in suites.book_suite(book, panel).collect()}
    rows = suites.baseline_rows(suites.book_dataset(book, panel), "BOOK_close", names=("persistence",)).toPandas()
    assert set(got) == {"book_persistence", "book_logistic_adaptive"}
    same(got["book_persistence"], plain_record(rows.sort_values("i")))


def test_live_rows(spark, panel):
    last = panel.agg(F.max("date")).head()[0]
    later, left = last, 10
    while left:
        later += dt.timedelta(days=1)
        left -= later.weekday() < 5
    row = suites.live_market_row(panel, "logistic").head()
    assert row.asof == last.isoformat() and row.label_resolves_after == later and 0 <= row.prob <= 1 and row.signal == int(row["rank"] >= 0.70)
    lo_hi = spark.range(1).select(bands.band_by_rank(F.lit(row["rank"])).alias("b")).head().b
    assert (row.band_lo, row.band_hi) == (lo_hi.lo, lo_hi.hi)
    book = panel.select("date", F.col("QQQ_close").alias("BOOK_close"))
    row = suites.live_book_row(book, panel).head()
    close = np.array([r.BOOK_close for r in book.orderBy("date").collect()])
    rv = np.array([np.std(np.diff(np.log(close[k - 10 : k + 1]))) * np.sqrt(252) for k in range(10, DAYS)])
    assert row.book_rv10_ann == pytest.approx(rv[-1], abs=6e-5) and row.book_regime_thresh == pytest.approx(np.quantile(rv[-252:], 0.75), abs=6e-5)
    assert row.in_regime == (rv[-1] > np.quantile(rv[-252:], 0.75)) and row.signal == int(row.in_regime) and row.label_resolves_after == later
    assert row.spy_hedge_notional_per_100k_book == pytest.approx(1e5 * (row.band_lo + row.band_hi) / 2 * row.book_beta63_vs_spy, abs=400)


def test_a_suite_is_logged_then_counted_then_adjusted(spark, tmp_path):
    from tidewatch.plans import runs
    from tidewatch.sources import ledger

    rows = [("m", 50, 0.7, 0.12, 0.004, 7), ("r", 50, 0.6, None, None, 3)]
    records = spark.createDataFrame([(n, k, a, d, p, k / 10, 0.01, 3, 1, 2.0, 2.5, v) for n, k, a, d, p, v in rows], "name string, n long, auc double, auc_diff double, p_raw double, n_eff double, nps double, n_onsets long, n_missed long, lead_median double, lead_mean double, n_valid long")
    path = str(tmp_path / "runs.jsonl")
    for k in range(4):
        ledger.log_run(spark, path, {"k": k}, {}, seed=1, data_snapshot_hash="h")
    got = runs.logged(records, path, {"suite": "x"}, seed=3, data_snapshot_hash="h")
    assert ledger.run_count(spark, path) == 6
    assert got["m"] | {"run_count_M": 6, "p_bonferroni": 0.024, "skill_claimed": True, "auc_minus_persistence": 0.12, "effective_n": 5.0, "lead_median_lead_days": 2.0} == got["m"]
    assert "run_count_M" not in got["r"] and "p_raw_vs_persistence" not in got["r"] and got["r"]["n_rows"] == 50
    assert runs.logged(records, path, {"suite": "x"}, seed=3, data_snapshot_hash="h")["m"]["run_count_M"] == 8
