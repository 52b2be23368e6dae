"""The registered queries: each operator over its stand-in of the test tables.

``bars``: daily mean price of each return flag (a long panel of three series);
``panel``: nine columns by day; ``orders``: order prices by priority, with gaps.
Outputs are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.bands import band, band_by_rank
from ..functions.scalars import add_business_days_10, row_digest
from ..functions.windows import Over
from ..operators import align, baselines, book, bootstrap, folds, integrity, metrics, ml
from ..operators.features import BOOK_FEATURES, MARKET_FEATURES, SMALL_FEATURES, with_book_features, with_market_features
from ..operators.labels import with_labels, with_returns
from ..sources import panel as panels
from ..sources.snapshots import content_hash, manifest_stats
from . import suites

LONG, WIDE = Over(), Over(by=())
SCAN = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ORDER_CUT = 2.0


def r6(c: Column | str, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bars(spark, d):
    return panels.lineitem_bars(_t(spark, d, "lineitem"))


def raw_panel(spark, d):
    return panels.lineitem_panel(_t(spark, d, "lineitem"))


def panel(spark, d):
    return align.fill_and_drop(raw_panel(spark, d), list(panels.PANEL_COLUMNS), WIDE)


def order_bars(spark, d):
    return panels.order_bars(_t(spark, d, "orders"))


def _window_query(build: Callable[[DataFrame], dict[str, Column]], stages: Callable[[DataFrame], DataFrame] = lambda df: df):
    def q(spark, d):
        df = stages(with_returns(bars(spark, d)))
        made = build(df)
        return df.select("series", "date", *[r6(c, k) for k, c in made.items()])

    return q


def _with_rv(df: DataFrame) -> DataFrame:
    return df.withColumn("rv10", w.volatility("lr", 10, LONG))


def labelled(spark, d):
    return with_labels(bars(spark, d))


def signal_rows(spark, d) -> DataFrame:
    """Labelled rows of each series: y, a score p (volatility rank in [0, 1]), the
    persistence signal s, the forward return r and positions i."""
    df = baselines.with_persistence(labelled(spark, d)).withColumn("r", w.return_ahead("close", 10, LONG))
    df = df.withColumn("p", F.try_divide(F.col("rv_trail"), F.col("rv_trail") + F.col("rv_thresh")))
    df = df.dropna("any", subset=["label", "r", "p"]).select("series", "date", F.col("label").alias("y"), F.col("persistence").alias("s"), "r", "p")
    return align.positioned(df, LONG)


def q_labels(spark, d):
    return labelled(spark, d).select("series", "date", r6("rv_trail"), r6("rv_thresh"), r6("rv_fwd"), r6("mdd_fwd"), "label")


def q_features(spark, d):
    return with_market_features(panel(spark, d)).select("date", *[r6(f) for f in MARKET_FEATURES])


def q_book_features(spark, d):
    book_, market = _book(spark, d)
    return with_book_features(book_.join(market, "date")).select("date", *[r6(f) for f in BOOK_FEATURES])


def q_rolling_beta(spark, d):
    df = panel(spark, d).withColumns({"a": w.log_return("QQQ_close", WIDE), "b": w.log_return("SPY_close", WIDE)})
    return df.select("date", r6(w.rolling_beta("a", "b", 63, WIDE), "beta63"))


def q_panel_build(spark, d):
    return panel(spark, d).select("date", *[r6(c) for c in panels.PANEL_COLUMNS])


def q_wide_panel(spark, d):
    """J1 from the long form: the anchor's dates, filled over three rows."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    wide = align.wide_panel(order_bars(spark, d), "1-URGENT", list(names), ("close",))
    return wide.select("date", *[r6(f"`{k}_close`", v) for k, v in names.items()])


def q_panel_split(spark, d):
    return align.split_by_date(bars(spark, d).select("series", "date")).select("series", "date", "boundary", "part")


def q_clean_suffix(spark, d):
    return align.clean_suffix(order_bars(spark, d), ORDER_CUT).select("series", "date", r6("close"), "cut_date")


def q_dedup_last(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("pos"))
    return align.keep_last(o).select("series", "date", r6("close"), "pos")


def q_clean_bars(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("close"), (F.col("o_orderstatus") == "P").alias("interpolated"))
    return align.clean_bars(o).groupBy("interpolated").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close"), "total"))


def q_calendar_align(spark, d):
    df = align.on_calendar(order_bars(spark, d))
    return df.select("series", "date", r6("close"), r6(w.log_return("close", LONG), "lr"))


def positions(spark, d):
    """Shares and last prices by priority, from the orders."""
    o = _t(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series")).agg(F.count(F.lit(1)).cast("double").alias("shares"), F.max("o_totalprice").alias("price"))


def q_book_weights(spark, d):
    return book.weights(positions(spark, d)).select("series", r6("weight"))


def q_book_index(spark, d):
    return book.book_index(order_bars(spark, d), book.weights(positions(spark, d)), ORDER_CUT).select("date", r6("BOOK_close"), F.col("n_names").cast("long").alias("n_names"))


def q_persistence(spark, d):
    return baselines.with_persistence(bars(spark, d)).select("series", "date", "persistence")


def q_trailing_pctl(spark, d):
    return baselines.with_trailing_pctl(bars(spark, d)).select("series", "date", "trailing_pctl")


def q_term_structure(spark, d):
    return baselines.with_term_structure(raw_panel(spark, d)).select("date", "term_structure")


def q_adaptive(spark, d):
    df = _with_rv(with_returns(bars(spark, d)))
    df = baselines.with_adaptive_signal(df, "rv10", LONG)
    return df.select("series", "date", r6("adaptive_threshold"), "adaptive")


def q_hedge_band(spark, d):
    rows = signal_rows(spark, d).withColumn("b", band(F.col("p")))
    return rows.select("series", "date", r6("p"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def q_hedge_band_rank(spark, d):
    df = _with_rv(with_returns(bars(spark, d))).withColumn("rank126", w.trailing_rank("rv10", 126, LONG)).withColumn("b", band_by_rank(F.col("rank126")))
    return df.select("series", "date", r6("rank126"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def q_folds(spark, d):
    return folds.folds_of(signal_rows(spark, d), ["series"])


def assigned(spark, d):
    rows = signal_rows(spark, d)
    return folds.assign(rows, folds.folds_of(rows, ["series"]).drop("n"), ["series"])


def q_fold_assignment(spark, d):
    return assigned(spark, d).groupBy("series", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("i").alias("first"), F.max("i").alias("last"))


def q_fold_scaler(spark, d):
    s = folds.scaler(assigned(spark, d), ["p", "r"], ["series"])
    return s.select("series", "fold", r6("p_mean"), r6("p_scale"), r6("r_mean"), r6("r_scale"))


def q_auc(spark, d):
    return metrics.auc(signal_rows(spark, d), ["series"]).select("series", r6("auc"))


def q_auc_ties(spark, d):
    return metrics.auc(signal_rows(spark, d), ["series"], "y", "s").select("series", r6("auc"))


def q_brier(spark, d):
    return signal_rows(spark, d).groupBy("series").agg(r6(metrics.brier_of(), "brier"))


def q_confusion(spark, d):
    c = metrics.confusion_of()
    return signal_rows(spark, d).groupBy("series").agg(*[v.alias(k) if k == "n" else r6(v, k) for k, v in c.items()], r6(metrics.effective_n(F.count(F.lit(1))), "n_eff"))


def q_nps(spark, d):
    return metrics.with_net_protection(signal_rows(spark, d), LONG).groupBy("series").agg(r6(metrics.net_protection_of(), "nps"))


def q_lead_times(spark, d):
    x = metrics.lead_times(signal_rows(spark, d), ["series"])
    return x.select("series", "n_onsets", "n_missed", r6("lead_median"), r6("lead_mean"))


def q_threshold_scan(spark, d):
    x = metrics.threshold_scan(signal_rows(spark, d), list(SCAN), ["series"])
    return x.select("series", "thr", r6("nps"), r6("on_frac"), r6("precision"), r6("recall"))


def q_calibration(spark, d):
    return metrics.calibration_bins(signal_rows(spark, d), ["series"]).select("series", "bin", "n", r6("mean_p"), r6("observed"))


def q_evaluate(spark, d):
    """The whole record, its intervals by stepped starts, which SQL can follow."""
    out = metrics.evaluate_strategy(signal_rows(spark, d), ["series"], rule="stepped").withColumn("lead_mean", F.round("lead_mean", 6))
    return out.select("*", *[F.col(f"{m}_ci90")[k].alias(f"{m}_{e}") for m in ("auc", "brier") for k, e in enumerate(("lo", "hi"))]).drop("auc_ci90", "brier_ci90")


def q_staleness(spark, d):
    df = with_market_features(with_labels(panel(spark, d), "SPY_close", WIDE)).where("label IS NOT NULL")
    return integrity.staleness(df, list(SMALL_FEATURES)).select("feature", "lag", r6("auc"))


def q_prefix_invariance(spark, d):
    """Of the rows that are checked, how many of the features' rows change: none."""
    df = align.positioned(panel(spark, d), WIDE)
    changed = integrity.prefix_variances(df, with_market_features, list(MARKET_FEATURES)).groupBy("i").agg(F.count(F.lit(1)).alias("changed"))
    checked = spark.createDataFrame([(at,) for at in integrity.prefix_places(df)], "i long")
    return df.select("i", "date").join(F.broadcast(checked), "i").join(changed, "i", "left").select("i", "date", F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))


def q_series_audit(spark, d):
    used = order_bars(spark, d)
    documented = used.select("series").distinct().where("series <> '5-LOW'")
    return integrity.undocumented(used, documented)


def q_ledger_audit(spark, d):
    ledger = _t(spark, d, "events").select("event_id", F.col("event_type").alias("data_snapshot_hash"))
    allowed = ledger.select("data_snapshot_hash").distinct().where("data_snapshot_hash <> 'view'")
    return integrity.unauthorised_runs(ledger, allowed).groupBy("data_snapshot_hash").agg(F.count(F.lit(1)).alias("runs"))


def q_folds_leak(spark, d):
    return integrity.folds_leak(folds.folds_of(signal_rows(spark, d), ["series"])).select("series", "fold")


def q_resolve_date(spark, d):
    return bars(spark, d).select("date").distinct().select("date", add_business_days_10(F.col("date")).alias("resolves"), F.date_format("date", "yyyy-MM-dd").alias("iso"))


def q_manifest_stats(spark, d):
    return manifest_stats(bars(spark, d))


def q_row_digest(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", row_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("digest"))


def q_content_hash(spark, d):
    return content_hash(_t(spark, d, "nation"))


def q_snapshot_union(spark, d):
    split = align.split_by_date(bars(spark, d))
    both = split.where("part = 'dev'").unionByName(split.where("part = 'holdout'"))
    return both.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"))


def q_bonferroni(spark, d):
    runs = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    m = runs.agg(F.count(F.lit(1)).alias("m"))
    p = _t(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 10000.0).alias("p"))
    return p.join(F.broadcast(m), how="cross").select("n_nationkey", "m", r6(bootstrap.bonferroni(F.col("p"), F.col("m")), "p_adjusted"))  # m is one row


def q_event_series(spark, d):
    """Hourly buckets of events: the same windows over another order column."""
    over = Over("hour", ("event_type",))
    df = _t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("x"))
    return df.select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), r6(w.rolling_mean("x", 24, over), "mean24"), r6(w.below_peak("x", 24, over), "below_peak24"))


def q_tail(spark, d):
    """Without the last ten rows, then the last five of them."""
    return align.last_rows(align.drop_last(panel(spark, d).select("date", "SPY_close"), 10, WIDE), 5).select("date", r6("SPY_close"))


def q_last_values(spark, d):
    return bars(spark, d).withColumn("gap", F.when(F.dayofweek("date") != 6, F.col("close"))).groupBy("series").agg(r6(align.last_value("gap"), "last_close"))


def bootstrap_rows(spark, d):
    return signal_rows(spark, d).select("series", "i", "y", "p", F.col("s").alias("p_base"))


def q_bootstrap_sample(spark, d):
    rows = bootstrap_rows(spark, d)
    starts = bootstrap.starts_of(rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")), ["series"], rule="stepped")
    return bootstrap.metric_auc(bootstrap.resampled_by(rows, starts, ["series"]), ["series", "rep"]).select("series", "rep", r6("value", "auc"))


def q_bootstrap_ci(spark, d):
    return bootstrap.block_bootstrap_ci(bootstrap_rows(spark, d), bootstrap.metric_brier, keys=["series"], rule="stepped").select("series", r6("point"), r6("lo"), r6("hi"), "n_valid")


def q_auc_diff(spark, d):
    return bootstrap.auc_difference(bootstrap_rows(spark, d), keys=["series"], rule="stepped").select("series", r6("auc_diff"), r6("p_raw"), "n_valid")


def model_frame(spark, d):
    rows = signal_rows(spark, d)
    df = labelled(spark, d).join(rows.select("series", "date", "i", "y"), ["series", "date"]).select("series", "date", "i", "y", "rv_trail", "rv_thresh")
    return folds.assign(df, folds.folds_of(df, ["series"]).drop("n"), ["series"])


def q_logistic(spark, d):
    return ml.walk_forward(model_frame(spark, d), ["rv_trail", "rv_thresh"], ["series"], "logistic").select("series", "fold", "i", r6("prob"))


def q_gbm(spark, d):
    return ml.walk_forward(model_frame(spark, d), ["rv_trail", "rv_thresh"], ["series"], "gbm").select("series", "fold", "i", r6("prob"))


def q_walk_forward_suite(spark, d):
    return suites.walk_forward_suite(panel(spark, d))


def q_holdout_suite(spark, d):
    return suites.holdout_suite(panel(spark, d))


def q_adaptive_suite(spark, d):
    return suites.adaptive_suite(panel(spark, d))


def _book(spark, d):
    p = panel(spark, d)
    return p.select("date", F.col("QQQ_close").alias("BOOK_close")), p


def q_book_suite(spark, d):
    return suites.book_suite(*_book(spark, d))


def q_live_market(spark, d):
    return suites.live_market_row(panel(spark, d))


def q_live_book(spark, d):
    return suites.live_book_row(*_book(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_returns": _window_query(lambda df: {"lr": F.col("lr")}),
    "rv_trailing": _window_query(lambda df: {f"rv{n}": w.volatility("lr", n, LONG) for n in (10, 21, 63)}),
    "rv_forward": _window_query(lambda df: {"rv_fwd": w.volatility_ahead("lr", 10, LONG)}),
    "fwd_max_drawdown": _window_query(lambda df: {"mdd_fwd": w.drawdown_ahead("close", 10, LONG)}),
    "rv_threshold": _window_query(lambda df: {"q75": w.rolling_quantile("rv10", 0.75, 252, LONG), "q60": w.rolling_quantile("rv10", 0.60, 252, LONG)}, _with_rv),
    "lags_and_changes": _window_query(lambda df: {"lag1": w.lagged("close", 1, LONG), "lag5": w.lagged("close", 5, LONG), "diff5": w.difference("close", 5, LONG), "chg1": w.change("close", 1, LONG), "chg21": w.change("close", 21, LONG)}),
    "return_ahead": _window_query(lambda df: {"r10": w.return_ahead("close", 10, LONG)}),
    "vol_of_vol": _window_query(lambda df: {"volofvol21": w.rolling_deviation("chg", 21, LONG)}, lambda df: _with_rv(df).withColumn("chg", w.change("rv10", 1, LONG))),
    "rolling_mean": _window_query(lambda df: {"mean5": w.rolling_mean(F.try_divide(F.col("high") - F.col("low"), F.col("close")), 5, LONG)}),
    "below_peak": _window_query(lambda df: {"dd63": w.below_peak("close", 63, LONG)}),
    "rolling_skew": _window_query(lambda df: {"skew63": w.rolling_skew("lr", 63, LONG)}),
    "trailing_rank": _window_query(lambda df: {"rank126": w.trailing_rank("rv10", 126, LONG)}, _with_rv),
    "index_level": _window_query(lambda df: {"level": w.index_level("lr", 100.0, LONG)}),
    "labels": q_labels, "features": q_features, "book_features": q_book_features, "rolling_beta": q_rolling_beta,
    "panel_build": q_panel_build, "wide_panel": q_wide_panel, "panel_split": q_panel_split, "clean_suffix": q_clean_suffix, "dedup_last": q_dedup_last, "clean_bars": q_clean_bars,
    "calendar_align": q_calendar_align, "book_weights": q_book_weights, "book_index": q_book_index,
    "baseline_persistence": q_persistence, "baseline_trailing_pctl": q_trailing_pctl, "baseline_term_structure": q_term_structure, "adaptive_signal": q_adaptive,
    "hedge_band": q_hedge_band, "hedge_band_rank": q_hedge_band_rank,
    "walk_forward_folds": q_folds, "fold_assignment": q_fold_assignment, "fold_scaler": q_fold_scaler,
    "auc": q_auc, "auc_ties": q_auc_ties, "brier": q_brier, "confusion": q_confusion, "nps": q_nps, "lead_times": q_lead_times, "threshold_scan": q_threshold_scan, "calibration_bins": q_calibration,
    "evaluate_strategy": q_evaluate, "staleness_auc": q_staleness, "prefix_invariance": q_prefix_invariance, "series_audit": q_series_audit, "ledger_audit": q_ledger_audit, "folds_leak": q_folds_leak,
    "label_resolve_date": q_resolve_date, "manifest_stats": q_manifest_stats, "row_digest": q_row_digest, "content_hash": q_content_hash, "snapshot_union": q_snapshot_union, "bonferroni": q_bonferroni,
    "event_series": q_event_series, "tail_rows": q_tail, "last_values": q_last_values,
    "bootstrap_sample": q_bootstrap_sample, "bootstrap_ci": q_bootstrap_ci, "auc_diff": q_auc_diff,
    "logistic_walk_forward": q_logistic, "gbm_walk_forward": q_gbm, "walk_forward_suite": q_walk_forward_suite, "holdout_suite": q_holdout_suite, "adaptive_suite": q_adaptive_suite,
    "book_suite": q_book_suite, "live_market_row": q_live_market, "live_book_row": q_live_book,
}
