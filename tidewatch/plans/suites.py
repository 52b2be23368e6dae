"""Whole evaluations: walk-forward, frozen holdout, portfolio, live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.bands import band_by_rank
from ..functions.scalars import add_business_days_10
from ..functions.windows import Over
from ..operators import align, baselines, bootstrap, folds, metrics, ml
from ..operators.features import BOOK_FEATURES, MARKET_FEATURES, SMALL_FEATURES, with_book_features, with_market_features
from ..operators.labels import HORIZON, with_labels

PANEL = Over(by=())
SEED = 20260813
FROZEN_THRESHOLD = 0.20
#: Book rows in and out of the regime use the rank of the top and of the lowest band.
RANK_IN, RANK_OUT = 0.75, 0.0


def _positioned(df: DataFrame, over: Over = PANEL) -> DataFrame:
    return align.positioned(df, over)


def market_dataset(panel: DataFrame) -> DataFrame:
    """Labels, features and forward returns, complete rows only, with ``i``."""
    df = with_market_features(with_labels(panel, "SPY_close", PANEL)).withColumn("r", w.return_ahead("SPY_close", HORIZON, PANEL))
    return _positioned(df.dropna("any", subset=["label", "rv_trail", "rv_thresh", "rv_fwd", "mdd_fwd", "r", *MARKET_FEATURES]).withColumnRenamed("label", "y"))


def book_dataset(book: DataFrame, market: DataFrame) -> DataFrame:
    df = with_labels(book.join(market, "date"), "BOOK_close", PANEL)
    df = with_book_features(df).withColumn("r", w.return_ahead("BOOK_close", HORIZON, PANEL))
    return _positioned(df.dropna("any", subset=["label", "rv_trail", "rv_thresh", "rv_fwd", "mdd_fwd", "r", *BOOK_FEATURES]).withColumnRenamed("label", "y"))


def book_only_dataset(book: DataFrame) -> DataFrame:
    """The same without market columns (persistence needs none)."""
    df = with_labels(book, "BOOK_close", PANEL).withColumn("r", w.return_ahead("BOOK_close", HORIZON, PANEL))
    return _positioned(df.dropna("any", subset=["label", "r"]).withColumnRenamed("label", "y"))


def baseline_rows(dataset: DataFrame, price: str = "SPY_close", warmup: str = "eval", names: tuple[str, ...] = ("persistence", "term_structure", "trailing_pctl")) -> DataFrame:
    """Test rows (from position 150 on) with the rule signals, long by ``name``.

    ``warmup='eval'`` runs the rules over the complete rows alone, so they warm up
    a second time and are off until then, as published evaluations did;
    ``'panel'`` expects the signals as columns of the dataset already.
    """
    df = dataset
    if warmup == "eval":
        df = baselines.with_trailing_pctl(baselines.with_persistence(df, price, PANEL), price, PANEL)
        if "term_structure" in names:
            df = baselines.with_term_structure(df)
    test = df.where(F.col("i") >= folds.MIN_TRAIN)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("s")) for n in names])).alias("e")
    return test.select("i", "date", "y", "r", each).select("i", "date", "y", "r", "e.name", "e.s", F.col("e.s").alias("p"))


def model_rows(dataset: DataFrame, features: list[str], kind: str, threshold: float | None = 0.5, name: str | None = None) -> DataFrame:
    """Out-of-sample rows of one model.  ``threshold`` None: the adaptive signal."""
    spark = dataset.sparkSession
    ranges = folds.purged_folds(spark, dataset.count())
    probs = ml.walk_forward(folds.assign(dataset, ranges, []), list(features), [], kind)
    rows = dataset.select("i", "date", "y", "r").join(probs.select("i", F.col("prob").alias("p")), "i")
    if threshold is None:
        rows = baselines.with_adaptive_signal(rows, "p", Over("i", ()), "s").drop("s_threshold")
    else:
        rows = rows.withColumn("s", (F.col("p") >= threshold).cast("double"))
    return rows.withColumn("name", F.lit(name or kind))


def with_model_tests(rows: DataFrame, models: list[str], rule: str, runs: int | None = None) -> DataFrame:
    """The metric records of ``rows`` by name, and for each model the columns of
    :func:`model_against_rule` (NULL for rules).  ``runs`` counts the runs to
    adjust for: those logged so far, or else the suite's own strategies."""
    records = metrics.evaluate_strategy(rows, ["name"], seed=SEED)
    runs = runs or rows.select("name").distinct().count()
    tests = model_against_rule(rows.where(F.col("name").isin(models)), rows.where(F.col("name") == rule), runs)
    return records.join(tests, "name", "left")


COLUMNS = ["i", "date", "y", "r", "name", "s", "p"]


def _made(records: DataFrame, *cached: DataFrame) -> DataFrame:
    """The records of a suite, one row for each strategy, worked out; what was
    cached for them is released."""
    rows, spark = records.collect(), records.sparkSession
    for df in cached:
        df.unpersist()
    return spark.createDataFrame(rows, records.schema)


def walk_forward_suite(panel: DataFrame, runs: int | None = None) -> DataFrame:
    """One metric record for each of three rules and two models."""
    data = market_dataset(panel).cache()
    rows = baseline_rows(data).select(COLUMNS)
    for kind in ("logistic", "gbm"):
        rows = rows.unionByName(model_rows(data, list(MARKET_FEATURES), kind).select(COLUMNS))
    rows = rows.cache()
    return _made(with_model_tests(rows, ["logistic", "gbm"], "persistence", runs), rows, data)


def adaptive_suite(panel: DataFrame, runs: int | None = None) -> DataFrame:
    """Small-feature models with the adaptive signal, against persistence."""
    data = market_dataset(panel).cache()
    names = [f"{k}_small4_adaptive" for k in ("logistic", "gbm")]
    rows = baseline_rows(data, names=("persistence",)).select(COLUMNS)
    for kind, name in zip(("logistic", "gbm"), names, strict=True):
        rows = rows.unionByName(model_rows(data, list(SMALL_FEATURES), kind, None, name).select(COLUMNS))
    rows = rows.cache()
    return _made(with_model_tests(rows, names, "persistence", runs), rows, data)


def holdout_rows(panel: DataFrame, kind: str = "gbm", tail: int = 251) -> DataFrame:
    """A model frozen on the rows up to the ``tail``-th last date, scored after.

    Training labels are made from training rows alone, so their last ones are
    missing and purge the edge; ten more rows go.  Rules run on the whole panel.
    """
    edge = align.last_rows(panel.select("date"), tail).agg(F.min("date").alias("edge"))
    before = panel.join(F.broadcast(edge), F.col("date") <= F.col("edge"), "left_semi")
    complete = ["label", *SMALL_FEATURES]
    train = with_market_features(with_labels(before, "SPY_close", PANEL)).dropna("any", subset=complete)
    train = _positioned(align.drop_last(train, folds.EMBARGO, PANEL).withColumnRenamed("label", "y"))
    whole = baselines.with_term_structure(baselines.with_trailing_pctl(baselines.with_persistence(panel, "SPY_close", PANEL), "SPY_close", PANEL))
    whole = with_market_features(with_labels(whole, "SPY_close", PANEL)).withColumn("r", w.return_ahead("SPY_close", HORIZON, PANEL))
    after = _positioned(whole.join(F.broadcast(edge), F.col("date") > F.col("edge"), "left_semi").dropna("any", subset=[*complete, "r"]).withColumnRenamed("label", "y"))
    model = after.join(ml.frozen(train, after, list(SMALL_FEATURES), kind), "i").withColumn("p", F.col("prob")).withColumn("s", (F.col("p") >= FROZEN_THRESHOLD).cast("double")).withColumn("name", F.lit(f"{kind}_small4_frozen"))
    rules = [after.withColumns({"name": F.lit(n), "s": F.col(n), "p": F.col(n)}).select(COLUMNS) for n in ("persistence", "term_structure", "trailing_pctl")]
    out = model.select(COLUMNS)
    for r in rules:
        out = out.unionByName(r)
    return out


def holdout_suite(panel: DataFrame, kind: str = "gbm", runs: int | None = None) -> DataFrame:
    """The frozen model and three rules on the rows after the boundary."""
    rows = holdout_rows(panel, kind).cache()
    return _made(with_model_tests(rows, [f"{kind}_small4_frozen"], "persistence", runs), rows)


def book_suite(book: DataFrame, market: DataFrame, runs: int | None = None) -> DataFrame:
    """Persistence and the adaptive logistic model on a portfolio."""
    data = book_dataset(book, market).cache()
    rule = baseline_rows(data, "BOOK_close", names=("persistence",)).withColumn("name", F.lit("book_persistence")).select(COLUMNS)
    model = model_rows(data, list(BOOK_FEATURES), "logistic", None, "book_logistic_adaptive").select(COLUMNS)
    rows = rule.unionByName(model).cache()
    return _made(with_model_tests(rows, ["book_logistic_adaptive"], "book_persistence", runs), rows, data)


def model_against_rule(models: DataFrame, rule: DataFrame, runs: int, n_boot: int = bootstrap.N_BOOT, seed: int = SEED) -> DataFrame:
    """``name, auc_diff, p_raw, n_valid, p_bonferroni, skill_claimed`` of each of
    the ``models`` on its rows in common with the rule, all in one plan."""
    both = models.select("name", "i", "y", "p").join(rule.select("i", F.col("p").alias("p_base")), "i")
    out = bootstrap.auc_difference(both, n_boot=n_boot, seed=seed, keys=["name"])
    p = bootstrap.bonferroni(F.col("p_raw"), runs)
    return out.withColumn("p_bonferroni", p).withColumn("skill_claimed", p < bootstrap.SKILL)


def scored_tail(df: DataFrame, features: list[str], kind: str, label: str, n: int = baselines.RANK_WINDOW + 1) -> DataFrame:
    """The last n feature-complete rows scored by a model fitted on all labelled
    rows; ``prob`` beside them."""
    train = _positioned(df.dropna("any", subset=[label, *features]).withColumnRenamed(label, "y"))
    tail = _positioned(align.last_rows(df.dropna("any", subset=features), n).drop("i"))
    return tail.join(ml.frozen(train, tail, features, kind), "i")


def live_market_row(panel: DataFrame, kind: str = "gbm") -> DataFrame:
    """Today's prediction: probability, its rank among the last 126, signal, band."""
    df = with_market_features(with_labels(panel, "SPY_close", PANEL))
    scored = scored_tail(df, list(SMALL_FEATURES), kind, "label").select("i", "date", "prob").withColumn("rank", w.trailing_rank("prob", baselines.RANK_WINDOW, Over("i", ())))
    last = align.last_rows(scored, 1)
    b = band_by_rank(F.col("rank"))
    return last.select(
        F.date_format("date", "yyyy-MM-dd").alias("asof"), F.round("prob", 4).alias("prob"), F.round("rank", 4).alias("rank"), (F.col("rank") >= 0.70).cast("int").alias("signal"),
        b["lo"].alias("band_lo"), b["hi"].alias("band_hi"), add_business_days_10(F.col("date")).alias("label_resolves_after"),
    )


def live_book_row(book: DataFrame, market: DataFrame) -> DataFrame:
    """Today's row for a portfolio: persistence decides, the model is shown only;
    the hedge is the band's middle times beta for 100,000 of the portfolio."""
    df = with_book_features(with_labels(book.join(market, "date"), "BOOK_close", PANEL))
    scored = scored_tail(df, list(BOOK_FEATURES), "logistic", "label").select("i", "date", "prob").withColumn("rank", w.trailing_rank("prob", baselines.RANK_WINDOW, Over("i", ())))
    shown = align.last_rows(scored, 1).select("date", "prob", "rank")
    state = df.agg(align.last_value("rv_trail").alias("rv10"), align.last_value("rv_thresh").alias("thresh"), align.last_value("beta63").alias("beta63"))
    regime = F.col("rv10") > F.col("thresh")
    both = shown.join(F.broadcast(state), how="cross").withColumn("in_regime", regime)  # one row each
    b = band_by_rank(F.when(F.col("in_regime"), RANK_IN).otherwise(RANK_OUT))
    return both.select(
        F.date_format("date", "yyyy-MM-dd").alias("asof"), "in_regime", F.col("in_regime").cast("int").alias("signal"), b["lo"].alias("band_lo"), b["hi"].alias("band_hi"),
        F.round("prob", 4).alias("model_prob_diagnostic"), F.round("rank", 4).alias("model_rank_diagnostic"), F.round("rv10", 4).alias("book_rv10_ann"), F.round("thresh", 4).alias("book_regime_thresh"),
        F.round("beta63", 2).alias("book_beta63_vs_spy"), F.bround(F.lit(1e5) * (b["lo"] + b["hi"]) / 2 * F.col("beta63")).cast("long").alias("spy_hedge_notional_per_100k_book"),
        add_business_days_10(F.col("date")).alias("label_resolves_after"),
    )


