"""Metrics of probabilities and signals; each takes grouping keys.

Inputs have one row per (key, position): ``y`` the label, ``p`` a score, ``s`` a
0/1 signal, ``r`` a forward return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w
from ..functions.windows import ANNUAL_DAYS, Over

#: Daily cost of a hedge, cost of a switch, share of a fall that a hedge captures.
BLEED, SWITCH, CAPTURE = 0.0002, 0.0010, 0.5
HORIZON, LOOKBACK = 10, 10
RANGES = 1000


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys)


def auc(df: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """``keys, auc``: rank statistic with mid-ranks for ties; NULL for one class.

    Rows are first counted for each distinct score, so the ranking sorts distinct
    scores only.  Without keys these are ranked in ``RANGES`` ranges of equal width
    side by side, each after the sum of those below it.
    """
    keys = keys or []
    each = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = lambda within, order: F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if keys:
        ranked = each.withColumn("mid", before(keys, p) + (F.col("n") + 1) / 2)
    else:
        ends = df.agg(F.min(p).alias("_least"), F.max(p).alias("_most"))  # one row
        width = (F.col("_most") - F.col("_least")).cast("double")
        place = F.floor((F.col(p) - F.col("_least")) / width * RANGES).cast("int")
        placed = each.join(F.broadcast(ends), how="cross").withColumn("_range", F.when((width > 0) & (width < float("inf")), place).otherwise(0))
        sums = placed.groupBy("_range").agg(F.sum("n").alias("n"))
        base = sums.select("_range", before([], "_range").alias("_base"))  # RANGES rows at most
        ranked = placed.join(F.broadcast(base), "_range").withColumn("mid", F.col("_base") + before(["_range"], p) + (F.col("n") + 1) / 2)
    sums = _by(ranked, keys).agg(F.sum(F.col("pos") * F.col("mid")).alias("ranks"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return sums.select(*keys, F.when((n1 > 0) & (n0 > 0), (F.col("ranks") - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"))


def brier_of(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def confusion_of(y: str = "y", s: str = "s") -> dict[str, Column]:
    """Aggregates: precision and recall (0 where undefined), and shares of rows."""
    hit = F.sum((F.col(y) * F.col(s)).cast("double"))
    missed = F.avg(((F.col(s) == 0) & (F.col(y) == 1)).cast("double"))
    return {
        "precision": F.coalesce(F.try_divide(hit, F.sum(s)), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(hit, F.sum(y)), F.lit(0.0)),
        "false_negative_rate": missed / F.greatest(F.avg(y), F.lit(1e-9)),
        "false_positive_days_frac": F.avg(((F.col(s) == 1) & (F.col(y) == 0)).cast("double")),
        "base_rate": F.avg(y),
        "hedge_on_frac": F.avg(s),
        "n": F.count(F.lit(1)),
    }


def with_net_protection(df: DataFrame, over: Over, s: str = "s", r: str = "r", name: str = "protection") -> DataFrame:
    """The daily net protection of a signal; its mean times 252 is the score."""
    gain = F.col(s) * F.greatest(F.lit(0.0), -F.col(r)) * CAPTURE / HORIZON
    daily = F.when(F.col(r).isNotNull(), gain) - BLEED * F.col(s) - SWITCH * w.switches(s, over)
    return df.withColumn(name, daily)


def net_protection_of(name: str = "protection") -> Column:
    return F.avg(name) * ANNUAL_DAYS


def lead_times(df: DataFrame, keys: list[str] | None = None, order: str = "i", y: str = "y", s: str = "s", lookback: int = LOOKBACK) -> DataFrame:
    """``keys, n_onsets, n_missed, lead_median, lead_mean``: for each onset of
    the label, how long the signal had been on (at most ``lookback``)."""
    keys = keys or []
    over = Over(order, tuple(keys))
    at = df.withColumn("_lead", w.lead_time(s, order, lookback, over)).withColumn("_onset", F.coalesce(w.onset(y, over), F.lit(False)))
    lead = F.when(F.col("_onset"), F.col("_lead"))
    return _by(at, keys).agg(
        F.count_if("_onset").alias("n_onsets"), F.count_if(F.col("_onset") & F.col("_lead").isNull()).alias("n_missed"), F.percentile(lead, F.lit(0.5)).alias("lead_median"), F.avg(lead).alias("lead_mean")
    )


def effective_n(n: Column, horizon: int = HORIZON) -> Column:
    return n / F.lit(float(horizon))


def evaluate_strategy(df: DataFrame, keys: list[str] | None = None, order: str = "i", seed: int = 0, rule: str = "drawn") -> DataFrame:
    """One row for each key: the whole metric record, rounded (4 places; net
    protection 5; effective n 1).  Columns y, p, s, r as above.  The 90 %
    intervals auc_ci90 and brier_ci90 are of N_BOOT block bootstrap replicates,
    their starts made by ``rule``."""
    from .bootstrap import intervals_by_key  # which needs this module

    keys = keys or []
    over = Over(order, tuple(keys))
    scored = with_net_protection(df, over)
    plain = {k: F.round(v, 4) if k != "n" else v for k, v in confusion_of().items()}
    out = _by(scored, keys).agg(*[v.alias(k) for k, v in plain.items()], F.round(brier_of(), 4).alias("brier"), F.round(net_protection_of(), 5).alias("nps"), F.round(effective_n(F.count(F.lit(1))), 1).alias("n_eff"))
    a, t = auc(df, keys).withColumn("auc", F.round("auc", 4)), lead_times(df, keys, order)
    ends = lambda m: F.array(F.round(f"{m}_lo", 4), F.round(f"{m}_hi", 4)).alias(f"{m}_ci90")
    ci = intervals_by_key(df, keys, seed=seed, order=order, rule=rule).select(*keys, ends("auc"), ends("brier"))
    if keys:
        return out.join(a, keys, "left").join(t, keys, "left").join(ci, keys, "left")
    return out.join(F.broadcast(a), how="cross").join(F.broadcast(t), how="cross").join(F.broadcast(ci), how="cross")  # one row each


def calibration_bins(df: DataFrame, keys: list[str] | None = None, bins: int = 3) -> DataFrame:
    """``keys, bin, n, mean_p, observed`` over equal-width bins of [0, 1]."""
    keys = keys or []
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


def threshold_scan(df: DataFrame, thresholds: list[float], keys: list[str] | None = None, order: str = "i") -> DataFrame:
    """``thr, nps, on_frac, precision, recall`` for each threshold on p."""
    keys = keys or []
    each = df.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn("s", (F.col("p") >= F.col("thr")).cast("double"))
    scored = with_net_protection(each, Over(order, (*keys, "thr")))
    c = confusion_of()
    return scored.groupBy(*keys, "thr").agg(net_protection_of().alias("nps"), F.avg("s").alias("on_frac"), c["precision"].alias("precision"), c["recall"].alias("recall"))
