"""Metrics over grouping sets, from one mergeable state.

AUC cannot be averaged over groups, but the counts by distinct score that it is
made of can be added.  Rows are aggregated once, to the finest groups and distinct
scores; coarser groups add those states, and every metric is made at the end.
Onsets and leads are found on the rows' own order first, and are then counts too.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w
from ..functions.windows import Over
from .metrics import LOOKBACK

STATE = ("n", "pos", "squares", "on", "hit", "missed_days", "false_days", "onsets", "missed_onsets", "leads", "lead_days")


def metric_states(rows: DataFrame, dims: list[str], series: list[str], order: str = "i", lookback: int = LOOKBACK) -> DataFrame:
    """``dims, p`` and the sums of ``STATE``: counts by distinct score of the rows
    (y, p, s) in each finest group.  ``series``: whose own order of rows onsets
    and leads follow.  Rows with a null y, p or s do not count, but stand in that
    order; null dims are groups."""
    over = Over(order, tuple(series))
    onset = F.coalesce(w.onset("y", over), F.lit(False))
    each = rows.withColumns({"_lead": w.lead_time("s", order, lookback, over), "_onset": onset}).where("y IS NOT NULL AND p IS NOT NULL AND s IS NOT NULL")
    one = lambda c: F.sum(c.cast("double"))
    y, p, s = F.col("y"), F.col("p"), F.col("s")
    led = F.col("_onset") & F.col("_lead").isNotNull()
    return each.groupBy(*dims, "p").agg(
        F.count(F.lit(1)).alias("n"), one(y).alias("pos"), F.sum(F.pow(p - y, 2)).alias("squares"), one(s).alias("on"), one(y * s).alias("hit"),
        F.count_if((s == 0) & (y == 1)).alias("missed_days"), F.count_if((s == 1) & (y == 0)).alias("false_days"), F.count_if("_onset").alias("onsets"),
        F.count_if(F.col("_onset") & F.col("_lead").isNull()).alias("missed_onsets"), F.count_if(led).alias("leads"), F.coalesce(F.sum(F.when(led, F.col("_lead").cast("double"))), F.lit(0.0)).alias("lead_days"),
    )


def merged_states(states: DataFrame, dims: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """The states of all ``sets`` of dims: ``level`` (a bit for each dim that is
    added up, the first one the highest), ``dims`` (null where added up), ``p``."""
    summed = states.groupingSets([[*s, "p"] for s in sets], *dims, "p").agg(F.grouping_id(*dims, "p").alias("_bits"), *[F.sum(c).alias(c) for c in STATE])
    return summed.withColumn("level", F.shiftright("_bits", 1).cast("int")).drop("_bits")


def measures(states: DataFrame, groups: list[str]) -> DataFrame:
    """The metrics of each group from its states by distinct score."""
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy(*groups).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = states.withColumn("_wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    sums = ranked.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in STATE], F.sum("_wins").alias("_wins"))
    n, pos, neg = F.col("n"), F.col("pos"), F.col("n") - F.col("pos")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *groups, "n", (pos / n).alias("base_rate"), (F.col("on") / n).alias("hedge_on_frac"), ratio(F.col("hit"), F.col("on")).alias("precision"), ratio(F.col("hit"), pos).alias("recall"),
        (F.col("missed_days") / n / F.greatest(pos / n, F.lit(1e-9))).alias("false_negative_rate"), (F.col("false_days") / n).alias("false_positive_days_frac"), (F.col("squares") / n).alias("brier"),
        F.when((pos > 0) & (neg > 0), F.try_divide(F.col("_wins"), pos * neg)).alias("auc"), F.col("onsets").alias("n_onsets"), F.col("missed_onsets").alias("n_missed"), F.try_divide("lead_days", "leads").alias("lead_mean"),
    )


def metrics_cube(rows: DataFrame, dims: list[str], series: list[str], sets: list[tuple[str, ...]] | None = None, order: str = "i") -> DataFrame:
    """``level, dims`` and the metrics over each of ``sets`` (None: all subsets of
    ``dims``; ``[dims[:k] ...]`` is a rollup).  An empty table gives no row."""
    sets = [c for k in range(len(dims), -1, -1) for c in combinations(dims, k)] if sets is None else sets
    return measures(merged_states(metric_states(rows, dims, series, order), dims, sets), ["level", *dims])
