"""Circular block bootstrap of metrics, and multiple-testing adjustment.

A replicate is a list of block starts, made by a rule: ``drawn`` by numpy's
generator, one call a replicate, so that published intervals can be met to the last
digit (up to ``DRAWN_ROWS`` starts a series; beyond, ``hashed``), ``hashed`` from
the seed and the place, ``stepped`` by a fixed step that other engines can follow.

All keys run in one plan.  The rows of a key of up to ``FAST_ROWS`` rows are one
group for each of ``PARTS`` parts of its replicates: a replicate is then how often
it takes each row, and AUC and Brier score are sums over rows in order of score.
Longer keys, starts handed in, and other metrics meet their replicates by a join on
position, and metrics run over all replicates at once; the values are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .metrics import auc, brier_of

BLOCK_LEN, N_BOOT, ALPHA = 20, 2000, 0.10
BROADCAST_ROWS = 1_000_000
FAST_ROWS = 100_000
DRAWN_ROWS = 10_000_000  # block starts that one numpy generator makes at most
PARTS = 8  # parts of a short key's replicates


def drawn_starts(spark: SparkSession, n: int, n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, seed: int = 0) -> DataFrame:
    """``rep, k, start``: uniform starts from 0 to n - 1, numpy's own sequence up
    to ``DRAWN_ROWS`` of them, and :func:`hashed_starts` beyond."""
    return starts_of(spark.range(1).select(F.lit(n).cast("long").alias("n")), [], n_boot, block_len, "drawn", seed).select("rep", "k", "start")


def hashed_starts(spark: SparkSession, n: int, n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, seed: int = 0) -> DataFrame:
    """The same for series of any length: each start is a hash of the seed and
    its place, so nothing is made on the driver."""
    each = spark.range(n_boot).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(ceil(n / block_len) - 1))).alias("k"))
    return each.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "rep", "k"), F.lit(n)))


def stepped_starts(spark: SparkSession, n: int, n_boot: int, block_len: int = BLOCK_LEN) -> DataFrame:
    """The same by a fixed rule, for checks in other engines."""
    reps = spark.range(n_boot).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(ceil(n / block_len) - 1))).alias("k"))
    return reps.withColumn("start", F.pmod(F.col("rep").cast("long") * 7919 + F.col("k").cast("long") * 104729, F.lit(n)))


def starts_of(sizes: DataFrame, keys: list[str], n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, rule: str = "drawn", seed: int = 0) -> DataFrame:
    """``keys, n, rep, k, start`` for ``sizes`` (keys, n): the starts of every key,
    made on the executors.  Keys of one size have the same starts."""
    if rule == "drawn":
        few = F.ceil(F.col("n") / block_len) * n_boot <= DRAWN_ROWS
        return _numpy_starts(sizes.where(few), n_boot, block_len, seed).unionByName(starts_of(sizes.where(~few), keys, n_boot, block_len, "hashed", seed))
    if rule not in ("hashed", "stepped"):
        raise ValueError(f"unknown rule of starts: {rule}")
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as these few bytes become many rows
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).repartition(width, "rep")
    each = reps.withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block_len) - 1).cast("int"))))
    place = F.xxhash64(F.lit(seed), "rep", "k") if rule == "hashed" else F.col("rep").cast("long") * 7919 + F.col("k").cast("long") * 104729
    return each.select(*keys, "n", "rep", "k", F.pmod(place, F.col("n")).alias("start"))


def _numpy_starts(sizes: DataFrame, n_boot: int, block_len: int, seed: int) -> DataFrame:
    """The drawn starts of each distinct size, made by the task that holds it, for
    all keys of that size."""
    import pandas as pd

    def run(parts):
        for part in parts:
            for n in part["n"]:
                starts = start_matrix("drawn", int(n), n_boot, block_len, seed)
                blocks, at_once = starts.shape[1], max(1, 200_000 // starts.shape[1])
                for a in range(0, n_boot, at_once):
                    own = starts[a : a + at_once]
                    yield pd.DataFrame({"n": n, "rep": np.repeat(np.arange(a, a + len(own)), blocks), "k": np.tile(np.arange(blocks), len(own)), "start": own.ravel()})

    ship(sizes.sparkSession)
    made = sizes.select(F.col("n").cast("long").alias("n")).distinct().mapInPandas(run, "n long, rep int, k int, start long")
    return sizes.join(made, "n")


def start_matrix(rule: str, n: int, n_boot: int, block_len: int, seed: int) -> np.ndarray:
    """The starts of a series of n rows, replicates x blocks, by numpy."""
    blocks = ceil(n / block_len)
    if rule == "stepped":
        return (np.arange(n_boot)[:, None] * 7919 + np.arange(blocks) * 104729) % n
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, n, size=blocks) for _ in range(n_boot)])


def resampled_by(rows: DataFrame, starts: DataFrame, keys: list[str], block_len: int = BLOCK_LEN) -> DataFrame:
    """Rows (keys, i, ...) of each key's replicates: blocks wrap around the end,
    and the last one is cut so that a replicate has n rows.  Up to
    ``BROADCAST_ROWS`` rows go to the starts, else both meet by a shuffle."""
    rows = F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
    each = starts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block_len - 1)))).where(F.col("k") * block_len + F.col("j") < F.col("n"))
    return each.select(*keys, "rep", F.pmod(F.col("start") + F.col("j"), F.col("n")).alias("i")).join(rows, [*keys, "i"])


def resampled(rows: DataFrame, starts: DataFrame, n: int, block_len: int = BLOCK_LEN, position: str = "i") -> DataFrame:
    """Rows of each replicate: blocks wrap around the end, and the last block is
    cut so that a replicate has n rows."""
    each = starts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block_len - 1)))).where(F.col("k") * block_len + F.col("j") < n)
    index = each.select("rep", F.pmod(F.col("start") + F.col("j"), F.lit(n)).alias(position))
    return index.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, position)


def replicate_values(y: np.ndarray, p: np.ndarray, starts: np.ndarray, block_len: int = BLOCK_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(AUC, Brier score) of each replicate; NaN where there is none.  ``starts``:
    replicates x blocks; rows whose y or p is NaN do not count."""
    n, known = len(y), ~(np.isnan(y) | np.isnan(p))
    order = np.flatnonzero(known)[np.argsort(p[known], kind="stable")]
    ranked, label = p[order], y[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, np.int64)
    error = (ranked - label) ** 2
    aucs, briers = np.full(len(starts), np.nan), np.full(len(starts), np.nan)
    at_once = max(1, 2_000_000 // max(1, n))
    for k in range(0, len(starts) if len(order) else 0, at_once):
        part = starts[k : k + at_once]
        rows = ((part[:, :, None] + np.arange(block_len)).reshape(len(part), -1)[:, :n]) % n
        times = np.bincount((rows + n * np.arange(len(part))[:, None]).ravel(), minlength=n * len(part)).reshape(len(part), n)[:, order].astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            briers[k : k + at_once] = times @ error / times.sum(axis=1)
            above, below = (np.add.reduceat(times * w, first, axis=1) for w in (label, 1 - label))
            under = np.cumsum(below, axis=1) - below / 2
            aucs[k : k + at_once] = (above * under).sum(axis=1) / (above.sum(axis=1) * below.sum(axis=1))
    return aucs, briers


def replicates_by(rows: DataFrame, keys: list[str], scores: list[str], n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, rule: str = "drawn", seed: int = 0, order: str = "i") -> DataFrame:
    """``keys, rep`` and ``<score>_auc``, ``<score>_brier`` of every replicate of
    each key's rows (y and scores, in the order of ``order``); NULL where there is
    none.  Keys of any size: each goes the way that its own size asks for."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if rule == "hashed":
        return _long_replicates(rows, sizes, keys, scores, n_boot, block_len, rule, seed, order)
    if not sizes.where(F.col("n") > FAST_ROWS).limit(1).count():
        return _short_replicates(rows, keys, scores, n_boot, block_len, rule, seed, order)
    if not keys:
        return _long_replicates(rows, sizes, keys, scores, n_boot, block_len, rule, seed, order)
    short, long = (sizes.where(F.col("n") <= FAST_ROWS), sizes.where(F.col("n") > FAST_ROWS))
    one = _short_replicates(rows.join(short.select(*keys), keys, "left_semi"), keys, scores, n_boot, block_len, rule, seed, order)
    return one.unionByName(_long_replicates(rows.join(long.select(*keys), keys, "left_semi"), long, keys, scores, n_boot, block_len, rule, seed, order))


def _short_replicates(rows: DataFrame, keys: list[str], scores: list[str], n_boot: int, block_len: int, rule: str, seed: int, order: str) -> DataFrame:
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order_")
        own = np.array_split(np.arange(n_boot), PARTS)[int(pdf["part_"].iloc[0])]
        starts = start_matrix(rule, len(pdf), n_boot, block_len, seed)[own]
        out = {**{k: [pdf[k].iloc[0]] * len(own) for k in keys}, "rep": own}
        for s in scores:
            out[f"{s}_auc"], out[f"{s}_brier"] = replicate_values(pdf["y"].to_numpy(float), pdf[s].to_numpy(float), starts, block_len)
        return pd.DataFrame(out)

    ship(rows.sparkSession)
    kept = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{kept}rep int, " + ", ".join(f"{s}_{m} double" for s in scores for m in ("auc", "brier"))
    each = rows.select(*keys, F.col(order).alias("order_"), "y", *scores, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part_"))
    made = each.groupBy(*keys, "part_").applyInPandas(run, schema)
    return made.select(*keys, "rep", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in made.columns[len(keys) + 1 :]])


def _long_replicates(rows: DataFrame, sizes: DataFrame, keys: list[str], scores: list[str], n_boot: int, block_len: int, rule: str, seed: int, order: str) -> DataFrame:
    if any(not k.startswith("_key") for k in keys):  # names that cannot clash with those of the starts
        own = {k: f"_key{j}" for j, k in enumerate(keys)}
        made = _long_replicates(rows.select(*[F.col(k).alias(v) for k, v in own.items()], F.col(order).alias("i"), "y", *scores), sizes.withColumnsRenamed(own), list(own.values()), scores, n_boot, block_len, rule, seed, "i")
        return made.withColumnsRenamed({v: k for k, v in own.items()})
    placed = rows.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    sample = resampled_by(placed.select(*keys, "i", "y", *scores), starts_of(sizes, keys, n_boot, block_len, rule, seed), keys, block_len)
    out = None
    for s in scores:
        one = auc(sample, [*keys, "rep"], "y", s).withColumnRenamed("auc", f"{s}_auc").join(sample.groupBy(*keys, "rep").agg(brier_of("y", s).alias(f"{s}_brier")), [*keys, "rep"], "full")
        out = one if out is None else out.join(one, [*keys, "rep"], "full")
    return out


def metric_auc(sample: DataFrame, keys: list[str]) -> DataFrame:
    return auc(sample, keys).withColumnRenamed("auc", "value")


def metric_brier(sample: DataFrame, keys: list[str]) -> DataFrame:
    return sample.groupBy(*keys).agg(brier_of().alias("value"))


def python_metric(f: Callable) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A metric from any function of two arrays (y, p); a ValueError gives NULL."""

    def metric(sample: DataFrame, keys: list[str]) -> DataFrame:
        import pandas as pd

        def one(pdf):
            try:
                value = float(f(pdf["y"].to_numpy(), pdf["p"].to_numpy()))
            except ValueError:
                value = None
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "value": [value]})

        schema = ", ".join(f"{k} {sample.schema[k].dataType.simpleString()}" for k in keys)
        return sample.select(*keys, "y", "p").groupBy(*keys).applyInPandas(one, f"{schema}, value double")

    return metric


def _bounds(value: str, alpha: float) -> list:
    """Quantiles of the finite values, and how many there are."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return [F.percentile(v, F.lit(alpha / 2)), F.percentile(v, F.lit(1 - alpha / 2)), F.count(v)]


def interval(values: DataFrame, alpha: float = ALPHA, keys: list[str] | None = None) -> DataFrame:
    """``keys, lo, hi, n_valid`` of the finite values (NULL if there are none)."""
    lo, hi, n = _bounds("value", alpha)
    return values.groupBy(*(keys or [])).agg(lo.alias("lo"), hi.alias("hi"), n.alias("n_valid"))


def block_bootstrap_ci(
    rows: DataFrame, metric, starts: DataFrame | None = None, n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, alpha: float = ALPHA, seed: int = 0, keys: list[str] | None = None, rule: str = "drawn"
) -> DataFrame:
    """``keys, point, lo, hi, n_valid`` of a metric over rows (keys, i from 0, y,
    p), of any number.  ``starts``: (keys, n, rep, k, start), else by ``rule``."""
    keys = keys or []
    point = metric(rows.withColumn("rep", F.lit(-1)), [*keys, "rep"]).select(*keys, F.col("value").alias("point"))
    kind = {metric_auc: "p_auc", metric_brier: "p_brier"}.get(metric)
    if kind and starts is None:
        values = replicates_by(rows, keys, ["p"], n_boot, block_len, rule, seed).select(*keys, "rep", F.col(kind).alias("value"))
    else:
        if starts is None:
            starts = starts_of(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, n_boot, block_len, rule, seed)
        values = metric(resampled_by(rows, starts, keys, block_len), [*keys, "rep"])
    found = interval(values, alpha, keys)
    return point.join(found, keys, "left") if keys else point.join(found, how="cross")  # one row each


def intervals_by_key(rows: DataFrame, keys: list[str], n_boot: int = N_BOOT, block_len: int = BLOCK_LEN, alpha: float = ALPHA, seed: int = 0, order: str = "i", rule: str = "drawn") -> DataFrame:
    """``keys, auc_lo, auc_hi, brier_lo, brier_hi``: the intervals of both metrics
    for each key, as :func:`block_bootstrap_ci` gives them for its rows alone."""
    values = replicates_by(rows, keys, ["p"], n_boot, block_len, rule, seed, order)
    ends = {f"{m}_{e}": c for m in ("auc", "brier") for e, c in zip(("lo", "hi"), _bounds(f"p_{m}", alpha), strict=False)}
    return values.groupBy(*keys).agg(*[c.alias(name) for name, c in ends.items()])


def auc_difference(rows: DataFrame, model: str = "p", base: str = "p_base", n_boot: int = N_BOOT, seed: int = 0, keys: list[str] | None = None, rule: str = "drawn", order: str = "i") -> DataFrame:
    """``keys, auc_diff, p_raw, n_valid``: both scores on the same replicates; p is
    the share of replicates in which the model is not better.  Replicates of one
    class are left out."""
    keys = keys or []
    per = replicates_by(rows, keys, [model, base], n_boot, BLOCK_LEN, rule, seed, order).where(F.col(f"{model}_auc").isNotNull() & F.col(f"{base}_auc").isNotNull())
    p = per.groupBy(*keys).agg(F.avg((F.col(f"{model}_auc") - F.col(f"{base}_auc") <= 0).cast("double")).alias("p_raw"), F.count(F.lit(1)).alias("n_valid"))
    first, second = auc(rows, keys, "y", model).withColumnRenamed("auc", "am"), auc(rows, keys, "y", base).withColumnRenamed("auc", "ab")
    if keys:
        whole = first.join(second, keys)
        return whole.select(*keys, (F.col("am") - F.col("ab")).alias("auc_diff")).join(p, keys, "left")
    return first.join(second, how="cross").select((F.col("am") - F.col("ab")).alias("auc_diff")).join(p, how="cross")  # one row each


def bonferroni(p, runs: int):
    """The p value times the number of runs logged so far, at most 1."""
    return F.least(F.lit(1.0), p * runs)


SKILL = 0.10
