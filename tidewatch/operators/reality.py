"""White's reality check and Romano-Wolf step-down p values for many strategies.

All strategies share one set of block starts, so a replicate is one resampling of
time for all of them.  A block's sum over a strategy is taken once for each start
by a window, replicates are joins on the start, and the largest replicate value
over the strategies that are not yet ahead is a running maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bootstrap import BLOCK_LEN

PLACES = 12  # statistics are equal if they agree to so many decimal places


def block_sums(rows: DataFrame, keys: list[str], block_len: int = BLOCK_LEN) -> DataFrame:
    """``keys, name, n, start, whole, last``: sums of ``d`` over the circular block
    from each position, of full length and of the length that the last block of a
    replicate has."""
    by = [*keys, "name"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = rows.join(sizes, by)
    # The first positions once more behind the end, so that blocks wrap.
    turn = F.when(F.col("i") < block_len - 1, F.sequence(F.lit(0), F.ceil((block_len - 1 - F.col("i")) / F.col("n")))).otherwise(F.array(F.lit(0).cast("long")))
    wrapped = placed.withColumn("_turn", F.explode(turn)).withColumn("_at", F.col("i") + F.col("_turn") * F.col("n")).where(F.col("_at") < F.col("n") + block_len - 1)
    w = Window.partitionBy(*by).orderBy("_at")
    last = F.col("n") - (F.ceil(F.col("n") / block_len) - 1) * block_len
    lists = wrapped.withColumn("_block", F.collect_list("d").over(w.rowsBetween(0, block_len - 1))).where(F.col("_at") < F.col("n"))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return lists.select(*by, "n", F.col("i").alias("start"), total(F.col("_block")).alias("whole"), total(F.slice("_block", F.lit(1), last.cast("int"))).alias("last"))


def replicate_means(rows: DataFrame, starts: DataFrame, keys: list[str], block_len: int = BLOCK_LEN) -> DataFrame:
    """``keys, name, rep, mean`` of ``d`` in each replicate.  ``starts``: (keys,
    rep, k, start), the same for all strategies of a key."""
    sums = block_sums(rows, keys, block_len)
    met = starts.join(sums, [*keys, "start"])
    part = F.when(F.col("k") == F.ceil(F.col("n") / block_len) - 1, F.col("last")).otherwise(F.col("whole"))
    return met.groupBy(*keys, "name", "rep").agg((F.sum(part) / F.first("n")).alias("mean"))


def reality_check(rows: DataFrame, starts: DataFrame, keys: list[str] | None = None, block_len: int = BLOCK_LEN, studentise: bool = False) -> DataFrame:
    """``keys, name, mean, rank, p_alone, p_step``: of ``rows`` (keys, name, i, d),
    where d is how much better than the benchmark the strategy was at position i
    (from 0, the same for all strategies of a key).

    The statistic is sqrt(n) times the mean, divided by the replicates' standard
    deviation if ``studentise`` (a strategy that never differs then has none: its
    p values are 1).  ``p_alone`` is the share of replicates whose centred
    statistic is at least the strategy's own; ``p_step`` compares with the largest
    among the strategies of its rank and below, and is never smaller than that of
    a better one; at rank 1 it is the reality check's p value for the best of all.
    Equal statistics are ranked by name.  d is not null; an empty table gives no
    row.
    """
    keys = keys or []
    by = [*keys, "name"]
    whole = rows.groupBy(*by).agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))
    reps = replicate_means(rows, starts, keys, block_len)
    if studentise:
        spread = reps.groupBy(*by).agg(F.stddev_pop(F.col("mean")).alias("sd"))
        whole = whole.join(spread, by, "left").withColumn("scale", F.when(F.round("sd", PLACES) > 0, 1 / F.col("sd")).otherwise(0.0))
    else:
        whole = whole.withColumn("scale", F.sqrt("n"))
    stat = whole.select(*by, "mean", F.round(F.col("mean") * F.col("scale"), PLACES).alias("stat"), "scale")
    stat = stat.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("stat"), "name")))
    centred = reps.join(stat.withColumnRenamed("mean", "own"), by).select(*by, "rep", "rank", "stat", F.round((F.col("mean") - F.col("own")) * F.col("scale"), PLACES).alias("z"), (F.col("scale") == 0).alias("none"))
    below = Window.partitionBy(*keys, "rep").orderBy(F.desc("rank"))
    shares = centred.withColumn("most", F.max("z").over(below)).groupBy(*by, "rank").agg(
        F.avg(((F.col("z") >= F.col("stat")) | F.col("none")).cast("double")).alias("p_alone"), F.avg(((F.col("most") >= F.col("stat")) | F.col("none")).cast("double")).alias("p")
    )
    step = F.max("p").over(Window.partitionBy(*keys).orderBy("rank"))
    return shares.join(stat.select(*by, "mean"), by).select(*by, "mean", "rank", "p_alone", step.alias("p_step"))
