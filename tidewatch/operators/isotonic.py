"""Isotonic calibration: pooling adjacent violators in ranges of scores.

Pooling neighbours that are out of order gives the same fit in whatever order it is
done.  So scores are cut into ranges of at most about ``RANGE_BLOCKS`` blocks, each
range pools its own, and where the last block of one and the first of the next are
out of order the pooled blocks are cut into other ranges and pooled again, until
none are.  No task holds more than a range, however many scores there are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from ..sources.scratch import Scratch
from .asof import asof_join, in_ranges

RANGE_BLOCKS = 50_000


def pooled(lows, highs, counts, sums):
    """Blocks (low, high, count, sum) in order after pooling adjacent violators."""
    out: list[list] = []
    for block in zip(lows, highs, counts, sums, strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:  # equal means pool too
            _, high, n, s = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = high, out[-1][2] + n, out[-1][3] + s
    return out


def isotonic_blocks(rows: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p", range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """``keys, low, high, n, value``: the non-decreasing step function of the score
    ``p`` that is nearest to ``y`` in squares, as blocks of scores from low to high
    with one value, for each key.

    Rows of one score, and repeated rows, count together; neighbouring blocks of
    one value are one block; rows with a null or NaN score or a null label do not
    count; an empty table gives no row.
    """
    import pandas as pd

    keys = keys or []
    scratch = Scratch(rows.sparkSession)
    sound = rows.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    blocks = sound.groupBy(*keys, F.col(p).cast("double").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s")).select(*keys, "low", F.col("low").alias("high"), "n", "s")
    blocks, k = scratch.save(blocks, "blocks-0"), 0

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        made = pd.DataFrame(pooled(*(pdf[c].tolist() for c in ("low", "high", "n", "s"))), columns=["low", "high", "n", "s"])
        for c in [*keys, "_range"]:
            made.insert(0, c, pdf[c].iloc[0])
        return made[[*keys, "_range", "low", "high", "n", "s"]]

    ship(rows.sparkSession)
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys) + "_range int, low double, high double, n long, s double"
    while True:
        largest = blocks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        ranges = max(1, ceil(largest / range_blocks)) + k % 2  # other cuts each time
        dealt = in_ranges(blocks, "low", ranges)
        k += 1
        now = scratch.save(dealt.groupBy(*keys, "_range").applyInPandas(pool, schema), f"blocks-{k}")
        scratch.drop(f"blocks-{k - 1}")
        ends = now.groupBy(*keys, "_range").agg(F.min_by(F.struct("n", "s"), "low").alias("first"), F.max_by(F.struct("n", "s"), "low").alias("last"))
        before = F.lag("last").over(Window.partitionBy(*keys).orderBy("_range"))
        # a row for each key and range
        wrong = ends.withColumn("before", before).where(F.col("before.s") * F.col("first.n") >= F.col("first.s") * F.col("before.n")).limit(1).count()
        blocks = now.drop("_range")
        if not wrong:
            return blocks.select(*keys, "low", "high", "n", (F.col("s") / F.col("n")).alias("value"))


def calibrated(rows: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = (), p: str = "p", name: str = "calibrated") -> DataFrame:
    """``rows`` with the value of the block that holds at their score: the last
    one begun; below all blocks the first one's.  Null scores give null."""
    scratch = Scratch(rows.sparkSession)
    steps = blocks.select(*keys, F.col("low").alias("_low"), F.col("value").alias(name))
    first = steps.groupBy(*keys).agg(F.min_by(name, "_low").alias("_first"))  # a row for each key
    met = asof_join(rows, steps, p, keys, right_on="_low", take=(name,), scratch=scratch).drop(f"{p}_right")
    met = met.join(first, list(keys), "left") if keys else met.join(F.broadcast(first), how="left")
    return met.withColumn(name, F.when(F.col(p).isNotNull(), F.coalesce(name, "_first"))).drop("_first")
