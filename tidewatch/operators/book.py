"""A weighted portfolio index from bars and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import Over
from .align import clean_suffix, on_calendar


BROADCAST_SERIES = 100_000  # so many series' weights at most are broadcast


def weights(positions: DataFrame) -> DataFrame:
    """``series, weight`` from (series, shares, price): the shares of total value."""
    valued = positions.select("series", (F.col("shares") * F.col("price")).alias("value"))
    total = valued.agg(F.sum("value").alias("total"))  # one row
    return valued.join(F.broadcast(total), how="cross").select("series", F.try_divide("value", "total").alias("weight"))


def target_weights(weight: DataFrame, digits: int = 6) -> list[tuple[str, float]]:
    """The weights as a manifest lists them: largest first, ties by name."""
    return [(r.series, r.weight) for r in weight.where("weight IS NOT NULL").select("series", F.round("weight", digits).alias("weight")).orderBy(F.desc("weight"), "series").collect()]


def weights_from_maps(document: DataFrame, shares: str = "shares", prices: str = "last_close") -> DataFrame:
    """The same from a row with two maps by symbol."""
    each = document.select(F.explode(shares).alias("series", "shares"), F.col(prices).alias("p"))
    return weights(each.select("series", "shares", F.try_element_at("p", F.col("series")).alias("price")))


def book_index(bars: DataFrame, weight: DataFrame, jump_cut: float = 0.7, base: float = 100.0) -> DataFrame:
    """``date, BOOK_close, n_names``.

    Bars after each series' last jump are aligned on one calendar; returns are
    taken there, so a gap misses the gap day and the next.  Each day weighs the
    series that have a return, renormalised; days without weight go.  A series
    without position has weight 0, a position without bars is ignored.
    """
    aligned = on_calendar(clean_suffix(bars, jump_cut))
    few = weight.count() <= BROADCAST_SERIES
    returns = aligned.withColumn("lr", w.log_return("close", Over())).join(F.broadcast(weight) if few else weight, "series", "left")
    held = F.when(F.col("lr").isNotNull(), F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    daily = returns.groupBy("date").agg(F.sum(held).alias("wsum"), F.sum(held * F.coalesce("lr", F.lit(0.0))).alias("wr"), F.count_if(held > 0).alias("n_names")).where("wsum > 0")
    over = Over(by=())
    out = daily.withColumn("r", F.col("wr") / F.col("wsum")).withColumn("BOOK_close", w.index_level("r", base, over))
    sound = F.when(F.isnan("BOOK_close") | (F.abs("BOOK_close") == float("inf")), F.raise_error(F.lit("the index is not finite")).cast("double")).otherwise(F.col("BOOK_close"))
    return out.select("date", sound.alias("BOOK_close"), "n_names")
