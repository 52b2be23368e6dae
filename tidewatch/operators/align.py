"""Cleaning and alignment of series on a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w
from ..functions.windows import Over


def wide_panel(bars: DataFrame, anchor: str, names: list[str], fields: tuple[str, ...] = ("close", "high", "low"), fill_limit: int = 3, over: Over = Over(by=())) -> DataFrame:
    """Long bars (series, date, fields) as one row per date of ``anchor``.

    One grouping by date makes all columns; gaps are filled from at most
    ``fill_limit`` rows before, and rows that still miss a value go.
    """
    cells = [F.max(F.when(F.col("series") == s, F.col(f))).alias(f"{s}_{f}") for s in names for f in fields]
    wide = bars.where(F.col("series").isin(names)).groupBy("date").agg(F.bool_or(F.col("series") == anchor).alias("_anchor"), *cells).where("_anchor").drop("_anchor")
    return fill_and_drop(wide, [f"{s}_{f}" for s in names for f in fields], over, fill_limit)


def fill_and_drop(panel: DataFrame, columns: list[str], over: Over, limit: int = 3) -> DataFrame:
    """Gaps filled from at most ``limit`` rows before; rows that still miss a value go."""
    return panel.withColumns({c: w.filled(c, limit, over) for c in columns}).dropna("any", subset=columns)


def keep_last(bars: DataFrame, keys: tuple[str, ...] = ("series", "date"), position: str = "pos") -> DataFrame:
    """One row for each key: the one latest in source order."""
    latest = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return bars.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars that were traded at a positive price."""
    return bars.where(~F.coalesce(F.col("interpolated"), F.lit(False)) & (F.col("close") > 0))


def clean_suffix(bars: DataFrame, cut: float = 0.7, over: Over = Over()) -> DataFrame:
    """Each series strictly after its last jump: |log return| above ``cut``."""
    jumps = bars.withColumn("_lr", w.log_return("close", over))
    last = F.max(F.when(F.abs("_lr") > cut, F.col(over.order))).over(Window.partitionBy(*over.by))
    return jumps.withColumn("cut_date", last).where(F.col("cut_date").isNull() | (F.col(over.order) > F.col("cut_date"))).drop("_lr")


def on_calendar(bars: DataFrame) -> DataFrame:
    """Every series on every date that any series has; missing closes are NULL.

    Dates and series are few next to the bars they index (one row per date of
    the whole calendar), so the grid is their product by definition of the result.
    """
    dates, series = bars.select("date").distinct(), bars.select("series").distinct()
    return dates.join(series, how="cross").join(bars.select("series", "date", "close"), ["series", "date"], "left")


def split_by_date(panel: DataFrame, months: int = 18, date: str = "date") -> DataFrame:
    """``part`` 'dev' up to the last date less ``months``, 'holdout' after."""
    edge = panel.agg(F.add_months(F.max(date), -months).alias("boundary"))
    return panel.join(F.broadcast(edge), how="cross").withColumn("part", F.when(F.col(date) <= F.col("boundary"), "dev").otherwise("holdout"))  # edge is one row


def drop_last(df: DataFrame, k: int, over: Over) -> DataFrame:
    """Without the last k rows of each of the series that ``over`` tells apart."""
    back = Window.partitionBy(*over.by).orderBy(F.col(over.order).desc())
    return df.withColumn("_k", F.row_number().over(back)).where(F.col("_k") > k).drop("_k")


def last_rows(df: DataFrame, k: int, date: str = "date") -> DataFrame:
    return df.orderBy(F.col(date).desc()).limit(k)


def positioned(df: DataFrame, over: Over, name: str = "i") -> DataFrame:
    """Dense row positions from 0, in order, of each of the series that ``over``
    tells apart.  One series is counted in one task."""
    return df.withColumn(name, (F.row_number().over(over.sorted()) - 1).cast("long"))


def last_value(x: Column | str, date: Column | str = "date") -> Column:
    """Aggregate: the last value that is there."""
    x, d = (F.col(v) if isinstance(v, str) else v for v in (x, date))
    return F.max_by(x, F.when(x.isNotNull(), d))
