"""Rule signals, 1.0 or 0.0; missing inputs give 0.0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import Over
from .labels import with_returns

RANK_WINDOW, RANK_LEAST, RANK_QUANTILE = 126, 60, 0.70


def with_trailing_rule(df: DataFrame, q: float, name: str, price: str = "close", over: Over = Over(), trail: int = 252) -> DataFrame:
    df = with_returns(df, price, over, "_lr").withColumn("_rv", w.volatility("_lr", 10, over))
    return df.withColumn(name, w.is_above(F.col("_rv"), w.rolling_quantile("_rv", q, trail, over))).drop("_lr", "_rv")


def with_persistence(df: DataFrame, price: str = "close", over: Over = Over()) -> DataFrame:
    """Volatility is above its own trailing 75 % quantile."""
    return with_trailing_rule(df, 0.75, "persistence", price, over)


def with_trailing_pctl(df: DataFrame, price: str = "close", over: Over = Over(), q: float = 0.60) -> DataFrame:
    return with_trailing_rule(df, q, "trailing_pctl", price, over)


def with_term_structure(df: DataFrame, near: str = "VIX_close", far: str = "VIX3M_close") -> DataFrame:
    """The near volatility index is at or above the far one."""
    return df.withColumn("term_structure", F.coalesce((F.col(near) >= F.col(far)).cast("double"), F.lit(0.0)))


def with_adaptive_signal(df: DataFrame, prob: str = "prob", over: Over = Over(by=()), name: str = "adaptive") -> DataFrame:
    """The probability is at or above the 70 % quantile of the last 126 rows, with
    60 probabilities at least."""
    threshold = w.rolling_quantile(prob, RANK_QUANTILE, RANK_WINDOW, over, RANK_LEAST)
    return df.withColumn(f"{name}_threshold", threshold).withColumn(name, F.coalesce((F.col(prob) >= F.col(f"{name}_threshold")).cast("double"), F.lit(0.0)))
