"""The elevated-volatility label and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import Over

HORIZON, TRAIL, LABEL_QUANTILE = 10, 252, 0.75


def with_returns(df: DataFrame, price: str = "close", over: Over = Over(), name: str = "lr") -> DataFrame:
    return df.withColumn(name, w.log_return(price, over))


def with_labels(df: DataFrame, price: str = "close", over: Over = Over(), horizon: int = HORIZON, trail: int = TRAIL, q: float = LABEL_QUANTILE) -> DataFrame:
    """``rv_trail, rv_thresh, rv_fwd, mdd_fwd, label`` beside the columns of df.

    The label is 1.0 where the volatility ahead is above the trailing quantile of
    trailing volatility, else 0.0; NULL where either is missing.
    """
    df = with_returns(df, price, over, "_lr")
    df = df.withColumns({"rv_trail": w.volatility("_lr", horizon, over), "rv_fwd": w.volatility_ahead("_lr", horizon, over), "mdd_fwd": w.drawdown_ahead(price, horizon, over)})
    df = df.withColumn("rv_thresh", w.rolling_quantile("rv_trail", q, trail, over))
    return df.withColumn("label", (F.col("rv_fwd") > F.col("rv_thresh")).cast("double")).drop("_lr")
