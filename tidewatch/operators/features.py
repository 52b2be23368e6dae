"""Point-in-time features; no frame reaches past the present row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import Over

#: The names of the features, in order.
MARKET_FEATURES = (
    "rv10", "rv21", "rv63", "rv10_chg5", "rv_ratio_10_63", "volofvol21", "vix", "vix_slope", "vix_chg5", "vrp", "credit_ratio_chg21", "credit_ratio_chg5", "qqq_rv10", "iwm_rv10",
    "dd_from_peak63", "ret21", "ret5", "skew63", "range5",
)
SMALL_FEATURES = ("rv10", "vix", "vix_slope", "rv_ratio_10_63")
BOOK_FEATURES = ("brv10", "brv21", "brv_ratio_10_63", "brv10_chg5", "bdd_from_peak63", "vix", "vix_slope", "vix_chg5", "credit_ratio_chg21", "spy_rv10", "beta63")
PANEL = Over(by=())
#: Rows that the longest chain of frames looks back.
LOOKBACK = 85


def _market_levels(df: DataFrame, over: Over) -> DataFrame:
    """Returns and ratios that the second window stage builds on."""
    return df.withColumns(
        {
            "_spy": w.log_return("SPY_close", over),
            "_credit": F.try_divide(F.col("HYG_close"), F.col("LQD_close")),
            "_range": F.try_divide(F.col("SPY_high") - F.col("SPY_low"), F.col("SPY_close")),
        }
    )


def with_market_features(panel: DataFrame, over: Over = PANEL) -> DataFrame:
    """The 19 market features beside the columns of a wide panel."""
    df = _market_levels(panel, over).withColumns({"_qqq": w.log_return("QQQ_close", over), "_iwm": w.log_return("IWM_close", over), "vix": F.col("VIX_close")})
    df = df.withColumns(
        {
            "rv10": w.volatility("_spy", 10, over),
            "rv21": w.volatility("_spy", 21, over),
            "rv63": w.volatility("_spy", 63, over),
            "vix_slope": F.try_divide(F.col("VIX_close"), F.col("VIX3M_close")) - 1,
            "vix_chg5": w.change("VIX_close", 5, over),
            "credit_ratio_chg21": w.change("_credit", 21, over),
            "credit_ratio_chg5": w.change("_credit", 5, over),
            "qqq_rv10": w.volatility("_qqq", 10, over),
            "iwm_rv10": w.volatility("_iwm", 10, over),
            "dd_from_peak63": w.below_peak("SPY_close", 63, over),
            "ret21": w.change("SPY_close", 21, over),
            "ret5": w.change("SPY_close", 5, over),
            "skew63": w.rolling_skew("_spy", 63, over),
            "range5": w.rolling_mean("_range", 5, over),
        }
    )
    df = df.withColumns(
        {
            "rv10_chg5": w.difference("rv10", 5, over),
            "rv_ratio_10_63": F.try_divide(F.col("rv10"), F.col("rv63")),
            "_rv10_chg1": w.change("rv10", 1, over),
            "vrp": F.col("VIX_close") / 100 - F.col("rv21"),
        }
    )
    return df.withColumn("volofvol21", w.rolling_deviation("_rv10_chg1", 21, over)).drop("_spy", "_credit", "_range", "_qqq", "_iwm", "_rv10_chg1")


def with_book_features(df: DataFrame, over: Over = PANEL) -> DataFrame:
    """The 11 features of a portfolio index joined with the market panel."""
    df = df.withColumns({"_book": w.log_return("BOOK_close", over), "_spy": w.log_return("SPY_close", over), "_credit": F.try_divide(F.col("HYG_close"), F.col("LQD_close")), "vix": F.col("VIX_close")})
    df = df.withColumns(
        {
            "brv10": w.volatility("_book", 10, over),
            "brv21": w.volatility("_book", 21, over),
            "_brv63": w.volatility("_book", 63, over),
            "bdd_from_peak63": w.below_peak("BOOK_close", 63, over),
            "vix_slope": F.try_divide(F.col("VIX_close"), F.col("VIX3M_close")) - 1,
            "vix_chg5": w.change("VIX_close", 5, over),
            "credit_ratio_chg21": w.change("_credit", 21, over),
            "spy_rv10": w.volatility("_spy", 10, over),
            "beta63": w.rolling_beta("_book", "_spy", 63, over),
        }
    )
    df = df.withColumns({"brv_ratio_10_63": F.try_divide(F.col("brv10"), F.col("_brv63")), "brv10_chg5": w.difference("brv10", 5, over)})
    return df.drop("_book", "_spy", "_credit", "_brv63")
