"""Readers of raw pulls and snapshots, and panels made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import wall_date

SERIES = ("SPY", "QQQ", "IWM", "HYG", "LQD", "VIX", "VIX3M")
FIELDS = ("close", "high", "low")
PULL_SCHEMA = "time array<string>, close array<double>, high array<double>, low array<double>"
BARS_SCHEMA = "data struct<results: array<struct<symbol: string, bars: array<struct<begins_at: string, close_price: string, interpolated: boolean>>>>>"
BOOK_SCHEMA = "date date, BOOK_close double, n_names int"


def panel_schema(series: tuple[str, ...] = SERIES) -> str:
    return "date date, " + ", ".join(f"{s}_{f} double" for s in series for f in FIELDS)


def read_pull(spark: SparkSession, path: str, series: str) -> DataFrame:
    """A pull of parallel arrays as bars (series, date, close, high, low)."""
    raw = spark.read.schema(PULL_SCHEMA).option("multiLine", True).json(path)
    rows = raw.selectExpr("inline(arrays_zip(time, close, high, low))")
    return rows.select(F.lit(series).alias("series"), wall_date(F.col("time")).alias("date"), *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in FIELDS])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Nested bars of many files: (series, date, close, interpolated, pos, file).

    Where several files have traded bars of a symbol, the last file by name wins.
    """
    raw = spark.read.schema(BARS_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    each = raw.select("file", F.explode("data.results").alias("r")).select("file", F.col("r.symbol").alias("series"), F.posexplode("r.bars").alias("pos", "b"))
    bars = each.select("series", wall_date(F.col("b.begins_at")).alias("date"), F.expr("try_cast(b.close_price AS double)").alias("close"), F.coalesce("b.interpolated", F.lit(False)).alias("interpolated"), "pos", "file").where("NOT interpolated")
    last = bars.groupBy("series").agg(F.max("file").alias("file"))
    return bars.join(last, ["series", "file"], "left_semi")


def read_csv_panel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A snapshot in CSV with its declared types; NaN reads as NULL."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def lineitem_bars(lineitem: DataFrame, by: str = "l_returnflag") -> DataFrame:
    """A long panel: the daily mean, highest and lowest price of each ``by``."""
    price = F.col("l_extendedprice")
    return lineitem.groupBy(F.col(by).alias("series"), F.to_date("l_shipdate").alias("date")).agg(F.avg(price).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"))


def lineitem_panel(lineitem: DataFrame) -> DataFrame:
    """A wide panel with gaps as they are; one grouping makes all columns."""
    price, quantity, flag, status = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    columns = {
        "SPY_close": F.avg(price), "SPY_high": F.max(price), "SPY_low": F.min(price), "QQQ_close": F.avg(F.when(flag == "A", price)), "IWM_close": F.avg(F.when(flag == "N", price)),
        "HYG_close": F.avg(F.when(flag == "R", price)), "LQD_close": F.avg(F.when(status == "F", price)), "VIX_close": F.avg(F.when(status == "O", quantity)), "VIX3M_close": F.avg(F.when(status == "F", quantity)),
    }
    return lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg(*[v.alias(k) for k, v in columns.items()])


PANEL_COLUMNS = ("SPY_close", "SPY_high", "SPY_low", "QQQ_close", "IWM_close", "HYG_close", "LQD_close", "VIX_close", "VIX3M_close")


def order_bars(orders: DataFrame) -> DataFrame:
    """A long panel with gaps: the daily mean order price of each priority."""
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
