"""Event-time windows over tables and streams alike.

The same plan serves both: a stream gets a watermark, and a window's row comes
once, when the watermark has passed its end (append), or again whenever it changes
(update).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    known = df.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    return known.withWatermark(time, delay) if df.isStreaming else known


def sliding(df: DataFrame, keys: list[str], time: str, length: str, slide: str | None = None, delay: str = "1 hour", value: str = "value") -> DataFrame:
    """``keys, start, end, n, mean, vol, low, high`` of ``value`` in windows of
    ``length``, one beginning every ``slide`` (None: one after another).  ``vol`` is
    the population deviation.  Windows are closed at their start and open at their
    end; null values count in n only, null times nowhere."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return _closed(_timed(df, time, delay).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *_moments(value)), keys)


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, delay: str = "1 hour", value: str = "value") -> DataFrame:
    """The same over sessions: rows of a key that follow each other by less than
    ``gap``; a session's end is its last row's time plus the gap."""
    return _closed(_timed(df, time, delay).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), *_moments(value)), keys)


def _moments(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("vol"), F.min(value).alias("low"), F.max(value).alias("high")]


def _closed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "vol", "low", "high")


def write_windows(windows: DataFrame, path: str, checkpoint: str, update: bool = False) -> StreamingQuery:
    """Run a stream of windows over what there is now.  Appended windows go to
    Parquet files, each once; updated ones to a folder for each batch, written over
    on a retry, of which the last row of a window holds."""
    if not update:
        return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return windows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest_updates(spark, path: str, keys: list[str]) -> DataFrame:
    """The last row of each window that :func:`write_windows` updated."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "start", "batch")]
    last = F.max_by(F.struct(*others), "batch").alias("last")
    return rows.groupBy(*keys, "start").agg(last).select(*keys, "start", "last.*")
