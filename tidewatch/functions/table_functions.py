"""Table functions for SQL text: folds, block starts and lead times.

``register(spark)`` makes them known to the session:

    SELECT * FROM purged_folds(TABLE(rows) PARTITION BY series)
    SELECT * FROM lead_times(TABLE(rows) PARTITION BY series ORDER BY i)
    SELECT * FROM block_starts(2200, 2000, 20, 7)

The key column is ``series`` unless ``key => 'name'`` says otherwise.  A partition's
rows pass one by one, and only counters are kept of them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from ..operators.folds import EMBARGO, HORIZON, MIN_TRAIN, N_FOLDS
from ..operators.metrics import LOOKBACK
from ..session import ship


def _schema(rows: AnalyzeArgument, key: AnalyzeArgument | None, needs: tuple[str, ...], made: StructType) -> AnalyzeResult:
    """The key column and ``made``; a clear error where a column is missing."""
    name = "series" if key is None else key.value
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(rows) PARTITION BY the key")
    missing = [c for c in (name, *needs) if c not in rows.dataType.names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the table")
    return AnalyzeResult(StructType([rows.dataType[name], *made.fields]))


class PurgedFolds:
    """``key, n, fold, train_end, test_start, test_end`` of each series, as
    :func:`operators.folds.folds_of` gives them; a series too short has none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        made = StructType().add("n", LongType()).add("fold", IntegerType()).add("train_end", LongType()).add("test_start", LongType()).add("test_end", LongType())
        return _schema(rows, key, (), made)

    def __init__(self):
        self.n, self.key = 0, None

    def eval(self, rows: Row, key: str = "series"):
        self.n, self.key = self.n + 1, rows[key]

    def terminate(self):
        n = self.n
        if n <= MIN_TRAIN + EMBARGO + HORIZON + N_FOLDS:
            return
        step = (n - MIN_TRAIN) // N_FOLDS
        for fold in range(N_FOLDS):
            start = MIN_TRAIN + fold * step
            yield self.key, n, fold, start - EMBARGO - HORIZON, start, n if fold == N_FOLDS - 1 else start + step


class LeadTimes:
    """``key, n_onsets, n_missed, lead_median, lead_mean`` of each series from its
    rows (i, y, s) in order, as :func:`operators.metrics.lead_times` gives them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        made = StructType().add("n_onsets", LongType()).add("n_missed", LongType()).add("lead_median", DoubleType()).add("lead_mean", DoubleType())
        return _schema(rows, key, ("i", "y", "s"), made)

    def __init__(self):
        self.key, self.before, self.off, self.missed = None, None, None, 0
        self.leads = [0] * (LOOKBACK + 1)  # onsets by lead

    def eval(self, rows: Row, key: str = "series"):
        self.key, i = rows[key], rows["i"]
        if self.off is None:
            self.off = i - 1
        if rows["s"] == 0:
            self.off = i
        if rows["y"] == 1 and self.before == 0:
            if rows["s"] == 1:
                self.leads[min(i - self.off - 1, LOOKBACK)] += 1
            else:
                self.missed += 1
        self.before = rows["y"]

    def terminate(self):
        if self.off is None:
            return
        led = sum(self.leads)
        median = (self._at((led - 1) // 2) + self._at(led // 2)) / 2 if led else None
        yield self.key, led + self.missed, self.missed, median, sum(k * c for k, c in enumerate(self.leads)) / led if led else None

    def _at(self, place: int) -> int:
        for lead, count in enumerate(self.leads):
            place -= count
            if place < 0:
                return lead
        return LOOKBACK


class BlockStarts:
    """``rep, k, start``: numpy's own sequence of block starts."""

    def eval(self, n: int, n_boot: int, block_len: int, seed: int):
        import numpy as np

        rng, blocks = np.random.default_rng(seed), ceil(n / block_len)
        for rep in range(n_boot):
            for k, start in enumerate(rng.integers(0, n, size=blocks).tolist()):
                yield rep, k, start


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udtf.register("purged_folds", udtf(PurgedFolds))
    spark.udtf.register("lead_times", udtf(LeadTimes))
    spark.udtf.register("block_starts", udtf(BlockStarts, returnType="rep int, k int, start long"))
