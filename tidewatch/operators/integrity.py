"""Leakage and integrity checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.windows import Over
from .metrics import auc


def prefix_variance(df: DataFrame, build: Callable[[DataFrame], DataFrame], columns: list[str], at: int, keys: tuple[str, ...] = ("i",), position: str = "i", rtol: float = 1e-10) -> DataFrame:
    """Rows whose point-in-time columns change when the future is cut off at row
    ``at``; empty if nothing leaks."""
    whole = build(df).where(F.col(position) == at).select(*keys, *[F.col(c).alias(f"{c}_whole") for c in columns])
    cut = build(df.where(F.col(position) <= at)).where(F.col(position) == at).select(*keys, *columns)
    differs = F.lit(False)
    for c in columns:
        a, b = F.col(c), F.col(f"{c}_whole")
        differs = differs | ~a.eqNullSafe(b) & ~F.coalesce(F.abs(a - b) <= rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
    return cut.join(whole, list(keys)).where(differs)


#: The rows at which a panel is cut, besides its last row.
PREFIXES = (300, 500)


def prefix_places(df: DataFrame, position: str = "i") -> list[int]:
    """The rows that :func:`prefix_variances` checks, ascending."""
    last = df.agg(F.max(position)).head()[0]
    return [] if last is None else sorted({at for at in (*PREFIXES, last - 1, last) if 0 <= at <= last})


def prefix_variances(df: DataFrame, build: Callable[[DataFrame], DataFrame], columns: list[str], position: str = "i") -> DataFrame:
    """:func:`prefix_variance` at the rows of :data:`PREFIXES` and at the last two.

    The last row has no future to cut off, so there both plans are the same by
    nature; the row before it is the last that can show a leak.  A panel too
    short for a row of :data:`PREFIXES` is checked at the others.
    """
    places = prefix_places(df, position)
    out = prefix_variance(df, build, columns, places[-1] if places else 0, position=position)
    for at in places[:-1]:
        out = out.unionByName(prefix_variance(df, build, columns, at, position=position))
    return out


#: A row frame that ends after its own row, as plans print it.
_AHEAD = re.compile(r"specifiedwindowframe\(RowFrame, [^)]*?, (?:[1-9]\d*|unboundedfollowing\$\(\))\)")


def looks_ahead(plan: DataFrame) -> bool:
    """Whether any window frame of a plan reaches past its row."""
    return bool(_AHEAD.search(plan._jdf.queryExecution().analyzed().toString()))


def staleness(df: DataFrame, features: list[str], label: str = "label", lags: tuple[int, ...] = (0, 1, 5), over: Over = Over(by=())) -> DataFrame:
    """``feature, lag, auc`` of each feature alone against the label, fresh and
    some rows late; one query over all of them."""
    late = df.select(label, *[w.lagged(f, k, over).alias(f"{f}__{k}") if k else F.col(f).alias(f"{f}__0") for f in features for k in lags])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"{f}__{k}").alias("p")) for f in features for k in lags])).alias("e")
    return auc(late.select(F.col(label).alias("y"), each).select("y", "e.*"), ["feature", "lag"])


def undocumented(used: DataFrame, documented: DataFrame, name: str = "series") -> DataFrame:
    """Series in use that no dictionary row calls free of revisions."""
    return used.select(name).distinct().join(documented, name, "left_anti")


def unauthorised_runs(ledger: DataFrame, allowed: DataFrame, name: str = "data_snapshot_hash") -> DataFrame:
    return ledger.join(allowed, name, "left_anti")


def folds_leak(folds: DataFrame, horizon: int = 10) -> DataFrame:
    """Folds whose training labels reach into their test rows."""
    return folds.where(F.col("train_end") - 1 + horizon >= F.col("test_start"))


def shuffled(df: DataFrame, column: str, seed: int, over: Over = Over(by=()), position: str = "i") -> DataFrame:
    """``column`` dealt anew at random among the rows (of each series)."""
    from pyspark.sql.window import Window

    mixed = df.select(*over.by, F.col(column).alias("_v"), (F.row_number().over(Window.partitionBy(*over.by).orderBy(F.xxhash64(F.lit(seed), position), position)) - 1).cast("long").alias(position))
    return df.drop(column).join(mixed.withColumnRenamed("_v", column), [*over.by, position])
