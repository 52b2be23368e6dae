"""Hedge-ratio bands by probability or by rank: the last cut at or below wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import in_unit_interval

#: Fixed values: (cut, low, high) in ascending order of the cut.
BY_PROBABILITY = ((0.0, 0.0, 0.10), (0.20, 0.25, 0.50), (0.30, 0.50, 0.75))
BY_RANK = ((0.0, 0.0, 0.10), (0.70, 0.25, 0.50), (0.85, 0.50, 0.75))


def band(x: Column, table=BY_PROBABILITY, what: str = "probability") -> Column:
    """struct(lo, hi); NULL for NULL, an error outside [0, 1]."""
    x = in_unit_interval(x, what)
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for cut, low, high in table:
        out = F.when(x >= cut, F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))).otherwise(out)
    return out


def band_by_rank(rank: Column) -> Column:
    return band(rank, BY_RANK, "rank")
