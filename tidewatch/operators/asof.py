"""As-of join: each row with the last (or next) row of another table at its time.

Both sides become one relation in order of time.  Time is cut into ranges of about
equally many rows, so that a key of any size lies over many tasks; inside a range a
window carries the last match forward, and what a range begins with comes from the
last match of each earlier range, one row a key and range.  No row meets another
side's rows but through its key and range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

RANGES, MOST_RANGES = 64, 4096
RANGE_ROWS = 2_000_000  # rows of a range of a written table, about


def _search(time: Column, cuts: Column, base: Column, stride: int, lo: int, hi: int) -> Column:
    """How many of the 63 cuts at base + stride - 1, base + 2 * stride - 1, ... are
    at most ``time``, by halving; a missing cut is larger than any time."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    below = F.coalesce(F.get(cuts, base + ((mid + 1) * stride - 1)) <= time, F.lit(False))
    return F.when(below, _search(time, cuts, base, stride, mid + 1, hi)).otherwise(_search(time, cuts, base, stride, lo, mid))


def ranges_of(rows: int) -> int:
    return max(RANGES, min(MOST_RANGES, -(-rows // RANGE_ROWS)))


def in_ranges(df: DataFrame, time: str, ranges: int = RANGES, name: str = "_range") -> DataFrame:
    """``df`` with the number, from 0, of each row's range of ``time``: ranges hold
    about equally many rows.  The cuts are one row, from one aggregate."""
    shares = [k / ranges for k in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(time, shares, 10 * ranges).alias("_cuts"))
    placed = df.join(F.broadcast(cuts), how="cross").withColumn(name, F.lit(0))  # one row
    stride = 1
    while stride * 64 < ranges:
        stride *= 64
    while stride:  # each step halves among 64 ranges of the one found before
        placed = placed.withColumn(name, F.col(name) + F.coalesce(_search(F.col(time), F.col("_cuts"), F.col(name), stride, 0, 63), F.lit(0)) * stride)
        stride //= 64
    return placed.drop("_cuts")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: tuple[str, ...] = (),
    right_on: str | None = None,
    take: tuple[str, ...] | None = None,
    strict: bool = False,
    lag: Column | None = None,
    tolerance: Column | None = None,
    forward: bool = False,
    how: str = "left",
    ranges: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``left`` with the columns ``take`` (all but the keys) of the right row that
    holds at its time.

    The right row is the one of equal ``by`` whose time (``right_on``, kept in the
    result as ``<on>_right``) is the latest at or before the left one;
    ``strict``: before it alone; ``forward``: the earliest at or after (after).
    ``lag`` is added to right times first, as for series published late, and a
    right row further than ``tolerance`` away does not count: intervals for dates
    and timestamps, numbers for numbers.  Of right rows of one time the one with
    the largest ``take`` columns, in their order, holds.

    ``how``: ``left`` keeps left rows without a match, with nulls, ``inner`` does
    not.  ``ranges``: of time (None: by the number of rows where both sides are
    written, else ``RANGES``).  With ``scratch`` both sides are written there once; else they are worked
    out for each of the three steps that read them.  Rows with a null key or time match nothing; repeated left rows stay.
    Names of ``take`` must not be in ``left``.
    """
    right_on = right_on or on
    take = tuple(c for c in right.columns if c not in (*by, right_on)) if take is None else tuple(take)
    clash = ({f"{on}_right", *take} & set(left.columns)) - set(by)
    if clash:
        raise ValueError(f"names in both tables: {sorted(clash)}")
    time = F.col(right_on) if lag is None else F.col(right_on) + lag
    known = lambda df, c: df.where(F.col(c).isNotNull() & _all_known(by))
    match = F.struct(*[F.col(c) for c in take], time.alias("_at"))
    kind = left.schema[on].dataType
    after = F.lit(2 if strict != forward else 0)  # place of the right rows among those of one time, the left ones being 1
    rights = known(right, right_on).select(*by, time.cast(kind).alias("_time"), after.alias("_side"), match.alias("_match"), F.lit(None).cast(left.schema).alias("_row"))
    lefts = known(left, on).select(*by, F.col(on).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_match"].dataType).alias("_match"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    both = lefts.unionByName(rights)
    if scratch is not None:
        both = scratch.save(both, f"asof-{uuid.uuid4().hex}")
    if ranges is None:
        ranges = RANGES if scratch is None else ranges_of(both.count())
    both = in_ranges(both, "_time", ranges)

    order = [F.desc("_time"), F.desc("_side"), F.asc("_match")] if forward else [F.asc("_time"), F.asc("_side"), F.asc("_match")]
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_here", F.last("_match", True).over(w)).where("_side = 1")
    # The match that each range hands on, and from those the one that each range begins with.
    place = F.struct(F.col("_time"), F.col("_match"))
    if forward:
        ends = both.where("_match IS NOT NULL").groupBy(*by, "_range", "_time").agg(F.max("_match").alias("_match"))
        ends = ends.groupBy(*by, "_range").agg(F.min(F.struct("_time", "_match")).alias("_end"))
    else:
        ends = both.where("_match IS NOT NULL").groupBy(*by, "_range").agg(F.max(place).alias("_end"))
    # From the ranges with matches to all others: as many rows a key as there are ranges, at most.
    nearest = Window.partitionBy(*by).orderBy(F.desc("_range") if forward else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    asked = inside.select(*by, "_range").distinct().withColumn("_asks", F.lit(True))
    begins = asked.join(ends, [*by, "_range"], "full").withColumn("_begin", F.last("_end", True).over(nearest)).where("_asks").select(*by, "_range", F.col("_begin._match").alias("_begin"))
    met = inside.join(begins, [*by, "_range"], "left").withColumn("_found", F.coalesce("_here", "_begin"))
    if tolerance is not None:
        near = (F.col("_found._at") <= F.col("_time") + tolerance) if forward else (F.col("_time") <= F.col("_found._at") + tolerance)
        met = met.withColumn("_found", F.when(near, F.col("_found")))
    if how == "inner":
        met = met.where("_found IS NOT NULL")
    kept = [F.col("_row")[c].alias(c) for c in left.columns]
    out = met.select(*kept, F.col("_found._at").alias(f"{on}_right"), *[F.col("_found")[c].alias(c) for c in take])
    if how == "inner":
        return out
    rest = left.where(~(F.col(on).isNotNull() & _all_known(by)))
    return out.unionByName(rest, allowMissingColumns=True)


def _all_known(by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).isNotNull()
    return out
