"""One series over many tasks: windows over ranges with a halo.

A window function needs its whole partition in one task.  Bounded frames need no
more than a few neighbours, so a series is cut into ranges of its order, each range
gets copies of the rows just before and just after it, and windows run within
ranges.  What runs over a whole series (row numbers, running sums) is a running
value inside each range plus the total of the ranges before.

    rows, over = spread(df, Over("date", ("series",)), before=300, after=11)
    own = core(with_labels(rows, "close", over))
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Over
from .asof import MOST_RANGES, in_ranges, ranges_of

#: Rows that labels and features look back (252 values of a deviation over 10 returns, and a little more) and ahead at most.
BEFORE, AFTER = 300, 11
RANGE, CORE = "_spread", "_core"
SHARE = 10  # a range has so many times the rows of its halo, about


def spread(df: DataFrame, over: Over, before: int = BEFORE, after: int = AFTER, ranges: int | None = None) -> tuple[DataFrame, Over]:
    """``df`` with each row in its own range and, as a copy, in those ranges that
    see it among their last ``before`` or next ``after`` rows; and the order that
    windows take within ranges.  ``_core`` tells rows from copies.

    Every range sees as many rows as it asks for, however short the ranges between
    are; rows with a null order are left out.  The order must be a total one within
    each series for equal results.  ``ranges`` None: so many that the copies are
    about one row in ten, by the number of rows.
    """
    by = list(over.by)
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, df.count() // (SHARE * (before + after))))
    dealt = in_ranges(df.where(F.col(over.order).isNotNull()), over.order, ranges, RANGE)
    inside = Window.partitionBy(*by, RANGE).orderBy(over.order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, RANGE))
    placed = dealt.withColumn("_nth", F.row_number().over(inside).cast("long")).withColumn("_left", n - F.col("_nth") + 1)
    counts = dealt.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(RANGE)  # a row for each series and range
    sums = counts.select(*by, RANGE, "_n", F.collect_list(F.struct(F.col(RANGE).alias("r"), F.col("_n").alias("n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    # The other ranges that may see some of a range's rows, and how many rows lie between.
    between = lambda low, high: F.aggregate(F.filter("_all", lambda x: (x["r"] > low) & (x["r"] < high)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    later = F.transform(F.filter("_all", lambda x: x["r"] > F.col(RANGE)), lambda x: F.struct(x["r"].alias("to"), between(F.col(RANGE), x["r"]).alias("gap"), F.lit(True).alias("ahead")))
    earlier = F.transform(F.filter("_all", lambda x: x["r"] < F.col(RANGE)), lambda x: F.struct(x["r"].alias("to"), between(x["r"], F.col(RANGE)).alias("gap"), F.lit(False).alias("ahead")))
    wanted = F.filter(F.concat(later, earlier), lambda x: F.when(x["ahead"], x["gap"] < before).otherwise(x["gap"] < after))
    seen = placed.join(sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(RANGE).alias("_k"), wanted.alias("_to")), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col(RANGE) == F.col("_k")])
    own = F.struct(F.col(RANGE).alias("to"), F.lit(0).cast("long").alias("gap"), F.lit(True).alias("ahead"), F.lit(True).alias("core"))
    copies = F.filter("_to", lambda x: F.when(x["ahead"], x["gap"] + F.col("_left") <= before).otherwise(x["gap"] + F.col("_nth") <= after))
    each = seen.withColumn("_go", F.explode(F.concat(F.array(own), F.transform(copies, lambda x: F.struct(x["to"].alias("to"), x["gap"].alias("gap"), x["ahead"].alias("ahead"), F.lit(False).alias("core"))))))
    return each.select(*df.columns, F.col("_go.to").alias(RANGE), F.col("_go.core").alias(CORE)), Over(over.order, (*over.by, RANGE))


def core(df: DataFrame) -> DataFrame:
    """The rows themselves, without copies."""
    return df.where(CORE).drop(RANGE, CORE)


def with_running(df: DataFrame, over: Over, aggregates: dict[str, tuple[Column, str]], ranges: int | None = None) -> DataFrame:
    """``df`` with running values over each whole series, up to and with each row:
    name to (value, kind), kind ``sum``, ``max`` or ``min``; ``sum`` of 1 less 1 is
    the row's position.  A running value inside the range, and that of the ranges
    before it, one row a series and range."""
    ranges = ranges_of(df.count()) if ranges is None else ranges
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    by = list(over.by)
    dealt = in_ranges(df.where(F.col(over.order).isNotNull()), over.order, ranges, RANGE)
    dealt = dealt.select(*df.columns, RANGE, *[value.alias(f"_v_{name}") for name, (value, _) in aggregates.items()])
    inside = Window.partitionBy(*by, RANGE).orderBy(over.order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, RANGE).agg(*[kinds[k](f"_v_{name}").alias(f"_t_{name}") for name, (_, k) in aggregates.items()])
    base = totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col(RANGE).alias("_k"), *[kinds[k](f"_t_{name}").over(before).alias(f"_b_{name}") for name, (_, k) in aggregates.items()])
    met = dealt.join(base, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col(RANGE) == F.col("_k")])
    joined = {"sum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    made = [joined[k](kinds[k](f"_v_{name}").over(inside), F.col(f"_b_{name}")).alias(name) for name, (_, k) in aggregates.items()]
    return met.select(*df.columns, *made)


def positioned(df: DataFrame, over: Over, ranges: int | None = None) -> DataFrame:
    """``df`` with ``i``, each row's place in its series from 0."""
    return with_running(df, over, {"i": (F.lit(1).cast("long"), "sum")}, ranges).withColumn("i", F.col("i") - 1)
