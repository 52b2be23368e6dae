"""Overlap joins of intervals, overlap counts and purging.

An interval's level is the smallest at which a bucket (its width doubles with the
level) is at least as long, so it touches two buckets of its level at most.  It is
at home there, and a guest in the buckets that it touches at the coarser levels
that the other side has.  Two intervals meet at the coarser of their levels, where
one at least is at home: guests never meet guests.  Of the buckets that both touch
the one that holds the later start gives the pair, so each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch
from .asof import asof_join, in_ranges

SALTS = 16


def _sound(df: DataFrame, by: tuple[str, ...], start: str, end: str) -> Column:
    out = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    for c in by:
        out = out & F.col(c).isNotNull()
    return out


def _level(start: Column, end: Column, width: int) -> Column:
    length = (end - start + 1).cast("double") / width
    return F.when(length <= 1, 0).otherwise(F.ceil(F.log2(length) - 1e-9)).cast("int")


def _size(level: Column, width: int) -> Column:
    return F.pow(F.lit(2.0), level).cast("long") * width


def _buckets(level: Column, start: Column, end: Column, width: int) -> Column:
    size = _size(level, width)
    return F.sequence(F.floor(start / size), F.floor(end / size))


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, by: tuple[str, ...] = (), width: int | None = None, salts: int = SALTS) -> DataFrame:
    """All pairs of ``left`` and ``right`` rows of equal ``by`` whose closed
    intervals [start, end] of whole numbers (long) overlap, each once: structs
    ``a`` and ``b``.

    ``width``: that of the finest buckets (None: half of left's intervals are no
    longer).  Left rows are dealt over ``salts`` parts and right rows go to each,
    in buckets that hold more than ``salts`` times the mean number of rows, so no
    bucket is one task's.  Intervals with a null end or key, or ended before their
    start, overlap nothing; repeated rows give a pair each.
    """
    if width is None:
        middle = left.where(_sound(left, by, start, end)).agg(F.percentile_approx(F.col(end) - F.col(start) + 1, 0.5)).first()[0]
        width = max(1, int(middle or 1))
    a, b = (_placed(df, name, by, start, end, width) for df, name in ((left, "a"), (right, "b")))
    levels = a.select("level").union(b.select("level")).distinct()  # 64 at most
    levels = levels.agg(F.collect_set("level").alias("levels"))
    sides = []
    for df in (a, b):
        each = df.join(F.broadcast(levels), how="cross").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
        each = each.withColumn("bucket", F.explode(_buckets(F.col("at"), F.col("s"), F.col("e"), width)))
        sides.append((each.where("at = level"), each.where("at > level")))
    (home_a, guest_a), (home_b, guest_b) = sides
    key = [*(f"k{i}" for i in range(len(by))), "at", "bucket"]
    out = None
    for x, y in ((home_a, home_b), (home_a, guest_b), (guest_a, home_b)):
        pairs = _salted(x, y, key, salts)
        later = F.floor(F.greatest("s_a", "s_b") / _size(F.col("at"), width))
        pairs = pairs.where((F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a")) & (F.col("bucket") == later)).select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _placed(df: DataFrame, name: str, by: tuple[str, ...], start: str, end: str, width: int) -> DataFrame:
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    return df.where(_sound(df, by, start, end)).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *keys, s.alias("s"), e.alias("e"), _level(s, e, width).alias("level"))


def _salted(x: DataFrame, y: DataFrame, key: list[str], salts: int) -> DataFrame:
    """``x`` join ``y`` on ``key``; rows of x in hot buckets are dealt over parts
    by hash, those of y in the same buckets go to each part."""
    x = x.select(*key, "a", F.col("s").alias("s_a"), F.col("e").alias("e_a"))
    y = y.select(*key, "b", F.col("s").alias("s_b"), F.col("e").alias("e_b"))
    if salts <= 1:
        return x.join(y, key)
    counts = x.groupBy(*key).count()
    mean = counts.agg(F.avg("count").alias("mean"))  # one row
    hot = counts.join(F.broadcast(mean), how="cross").where(F.col("count") > salts * F.col("mean")).select(*key, F.lit(True).alias("hot"))
    # fewer than one bucket in ``salts`` is hot; both sides learn it by a join on the bucket
    x = x.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
    y = y.join(hot, key, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return x.join(y, [*key, "salt"]).drop("salt")


def overlap_counts(left: DataFrame, right: DataFrame, start: str, end: str, by: tuple[str, ...] = (), name: str = "n_overlaps") -> DataFrame:
    """``left`` with the number of ``right`` intervals (of equal ``by``) that each
    overlaps, without making the pairs: those begun by its end less those ended
    before its start.

    Begins and ends become running counts over ranges of time, and each row reads
    them as of its own two times.  Rows that overlap nothing by rule have 0.
    """
    scratch = Scratch(left.sparkSession)
    sound = right.where(_sound(right, by, start, end))
    starts = running_count(sound, start, by, "_begun")
    ends = running_count(sound, end, by, "_ended")
    numbered = left.withColumns({"_ok": F.coalesce(_sound(left, by, start, end), F.lit(False)), "_to": F.col(end).cast("long"), "_from": F.col(start).cast("long")})
    met = asof_join(numbered, starts.withColumnRenamed(start, "_to"), "_to", by, take=("_begun",), scratch=scratch).drop("_to_right")
    met = asof_join(met, ends.withColumnRenamed(end, "_from"), "_from", by, take=("_ended",), strict=True, scratch=scratch).drop("_from_right")
    n = F.coalesce("_begun", F.lit(0)) - F.coalesce("_ended", F.lit(0))
    return met.withColumn(name, F.when(F.col("_ok"), n).otherwise(0).cast("long")).drop("_ok", "_to", "_from", "_begun", "_ended")


def running_count(df: DataFrame, time: str, by: tuple[str, ...] = (), name: str = "n") -> DataFrame:
    """``by, time, name``: for each distinct time how many rows are at or before
    it, by sums of ranges and running sums inside them."""
    each = df.groupBy(*by, F.col(time).cast("long").alias(time)).agg(F.count(F.lit(1)).alias("_n"))
    placed = in_ranges(Scratch(df.sparkSession).save(each, "times"), time)
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(time))
    sums = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(*by, "_range", before.alias("_base"))  # a row for each key and range
    return placed.join(base, [*by, "_range"]).select(*by, time, (inside + F.col("_base")).alias(name))


def merged(intervals: DataFrame, start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, start, end``: the union of the intervals of each key as disjoint ones;
    those that share a point are one.  The furthest end so far runs over ranges of
    time, with each range's own furthest handed on."""
    scratch = Scratch(intervals.sparkSession)
    each = intervals.where(_sound(intervals, by, start, end)).groupBy(*by, F.col(start).cast("long").alias("_s")).agg(F.max(F.col(end).cast("long")).alias("_e"))
    each = scratch.save(each, "starts")
    placed = in_ranges(each, "_s")
    w = Window.partitionBy(*by, "_range").orderBy("_s")
    ranges = placed.groupBy(*by, "_range").agg(F.max("_e").alias("_far"))
    far = F.max("_far").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    known = placed.join(ranges.select(*by, "_range", far.alias("_base")), [*by, "_range"])
    before = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_base")
    upto = F.greatest(F.max("_e").over(w), "_base")
    opens = known.select(*by, "_range", "_s", (before.isNull() | (F.col("_s") > before)).alias("_opens"), upto.alias("_upto"))
    # An island ends with the furthest end before the next one opens.
    heads = opens.where("_opens").select(*by, F.col("_s").alias("_head"))
    named = asof_join(opens.select(*by, "_s", "_upto"), heads, "_s", by, right_on="_head", take=(), scratch=scratch).groupBy(*by, "_s_right").agg(F.max("_upto").alias("_end"))
    return named.select(*by, F.col("_s_right").alias(start), F.col("_end").alias(end))


def purged(rows: DataFrame, tests: DataFrame, start: str, end: str, by: tuple[str, ...] = (), embargo: int = 0) -> DataFrame:
    """``rows`` whose label interval [start, end] overlaps no interval of
    ``tests``, these made longer by ``embargo`` on both sides: the purge of
    training rows by time instead of position, right for series of unequal
    calendars.  Rows without a sound interval are kept."""
    wider = tests.select(*by, (F.col(start).cast("long") - embargo).alias(start), (F.col(end).cast("long") + embargo).alias(end))
    islands = merged(wider, start, end, by).select(*by, F.col(start).alias("_open"), F.col(end).alias("_shut"))
    asked = rows.withColumn("_until", F.col(end).cast("long"))
    met = asof_join(asked, islands, "_until", by, right_on="_open", take=("_shut",), scratch=Scratch(rows.sparkSession))
    hit = F.coalesce((F.col("_shut") >= F.col(start)) & _sound(rows, by, start, end), F.lit(False))
    return met.where(~hit).drop("_until", "_until_right", "_shut")


def uniqueness(labels: DataFrame, start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``labels`` with ``uniqueness``: the mean, over the whole numbers from start
    to end, of one divided by the number of labels (of equal ``by``) that cover
    it; null where there is no sound interval."""
    sound = labels.where(_sound(labels, by, start, end))
    edges = sound.select(*by, F.inline(F.array(F.struct(F.col(start).cast("long").alias("_t"), F.lit(1).alias("_d")), F.struct((F.col(end).cast("long") + 1).alias("_t"), F.lit(-1).alias("_d")))))
    scratch = Scratch(labels.sparkSession)
    each = in_ranges(scratch.save(edges.groupBy(*by, "_t").agg(F.sum("_d").alias("_d")), "edges"), "_t")
    within, across = Window.partitionBy(*by, "_range").orderBy("_t"), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # from each edge to the next: how many cover it, and the area up to it, both by running sums within a range and the sums of earlier ranges
    sums = each.groupBy(*by, "_range").agg(F.sum("_d").alias("_sum"), F.min("_t").alias("_first"))
    base = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"), F.lead("_first").over(Window.partitionBy(*by).orderBy("_range")).alias("_next"))
    level = each.join(base, [*by, "_range"]).select(*by, "_range", "_t", (F.col("_base") + F.sum("_d").over(within)).alias("_level"), F.coalesce(F.lead("_t").over(within), "_next").alias("_till"))
    area = F.when(F.col("_level") > 0, (F.col("_till") - F.col("_t")) / F.col("_level")).otherwise(0.0)
    areas = scratch.save(level.withColumn("_area", F.coalesce(area, F.lit(0.0))), "areas")
    whole = areas.groupBy(*by, "_range").agg(F.sum("_area").alias("_sum"))
    before = whole.select(*by, "_range", F.coalesce(F.sum("_sum").over(across), F.lit(0.0)).alias("_base"))
    upto = areas.join(before, [*by, "_range"]).select(*by, "_t", (F.col("_base") + F.coalesce(F.sum("_area").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("_upto"))
    asked = labels.withColumns({"_ok": F.coalesce(_sound(labels, by, start, end), F.lit(False)), "_from": F.col(start).cast("long"), "_to": F.col(end).cast("long") + 1})
    met = asof_join(asked, upto.withColumnsRenamed({"_t": "_from", "_upto": "_a"}), "_from", by, take=("_a",), scratch=scratch).drop("_from_right")
    met = asof_join(met, upto.withColumnsRenamed({"_t": "_to", "_upto": "_b"}), "_to", by, take=("_b",), scratch=scratch).drop("_to_right")
    return met.withColumn("uniqueness", F.when(F.col("_ok"), (F.col("_b") - F.col("_a")) / (F.col("_to") - F.col("_from")))).drop("_ok", "_from", "_to", "_a", "_b")
