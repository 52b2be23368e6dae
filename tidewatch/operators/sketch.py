"""Quantiles by mergeable sketches with a rank error that each sketch knows.

A sketch is levels of values; those of level h stand for 2**h rows each.  A level
that outgrows ``k`` values is sorted and every other one goes up, from the first or
the second by turns, so a rank moves by at most the weight of one value each time:
the sum of those weights is the sketch's own bound.  Sketches merge by joining their
levels, and their bounds add.

Long trailing frames are answered from a dyadic tree: blocks of rows have sketches,
two neighbours merge to one of the next level, and a frame is its own block's rows
and those of the block it begins in, exactly, and a few tree nodes between.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate
from ..functions.windows import Over
from ..session import ship
from ..sources.scratch import Scratch
from .spread import positioned, with_running

K = 256
BLOCK = 512  # rows of a block
HALOS = 10  # frames of a block whose ranks are counted together


@dataclass
class Sketch:
    k: int = K
    levels: list = field(default_factory=lambda: [np.zeros(0)])
    bound: int = 0  # how far a rank may be off, in rows
    turn: int = 0

    def add(self, values) -> Sketch:
        values = np.asarray(values, float)
        self.levels[0] = np.concatenate((self.levels[0], values[~np.isnan(values)]))
        return self._settle()

    def merge(self, other: Sketch) -> Sketch:
        out = Sketch(self.k, [np.zeros(0)] * max(len(self.levels), len(other.levels)), self.bound + other.bound, self.turn ^ other.turn)
        for own in (self.levels, other.levels):
            for h, v in enumerate(own):
                out.levels[h] = np.concatenate((out.levels[h], v))
        return out._settle()

    def _settle(self) -> Sketch:
        h = 0
        while h < len(self.levels):
            v = self.levels[h]
            if len(v) > self.k:
                v = np.sort(v)
                kept, v = v[len(v) // 2 * 2 :], v[: len(v) // 2 * 2]  # an odd one out stays
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[h] = kept
                self.levels[h + 1] = np.concatenate((self.levels[h + 1], v[self.turn :: 2]))
                self.turn ^= 1
                self.bound += 1 << h
            h += 1
        return self

    @property
    def n(self) -> int:
        return sum(len(v) << h for h, v in enumerate(self.levels))

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.levels), np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])


def quantile_of(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The value at rank q * (n - 1), from 0, of values with weights."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(ends, q * (ends[-1] - 1), "right")])


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], k: int = K) -> DataFrame:
    """``keys, quantiles, n, rank_error`` of each key's values that are neither
    null nor NaN, in two phases: every task sketches its own rows, and only
    sketches are shuffled.  The true ranks are at most ``rank_error`` rows off."""

    def finish(s: Sketch):
        return ([quantile_of(*s.weighted(), q) for q in shares] if s.n else [], s.n, s.bound)

    return Aggregate(lambda: Sketch(k), lambda s, pdf: s.add(pdf[value]), Sketch.merge, finish, "quantiles array<double>, n long, rank_error long").over(df, keys, [value])


def trailing_quantile(df: DataFrame, value: str, q: float, n: int, over: Over, k: int = K, block: int = BLOCK) -> DataFrame:
    """``df`` with ``quantile`` and ``rank_error``: the q-quantile of the last n
    values, this row's too, where all of them are there, else null; the true rank of
    the value in its frame is at most ``rank_error`` rows from q * (n - 1).

    ``n`` is a multiple of ``block``.  A series of any length lies over blocks;
    nulls and NaN make a frame incomplete, rows need a total order.  Blocks and
    sketches go to scratch tables.
    """
    import pandas as pd

    if n % block or n < block:
        raise ValueError("the frame is a multiple of the block")
    by, spark = list(over.by), df.sparkSession
    ship(spark)
    own = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    rows = positioned(df.where(F.col(over.order).isNotNull()), over).withColumn("_block", F.floor(F.col("i") / block))
    scratch = Scratch(spark)
    listed = rows.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("i", F.col(value).cast("double").alias("x")))).alias("rows")).select(*by, "_block", F.transform("rows", lambda r: F.coalesce(r["x"], F.lit(float("nan")))).alias("xs"))
    listed = scratch.save(listed, "blocks")

    def leaf(parts):
        for pdf in parts:
            pdf["sketch"] = [pickle.dumps(Sketch(k).add(x)) for x in pdf["xs"]]
            pdf["missing"] = [int(np.isnan(np.asarray(x, float)).sum()) for x in pdf["xs"]]
            pdf["level"] = 0
            yield pdf.rename(columns={"_block": "node"})[[*by, "level", "node", "sketch", "missing"]]

    def merged(parts):
        for pdf in parts:
            made = [[pickle.loads(x) for x in row] for row in pdf["sketches"]]  # noqa: S301  made by our own tasks
            pdf["sketch"] = [pickle.dumps(x[0] if len(x) == 1 else x[0].merge(x[1])) for x in made]
            yield pdf[[*by, "level", "node", "sketch", "missing"]]

    def paired(level: DataFrame) -> DataFrame:
        two = level.groupBy(*by, "level", F.floor(F.col("node") / 2).alias("_up")).agg(F.sort_array(F.collect_list(F.struct("node", "sketch"))).alias("two"), F.sum("missing").alias("missing"))
        return two.select(*by, (F.col("level") + 1).alias("level"), F.col("_up").alias("node"), F.col("two.sketch").alias("sketches"), "missing").mapInPandas(merged, schema)

    schema = f"{own}level int, node long, sketch binary, missing long"
    level = nodes = scratch.save(listed.mapInPandas(leaf, schema), "level0")
    inner = n // block - 1  # whole blocks between the one a frame begins in and its own
    h = 0
    while 2 << h <= inner:
        level = scratch.save(paired(level), f"level{h + 1}")
        nodes, h = nodes.unionByName(level), h + 1
    # The largest aligned nodes that make up the blocks between, for each block.
    cover = spark.createDataFrame([(r, *c) for r in range(1 << h) for c in _cover(r, inner, h)], "r long, level int, back long")
    asks = listed.select(*by, "_block").withColumn("r", F.col("_block") % (1 << h)).join(F.broadcast(cover), "r")  # at most 2 h rows a remainder
    asks = asks.where("_block >= back").withColumn("node", ((F.col("_block") - F.col("back")) / F.pow(F.lit(2), F.col("level"))).cast("long"))
    met = asks.alias("a").join(nodes.alias("b"), [*(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by), F.col("a.level") == F.col("b.level"), F.col("a.node") == F.col("b.node")])
    middle = met.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a._block").alias("_block")).agg(F.collect_list("b.sketch").alias("sketches"), F.sum("b.missing").alias("missing"))
    first = listed.select(*by, (F.col("_block") + inner + 1).alias("_block"), F.col("xs").alias("begun"))
    both = listed.where(F.col("_block") >= inner).alias("x").join(first.alias("f"), [*(F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by), F.col("x._block") == F.col("f._block")], "left")
    both = both.select(*[F.col(f"x.{c}").alias(c) for c in by], F.col("x._block").alias("_block"), "xs", "begun")
    both = both.alias("x").join(middle.alias("m"), [*(F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by), F.col("x._block") == F.col("m._block")], "left")
    both = both.select(*[F.col(f"x.{c}").alias(c) for c in by], F.col("x._block").alias("_block"), "xs", "begun", "sketches", "missing")

    def answer(parts):
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                xs, none = np.asarray(row["xs"], float), row["begun"] is None  # the first full frame begins with its block
                begun = np.full(block, np.nan) if none else np.asarray(row["begun"], float)
                whole = Sketch(k)
                for s in row["sketches"] if row["sketches"] is not None else ():
                    whole = whole.merge(pickle.loads(s))  # noqa: S301
                gone = row["missing"] is not None and row["missing"] == row["missing"] and row["missing"] > 0
                if gone:
                    continue
                got, full = _slid(*whole.weighted(), np.concatenate((begun[1:], xs)), block, q)
                out.append(pd.DataFrame({**{c: row[c] for c in by}, "i": row["_block"] * block + np.flatnonzero(full), "quantile": got[full], "rank_error": whole.bound}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*by, "i", "quantile", "rank_error"])

    told = both.repartition(_tasks(spark)).mapInPandas(answer, f"{own}i long, quantile double, rank_error long")
    return rows.alias("x").join(told.alias("t"), [*(F.col(f"x.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by), F.col("x.i") == F.col("t.i")], "left").select(*[F.col(f"x.`{c}`") for c in df.columns], "t.quantile", "t.rank_error")


def _tasks(spark: SparkSession) -> int:
    """As many tasks as a shuffle makes: few bytes may be much work here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _slid(values: np.ndarray, weights: np.ndarray, edge: np.ndarray, block: int, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The q-quantile of weighted values and, in turn, each ``block`` neighbours of
    ``edge``, and where none of those is NaN: one sort for all of them."""
    m = len(edge) - block + 1
    held = np.concatenate((values, edge))
    order = np.argsort(held, kind="stable")
    at = np.arange(len(edge)) - np.arange(m)[:, None]
    each = np.hstack((np.broadcast_to(weights, (m, len(weights))), (at >= 0) & (at < block)))[:, order]
    ends = np.cumsum(each, axis=1)
    got = held[order][(ends > q * (ends[:, -1:] - 1)).argmax(axis=1)]
    lost = np.cumsum(np.append(0, np.isnan(edge)))
    return got, lost[block:] == lost[:m]


def frame_ranks(df: DataFrame, value: str, at: str, n: int, over: Over) -> DataFrame:
    """``df`` with ``below`` and ``upto``: how many of the last n values, this row's
    too, are below the column ``at``, and how many are not above it, exactly; null
    where ``at`` or one of the values is not there.

    A series of any length lies over blocks with the n - 1 rows before them; rows
    need a total order.
    """
    size = HALOS * n
    placed = with_running(df, over, {"_i": (F.lit(1).cast("long"), "sum")}).withColumn("_block", F.floor((F.col("_i") - 1) / size))
    seen = F.array("_block", F.col("_block") + 1)  # the last rows of a block are seen by the next one, too
    rows = placed.withColumn("_by", F.explode(F.when((F.col("_i") - 1) % size > size - n, seen).otherwise(F.array("_block"))))
    keys = [*over.by, "_by"]
    schema = T.StructType([*df.schema.fields, T.StructField("below", T.LongType()), T.StructField("upto", T.LongType())])
    columns = df.columns

    def count(table):
        import pyarrow as pa

        table = table.sort_by("_i")
        x, wanted = (table[c].cast(pa.float64()).to_numpy() for c in (value, at))
        below, upto = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        known = np.zeros(len(x), bool)
        if len(x) >= n:
            lost = np.cumsum(np.append(0, np.isnan(x)))
            known[n - 1 :] = (lost[n:] == lost[:-n]) & ~np.isnan(wanted[n - 1 :])
            frames = np.lib.stride_tricks.sliding_window_view(x, n)
            for k in range(0, len(frames), step := max(1, (1 << 22) // n)):
                here, most = slice(n - 1 + k, n - 1 + k + step), wanted[n - 1 + k : n - 1 + k + step, None]
                below[here], upto[here] = (frames[k : k + step] < most).sum(axis=1), (frames[k : k + step] <= most).sum(axis=1)
        own = table["_block"].to_numpy() == table["_by"].to_numpy()
        out = table.select(columns)
        for name, c in (("below", below), ("upto", upto)):
            out = out.append_column(name, pa.array(c, mask=~known))
        return out.filter(pa.array(own))

    return rows.repartition(_tasks(df.sparkSession), *keys).groupBy(*keys).applyInArrow(count, schema)


def _cover(r: int, inner: int, most: int) -> list[tuple[int, int]]:
    """(level, blocks back) of aligned nodes that make up the ``inner`` blocks
    before a block whose number leaves ``r`` when divided by 2**most."""
    out, at, end = [], r - inner, r
    while at < end:
        h = 0
        while h < most and at % (2 << h) == 0 and at + (2 << h) <= end:
            h += 1
        out.append((h, r - at))
        at += 1 << h
    return out
