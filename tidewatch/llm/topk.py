"""Exact top-k by inner product, by aggregation without random access.

Each component is a list of the candidates sorted by that component.  For a
query, a list is read from the end where the query's product with it is largest,
step by step.  What a list has shown of a candidate adds to its lower bound, which
starts from the list's far end and is kept from step to step; the list's last
value read bounds what it may still show.  Candidates whose upper bound is below
the k-th best lower bound are given up; reading stops once no more than a few are
left, and the rest of the lists is read for those alone, which gives their final
scores.

Candidates and queries are dealt in blocks of fixed size.  Blocks of candidates
are dealt over slots; a task meets one slot with blocks of queries, takes its
candidate blocks one after another, remembers each query's k best so far, and
leaves out a whole block where the ends of its lists cannot reach them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _arrow_schema

BLOCK = 4096
QUERIES = 1024
SLOT_BLOCKS = 16  # candidate blocks of one slot, about
DEPTHS = (0.7, 0.9)  # shares of each list read before each test
_FEW = 4  # times k: so many open candidates end the reading

def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` with v the components as floor(scale * x), x as double, kept
    as doubles: whole numbers of any size.

    Null vectors and ids, and vectors with null, NaN or infinite components, are
    left out; so are components whose product with ``scale`` no double holds.
    """
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    # NaN is larger than anything in Spark, and a null comparison is not true
    sound = F.col(vector_col).isNotNull() & F.forall(scaled, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))  # doubles from there on are whole
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v")).where(sound & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows packed to blocks of at most ``size``: (name, dim, ids binary, data
    binary).  Packing goes partition by partition, so nothing is sorted."""
    schema = f"{name} string, dim int, ids binary, kind string, data binary"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def pack(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            nonlocal n
            ids, vectors = held.pop(dim)
            n += 1
            data = np.concatenate(vectors)
            if np.abs(data).max(initial=0) < 1 << 53:
                data = data.astype(np.result_type(*(np.min_scalar_type(int(x)) for x in (data.min(initial=-1), data.max(initial=1)))))
            return pa.RecordBatch.from_pydict({name: [f"{part}-{n}"], "dim": [dim], "ids": [np.concatenate(ids).tobytes()], "kind": [data.dtype.str], "data": [data.tobytes()]}, schema=arrow)

        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                rows_of = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                while len(at):
                    have = held.setdefault(dim, ([], []))
                    room = size - sum(map(len, have[0]))
                    have[0].append(ids[at[:room]])
                    have[1].append(np.ascontiguousarray(rows_of[:room], np.float64))
                    full = room <= len(at)
                    at, rows_of = at[room:], rows_of[room:]
                    if full:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.select("vec_id", "v").mapInArrow(pack, schema)


def nra_block(queries: np.ndarray, candidates: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, list[int] | np.ndarray]]:
    """For each query the places and scores of all candidates that may be among
    its k best here: all whose score is at least the k-th best and at least
    ``least`` (the query's k-th best so far elsewhere; -inf: none).

    Both are matrices of whole numbers (any numpy kind) with equal columns.
    """
    n, dim = candidates.shape
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0)) * max(dim, 1)
    if largest >= 1 << 52:
        return [_plain(q, candidates, k) for q in queries]
    kind = np.float32 if largest < 1 << 23 else np.float64  # bounds and scores are exact whole numbers in it
    out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    if not n or not len(queries):
        return out
    keep = min(k, n)
    floor = np.full(len(queries), -np.inf) if least is None else least
    lists = np.sort(candidates, axis=0).astype(kind)
    low, high = lists[0], lists[-1]
    values = candidates.astype(kind)
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    live = np.flatnonzero(plus @ high + minus @ low >= floor)  # for the others the whole block is out of reach
    here = np.arange(n)  # candidates open for a live query
    lower = np.broadcast_to((plus @ low + minus @ high)[live, None], (len(live), n)).astype(kind)
    open_ = np.ones((len(live), n), bool)
    read_down, read_up = np.zeros((n, dim), bool), np.zeros((n, dim), bool)  # what the lists have shown, from their tops and their bottoms
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in DEPTHS:
        if not len(live) or len(here) <= _FEW * keep:
            break
        at = min(n - 1, int(n * depth))
        down, up = lists[n - 1 - at], lists[at]  # the last values read
        now_down, now_up = values[here] >= down, values[here] <= up
        p, m = plus[live], minus[live]
        lower += p @ np.where(now_down & ~read_down, values[here] - low, 0).T + m @ np.where(now_up & ~read_up, values[here] - high, 0).T
        read_down, read_up = now_down, now_up
        upper = lower + (p * (down - low)) @ (~read_down).T.astype(kind) + (m * (up - high)) @ (~read_up).T.astype(kind)
        bound = floor[live]
        if len(here) >= keep:
            bound = np.maximum(bound, np.partition(lower, len(here) - keep, axis=1)[:, len(here) - keep])
        floor[live] = bound
        open_ &= upper >= bound[:, None]
        ready = open_.sum(axis=1) <= _FEW * keep
        if ready.any():
            done.append((live[ready], here, open_[ready], lower[ready], (read_down, read_up)))
            live, open_, lower = live[~ready], open_[~ready], lower[~ready]
        wanted = open_.any(axis=0)
        here, open_, lower, read_down, read_up = here[wanted], open_[:, wanted], lower[:, wanted], read_down[wanted], read_up[wanted]
    if len(live):
        done.append((live, here, open_, lower, (read_down, read_up)))
    for queries_, places, open_rows, bounds, (shown_down, shown_up) in done:
        unread_down, unread_up = np.where(shown_down, 0, values[places] - low), np.where(shown_up, 0, values[places] - high)
        for q, row, bound in zip(queries_.tolist(), open_rows, bounds, strict=True):
            at = np.flatnonzero(row)  # the rest of the lists, for those still open
            scores = bound[at] + unread_down[at] @ plus[q] + unread_up[at] @ minus[q]
            if len(at) > keep:
                worst = np.partition(scores, len(at) - keep)[len(at) - keep]
                at, scores = at[scores >= worst], scores[scores >= worst]
            out[q] = (places[at], scores.astype(np.int64))
    return out


def _plain(q: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """The same by Python's integers, where doubles may not hold a bound."""
    own = [int(a) for a in q]
    scores = [sum(a * int(b) for a, b in zip(own, c, strict=True)) for c in candidates]
    worst = sorted(scores, reverse=True)[min(k, len(scores)) - 1] if scores else 0
    at = [j for j, s in enumerate(scores) if s >= worst]
    return np.array(at, np.int64), [scores[j] for j in at]


def _beyond(score: int) -> tuple[int, int | None, bytes | None]:
    """(side, score, rest) that sort as the score: side is 0 and rest null where
    64 bits hold it, else 1 or -1 and its digits in base 256 (of the negative ones
    the complement), longer numbers further out."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, None
    size = abs(score).bit_length() + 7 >> 3
    digits = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, None, digits) if score > 0 else (-1, None, bytes(255 - b for b in digits))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates but
    itself; ties go to the smaller vec_id; all candidates if they are fewer.

    Both inputs are :func:`quantised`.  A query meets the candidates of its own
    dimension only.  Repeated candidate rows count each; repeated query rows are
    one query (equal ids: the row with the smallest vector).  A score that 64 bits
    do not hold is null, in its right place.  Empty tables give an empty result.
    """
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    q = _blocks(one.select("vec_id", "v"), QUERIES, "q_block")
    c = _blocks(candidates, BLOCK, "c_block")
    # Candidate blocks are dealt over slots, and each query block goes to every slot: an equi-join of whole blocks.
    slots = plan_width(candidates.count(), queries.sparkSession.sparkContext.defaultParallelism)
    c = c.withColumn("slot", F.pmod(F.hash("c_block"), F.lit(slots))).repartition(slots, "dim", "slot")
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(slots, "dim", "slot")
    pairs = q.withColumnsRenamed({"ids": "q_ids", "data": "q_data", "kind": "q_kind"}).join(c, ["dim", "slot"])
    schema = "query_id long, vec_id long, side int, score long, rest binary"
    arrow = _arrow_schema(queries.sparkSession, schema)

    def work(batches):
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # by query block: each query's k best scores so far here
        for batch in batches:
            for block, dim, q_ids, q_kind, q_data, ids, kind, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                qv, cv = (np.frombuffer(d, t).reshape(n, dim) for d, t, n in ((q_data, q_kind, len(qi)), (data, kind, len(ci))))
                if block not in best:
                    best = {block: np.full((len(qi), k), -np.inf)}  # rows of one query block come one after another, or are met anew
                tops = best[block]
                # As many more are kept as the query's own id has rows here; queries alike in that go together.
                own = np.searchsorted(ids_sorted := np.sort(ci), qi, "right") - np.searchsorted(ids_sorted, qi, "left")
                found: tuple[list, ...] = ([], [], [], [], [])
                for n in np.unique(own).tolist():
                    alike = np.flatnonzero(own == n)
                    for place, (at, scores) in zip(alike.tolist(), nra_block(qv[alike], cv, k + n, tops[alike, 0].copy()), strict=True):
                        others = ci[at] != qi[place]
                        if isinstance(scores, list):  # exact scores of any size
                            order = sorted((-s, v) for s, v, o in zip(scores, ci[at].tolist(), others.tolist(), strict=True) if o)[:k]
                            sides = [_beyond(-s) for s, _ in order]
                            parts = [v for _, v in order], *([x[j] for x in sides] for j in range(3))
                        else:
                            at, scores = at[others], scores[others]
                            order = np.lexsort((ci[at], -scores))[:k]
                            at, scores = at[order], scores[order]
                            tops[place] = np.sort(np.concatenate((tops[place], scores)))[-k:]
                            parts = ci[at].tolist(), [0] * len(at), scores.tolist(), [None] * len(at)
                        found[0].extend([int(qi[place])] * len(parts[0]))
                        for to, values in zip(found[1:], parts, strict=True):
                            to.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    ordered = pairs.select("q_block", "dim", "q_ids", "q_kind", "q_data", "ids", "kind", "data").sortWithinPartitions("q_block")
    got = ordered.mapInArrow(work, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("rest"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible_queries(vectors: DataFrame, by: int, k: int = 20, scale: int = 64) -> DataFrame:
    """The k best for the rows whose id is divisible by ``by``, among all rows."""
    rows = quantised(vectors, scale)
    return exact_top_k(rows.where(F.col("vec_id") % by == 0), rows, k)


def plan_width(rows: int, tasks: int = 1, block: int = BLOCK) -> int:
    """Slots over which the candidate blocks of so many rows are dealt: of
    ``SLOT_BLOCKS`` blocks, or fewer where there are more tasks than slots."""
    blocks = max(1, math.ceil(rows / block))
    return max(math.ceil(blocks / SLOT_BLOCKS), min(blocks, 2 * tasks))
