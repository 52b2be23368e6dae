"""Approximate nearest neighbours: NN-descent builds a graph, greedy search walks it.

*Points.*  Rows with equal vectors are one node.  Nodes get one more component, so
that all have one length and the graph's nearness goes with the inner product
whatever the vectors' norms; they are kept as bytes with a scale.

*First graph.*  A few random-projection trees, fitted on a bounded sample, deal all
nodes to leaves; a leaf is cut into pieces of about ``LEAF`` nodes by hash, however
many it has, and each node's best of its pieces are its first neighbours.

*NN-descent.*  In each round every node gathers its neighbours and a sample of the
nodes that have it as one; among those, pairs with a new link are scored, and both
hear of the other if it beats the worst that they have.  Each round is one join of
links with points and one merge, written to the shared folder.  Rounds end when few
links change.

*Search.*  Each query holds a pool of its best nodes so far, begins at its own node
and at those of the largest norm, and expands the best ones not yet expanded, all
queries at once, by joining them with the nodes' neighbourhoods (a bucketed table,
which no round shuffles again), until its pool holds none.  The best of the pool are
scored on the original vectors.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, _arrow_schema, tidy_shuffles

NEIGHBOURS = 32  # links of a node
REVERSE = 32  # links to a node that are gathered with its own
TREES, LEAF = 4, 512
SAMPLE = 8192  # nodes, those of the smallest hashes, that trees are fitted on
OFFERED = 6  # partners that a node may hear of from one gathering
SETTLED, ROUNDS = 0.22, 12  # share of new links at which rounds end; rounds at most
POOL, EXPANDED, STEPS = 320, 64, 32  # nodes of a query's pool; expanded at once; steps at most
STARTS = 16  # nodes of the largest norm that each search knows from the start
RESCORED = 3  # times k: nodes of the pool that are scored exactly


def sound(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) without null ids, and vectors that are null or zero
    or hold null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is larger than anything
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """``node, v, members``: distinct vectors, each with its k + 1 smallest ids and
    their rows, which is all that a result of k can hold of it."""
    by_id = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    first = by_id.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("members")).select(F.monotonically_increasing_id().alias("node"), "v", "members")


def _length(v: Column, by: float) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / by) * (x / by)))


def _points(nodes: DataFrame) -> DataFrame:
    """``node, dim, norm, code, scale``: unit vectors of dim + 1 components as
    signed bytes times a scale; norm is the node's share of the largest."""
    largest = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    longest = nodes.agg(F.max(_length(F.col("v"), largest))).first()[0] or 1.0
    schema = "node long, dim int, norm float, code binary, scale float"
    arrow = _arrow_schema(nodes.sparkSession, schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths, ids = np.diff(lists.offsets.to_numpy()), batch.column(0).to_numpy()
            flat, ends = lists.flatten().to_numpy() / largest / longest, np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                square = (x * x).sum(axis=1)
                y = np.column_stack((x, np.sqrt(np.maximum(0, 1 - square))))
                scale = np.abs(y).max(axis=1) / 127
                code = np.rint(y / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids[at], np.full(len(at), dim), np.sqrt(square), [r.tobytes() for r in code], scale), arrow, strict=True)], schema=arrow)

    return nodes.select("node", "v").mapInArrow(run, schema)


def _matrix(codes: pa.Array, scales: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(-1, width)
    return raw.astype(np.float32) * scales.to_numpy(zero_copy_only=False).astype(np.float32)[:, None]


def fit_tree(y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a tree's inner nodes in breadth-first order: each
    direction leads from one of its rows to another, the cut is the median."""
    inner = (1 << depth) - 1
    ways, cuts, parts = np.zeros((inner, y.shape[1]), np.float32), np.zeros(inner, np.float32), [np.arange(len(y))]
    for i in range(inner):
        part = parts[i]
        if len(part) > 1:
            a, b = rng.choice(part, 2, replace=False)
            ways[i] = y[a] - y[b]
            along = y[part] @ ways[i]
            cuts[i] = np.median(along)
            right = along > cuts[i]
            parts += [part[~right], part[right]]
        else:
            parts += [part, part[:0]]
    return ways, cuts


def leaf_of(y: np.ndarray, ways: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.zeros(len(y), np.int64)
    for _ in range(len(cuts).bit_length()):
        at = 2 * at + 1 + ((y * ways[at]).sum(axis=1) > cuts[at])
    return at - len(cuts)


def _first_links(points: DataFrame) -> DataFrame:
    """``node, id, score`` from the pieces of the trees' leaves."""
    spark = points.sparkSession
    sizes = dict(points.groupBy("dim").count().collect())
    sample = points.orderBy(F.xxhash64("node")).limit(SAMPLE).select("dim", "code", "scale").toArrow()
    forest = {}
    for dim in set(sample.column("dim").to_pylist()):
        own = sample.filter(pa.compute.equal(sample.column("dim"), dim)).combine_chunks()
        y = _matrix(own.column("code"), own.column("scale"), dim + 1)
        depth = max(0, min(int(np.ceil(np.log2(sizes[dim] / LEAF))), int(np.log2(max(1, len(y) / 16)))))
        rng = np.random.default_rng(dim)
        forest[dim] = [fit_tree(y, depth, rng) for _ in range(TREES)]
    shared = spark.sparkContext.broadcast(forest)  # at most TREES trees of SAMPLE / 16 leaves for each width in the sample
    schema = "tree int, leaf long, dim int, node long, code binary, scale float"
    arrow = _arrow_schema(spark, schema)

    def deal(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for dim in t.column("dim").unique().to_pylist():
                own = t.filter(pa.compute.equal(t.column("dim"), dim)).combine_chunks()
                y = _matrix(own.column("code"), own.column("scale"), dim + 1)
                none = np.zeros((0, dim + 1), np.float32), np.zeros(0, np.float32)
                for k, tree in enumerate(shared.value.get(dim, [none] * TREES)):
                    made = [pa.array(np.full(len(y), k, np.int32)), pa.array(leaf_of(y, *tree)), *(own.column(c) for c in ("dim", "node", "code", "scale"))]
                    yield from pa.Table.from_arrays(made, schema=arrow).to_batches()

    dealt = points.select("node", "dim", "code", "scale").mapInArrow(deal, schema)
    pieces = dealt.groupBy("dim", "tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("pieces"))
    dealt = dealt.join(pieces, ["dim", "tree", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("node", "tree"), F.col("pieces")))

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        y = _matrix(table.column("code"), table.column("scale"), table.column("dim")[0].as_py() + 1)
        score = y @ y.T
        np.fill_diagonal(score, -np.inf)
        keep = min(NEIGHBOURS, len(ids) - 1)
        at = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(ids), 0), np.int64)
        return pa.table({"node": np.repeat(ids, keep), "id": ids[at].ravel(), "score": np.take_along_axis(score, at, 1).ravel()})

    return dealt.groupBy("dim", "tree", "leaf", "piece").applyInArrow(best, "node long, id long, score float")


def _best_links(links: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of ``links`` (node, id, score, old) of each node; ``old``
    ones stay so."""
    once = links.repartition("node").groupBy("node", "id").agg(F.max("score").alias("score"), F.max("old").alias("old"))
    w = Window.partitionBy("node").orderBy(F.desc("score"), "id")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")


def _gathered(graph: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """``centre, member, old, code, scale``: each node's links and a sample of the
    links to it, with the members' points."""
    own = graph.select(F.col("node").alias("centre"), F.col("id").alias("member"), "old")
    to = graph.select(F.col("id").alias("centre"), F.col("node").alias("member"), "old")
    w = Window.partitionBy("centre").orderBy(F.xxhash64("member", F.lit(seed)))
    some = to.withColumn("r", F.row_number().over(w)).where(F.col("r") <= REVERSE).drop("r")
    return own.union(some).join(points, "member")


def _whole_groups(batches):
    """Tables in which every group of the first column's rows, sorted, is whole."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        key = t.column(0).to_numpy()
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0
        held = t.slice(end)
        if end:
            yield t.slice(0, end).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _places(key: np.ndarray) -> np.ndarray:
    """Row numbers of each group of a sorted key, padded with -1."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    at = np.arange(size.max())[None] + first[:, None]
    return np.where(np.arange(size.max())[None] < size[:, None], at, -1)


def _heard(graph: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """``node, id, score`` of pairs gathered at one node that may better a link."""
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) == NEIGHBOURS, F.min("score")).otherwise(float("-inf")).alias("worst"))
    members = points.join(worst, "node", "left").select(F.col("node").alias("member"), "dim", "code", "scale", F.coalesce("worst", F.lit(float("-inf"))).cast("float").alias("worst"))
    schema = "node long, id long, score float"
    arrow = _arrow_schema(graph.sparkSession, schema)

    def run(batches):
        for t in _whole_groups(batches):
            key, ids, old, dims, worst_of = (t.column(c).to_numpy() for c in ("centre", "member", "old", "dim", "worst"))
            for dim in np.unique(dims).tolist():
                pick = np.flatnonzero(dims == dim)
                part = t.take(pick).combine_chunks() if len(pick) < len(dims) else t
                y = np.vstack((_matrix(part.column("code"), part.column("scale"), dim + 1), np.zeros((1, dim + 1), np.float32)))
                who, was, floor = np.r_[ids[pick], -1], np.r_[old[pick], True], np.r_[worst_of[pick], np.inf]
                places = _places(key[pick])
                for a in range(0, len(places), 128):
                    at = places[a : a + 128]
                    v, b = y[at], who[at]
                    score = v @ v.transpose(0, 2, 1)
                    use = (b[:, :, None] != b[:, None, :]) & (b[:, None, :] >= 0) & ~(was[at][:, :, None] & was[at][:, None, :]) & (score > floor[at][:, :, None])
                    score[~use] = -np.inf
                    top = min(OFFERED, score.shape[2])
                    best = np.argpartition(-score, top - 1, axis=2)[:, :, :top]
                    got = np.take_along_axis(score, best, 2)
                    good = got > -np.inf
                    node = np.broadcast_to(b[:, :, None], got.shape)[good]
                    other = np.take_along_axis(np.broadcast_to(b[:, None, :], score.shape), best, 2)[good]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((node, other, got[good]), arrow, strict=True)], schema=arrow)

    gathered = _gathered(graph, members, seed).select("centre", "member", "old", "dim", "code", "scale", "worst")
    return gathered.repartition("centre").sortWithinPartitions("centre").mapInArrow(run, schema)


def neighbour_graph(points: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, id, score, old``: each node's ``NEIGHBOURS`` nearest by NN-descent."""
    graph = scratch.save(_best_links(_first_links(points).withColumn("old", F.lit(False)), NEIGHBOURS), "graph-0")
    for k in range(1, ROUNDS + 1):
        heard = _heard(graph, points, k).withColumn("old", F.lit(False))
        graph = scratch.save(_best_links(graph.withColumn("old", F.lit(True)).select("node", "id", "score", "old").unionByName(heard), NEIGHBOURS), f"graph-{k}")
        scratch.drop(f"graph-{k - 1}")
        links, new = graph.agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col("old")).cast("long")), F.lit(0))).first()
        if new <= SETTLED * links:
            break
    return graph


def _pack(rows: DataFrame) -> DataFrame:
    """``node, ids, codes, scales``: the members of each centre in one row."""
    schema = "node long, ids binary, codes binary, scales binary"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches):
        for t in _whole_groups(batches):
            key = t.column("centre").to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() + [len(key)]
            ids, scales, codes = t.column("member").to_numpy(), t.column("scale").to_numpy(), t.column("code").to_pylist()
            spans = list(zip(first, first[1:], strict=False))
            made = key[first[:-1]], [ids[a:b].tobytes() for a, b in spans], [b"".join(codes[a:b]) for a, b in spans], [scales[a:b].tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return rows.select("centre", "member", "code", "scale").repartition("centre").sortWithinPartitions("centre").mapInArrow(run, schema)


def _neighbourhoods(graph: DataFrame, points: DataFrame, scratch: Scratch) -> str:
    """The name of a table of all nodes' packed members, bucketed by node."""
    members = points.select(F.col("node").alias("member"), "code", "scale")
    packed = _pack(_gathered(graph, members, 0).dropDuplicates(["centre", "member"]))
    buckets, name = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"tidewatch_{uuid.uuid4().hex}"
    packed.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", f"{scratch.base}/{name}").format("parquet").saveAsTable(name)
    return name


def _expand(frontier: DataFrame) -> DataFrame:
    """``query, id, score`` of the frontier nodes' neighbours that fit the pool."""
    schema = "query long, id long, score float"
    arrow = _arrow_schema(frontier.sparkSession, schema)

    def run(batches):
        for batch in batches:
            query, bound = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for q, least, y, ids, codes, scales in zip(query.tolist(), bound, *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                who, scale, way = np.frombuffer(ids, np.int64), np.frombuffer(scales, np.float32), np.frombuffer(y, np.float32)
                score = (np.frombuffer(codes, np.int8).reshape(len(who), -1)[:, :-1].astype(np.float32) @ way) * scale
                good = score > least
                out[0].append(np.full(int(good.sum()), q))
                out[1].append(who[good])
                out[2].append(score[good])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return frontier.select("query", "bound", "way", "ids", "codes", "scales").mapInArrow(run, schema)


def _pool(rows: DataFrame) -> DataFrame:
    """The best ``POOL`` of ``rows`` (query, id, score, done) of each query, with
    the turn of those not done and the score that a further node must beat."""
    once = rows.repartition("query").groupBy("query", "id").agg(F.max("score").alias("score"), F.max("done").alias("done"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= POOL)
    turn = F.sum(F.when(F.col("done"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("query").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bound = F.when(F.count(F.lit(1)).over(whole) == POOL, F.min("score").over(whole)).otherwise(float("-inf")).cast("float")
    return best.select("query", "id", "score", "done", "place", (~F.col("done") & (turn <= EXPANDED)).alias("next"), bound.alias("bound"))


def _ways(asked: DataFrame) -> DataFrame:
    """``query, way``: the queries' unit vectors as 32-bit floats."""
    schema = "query long, way binary"
    arrow = _arrow_schema(asked.sparkSession, schema)

    def run(batches):
        for batch in batches:
            made = []
            for v in batch.column(1):
                x = v.values.to_numpy()
                x = x / np.abs(x).max()
                made.append((x / np.sqrt((x * x).sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=arrow)

    return asked.select("query", "v").mapInArrow(run, schema)


def search(asked: DataFrame, points: DataFrame, graph: DataFrame, scratch: Scratch) -> DataFrame:
    """The pools, ``query, id, score, place``, of ``asked`` (query, node, v), whose
    nodes are in the graph."""
    spark = asked.sparkSession
    ways = scratch.save(_ways(asked), "ways")
    name = _neighbourhoods(graph, points, scratch)
    own = asked.join(points, "node").select("query", F.col("node").alias("id"), F.col("norm").alias("score"), "dim")
    w = Window.partitionBy("dim").orderBy(F.desc("norm"), "node")
    longest = points.withColumn("r", F.row_number().over(w)).where(F.col("r") <= STARTS).select(F.col("dim").cast("long").alias("centre"), F.col("node").alias("member"), "code", "scale")
    starts = scratch.save(_pack(longest).withColumnsRenamed({"node": "dim"}), "starts")
    known = own.join(starts, "dim").join(ways, "query").select("query", F.lit(float("-inf")).cast("float").alias("bound"), "way", "ids", "codes", "scales")
    first = _expand(known)
    pool = scratch.save(_pool(own.select("query", "id", "score", F.lit(False).alias("done")).union(first.withColumn("done", F.lit(False)))), "pool-0")
    for k in range(1, STEPS + 1):
        next_ = pool.where("next")
        met = next_.select("query", F.col("id").alias("node"), "bound").join(ways, "query").join(spark.table(name), "node")
        rows = pool.select("query", "id", "score", (F.col("done") | F.col("next")).alias("done")).union(_expand(met).withColumn("done", F.lit(False)))
        pool = scratch.save(_pool(rows), f"pool-{k}")
        scratch.drop(f"pool-{k - 1}")
        if not pool.where("next").limit(1).count():
            break
    spark.sql(f"DROP TABLE {name}")
    scratch.drop(name)
    return pool.select("query", "id", "score", "place")


def approximate_neighbours(vectors: DataFrame, by: int, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows whose id is divisible by
    ``by`` the k nearest found among all rows with other ids, by inner product.

    Scores are sums of products in double precision on the original vectors, from
    the first component on; ties go to the smaller vec_id; all candidates come if
    they are fewer than k.  Vectors that are null or zero or hold null or
    non-finite components, and null ids, take no part; only vectors of one length
    are compared.  Repeated candidate rows count each; repeated query rows are one
    query (the row with the smallest vector).  Columns besides vec_id and
    embedding are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    with tidy_shuffles(spark):
        rows = sound(vectors)
        nodes = scratch.save(_nodes(rows, k), "nodes")
        points = scratch.save(_points(nodes), "points")
        graph = neighbour_graph(points, scratch)
        asked = rows.where(F.col("vec_id") % by == 0).groupBy(F.col("vec_id").alias("query")).agg(F.min("v").alias("v"))
        asked = scratch.save(asked.join(nodes.select("v", "node"), "v").select("query", "node", "v"), "asked")
        pool = search(asked, points, graph, scratch)
    near = pool.where(F.col("place") <= RESCORED * k).select("query", F.col("id").alias("node"))
    both = near.join(nodes.select("node", F.col("v").alias("w"), "members"), "node").join(asked.select("query", "v"), "query")
    score = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    each = both.select("query", score.alias("score"), F.explode(F.filter("members", lambda m: m["vec_id"] != F.col("query"))).alias("m"))
    each = each.select("query", "score", F.explode(F.array_repeat(F.col("m.vec_id"), F.least(F.col("m.copies"), F.lit(k)).cast("int"))).alias("vec_id"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
