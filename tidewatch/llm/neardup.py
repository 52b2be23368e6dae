"""Near-duplicate documents by bottom-k sketches from one hash function.

Each document's set of word shingles keeps its ``SKETCH`` smallest hash values.
Documents with equal sets form a class and are handled once.  Inverted lists of
retained values give candidate pairs, the sketch of a pair's union estimates
their similarity, and the full sets confirm it; the confirmed links are joined to
components.

Long lists (a passage in many documents, a large group of near copies) never
give all their pairs:

1. *Sketches.*  Each class lists its sketch, rarest values first.  Two sketches of
   sets with the least similarity asked for share ``_least_shared`` values or
   more (but for 1 in 10**9 pairs), so the rarest values up to there hold a
   common one.  Lists of at most ``LONG`` classes give their pairs.
2. *Full sets.*  Classes that stand in a longer list there list their full sets,
   rarest value first, up to the exact prefix, with positions: a common value at
   positions i and j leaves room for a bounded overlap only.  Pairs of short
   lists are candidates.  Of long lists each class meets the list's most typical
   class; confirmed links are joined to components, and only classes whose
   component is not the list's prevailing one meet the list's other classes.

So no link is lost to a cap; what was joined already is not compared again.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from math import comb, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_rows, claim_memory

SKETCH = 64
LONG = 32  # classes in a list above which it does not give all its pairs
BROADCAST_IDS = 2_000_000  # so many class or document numbers at most are broadcast

#: Odd 64-bit multipliers of the published splitmix64 finaliser, and its increment.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (int64) of a text's word shingles.

    Words are runs of characters other than space and the five ASCII controls
    from tab to carriage return, with A-Z in lower case.  A text of fewer than
    ``size`` words is one shingle; one without words has none.
    """
    claim_memory("neardup", _words.clear)
    words = text.encode().translate(_LOWER).split()  # bytes.split() parts at exactly those characters
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    rows = len(h) - n + 1
    acc = np.full(rows, np.uint64(n), np.uint64)
    for k in range(n):
        acc = _mix(acc * _M2 + h[k : k + rows] + _STEP)
    return np.unique(acc.view(np.int64))


@lru_cache(256)
def _least_shared(draws: int, percent: int) -> int:
    """How many of the ``draws`` smallest values of a union lie in the
    intersection at least, but for 1 in 10**9 pairs of the least similarity."""
    t, tail, c = percent / 100, 0.0, 0
    while c < draws:
        tail += comb(draws, c) * t**c * (1 - t) ** (draws - c)
        if tail > 1e-9:
            return c
        c += 1
    return c


def signature(s: np.ndarray) -> tuple[int, int, int, list[int]]:
    """(size, two hashes, sketch) of a set of :func:`shingles`."""
    u = _mix(s.view(np.uint64) + _STEP)
    return len(s), int(u.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_mix(u), initial=np.uint64(0)).astype(np.int64)), s[:SKETCH].tolist()


def scan(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, h1, h2, sketch`` of every row (null text: empty)."""

    def make():
        return lambda rows: ((doc, *signature(shingles(text, size))) for doc, text in rows)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_rows(plain, ["doc_id", "text"], "doc_id long, n long, h1 long, h2 long, sketch array<long>", make)


def _among(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` stands (``left_anti``: does not stand) in ``ids``, a
    saved table of distinct numbers.  Up to ``BROADCAST_IDS`` numbers go to the
    rows; beyond, rows and numbers meet by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def _size_ok(percent: int):
    return (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)


def _listed(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, length) of the short lists with two classes or more, and of the long ones."""
    lengths = postings.groupBy("v").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    return lengths.where(F.col("length") <= LONG), lengths.where(F.col("length") > LONG)


def _rare_first(values: DataFrame, classes: DataFrame, limit: int | None = None) -> DataFrame:
    """``v, cls, n, df, pos`` of the values that two classes or more have: their
    place in the class's values by rarity.  Values of one class alone come first
    in that order, so only their number is needed.  ``limit``: the most values a
    class lists."""
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(common, "v").join(classes.select("cls", "n"), "cls")
    by_class = Window.partitionBy("cls")
    listed = F.col("n") if limit is None else F.least(F.col("n"), F.lit(limit))
    place = F.row_number().over(by_class.orderBy("df", "v")) - 1
    return shared.withColumn("pos", listed - F.count(F.lit(1)).over(by_class) + place)


def _band(percent: int):
    """The number of a set's band of size: a little wider than the ratio that the
    similarity allows, so that such sizes are at most one band apart."""
    return F.col("n") if percent == 100 else F.floor(F.log(F.col("n")) / (log(100 / percent) * (1 + 1e-9)))


def _pairs_within(postings: DataFrame, short: DataFrame, percent: int, extra=None) -> DataFrame:
    """(a, b) with a < b that share a short list and fit in size."""
    own = postings.join(short.select("v"), "v")
    joined = own.alias("a").join(own.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.cls") < F.col("b.cls")) & _size_ok(percent) & (F.lit(True) if extra is None else extra))
    return joined.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))


def _room(percent: int):
    """Whether a common value at positions a.pos and b.pos leaves room for the
    overlap that the similarity needs."""
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return left * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent


def _likely(pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule out the similarity."""
    pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
    ids = scratch.save(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), f"{name}-ids")
    own = _among(classes.select("cls", "n", "sketch"), ids, "cls")
    both = pairs.join(own.withColumnsRenamed({"cls": "a", "n": "n_a", "sketch": "s_a"}), "a").join(own.withColumnsRenamed({"cls": "b", "n": "n_b", "sketch": "s_b"}), "b")

    def make():
        def work(rows):
            for a, b, n_a, n_b, s_a, s_b in rows:
                x, y = np.array(s_a, np.int64), np.array(s_b, np.int64)
                merged = np.sort(np.concatenate((x, y)))
                twice = merged[1:] == merged[:-1]
                if max(n_a, n_b) <= SKETCH:  # the sketches are the sets
                    shared = int(twice.sum())
                    good = shared * (100 + percent) >= (n_a + n_b) * percent
                else:
                    first = np.r_[True, ~twice]
                    rank = np.cumsum(first)  # place among the union's values
                    draws = min(SKETCH, int(rank[-1]))
                    shared = int((twice & (rank[1:] <= draws)).sum())
                    good = shared >= _least_shared(draws, percent)
                if good:
                    yield a, b

        return work

    return arrow_rows(both, ["a", "b", "n_a", "n_b", "s_a", "s_b"], "a long, b long", make)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough.  ``texts``: (cls, text)."""
    both = pairs.join(texts.withColumnsRenamed({"cls": "a", "text": "t_a"}), "a").join(texts.withColumnsRenamed({"cls": "b", "text": "t_b"}), "b")

    def make():
        @lru_cache(64)
        def of(text):
            return shingles(text, size)

        def work(rows):
            for a, b, t_a, t_b in rows:
                x, y = of(t_a), of(t_b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared * (100 + percent) >= (len(x) + len(y)) * percent:
                    yield a, b

        return work

    return arrow_rows(both, ["a", "b", "t_a", "t_b"], "a long, b long", make)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has
    an edge (a, b).

    Each round gives every node the smallest label among its own and its
    neighbours', then follows labels once; rounds are written to the shared
    folder, and end when no label changes.
    """
    both = scratch.save(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "m"}), "other").groupBy("node").agg(F.min("m").alias("m"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("low"))
        jump = labels.withColumnsRenamed({"node": "low", "component": "further"})
        done = low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("component"), (F.least("low", F.coalesce("further", "low")) != F.col("component")).alias("moved"))
        k += 1
        labels_now = scratch.save(done, f"{name}-{k}")
        more = labels_now.where("moved").limit(1).count()
        scratch.drop(f"{name}-{k - 1}")
        labels = labels_now.select("node", "component")
        if not more:
            return labels


def _dense_links(classes: DataFrame, hard: DataFrame, texts: DataFrame, links: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links among the ``hard`` classes by their full sets; see the module text."""

    def make():
        return lambda rows: ((cls, v) for cls, text in rows for v in shingles(text, size).tolist())

    values = scratch.save(arrow_rows(_among(texts, hard, "cls"), ["cls", "text"], "cls long, v long", make, 8192), "hard-values")
    ranked = _rare_first(values, classes)
    # position pos can be the first common one only if the rest is large enough for the smallest partner, percent of n
    near = (F.col("n") - F.col("pos")) * 100 >= F.col("n") * percent
    centrality = F.sum(F.col("df").cast("double")).over(Window.partitionBy("cls")) / F.col("n")
    prefix = scratch.save(ranked.withColumn("centrality", centrality).where(near).select("v", "cls", "n", "pos", "centrality"), "hard-prefix")
    short, long = _listed(prefix)
    plain = _pairs_within(prefix, short, percent, _room(percent))
    in_long = scratch.save(prefix.join(long.select("v"), "v"), "long-lists")
    heart = in_long.groupBy("v").agg(F.max_by("cls", F.struct("centrality", -F.col("cls"))).alias("heart"))
    star = in_long.join(heart, "v").where("cls <> heart").select(F.least("cls", "heart").alias("a"), F.greatest("cls", "heart").alias("b"))
    first = scratch.save(_confirmed(_likely(plain.union(star), classes, scratch, "hard-likely", percent), texts, size, percent), "hard-links")
    found = links.union(first)
    if not in_long.limit(1).count():
        return first
    placed = in_long.join(components(found, scratch, "hard").withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    per = placed.groupBy("v", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
    main = per.groupBy("v").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least")).where("parts > 1")
    # a class is of use in a list only if its position leaves room for the smallest partner there
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    useful = scratch.save(
        placed.join(main, "v").where((F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n") + smallest) * percent).select("v", "cls", "n", "pos", "component", (F.col("component") != F.col("main")).alias("outside")), "useful"
    )
    # Classes of one list meet by bands of size: sizes that may go together lie in one band or in neighbouring ones.
    banded = useful.withColumn("band", _band(percent))
    a, b = banded.where("outside").alias("a"), banded.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("b")
    rest = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.band") == F.col("b.near")) & (F.col("a.component") != F.col("b.component")) & _size_ok(percent) & _room(percent))
    pairs = rest.select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b"))
    return first.union(_confirmed(_likely(pairs, classes, scratch, "rest-likely", percent), texts, size, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their
    shingle sets; ``component_id`` is the smallest doc_id reachable over links,
    ``kept`` whether it is the document's own.  Texts without words (and null
    texts) are linked with nothing.  Rows with equal doc_id are rows each, and
    share a component only over their texts; a null doc_id takes no part: its
    component is null, and it is kept.  Columns besides doc_id and text are
    ignored; an empty table gives an empty result.  Very long texts are one set
    each, held by the tasks that compare them.
    """
    return _judged(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with their sets' hashes (h1, h2)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    scratch = Scratch(docs.sparkSession)
    signed = scratch.save(scan(docs, size), "signed")
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    # A class is a distinct set; it has a number of its own, and doc is the smallest document with it.
    classes = linked.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = scratch.save(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    pairs, hard = _sketch_lists(classes, scratch, percent)
    likely = scratch.save(_likely(pairs, classes, scratch, "sketch-likely", percent), "likely")
    scratch.drop("sketch-prefix")
    chosen = scratch.save(likely.select(F.col("a").alias("cls")).union(likely.select("b")).union(hard).distinct(), "chosen")
    texts = scratch.save(_texts_of(docs, signed, _among(classes, chosen, "cls"), scratch, size), "texts")
    links = scratch.save(_confirmed(likely, texts, size, percent), "links")
    if hard.limit(1).count():
        links = links.union(scratch.save(_dense_links(classes, hard, texts, links, scratch, size, percent), "dense"))
    component = components(links, scratch, "final")
    placed = component.join(classes.select(F.col("cls").alias("node"), "h1", "h2", "n", "doc"), "node")
    least = placed.groupBy("component").agg(F.min("doc").alias("least"))
    joined = placed.join(least, "component").select("h1", "h2", "n", "least")
    named = classes.select("h1", "h2", "n", "doc").join(joined, ["h1", "h2", "n"], "left").select("h1", "h2", "n", F.coalesce("least", "doc").alias("component"))
    out = signed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    out = scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), "h1", "h2"), "judged")
    scratch.drop("likely", "texts", "hard-values", "hard-prefix", "long-lists", "useful", "classes", "signed", "links", "dense", "hard-links", "hard", "chosen")
    scratch.drop(*[f"{k}-{x}" for k in ("sketch-likely", "hard-likely", "rest-likely") for x in ("pairs", "ids")])
    return out


def _texts_of(docs: DataFrame, signed: DataFrame, chosen: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(cls, text) of some classes: the text of their smallest document whose set
    is the class's own (of repeated ids another row may have another set)."""
    wanted = scratch.save(chosen.select("cls", F.col("doc").alias("doc_id"), "h1", "h2", "n"), "wanted")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    few = wanted.count() <= BROADCAST_IDS
    met = plain.join(F.broadcast(wanted) if few else wanted, "doc_id")

    def make():
        return lambda rows: ((cls, text) for cls, text, n, h1, h2 in rows if signature(shingles(text, size))[:3] == (n, h1, h2))

    texts = arrow_rows(met, ["cls", "text", "n", "h1", "h2"], "cls long, text string", make, 512)
    again = signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return texts.dropDuplicates(["cls"]) if again else texts


def _sketch_lists(classes: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs from whole sketches, rarest value first, and the classes
    that still stand in a long list."""
    values = classes.select("cls", F.explode("sketch").alias("v"))
    ranked = _rare_first(values, classes, SKETCH)
    # Sketches hold the whole set up to SKETCH values; a partner of such a set may have more, so the exact bound holds up to percent of SKETCH only.
    whole = SKETCH * percent // 100
    least = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(_least_shared(SKETCH, percent)))
    prefix = ranked.where(F.least(F.col("n"), F.lit(SKETCH)) - F.col("pos") >= least)
    prefix = scratch.save(prefix.select("v", "cls", "n"), "sketch-prefix")
    short, long = _listed(prefix)
    hard = scratch.save(prefix.join(long.select("v"), "v").select("cls").distinct(), "hard")
    return _pairs_within(prefix, short, percent), hard


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; all columns
    stay, whatever their names.  Of repeated rows each stays if it is kept; of
    rows with one doc_id and different texts each goes by its own text."""
    scratch = Scratch(docs.sparkSession)
    judged = _judged(docs, size, percent)
    gone = scratch.save(judged.where(~F.col("kept")).select("doc_id", "n_shingles", "h1", "h2").distinct(), "gone")
    ids = scratch.save(gone.select("doc_id").distinct(), "gone-ids")
    both = judged.where("kept").select("doc_id").join(ids, "doc_id", "left_semi").limit(1).count()
    if not both:  # no id has a row that stays and one that goes
        return _among(docs, ids.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id", "left_anti")
    own = f"set_{uuid.uuid4().hex}"
    signed = docs.withColumn(own, _signature_of(size)(F.col("text")))
    same = (signed["doc_id"] == gone["doc_id"]) & (signed[own]["n"] == gone["n_shingles"]) & (signed[own]["h1"] == gone["h1"]) & (signed[own]["h2"] == gone["h2"])
    return signed.join(gone, same, "left_anti").drop(own)


def _signature_of(size: int):
    import pandas as pd

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signature(shingles(t or "", size))[:3] for t in texts], columns=["n", "h1", "h2"])

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(of, "n long, h1 long, h2 long")
