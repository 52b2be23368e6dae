"""Document quality by histogram gradient-boosted trees over text statistics.

The statistics of a whole text (shares of character kinds, word and line
lengths, repetition) are binned by quantiles of the training rows; each tree is
grown level by level from gradient histograms, and kept as flat arrays (feature,
threshold and leaf value by place in a complete binary tree), so that scoring is a
few numpy steps for each level and all trees at once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, claim_memory, doc_text, give_back

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "newlines", "stops", "commas", "exclaims", "symbols", "pipes", "quotes_brackets", "not_ascii",
    "log_words", "word_length", "distinct_words", "top_word", "distinct_trigrams", "log_lines", "distinct_lines", "longest_line", "ends_in_stop", "short_words", "long_words", "upper_words", "marked_words",
)


def _kinds(*groups: bytes) -> np.ndarray:
    out = np.zeros((len(groups), 256), np.int64)
    for k, g in enumerate(groups):
        out[k, list(g)] = 1
    return out


_GROUPS = _kinds(
    bytes([*range(65, 91), *range(97, 123)]), bytes(range(65, 91)), b"0123456789", b" ", b"\n", b".", b",", b"!?", b"#$%&*@^~_+=<>", b"|", b"\"'()[]{}", bytes(range(128, 256))
)


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of :data:`FEATURES`; an empty text
    has zeros."""
    claim_memory("quality")
    raw = text.encode()
    n = max(1, len(raw))
    shares = (_GROUPS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n).tolist()
    words = text.split()
    counts = Counter(words)
    w = max(1, len(words))
    trigrams = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    lines = text.split("\n")
    lengths = Counter()
    upper = marked = 0
    for word, c in counts.items():
        lengths[len(word)] += c
        if len(word) > 1 and word.isupper():
            upper += c
        if not word[-1].isalnum() and word[-1] not in ".,;:":
            marked += c
    return [
        math.log1p(len(raw)), *shares,
        math.log1p(len(words)), sum(k * c for k, c in lengths.items()) / w, len(counts) / w, max(counts.values(), default=0) / w, trigrams,
        math.log1p(len(lines)), len(set(lines)) / len(lines), max(map(len, lines)) / n, sum(x[-1:] in (".", "!", "?") for x in lines) / len(lines),
        sum(c for k, c in lengths.items() if k <= 2) / w, sum(c for k, c in lengths.items() if k >= 12) / w, upper / w, marked / w,
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node i of a tree has the children 2i + 1 (value <=
    threshold) and 2i + 2; ``values`` are those of the last level."""

    base: float
    features: np.ndarray  # trees x nodes
    thresholds: np.ndarray
    values: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.features.shape
        depth = (nodes + 1).bit_length() - 1
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.features[tree, at]] > self.thresholds[tree, at])
        return self.base + self.values[tree, at - nodes].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Newton boosting of the log-loss on histograms.

    ``least``: the least sum of second derivatives in a leaf.  With rows of one
    class only, or none, the forest gives that class's share, held off 0 and 1.
    """
    share = (float(y.sum()) + 1) / (len(y) + 2)
    base, nodes = math.log(share / (1 - share)), (1 << depth) - 1
    feats, cuts, leaves = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, feats, cuts, leaves)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    offset = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            slot = ((at - first)[:, None] * (width * bins) + offset + binned).ravel()
            hist_g = np.bincount(slot, np.repeat(g, width), n * width * bins).reshape(n, width, bins)
            hist_h = np.bincount(slot, np.repeat(h, width), n * width * bins).reshape(n, width, bins)
            left_g, left_h = hist_g.cumsum(axis=2), hist_h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for node in range(n):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    feats[t, first + node], cuts[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feats[t, at]] > cuts[t, at])
        leaf = at - nodes
        leaves[t] = -rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + l2)
        margin += leaves[t][leaf]
    return Forest(base, feats, cuts, leaves)


def held_out(doc_id) -> object:
    """Whether a document is kept from training: crc32 of its id modulo 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **params) -> Forest:
    """A forest from labelled documents that are not held out.

    At most ``max_rows`` labelled documents are used, those with the smallest
    hash of their id; their statistics (not their texts) come to the driver.
    Labels that are null are left out; a document with several labels counts
    with the smallest, one with several rows by the row of the smallest
    statistics, so that no more than ``max_rows`` rows ever come.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = doc_text(docs).join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers

    def make():
        return lambda it: ((doc, quality, statistics(text)) for doc, quality, text in it)

    got = arrow_rows(rows, ["doc_id", "quality", "text"], "doc_id long, quality int, x array<double>", make).groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return train(x, got["quality"].to_numpy(float), **params)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every document: 0 to 1, higher for better texts.

    Null text scores as the empty text; repeated rows score each; only the text
    is an input.
    """

    def make():
        def work(rows):
            held = []
            for doc, text in rows:
                held.append((doc, statistics(text)))
                if len(held) == 512:
                    yield from zip([d for d, _ in held], forest.score(np.array([s for _, s in held])).tolist(), strict=True)
                    held = []
            if held:
                yield from zip([d for d, _ in held], forest.score(np.array([s for _, s in held])).tolist(), strict=True)

        return work

    return arrow_rows(doc_text(docs), ["doc_id", "text"], "doc_id long, score double", make)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null text scores as the empty text; a null doc_id is kept, with held_out null;
    repeated rows are rows each; columns besides doc_id and text are ignored; an
    empty table gives no row.  Without labels every score is the same.
    """
    done = score(docs, fit(docs, labels, max_rows))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns of
    whatever name and type, which pass as Arrow columns.

    Nulls, repeated rows and empty tables as in :func:`classify`.
    """
    forest = fit(docs, labels, max_rows)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, good = batch.column(place), []
            for k in range(0, len(texts), 512):
                part = [statistics(t or "") for t in texts.slice(k, 512).to_pylist()]
                good += (forest.score(np.array(part)) >= threshold).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))
        give_back()

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of any kind pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
