"""Boosted trees over any number of rows.

The objective, bins and limits are those of :func:`.ml.fit_boosted`.  Rows are
binned once and written to the shared folder with their margin.  For each level of a
tree the tasks add up gradients by (node, feature, bin), sums of at most
``2**level * features * bins`` cells meet on the driver, and the best splits go back
with the next level's work; rows never leave their tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import Scratch
from .ml import Boosted, _predict

REFRESH = 20  # trees after which the written margins are brought up to date


def cuts_of(df: DataFrame, features: list[str], bins: int = 255) -> list[np.ndarray]:
    """Where each feature is cut: between all values if they are few, else at
    approximate percentiles."""
    out = []
    for f in features:
        few = df.select(F.col(f).cast("double").alias("v")).distinct().limit(bins + 1).collect()
        if len(few) <= bins:
            values = np.sort([r.v for r in few])
            out.append((values[:-1] + values[1:]) / 2)
        else:
            shares = [k / bins for k in range(1, bins)]
            out.append(np.unique(df.agg(F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins)).first()[0]))
    return out


def fit_boosted_over(df: DataFrame, features: list[str], y: str = "y", depth: int = 2, rounds: int = 100, rate: float = 0.05, min_leaf: int = 20, l2: float = 1.0, bins: int = 255) -> Boosted:
    """The model for rows without nulls; see the module.  Repeated rows count
    each; an empty table is a ValueError."""
    import pandas as pd

    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    ship(spark)
    share, n = df.agg(F.avg(F.col(y).cast("double")), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no rows to learn from")
    share = min(max(share, 1e-12), 1 - 1e-12)
    base, cuts, trees = float(np.log(share / (1 - share))), cuts_of(df, features, bins), []
    shape = (len(features), max(len(c) for c in cuts) + 1)

    def binning(parts):
        for pdf in parts:
            binned = np.column_stack([np.searchsorted(c, pdf[f].to_numpy(float), side="left") for f, c in zip(features, cuts, strict=True)]).astype("<i2")
            yield pd.DataFrame({"bins": [b.tobytes() for b in binned], "y": pdf[y].to_numpy(float), "margin": base})

    rows = scratch.save(df.select(*features, y).mapInPandas(binning, "bins binary, y double, margin double"), "rows-0")
    written, version = 0, 0

    def margins(pdf, trees):
        x = np.frombuffer(b"".join(pdf["bins"]), "<i2").reshape(-1, len(features))
        margin = pdf["margin"].to_numpy(float).copy()
        for tree in trees:
            margin += _predict(tree, x)
        return x, margin

    def histograms(rows: DataFrame, since: list, splits: list) -> dict[int, np.ndarray]:
        """Sums (gradient, curvature, rows) by feature and bin of each open node;
        ``splits``: for each level the (feature, bin) of its nodes, None for closed
        ones."""

        def run(parts):
            sums: dict[int, np.ndarray] = {}
            for pdf in parts:
                x, margin = margins(pdf, since)
                p = 1 / (1 + np.exp(-margin))
                g, h = p - pdf["y"].to_numpy(float), p * (1 - p)
                node = np.zeros(len(x), np.int64)
                for level in splits:
                    at, right = np.full(len(x), -1), np.zeros(len(x), bool)
                    for j, split in enumerate(level):
                        own = node == j
                        if split is not None:
                            right[own] = x[own, split[0]] > split[1]
                            at[own] = 2 * j
                    node = np.where(at >= 0, at + right, -1)
                for j in np.unique(node[node >= 0]).tolist():
                    own = node == j
                    held = sums.setdefault(j, np.zeros((3, *shape)))
                    for f in range(len(features)):
                        for k, v in enumerate((g[own], h[own], np.ones(int(own.sum())))):
                            held[k, f] += np.bincount(x[own, f], v, shape[1])
            for j, held in sums.items():
                f, b = np.nonzero(held[2])
                yield pd.DataFrame({"node": j, "f": f, "b": b, "g": held[0, f, b], "h": held[1, f, b], "n": held[2, f, b]})

        cells = rows.mapInPandas(run, "node int, f int, b int, g double, h double, n double").groupBy("node", "f", "b").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()  # nodes x features x bins at most
        out: dict[int, np.ndarray] = {}
        for r in cells.itertuples(index=False):
            out.setdefault(r.node, np.zeros((3, *shape)))[:, r.f, r.b] = r.g, r.h, r.n
        return out

    def best(hist: np.ndarray):
        """(feature, bin) of the best split, or None."""
        total = hist[:, 0].sum(axis=1)
        found = (1e-12, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            lg, lh, ln = np.cumsum(hist[:, f, : len(c) + 1], axis=1)[:, :-1]
            sound = (ln >= min_leaf) & (total[2] - ln >= min_leaf) & (lh >= 1e-3) & (total[1] - lh >= 1e-3)
            gain = np.where(sound, lg**2 / (lh + l2) + (total[0] - lg) ** 2 / (total[1] - lh + l2) - total[0] ** 2 / (total[1] + l2), 0.0)
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = (gain[k], (f, k))
        return found[1] if total[2] >= 2 * min_leaf else None

    def leaf(sums) -> float:
        return float(-rate * sums[0] / (sums[1] + l2))

    for _ in range(rounds):
        splits, totals, level = [], {}, histograms(rows, trees[written:], [])
        for d in range(depth):
            chosen = [best(level[j]) if j in level else None for j in range(1 << d)]
            for j, hist in level.items():
                totals[d, j] = hist[:, 0].sum(axis=1)
                if chosen[j] is not None:
                    f, k = chosen[j]
                    left = hist[:, f, : k + 1].sum(axis=1)
                    totals[d + 1, 2 * j], totals[d + 1, 2 * j + 1] = left, totals[d, j] - left
            splits.append(chosen)
            if d + 1 < depth and any(c is not None for c in chosen):
                level = histograms(rows, trees[written:], splits)
            else:
                break

        def grown(d: int, j: int):
            split = splits[d][j] if d < len(splits) else None
            if split is None:
                return leaf(totals[d, j])
            return split[0], split[1], grown(d + 1, 2 * j), grown(d + 1, 2 * j + 1)

        trees.append(grown(0, 0))
        if len(trees) - written >= REFRESH and len(trees) < rounds:
            since, version = trees[written:], version + 1

            def moved(parts, since=since):
                for pdf in parts:
                    yield pdf.assign(margin=margins(pdf, since)[1])

            rows = scratch.save(rows.mapInPandas(moved, "bins binary, y double, margin double"), f"rows-{version}")
            scratch.drop(f"rows-{version - 1}")
            written = len(trees)
    scratch.drop(f"rows-{version}")

    def named(tree):  # bins become the cuts between them
        return tree if not isinstance(tree, tuple) else (tree[0], float(cuts[tree[0]][tree[1]]), named(tree[2]), named(tree[3]))

    return Boosted(base, [named(t) for t in trees])
