"""The booster against splits tried one by one, and its twin over many tasks."""

import numpy as np
import pytest

from tidewatch.operators import boosted, ml


def data(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.round(rng.normal(size=n), 1), rng.integers(0, 4, n).astype(float), rng.normal(size=n)])
    return x, (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 1, n) > 1).astype(float)


def tried(x, y, depth, rounds, rate, min_leaf, l2):
    """Every split between two values of every feature, by plain loops."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))

    def grow(rows, g, h, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + l2)
        if level == depth or len(rows) < 2 * min_leaf:
            return {None: value}, rows
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        best = (1e-12, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) >= min_leaf and min(h[a].sum(), h[b].sum()) >= 1e-3 and (gain := score(a) + score(b) - score(rows)) > best[0] + 1e-10:
                    best = (gain, (a, b))
        if best[1] is None:
            return {None: value}, rows
        return tuple(grow(r, g, h, level + 1) for r in best[1]), rows

    def add(node, rows):
        if isinstance(node, dict):
            margin[rows] += node[None]
        else:
            for child in node:
                add(*child)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        add(*grow(np.arange(len(y)), p - y, p * (1 - p), 0))
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize(("depth", "min_leaf"), [(1, 20), (2, 20), (3, 5)])
def test_every_split_is_the_best_one(depth, min_leaf):
    x, y = data(200)
    model = ml.fit_boosted(x, y, depth=depth, rounds=8, rate=0.3, min_leaf=min_leaf)
    assert model.probability(x) == pytest.approx(tried(x, y, depth, 8, 0.3, min_leaf, 1.0))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_many_tasks_give_the_model_of_one(spark, depth, monkeypatch):
    monkeypatch.setattr(boosted, "REFRESH", 2)
    x, y = data(250)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(5)
    got = boosted.fit_boosted_over(df, ["a", "b", "c"], depth=depth, rounds=5, rate=0.3, min_leaf=10)
    assert got.probability(x) == pytest.approx(ml.fit_boosted(x, y, depth=depth, rounds=5, rate=0.3, min_leaf=10).probability(x))


def test_many_values_one_class_and_no_rows(spark):
    x, y = data(2000, 5)
    df = spark.createDataFrame([(float(r[2] + r[0]), float(t)) for r, t in zip(x, y, strict=True)], "a double, y double")
    got = boosted.fit_boosted_over(df, ["a"], rounds=3, rate=0.3, bins=16)
    assert got.probability(np.array([[-2.0], [2.0]]))[0] < got.probability(np.array([[-2.0], [2.0]]))[1]
    one = boosted.fit_boosted_over(df.where("y = 1"), ["a"], rounds=2)
    assert one.probability(np.array([[0.0]]))[0] > 0.999
    with pytest.raises(ValueError, match="no rows"):
        boosted.fit_boosted_over(df.limit(0), ["a"])
