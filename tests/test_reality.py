"""The reality check and step-down p values against numpy."""

import numpy as np
import pytest

from tidewatch.operators import bootstrap, reality


def frame(spark, d, keys=("a",)):
    rows = [(k, f"s{m:02d}", i, float(v)) for k in keys for m, column in enumerate(d.T) for i, v in enumerate(column)]
    return spark.createDataFrame(rows, "series string, name string, i long, d double")


def plain(d, starts, block_len, studentise):
    n, m = d.shape
    index = ((starts[:, :, None] + np.arange(block_len)) % n).reshape(len(starts), -1)[:, :n]
    means, own = d[index].mean(axis=1), d.mean(axis=0)
    scale = np.sqrt(n) if not studentise else 1 / means.std(axis=0)
    stat, z = np.round(own * scale, 12), np.round((means - own) * scale, 12)
    order = np.argsort(-stat, kind="stable")
    out, worst = {}, 0.0
    for rank, j in enumerate(order, 1):
        worst = max(worst, np.mean(z[:, order[rank - 1 :]].max(axis=1) >= stat[j]))
        out[f"s{j:02d}"] = rank, own[j], np.mean(z[:, j] >= stat[j]), worst
    return out


@pytest.mark.parametrize("n", [7, 60, 95])
@pytest.mark.parametrize("studentise", [False, True])
def test_reality_check(spark, n, studentise):
    rng = np.random.default_rng(n)
    d = rng.normal(0, 1, (n, 6)) + np.array([0.4, 0, 0, 0.2, -0.3, 0])
    rows = frame(spark, d, ("a", "b"))
    starts = bootstrap.starts_of(rows.selectExpr("series").distinct().selectExpr("series", f"{n}L AS n"), ["series"], 80, 20, "stepped").drop("n")
    got = reality.reality_check(rows, starts, ["series"], studentise=studentise).collect()
    assert len(got) == 12
    if studentise and n < 20:  # every replicate takes each row once
        assert {r.p_step for r in got} == {1.0}
        return
    want = plain(d, bootstrap.start_matrix("stepped", n, 80, 20, 0), 20, studentise)
    for r in got:
        assert (r["rank"], r.mean, r.p_alone, r.p_step) == pytest.approx(want[r.name])


def test_noise_is_seldom_found_and_skill_is(spark):
    """50 strategies of noise in each of 60 worlds, all in one plan."""
    rng = np.random.default_rng(3)
    rows = [(w, f"s{m}", i, float(v)) for w in range(60) for (i, m), v in np.ndenumerate(rng.normal(0, 1, (80, 50)))]
    rows += [("skill", f"s{m}", i, float(v + (m == 7))) for (i, m), v in np.ndenumerate(rng.normal(0, 1, (80, 50)))]
    df = spark.createDataFrame([(str(w), *r) for w, *r in rows], "world string, name string, i long, d double")
    starts = bootstrap.starts_of(df.select("world").distinct().selectExpr("world", "80L AS n"), ["world"], 200, 20, "drawn", 5).drop("n")
    best = {r.world: r for r in reality.reality_check(df, starts, ["world"]).where("rank = 1").collect()}
    assert best["skill"].name == "s7" and best.pop("skill").p_step < 0.05
    assert sum(r.p_step < 0.10 for r in best.values()) <= 16  # about 6 expected, blocks of 20 make it some more


def test_no_rows_and_strategies_without_difference(spark):
    none = frame(spark, np.zeros((0, 2)))
    starts = bootstrap.starts_of(spark.createDataFrame([("a", 40)], "series string, n long"), ["series"], 10).drop("n")
    assert reality.reality_check(none, starts, ["series"]).count() == 0
    same = reality.reality_check(frame(spark, np.zeros((40, 2))), starts, ["series"], studentise=True).collect()
    assert [(r.name, r["rank"], r.p_step) for r in sorted(same)] == [("s00", 1, 1.0), ("s01", 2, 1.0)]
