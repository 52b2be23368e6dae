import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.windows import Over
from tidewatch.operators import bootstrap, folds, integrity, metrics, ml


@pytest.mark.parametrize(("n", "k"), [(800, 5), (600, 4), (500, 3)])
def test_folds_are_purged_and_tile_the_tail(spark, n, k):
    got = sorted(folds.purged_folds(spark, n, n_folds=k).collect())
    assert got[0].test_start == 150 and got[-1].test_end == n
    assert all(a.test_end == b.test_start for a, b in zip(got, got[1:], strict=False))
    assert all(f.train_end + 20 == f.test_start and f.train_end - 1 + 10 < f.test_start for f in got)


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="too few"):
        folds.purged_folds(spark, 100)


def test_fold_table_equals_the_ranges(spark):
    df = spark.range(607).withColumn("series", F.lit("X"))
    got = sorted((r.fold, r.train_end, r.test_start, r.test_end) for r in folds.folds_of(df, ["series"]).collect())
    assert got == sorted(tuple(r) for r in folds.purged_folds(spark, 607).collect())
    assert integrity.folds_leak(folds.purged_folds(spark, 607)).count() == 0


def rows_of(spark, y, p, s=None, r=None):
    n = len(y)
    s, r = s if s is not None else [0.0] * n, r if r is not None else [0.0] * n
    return spark.createDataFrame([(i, float(a), None if b is None else float(b), float(c), None if d is None else float(d)) for i, (a, b, c, d) in enumerate(zip(y, p, s, r, strict=True))], "i long, y double, p double, s double, r double")


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


@pytest.mark.parametrize("levels", [4, 1000])
def test_auc_with_ties(spark, levels):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 300).astype(float), rng.integers(0, levels, 300) / levels
    assert metrics.auc(rows_of(spark, y, p)).head().auc == pytest.approx(brute_auc(y, p))


def test_auc_of_one_class_is_missing(spark):
    assert metrics.auc(rows_of(spark, [1, 1], [0.1, 0.2])).head().auc is None


def test_net_protection_by_hand(spark):
    df = metrics.with_net_protection(rows_of(spark, [0] * 3, [0] * 3, [0, 1, 1], [-0.1, -0.1, None]), Over("i", ()))
    want = np.mean([0.0, 0.1 * 0.5 / 10 - 0.0002 - 0.001]) * 252
    assert df.agg(metrics.net_protection_of().alias("x")).head().x == pytest.approx(want)


def test_a_signal_that_is_always_on_leads_fully(spark):
    y = [0] * 20 + [1] * 5 + [0] * 5 + [1] * 2
    got = metrics.lead_times(rows_of(spark, y, y, [1.0] * len(y))).head()
    assert (got.n_onsets, got.n_missed, got.lead_median) == (2, 0, 10.0)
    off = metrics.lead_times(rows_of(spark, y, y, [0.0] * len(y))).head()
    assert (off.n_missed, off.lead_median) == (2, None)


def test_confusion_without_any_signal(spark):
    got = rows_of(spark, [0, 1], [0, 0]).agg(*[v.alias(k) for k, v in metrics.confusion_of().items()]).head()
    assert got.precision == 0.0 and got.recall == 0.0 and got.false_negative_rate == pytest.approx(1.0)


def test_bootstrap_matches_numpy(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 95).astype(float), rng.random(95)
    got = bootstrap.block_bootstrap_ci(rows_of(spark, y, p), bootstrap.metric_brier, n_boot=50, seed=7).head()
    gen, values = np.random.default_rng(7), []
    for _ in range(50):
        idx = np.concatenate([np.arange(s, s + 20) % 95 for s in gen.integers(0, 95, size=5)])[:95]
        values.append(np.mean((p[idx] - y[idx]) ** 2))
    assert (got.lo, got.hi) == pytest.approx(tuple(np.quantile(values, [0.05, 0.95])))
    custom = bootstrap.block_bootstrap_ci(rows_of(spark, y, p), bootstrap.python_metric(lambda a, b: np.mean((a - b) ** 2)), n_boot=50, seed=7).head()
    assert custom.lo == pytest.approx(got.lo) and got.point == pytest.approx(np.mean((p - y) ** 2))


@pytest.mark.parametrize("fast", [100_000, 0])
def test_short_and_long_series_give_the_same_replicates(spark, monkeypatch, fast):
    monkeypatch.setattr(bootstrap, "FAST_ROWS", fast)
    rng = np.random.default_rng(9)
    y, p, base = rng.integers(0, 2, 70).astype(float), np.round(rng.random(70), 1), rng.random(70)
    rows = rows_of(spark, y, [None if k == 5 else v for k, v in enumerate(p)]).withColumn("p_base", F.element_at(F.array(*[F.lit(float(b)) for b in base]), (F.col("i") + 1).cast("int")))
    gen, aucs, briers, worse = np.random.default_rng(7), [], [], []
    for _ in range(60):
        idx = np.concatenate([np.arange(s, s + 20) % 70 for s in gen.integers(0, 70, size=4)])[:70]
        known = idx[idx != 5]
        aucs.append(brute_auc(y[known], p[known]))
        briers.append(np.mean((p[known] - y[known]) ** 2))
        worse.append(brute_auc(y[known], p[known]) - brute_auc(y[idx], base[idx]) <= 0)
    for metric, values in ((bootstrap.metric_auc, aucs), (bootstrap.metric_brier, briers)):
        got = bootstrap.block_bootstrap_ci(rows, metric, n_boot=60, seed=7).head()
        assert (got.lo, got.hi, got.n_valid) == pytest.approx((*np.quantile(values, [0.05, 0.95]), 60))
    assert bootstrap.auc_difference(rows, n_boot=60, seed=7).head().p_raw == pytest.approx(np.mean(worse))
    whole = bootstrap.intervals_by_key(rows, [], n_boot=60, seed=7).head()
    assert (whole.auc_lo, whole.brier_hi) == pytest.approx((np.quantile(aucs, 0.05), np.quantile(briers, 0.95)))


def test_hashed_starts_need_no_driver(spark, monkeypatch):
    got = bootstrap.hashed_starts(spark, 95, 400, seed=3).toPandas()
    assert len(got) == 400 * 5 and got.start.between(0, 94).all() and got.start.nunique() == 95
    assert got.equals(bootstrap.hashed_starts(spark, 95, 400, seed=3).toPandas())
    monkeypatch.setattr(bootstrap, "DRAWN_ROWS", 100)
    place = ["rep", "k", "start"]
    assert sorted(map(tuple, bootstrap.drawn_starts(spark, 95, 400, seed=3).select(place).collect())) == sorted(map(tuple, got[place].to_numpy().tolist()))


@pytest.mark.parametrize("n", [60_000, 200_000])
def test_any_number_of_rows_with_the_defaults(spark, n):
    """The longer series goes the way of long series."""
    rows = spark.range(n).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("double").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 50).alias("p"))
    boot = bootstrap.N_BOOT if n <= bootstrap.FAST_ROWS else 20
    whole = rows.select(F.avg(F.pow(F.col("p") - F.col("y"), 2))).head()[0]
    ends = bootstrap.intervals_by_key(rows, [], n_boot=boot).head()
    assert ends.brier_lo < whole < ends.brier_hi and ends.brier_hi - ends.brier_lo < 0.01 and 0.48 < ends.auc_lo < ends.auc_hi < 0.52
    both = rows.withColumn("p_base", 1 - F.col("p")).withColumn("k", F.lit("a")).unionByName(rows.where("i < 500").withColumn("p_base", F.col("p")).withColumn("k", F.lit("b")))
    diff = {r.k: r for r in bootstrap.auc_difference(both, n_boot=20, keys=["k"]).collect()}
    assert diff["b"].p_raw == 1 and diff["b"].auc_diff == 0 and diff["a"].n_valid == 20


def test_starts_of_several_sizes(spark):
    sizes = spark.createDataFrame([("a", 95), ("b", 40), ("c", 95)], "key string, n long")
    for rule in ("drawn", "stepped", "hashed"):
        got = bootstrap.starts_of(sizes, ["key"], 6, 20, rule, 3).toPandas().sort_values(["key", "rep", "k"])
        own = {k: g.start.to_numpy().reshape(6, -1) for k, g in got.groupby("key")}
        assert (own["a"] == own["c"]).all() and own["b"].shape == (6, 2) and got.start.between(0, got.n - 1).all()
        if rule != "hashed":
            assert (own["b"] == bootstrap.start_matrix(rule, 40, 6, 20, 3)).all()


@pytest.mark.parametrize("values", ["spread", "one", "infinite"])
def test_auc_in_ranges_of_scores(spark, monkeypatch, values):
    monkeypatch.setattr(metrics, "RANGES", 7)
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, 300).astype(float)
    p = {"spread": np.round(rng.normal(0, 5, 300), 1), "one": np.full(300, 0.5), "infinite": np.where(rng.random(300) < 0.1, np.inf, rng.random(300))}[values]
    assert metrics.auc(rows_of(spark, y, p)).head().auc == pytest.approx(brute_auc(y, p))


def test_the_metric_record_has_both_intervals(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 95).astype(float), rng.random(95)
    one = rows_of(spark, y, p)
    both = one.withColumn("name", F.lit("a")).unionByName(one.where("i < 70").withColumn("i", F.col("i") + 150).withColumn("name", F.lit("b")))
    got = {r.name: r for r in metrics.evaluate_strategy(both, ["name"], seed=7).collect()}
    for name, n in (("a", 95), ("b", 70)):
        gen, values = np.random.default_rng(7), []
        for _ in range(bootstrap.N_BOOT):
            idx = np.concatenate([np.arange(s, s + 20) % n for s in gen.integers(0, n, size=-(-n // 20))])[:n]
            values.append((brute_auc(y[idx], p[idx]), np.mean((p[idx] - y[idx]) ** 2)))
        want = np.quantile(values, [0.05, 0.95], axis=0)
        assert got[name].auc_ci90 == pytest.approx(want[:, 0].tolist(), abs=6e-5) and got[name].brier_ci90 == pytest.approx(want[:, 1].tolist(), abs=6e-5)
    assert metrics.evaluate_strategy(one, seed=7).head().brier_ci90 == got["a"].brier_ci90


def test_suites_test_models_against_the_rule(spark):
    from tidewatch.plans import suites

    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 80).astype(float)
    rule, model = rows_of(spark, y, rng.random(80)), rows_of(spark, y, y + rng.normal(0, 0.5, 80))
    got = {r.name: r for r in suites.with_model_tests(rule.withColumn("name", F.lit("r")).unionByName(model.withColumn("name", F.lit("m"))), ["m"], "r").collect()}
    assert got["r"].p_raw is None and got["m"].skill_claimed and got["m"].p_bonferroni == pytest.approx(min(1.0, 2 * got["m"].p_raw))


def test_whole_bootstrap_runs_every_series(spark, monkeypatch):
    from tidewatch.plans import queries

    rng = np.random.default_rng(15)
    own = {s: (rng.integers(0, 2, n).astype(float), rng.random(n)) for s, n in (("A", 65), ("N", 50))}
    rows = [(s, i, float(a), float(b), float(b > 0.5)) for s, (y, p) in own.items() for i, (a, b) in enumerate(zip(y, p, strict=True))]
    monkeypatch.setattr(queries, "signal_rows", lambda spark, d: spark.createDataFrame(rows, "series string, i long, y double, p double, s double"))
    ci = {r.series: r for r in queries.QUERIES["bootstrap_ci"](spark, "").collect()}
    diff = {r.series: r for r in queries.QUERIES["auc_diff"](spark, "").collect()}
    assert set(ci) == set(diff) == set(own) and queries.QUERIES["bootstrap_sample"](spark, "").count() == 2 * bootstrap.N_BOOT
    for s, (y, p) in own.items():
        n, brier, better = len(y), [], []
        for rep in range(bootstrap.N_BOOT):
            idx = np.concatenate([np.arange(x, x + 20) % n for x in ((rep * 7919 + k * 104729) % n for k in range(-(-n // 20)))])[:n]
            brier.append(np.mean((p[idx] - y[idx]) ** 2))
            better.append(brute_auc(y[idx], p[idx]) - brute_auc(y[idx], (p[idx] > 0.5).astype(float)) <= 1e-12)
        assert (ci[s].lo, ci[s].hi) == pytest.approx(tuple(np.quantile(brier, [0.05, 0.95])), abs=1e-6) and ci[s].n_valid == bootstrap.N_BOOT
        assert diff[s].n_valid == bootstrap.N_BOOT and diff[s].p_raw == pytest.approx(np.mean(better), abs=0.002)


def test_paired_difference(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 120).astype(float)
    good, bad = y + rng.normal(0, 0.5, 120), rng.random(120)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(120), "y": y, "p": good, "p_base": bad}))
    got = bootstrap.auc_difference(df, n_boot=60, seed=1).head()
    assert got.auc_diff == pytest.approx(brute_auc(y, good) - brute_auc(y, bad)) and got.p_raw < 0.05


def test_logistic_optimum_and_spark_ml_agree(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 2))
    y = (x[:, 0] + rng.normal(0, 1, 300) > 0.7).astype(float)
    m = ml.fit_logistic(x, y)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    other = ml.logistic_ml(df, ["a", "b"])
    np.testing.assert_allclose(m.weights, other.coefficients.toArray(), atol=1e-5)
    assert m.intercept == pytest.approx(other.intercept, abs=1e-5)


def test_boosting_learns_and_unknown_kinds_fail():
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = ml.fit_boosted(x, y).probability(x)
    assert brute_auc(y, p) > 0.9
    with pytest.raises(ValueError, match="unknown"):
        ml.fit_kind("forest", x, y)
    same = np.array([0.2, 0.4])
    assert ml.fit_platt(same, np.zeros(2))(same) is same


def test_walk_forward_is_blind_to_later_rows(spark):
    rng = np.random.default_rng(11)
    n = 260
    x = rng.normal(0, 1, n)
    y = (x + rng.normal(0, 1, n) > 0).astype(float)

    def probs(values):
        df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": values, "y": y}))
        got = ml.walk_forward(folds.assign(df, folds.purged_folds(spark, n), []), ["x"], [], "logistic").toPandas()
        return got[got.fold == 0].sort_values("i").prob.to_numpy()

    garbled = x.copy()
    garbled[172:] = 999.0
    np.testing.assert_allclose(probs(x), probs(garbled))


def test_shuffled_labels_carry_nothing(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(600), "y": rng.integers(0, 2, 600).astype(float), "p": rng.random(600)}))
    mixed = integrity.shuffled(df, "y", 3)
    assert mixed.agg(F.sum("y")).head()[0] == df.agg(F.sum("y")).head()[0]
    assert abs(metrics.auc(mixed).head().auc - 0.5) < 0.1


def test_prefix_invariance_finds_a_leak(spark):
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(50), "x": np.random.default_rng(0).random(50)}))
    from pyspark.sql.window import Window

    ahead = lambda d: d.withColumn("z", F.lead("x", 1).over(Window.orderBy("i")))
    back = lambda d: d.withColumn("z", F.lag("x", 1).over(Window.orderBy("i")))
    assert integrity.prefix_variance(df, ahead, ["z"], 30).count() == 1
    assert integrity.prefix_variance(df, back, ["z"], 30).count() == 0
    assert integrity.looks_ahead(ahead(df)) and not integrity.looks_ahead(back(df))


def test_prefixes_of_short_and_long_panels(spark):
    from pyspark.sql.window import Window

    ahead = lambda d: d.withColumn("z", F.lead("x", 1).over(Window.orderBy("i")))
    for n, want in ((50, [48]), (400, [300, 398]), (600, [300, 500, 598])):
        df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": np.random.default_rng(0).random(n)}))
        assert sorted(r.i for r in integrity.prefix_variances(df, ahead, ["z"]).collect()) == want
        assert integrity.prefix_variances(df.limit(0), ahead, ["z"]).count() == 0
