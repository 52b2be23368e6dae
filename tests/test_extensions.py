"""Metric cubes, aggregates and table functions of the user's own, the ledger source."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import table_functions
from tidewatch.functions.aggregates import Aggregate
from tidewatch.operators import cube, folds, metrics
from tidewatch.sources import ledger_source


def signals(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(rng.random() < 0.3), round(float(rng.random()), 2), float(rng.random() < 0.4), -0.01, f"y{i // 60}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "series string, i long, y double, p double, s double, r double, year string").cache()


def test_cube_equals_each_group_by_itself(spark):
    rows = signals(spark, {"a": 170, "b": 90})
    got = {(r.level, r.series, r.year): r for r in cube.metrics_cube(rows, ["series", "year"], ["series"]).collect()}
    assert len(got) == 5 + 2 + 3 + 1
    for (level, series, year), r in got.items():
        own = rows.where(F.lit(bool(level & 2)) | (F.col("series") == series)).where(F.lit(bool(level & 1)) | (F.col("year") == year))
        c = own.agg(*[v.alias(k) for k, v in metrics.confusion_of().items()], metrics.brier_of().alias("brier")).head()
        assert (r.n, r.precision, r.recall, r.brier, r.base_rate, r.false_negative_rate) == pytest.approx((c.n, c.precision, c.recall, c.brier, c.base_rate, c.false_negative_rate))
        a = metrics.auc(own).head().auc
        assert r.auc == pytest.approx(a)
    for series in "ab":  # onsets follow the series' own order
        lead = metrics.lead_times(rows.where(F.col("series") == series), ["series"]).head()
        one = got[1, series, None]
        assert (one.n_onsets, one.n_missed, one.lead_mean) == pytest.approx((lead.n_onsets, lead.n_missed, lead.lead_mean))
    assert cube.metrics_cube(rows.limit(0), ["series"], ["series"]).count() == 0
    assert {r.level for r in cube.metrics_cube(rows, ["series", "year"], ["series"], [("series", "year"), ("series",), ()]).collect()} == {0, 1, 3}


BRIER = Aggregate(lambda: (0, 0.0), lambda st, df: (st[0] + len(df), st[1] + float(((df["p"] - df["y"]) ** 2).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda st: (st[1] / st[0], st[0]), "brier double, n long")


def test_a_mergeable_aggregate_equals_the_built_in_one(spark, monkeypatch):
    rows = signals(spark, {"a": 170, "b": 90, None: 30}).repartition(7)
    want = {r.series: (r.b, r.n) for r in rows.groupBy("series").agg(metrics.brier_of().alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    for held in (10_000, 0):
        monkeypatch.setattr("tidewatch.functions.aggregates.HELD", held)
        monkeypatch.setattr("tidewatch.functions.aggregates.FAN_IN", 2)
        got = {r.series: (r.brier, r.n) for r in BRIER.over(rows, ["series"], ["y", "p"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert BRIER.over(rows, [], ["y", "p"]).head().n == 290 and BRIER.over(rows.limit(0), ["series"], ["y", "p"]).count() == 0


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    rows = signals(spark, {"a": 400, "b": 180, "c": 20})
    rows.createOrReplaceTempView("rows_of_series")
    got = spark.sql("SELECT * FROM purged_folds(TABLE(rows_of_series) PARTITION BY series)")
    want = folds.folds_of(rows, ["series"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 10
    lead = spark.sql("SELECT * FROM lead_times(TABLE(rows_of_series) PARTITION BY series ORDER BY i)").collect()
    plain = {r.series: r for r in metrics.lead_times(rows, ["series"]).collect()}
    assert len(lead) == 3
    for r in lead:
        w = plain[r.series]
        assert (r.n_onsets, r.n_missed, r.lead_median, r.lead_mean) == pytest.approx((w.n_onsets, w.n_missed, w.lead_median, w.lead_mean))
    starts = spark.sql("SELECT start FROM block_starts(95, 3, 20, 7) ORDER BY rep, k").collect()
    rng = np.random.default_rng(7)
    assert [r.start for r in starts] == [x for _ in range(3) for x in rng.integers(0, 95, size=5).tolist()]
    with pytest.raises(Exception, match="no column s"):
        spark.sql("SELECT * FROM lead_times(TABLE(SELECT series, i, y FROM rows_of_series) PARTITION BY series ORDER BY i)").collect()


def runs(spark, n, tag, parts=3):
    rows = [("2024-01-01", "abc", "c", f"{tag}{k}", k, "{}", '{"auc": 0.5}', None) for k in range(n)]
    return spark.createDataFrame(rows, ledger_source.SCHEMA).repartition(parts)


def append(df, path):
    df.write.format("run_ledger").mode("append").save(path)


def test_ledger_source_reads_what_was_committed_alone(spark, tmp_path):
    ledger_source.register(spark)
    path = str(tmp_path / "ledger")
    read = lambda: spark.read.format("run_ledger").load(path)
    assert read().count() == 0 and ledger_source.run_count(path) == 0
    append(runs(spark, 7, "a"), path)
    assert sorted(r.data_snapshot_hash for r in read().collect()) == [f"a{k}" for k in range(7)]
    bad = runs(spark, 5, "b").withColumn("data_snapshot_hash", F.when(F.col("seed") != 3, F.col("data_snapshot_hash")))
    with pytest.raises(Exception, match="data_snapshot_hash"):
        append(bad, path)
    assert read().count() == 7 == ledger_source.run_count(path) and ledger_source.sweep(path) == 0  # the failed write left nothing
    with pytest.raises(Exception, match="never overwritten"):
        runs(spark, 1, "c").write.format("run_ledger").mode("overwrite").save(path)
    append(runs(spark, 1, "x").limit(0), path)
    assert ledger_source.commits(path) == [1]


def test_two_writers_lose_nothing(spark, tmp_path):
    ledger_source.register(spark)
    path = str(tmp_path / "ledger")

    def one(df):
        spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)  # each thread has its own
        append(df, path)

    threads = [threading.Thread(target=one, args=(runs(spark, 6, tag),)) for tag in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.read.format("run_ledger").load(path).select("data_snapshot_hash").distinct().count() == 24 == ledger_source.run_count(path) and ledger_source.commits(path) == [1, 2, 3, 4]


def test_ledger_stream_gives_each_run_once(spark, tmp_path):
    ledger_source.register(spark)
    path, out, log = (str(tmp_path / x) for x in ("ledger", "out", "log"))

    def drain():
        spark.readStream.format("run_ledger").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(once=True).start().awaitTermination()
        return sorted(r.data_snapshot_hash for r in spark.read.parquet(out).collect())

    append(runs(spark, 3, "a"), path)
    append(runs(spark, 2, "b"), path)
    assert drain() == ["a0", "a1", "a2", "b0", "b1"]
    append(runs(spark, 2, "c"), path)
    assert drain() == ["a0", "a1", "a2", "b0", "b1", "c0", "c1"]
