import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import bands, scalars
from tidewatch.functions.windows import Over
from tidewatch.operators import align, book, metrics
from tidewatch.plans import suites
from tidewatch.sources import ledger, panel, snapshots
from tidewatch.streaming import ledger_stream

D = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(40)]


def bars(spark, rows):
    return spark.createDataFrame(rows, "series string, date date, close double")


def test_clean_suffix_is_strict_and_drops_the_jump(spark):
    e = float(np.exp(0.7))
    exact = bars(spark, [("A", D[0], 1.0), ("A", D[1], 2.0**0.5)])
    assert align.clean_suffix(exact).count() == 2
    jump = bars(spark, [("A", D[0], 1.0), ("A", D[1], e * 1.2), ("A", D[2], e * 1.2), ("B", D[0], 1.0)])
    assert sorted((r.series, r.date) for r in align.clean_suffix(jump).collect()) == [("A", D[2]), ("B", D[0])]


def test_keep_last_and_clean(spark):
    df = spark.createDataFrame([("A", D[0], 1.0, 0, False), ("A", D[0], 2.0, 1, None), ("A", D[1], 0.0, 2, False), ("A", D[2], 3.0, 3, True)], "series string, date date, close double, pos int, interpolated boolean")
    assert [(r.date, r.close) for r in align.keep_last(align.clean_bars(df)).collect()] == [(D[0], 2.0)]


def test_gap_misses_two_returns_and_the_index_renormalises(spark):
    rows = [("A", D[k], 100.0 * 1.01**k) for k in range(5)] + [("B", D[k], 50.0 * 1.02**k) for k in (0, 1, 3, 4)] + [("C", D[0], 9.0)]
    w = spark.createDataFrame([("A", 3.0, 10.0), ("B", 1.0, 10.0), ("Z", 5.0, 0.0)], "series string, shares double, price double")
    got = {r.date: (r.BOOK_close, r.n_names) for r in book.book_index(bars(spark, rows), book.weights(w)).collect()}
    both, one = 0.75 * np.log(1.01) + 0.25 * np.log(1.02), np.log(1.01)
    want = np.cumsum([both, one, one, both])
    assert [got[D[k]][0] for k in (1, 2, 3, 4)] == pytest.approx(list(100 * np.exp(want)))
    assert [got[D[k]][1] for k in (1, 2, 3, 4)] == [2, 1, 1, 2]


def test_weights_from_maps(spark):
    doc = spark.createDataFrame([({"A": 2.0, "B": 1.0}, {"A": 10.0, "B": 20.0})], "shares map<string,double>, last_close map<string,double>")
    assert {r.series: r.weight for r in book.weights_from_maps(doc).collect()} == {"A": 0.5, "B": 0.5}


def test_bands(spark):
    grid = spark.range(201).select((F.col("id") / 200.0).alias("p"))
    for f in (bands.band, bands.band_by_rank):
        got = [r.b for r in grid.select("p", f(F.col("p")).alias("b")).orderBy("p").collect()]
        assert all(a.lo <= b.lo and a.hi <= b.hi for a, b in zip(got, got[1:], strict=False))
    at = lambda f, x: tuple(spark.range(1).select(f(F.lit(x)).alias("b")).head().b)
    assert at(bands.band, 0.19) == (0.0, 0.10) and at(bands.band, 0.20) == (0.25, 0.50) and at(bands.band, 0.75) == (0.50, 0.75)
    assert at(bands.band_by_rank, 0.69) == (0.0, 0.10) and at(bands.band_by_rank, 0.70) == (0.25, 0.50) and at(bands.band_by_rank, 0.90) == (0.50, 0.75)
    for bad in (1.5, -0.1):
        with pytest.raises(Exception, match="within"):
            at(bands.band, bad)


def test_business_days(spark):
    df = spark.createDataFrame([(d,) for d in D[:14]], "d date").select("d", scalars.add_business_days_10(F.col("d")).alias("e"))
    for r in df.collect():
        assert r.e == np.busday_offset(r.d, 10, roll="preceding").astype(object)


def test_pulls_and_bars(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"time": ["2020-01-01T23:30:00-05:00", "2020-01-02"], "close": [1.0, 2.0], "high": [1.5, 2.5], "low": [0.5, 1.5]}, indent=1))
    assert [(r.date, r.close) for r in panel.read_pull(spark, str(tmp_path / "x.json"), "X").orderBy("date").collect()] == [(D[0], 1.0), (D[1], 2.0)]
    bar = lambda day, price, inter=False: {"begins_at": f"2020-01-0{day}T00:00:00Z", "close_price": price, "interpolated": inter}
    for name, content in {"batch1": [("A", [bar(1, "1.0")]), ("B", [bar(1, "7.5")])], "batch2": [("A", [bar(2, "2.0"), bar(3, "bad")]), ("B", [bar(1, "1", True)])]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": {"results": [{"symbol": s, "bars": b} for s, b in content]}}))
    got = sorted((r.series, r.date.day, r.close) for r in panel.read_bars(spark, f"{tmp_path}/batch*.json").collect() if r.close)
    assert got == [("A", 2, 2.0), ("B", 1, 7.5)]


def test_snapshots_are_frozen_and_verified(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(d, float(k) + 1 / 3) for k, d in enumerate(D)], "date date, x double")
    assert snapshots.content_hash(df).head()[0] == snapshots.content_hash(df.orderBy(F.desc("x")).repartition(3)).head()[0] != snapshots.content_hash(df.limit(39)).head()[0]
    snapshots.freeze(df, base, "all")
    with pytest.raises(snapshots.SnapshotError, match="frozen"):
        snapshots.freeze(df, base, "all")
    assert snapshots.load(spark, base, "all").count() == 40
    snapshots.load(spark, base, "all").limit(5).write.mode("append").parquet(f"{base}/all.parquet")
    with pytest.raises(snapshots.SnapshotError, match="changed"):
        snapshots.load(spark, base, "all")
    snapshots.write_csv_snapshot(df, f"{base}/csv")
    assert panel.read_csv_panel(spark, f"{base}/csv", "date date, x double").agg(F.sum("x")).head()[0] == pytest.approx(40 * 39 / 2 + 40 * 0.333333)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.write_csv_snapshot(df, f"{base}/csv")


def test_holdout_is_sealed_until_dissolved(spark, tmp_path):
    base = f"file://{tmp_path}"
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=30 * k) for k in range(40)]
    df = spark.createDataFrame([(d, 1.0) for d in days], "date date, x double")
    snapshots.freeze_split(df, base)
    dev = snapshots.load_dev(spark, base).count()
    with pytest.raises(snapshots.SnapshotError, match="permission"):
        snapshots.load_holdout(spark, base)
    assert dev + snapshots.load_holdout(spark, base, explicit_permission=True).count() == 40
    with pytest.raises(snapshots.SnapshotError, match="unlock"):
        snapshots.dissolve_holdout(spark, base)
    snapshots.write_text(spark, f"{base}/unlock.json", json.dumps({"unlocked": True}))
    snapshots.dissolve_holdout(spark, base)
    assert snapshots.load_dev(spark, base).count() == 40
    with pytest.raises(snapshots.SnapshotError, match="dissolved"):
        snapshots.load_holdout(spark, base, explicit_permission=True)


def test_run_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert ledger.run_count(spark, path) == 0
    for k in range(3):
        ledger.log_run(spark, path, {"b": 1, "a": k}, {"auc": float("nan"), "n": k}, seed=1, data_snapshot_hash="h", sha="s")
    runs = ledger.read_runs(spark, path).collect()
    assert len(runs) == 3 and {json.loads(r.metrics)["n"] for r in runs} == {0, 1, 2}
    assert scalars.config_hash({"a": 1, "b": 2}) == scalars.config_hash({"b": 2, "a": 1})
    with pytest.raises(ValueError, match="hash"):
        ledger.log_run(spark, path, {}, {}, seed=1, data_snapshot_hash="")
    assert all("NaN" in r.metrics for r in runs), "what is not finite stays so"
    whole = {"timestamp": "t", "git_sha": "s", "config_hash": "c", "data_snapshot_hash": "d", "seed": 1, "config": {}, "metrics": {}}
    ledger.append_row(spark, path, whole)
    with pytest.raises(Exception, match="missing fields: notes"):
        ledger.read_runs(spark, path).collect()


def test_suite_records_and_live_rows_are_logged(spark, tmp_path):
    runs, live = f"file://{tmp_path}/runs", f"file://{tmp_path}/live"
    records = spark.createDataFrame([("b", 0.5, [0.1, 0.2]), ("a", None, [0.3, None])], "name string, auc double, auc_ci90 array<double>")
    assert ledger.log_records(spark, runs, records, {"suite": "x"}, seed=3, data_snapshot_hash="h") == 2
    assert sorted((r.notes, json.loads(r.metrics)["auc"], json.loads(r.config)["strategy"]) for r in ledger.read_runs(spark, runs).collect()) == [("a", None, "a"), ("b", 0.5, "b")]
    row = spark.createDataFrame([("2024-05-01", 0.7, 1, dt.date(2024, 5, 15))], "asof string, prob double, signal int, label_resolves_after date")
    got = ledger.append_live(spark, live, runs, row, {"kind": "gbm"}, seed=3, data_snapshot_hash="h")
    assert got["label_resolves_after"] == "2024-05-15" and ledger.run_count(spark, runs) == 3
    ledger.append_live(spark, live, runs, row.withColumn("asof", F.lit("2024-05-02")), {"kind": "gbm"}, seed=3, data_snapshot_hash="h")
    assert sorted(r.asof for r in ledger.read_merged(spark, live).collect()) == ["2024-05-01", "2024-05-02"]
    with pytest.raises(ValueError, match="already"):
        ledger.append_live(spark, live, runs, row, {"kind": "gbm"}, seed=3, data_snapshot_hash="h")


def test_book_is_built_and_frozen(spark, tmp_path):
    base = f"file://{tmp_path}"
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(8)]
    rows = [(s, d, 100.0 + k * (1 + j) if (s, k) != ("b", 2) else 900.0) for j, s in enumerate("ab") for k, d in enumerate(days)]
    positions = spark.createDataFrame([("a", 1.0, 10.0), ("b", 3.0, 10.0), ("gone", 2.0, 10.0)], "series string, shares double, price double")
    listing = snapshots.freeze_book(spark.createDataFrame(rows, "series string, date date, close double"), positions, base, manifest={"weights_asof": "2024-01-09"})
    assert list(snapshots.read_manifest(spark, base, "book")["target_weights"]) == ["b", "gone", "a"] and listing["target_weights"]["b"] == 0.5
    assert listing["excluded"] == ["gone"] and listing["cut_dates"] == {"b": "2024-01-04"} and listing["rows"] == 7
    assert snapshots.load(spark, base, "book").columns == ["date", "BOOK_close", "n_names"]
    with pytest.raises(snapshots.SnapshotError, match="frozen"):
        snapshots.freeze_book(spark.createDataFrame(rows, "series string, date date, close double"), positions, base)


def test_csv_snapshots_keep_what_is_missing_and_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/s.csv"
    df = spark.createDataFrame([(dt.date(2024, 1, 2), None, 2), (dt.date(2024, 1, 1), 1.25, 1)], "date date, BOOK_close double, n_names int")
    snapshots.write_csv_snapshot(df, path)
    sha = snapshots.file_hash(spark, f"{path}/*.csv")
    got = [tuple(r) for r in snapshots.load_csv(spark, f"{path}/*.csv", panel.BOOK_SCHEMA, sha).collect()]
    assert got == [(dt.date(2024, 1, 1), 1.25, 1), (dt.date(2024, 1, 2), None, 2)]
    with pytest.raises(snapshots.SnapshotError, match="manifest"):
        snapshots.load_csv(spark, f"{path}/*.csv", panel.BOOK_SCHEMA, "0" * 64)


def test_prediction_stream_appends_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ck"))
    spark.createDataFrame([("2024-05-01", 0.9), ("2024-05-02", 0.1)], "asof string, rank double").write.json(src)
    stream = ledger_stream.with_prediction(spark.readStream.schema("asof string, rank double").json(src))
    for _ in range(2):
        ledger_stream.append_predictions(stream, out, ck).awaitTermination()
    got = sorted((r.asof, r.signal, r.band_hi) for r in spark.read.json(out).collect())
    assert got == [("2024-05-01", 1, 0.75), ("2024-05-02", 0, 0.10)]


@pytest.mark.skipif(not os.environ.get("GOLDEN_BOOK_CSV"), reason="needs a portfolio index with published results")
def test_published_portfolio_numbers(spark):
    """Published results of the persistence rule on one index."""
    df = panel.read_csv_panel(spark, os.environ["GOLDEN_BOOK_CSV"], panel.BOOK_SCHEMA)
    data = suites.book_only_dataset(df).cache()
    rows = suites.baseline_rows(data, "BOOK_close", names=("persistence",))
    got = metrics.evaluate_strategy(rows, ["name"]).head()
    assert (got.n, got.base_rate, got.auc, got.brier) == (831, 0.361, 0.6388, 0.3189)
    assert (got.precision, got.recall, got.false_positive_days_frac, got.hedge_on_frac) == (0.5681, 0.4867, 0.1336, 0.3093)
    assert (got.nps, got.n_onsets, got.n_missed, got.lead_median, got.lead_mean) == (0.18223, 29, 19, 7.5, 6.0)
    from tidewatch.operators import bootstrap

    own = align.positioned(rows.select("date", "y", "p"), Over(by=()))
    ci = bootstrap.block_bootstrap_ci(own, bootstrap.metric_auc, seed=20260813).head()
    assert (round(ci.lo, 4), round(ci.hi, 4)) == (0.5619, 0.7082)
