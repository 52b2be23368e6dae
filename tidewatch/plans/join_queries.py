"""Registered queries of joins in time, tests of many strategies and streams in
batches, and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.bands import band
from ..functions.scalars import round_double
from ..functions.windows import Over
from ..operators import asof, bootstrap, cube, folds, intervals, isotonic, metrics, reality, sketch, spread
from ..operators.features import MARKET_FEATURES, with_market_features
from ..operators.labels import with_labels, with_returns
from ..sources.scratch import Scratch
from ..streaming import labels, windows
from .oracle import BARS, FOLDS, SIGNALS, with_
from .oracle import ORACLE as BASE
from .queries import SCAN, WIDE, _t, bars, order_bars, panel, r6, signal_rows

LONG = Over()
YEAR = 1998


def q_asof_join(spark, d):
    """Each order with the last bar of flag A, published two days late, of the
    last five days: all rows have one key."""
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    b = bars(spark, d).where("series = 'A'").select("date", "close")
    out = asof.asof_join(o, b, "date", lag=F.expr("INTERVAL '2' DAY"), tolerance=F.expr("INTERVAL '5' DAY"))
    return out.select("o_orderkey", F.date_format("date_right", "yyyy-MM-dd").alias("known_since"), r6("close"))


def q_asof_events(spark, d):
    """Each purchase with the same user's last view before it and the first error
    from then on."""
    e = _t(spark, d, "events")
    of = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name), F.col("value").alias(f"{name}_value"))
    out = asof.asof_join(of("purchase", "purchase"), of("view", "view"), "ts", ("user_id",), strict=True, tolerance=F.expr("INTERVAL '1' DAY")).drop("ts_right")
    out = asof.asof_join(out, of("error", "error"), "ts", ("user_id",), forward=True)
    return out.select("purchase", "view", r6("view_value"), "error", r6("error_value"))


def q_common_days(spark, d):
    """Days on which bars of lines and of orders both exist."""
    return bars(spark, d).select("date").intersect(order_bars(spark, d).select("date")).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


def label_spans(spark, d):
    """Each bar's label interval in days since 1970: to the tenth later bar."""
    rows = bars(spark, d).withColumn("last", F.lead("date", 10).over(LONG.sorted())).where("last IS NOT NULL")
    return rows.select("series", "date", F.unix_date("date").cast("long").alias("s"), F.unix_date("last").cast("long").alias("e"))


def q_label_overlap(spark, d):
    """For each label the labels, of any series, whose interval overlaps its own."""
    rows = label_spans(spark, d)
    pairs = intervals.overlap_join(rows, rows, "s", "e")
    shared = F.least("a.e", "b.e") - F.greatest("a.s", "b.s") + 1
    return pairs.groupBy(F.col("a.series").alias("series"), F.col("a.date").alias("date")).agg(F.count(F.lit(1)).alias("n_overlaps"), F.sum(shared).alias("days_shared"))


def q_label_uniqueness(spark, d):
    """How many labels of all series overlap each label, and its average
    uniqueness among those of its own series."""
    rows = label_spans(spark, d)
    out = intervals.uniqueness(intervals.overlap_counts(rows, rows, "s", "e"), "s", "e", ("series",))
    return out.select("series", "date", "n_overlaps", r6("uniqueness"))


def q_purge_by_time(spark, d):
    """The labels of other series that overlap no label of series N of one year,
    ten days apart at least."""
    rows = label_spans(spark, d)
    tests = rows.where((F.col("series") == "N") & (F.year("date") == YEAR))
    return intervals.purged(rows.where("series <> 'N'"), tests, "s", "e", embargo=10).select("series", "date")


def rule_differences(spark, d):
    """How much more net protection each threshold on the score gives than the
    persistence rule, by series and day."""
    rows = signal_rows(spark, d)
    each = rows.withColumn("thr", F.explode(F.array(*[F.lit(t) for t in SCAN]))).withColumn("s_thr", (F.col("p") >= F.col("thr")).cast("double"))
    each = metrics.with_net_protection(each, Over("i", ("series", "thr")), "s_thr", name="own")
    each = metrics.with_net_protection(each, Over("i", ("series", "thr")), "s", name="base")
    return each.select("series", F.col("thr").cast("string").alias("name"), "i", (F.col("own") - F.col("base")).alias("d"))


def q_reality_check(spark, d):
    rows = rule_differences(spark, d)
    sizes = rows.groupBy("series", "name").count().groupBy("series").agg(F.max("count").alias("n"))
    starts = bootstrap.starts_of(sizes, ["series"], rule="stepped").drop("n")
    out = reality.reality_check(rows, starts, ["series"])
    return out.select("series", "name", r6("mean"), "rank", r6("p_alone"), r6("p_step"))


def fold_scores(spark, d):
    """Training rows of each fold with the score to three places."""
    rows = signal_rows(spark, d).withColumn("p", F.round("p", 3))
    each = folds.assign(rows, folds.folds_of(rows, ["series"]).drop("n"), ["series"])
    return each.where("role = 'train'").select("series", "fold", "y", "p")


def q_isotonic(spark, d):
    out = isotonic.isotonic_blocks(fold_scores(spark, d), ["series", "fold"])
    return out.select("series", "fold", r6("low"), r6("high"), "n", r6("value"))


def q_metrics_cube(spark, d):
    """The metric record by series, year and hedge band, and by all coarser groups."""
    rows = signal_rows(spark, d).withColumns({"year": F.year("date"), "band": band(F.col("p"))["lo"]})
    out = cube.metrics_cube(rows, ["series", "year", "band"], ["series"])
    return out.select("level", "series", "year", "band", "n", *[r6(c) for c in out.columns if c not in ("level", "series", "year", "band", "n", "n_onsets", "n_missed")], "n_onsets", "n_missed")


def event_bars(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_type").alias("series"), "ts", "event_id", (F.col("value") + 10).alias("price"), (F.col("value") / (F.col("value") + 1)).alias("p"))


DELAY = "1 hour"


def _resolved(df):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return df.select("series", at("ts"), round_double("p", 6), at("resolved_ts"), round_double("r", 6), "y")


def q_resolved(spark, d):
    """Every event is a bar, those of one time in the order of their ids."""
    rows = event_bars(spark, d)
    return _resolved(labels.resolve_batch(rows, labels.latest(spark, rows, DELAY), order="event_id"))


def q_resolved_stream(spark, d):
    """The same from a stream over the events, with state and timers."""
    scratch = Scratch(spark)
    kept = scratch.save(event_bars(spark, d), "bars")  # a folder, as a stream of files needs one
    rows = spark.readStream.schema(kept.schema).parquet(f"{scratch.base}/bars")
    labels.start_resolved(rows, f"{scratch.base}/rows", f"{scratch.base}/log", DELAY, order="event_id").awaitTermination()
    return _resolved(spark.read.schema(labels.SCHEMA).parquet(f"{scratch.base}/rows"))


def _windowed(df, *keys):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return df.select(*keys, at("start"), at("end"), "n", r6("mean"), r6("vol"), r6("low"), r6("high"))


def q_sessions(spark, d):
    return _windowed(windows.sessions(_t(spark, d, "events"), ["user_id"], "ts", "6 hours"), "user_id")


def q_sliding(spark, d):
    return _windowed(windows.sliding(_t(spark, d, "events"), ["event_type"], "ts", "2 hours", "30 minutes"), "event_type")


def q_labels_spread(spark, d):
    """The labels with each series cut into ranges."""
    rows, over = spread.spread(bars(spark, d), LONG, ranges=8)
    out = spread.core(with_labels(rows, "close", over))
    return out.select("series", "date", r6("rv_trail"), r6("rv_thresh"), r6("rv_fwd"), r6("mdd_fwd"), "label")


def q_features_spread(spark, d):
    """The features of one series, the panel, cut into ranges."""
    rows, over = spread.spread(panel(spark, d), WIDE, ranges=8)
    return spread.core(with_market_features(rows, over)).select("date", *[r6(f) for f in MARKET_FEATURES])


def _spread_signals(spark, d):
    rows = spread.positioned(signal_rows(spark, d).drop("i"), LONG)
    return spread.spread(rows, Over("i"), 11, 1, ranges=8)


def q_nps_spread(spark, d):
    rows, over = _spread_signals(spark, d)
    return spread.core(metrics.with_net_protection(rows, over)).groupBy("series").agg(r6(metrics.net_protection_of(), "nps"))


def q_lead_times_spread(spark, d):
    rows, over = _spread_signals(spark, d)
    onset, lead = F.coalesce(w.onset("y", over), F.lit(False)), w.lead_time("s", "i", metrics.LOOKBACK, over)
    each = spread.core(rows.withColumns({"onset": onset, "lead": lead}))
    led = F.when(F.col("onset"), F.col("lead"))
    return each.groupBy("series").agg(F.count_if("onset").alias("n_onsets"), F.count_if(F.col("onset") & F.col("lead").isNull()).alias("n_missed"), r6(F.percentile(led, F.lit(0.5)), "lead_median"), r6(F.avg(led), "lead_mean"))


def q_index_level_spread(spark, d):
    """The running index of each series over ranges."""
    rows = with_returns(bars(spark, d))
    out = spread.with_running(rows, LONG, {"total": (F.col("lr"), "sum")})
    return out.select("series", "date", r6(F.exp("total") * 100.0, "level"))


FRAME, FRAME_BLOCK = 1024, 128


def q_approx_threshold(spark, d):
    """The trailing 75 % quantile of the events' values over long frames, from a
    tree of sketches: how many are within the rank error that they state."""
    rows = _t(spark, d, "events").select(F.lit("all").alias("series"), "event_id", "value")
    over = Over("event_id")
    out = Scratch(spark).save(sketch.trailing_quantile(rows, "value", 0.75, FRAME, over, k=64, block=FRAME_BLOCK), "quantiles")
    met = sketch.frame_ranks(out, "value", "quantile", FRAME, over).where("quantile IS NOT NULL")
    want = 0.75 * (FRAME - 1)
    within = F.greatest(F.col("below") - want, want - F.col("upto") + 1) <= F.col("rank_error") + 1
    return met.groupBy("series").agg(F.count(F.lit(1)).alias("frames"), F.count_if(within).alias("within"), F.count_if(F.col("rank_error") < FRAME * 0.1).alias("close"))


SPREAD = {"labels_spread": q_labels_spread, "features_spread": q_features_spread, "nps_spread": q_nps_spread, "lead_times_spread": q_lead_times_spread, "index_level_spread": q_index_level_spread}

QUERIES = SPREAD | {
    "common_days": q_common_days, "asof_join": q_asof_join, "asof_events": q_asof_events, "label_overlap": q_label_overlap, "label_uniqueness": q_label_uniqueness, "purge_by_time": q_purge_by_time,
    "reality_check": q_reality_check, "isotonic_calibration": q_isotonic, "metrics_cube": q_metrics_cube, "approx_threshold": q_approx_threshold,
    "resolved_labels": q_resolved, "resolved_labels_stream": q_resolved_stream, "session_bursts": q_sessions, "sliding_vol": q_sliding,
}

GROUPS = [c for k in (3, 2, 1, 0) for c in combinations(("series", "year", "band"), k)]
FOLD_SCORES = """scores AS (SELECT r.series, f.fold, r.y, round(r.p, 3) AS p FROM rows_ r JOIN folds f ON r.series = f.series AND r.i < f.train_end)"""
RESOLVED = """WITH b AS (SELECT event_type AS series, ts, value + 10 AS price, value / (value + 1) AS p FROM events),
l AS (SELECT *, lead(ts, 10) OVER w AS then_ts, lead(price, 10) OVER w AS then_price FROM b WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT series, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(p, 6) AS p, strftime(then_ts, '%Y-%m-%d %H:%M:%S.%f') AS resolved_ts, round(then_price / price - 1, 6) AS r, (then_price / price - 1 < 0)::INT AS y
FROM l WHERE then_ts < (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) FROM b)"""
MOMENTS = "count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS vol, round(min(value), 6) AS low, round(max(value), 6) AS high"

SPANS = BARS + """,
spans AS (SELECT series, date, date - DATE '1970-01-01' AS s, lead(date, 10) OVER (PARTITION BY series ORDER BY date) - DATE '1970-01-01' AS e FROM bars QUALIFY e IS NOT NULL)"""

ORACLE = {name: BASE[name.removesuffix("_spread")] for name in SPREAD} | {
    "common_days": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem INTERSECT SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders",
    "asof_join": f"""WITH {BARS}, late AS (SELECT date + 2 AS since, close FROM bars WHERE series = 'A')
SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= since + 5 THEN strftime(since, '%Y-%m-%d') END AS known_since, CASE WHEN o_orderdate::DATE <= since + 5 THEN round(close, 6) END AS close
FROM orders ASOF LEFT JOIN late ON o_orderdate::DATE >= since""",
    "asof_events": """SELECT p.event_id AS purchase, CASE WHEN p.ts <= v.ts + INTERVAL 1 DAY THEN v.event_id END AS view, CASE WHEN p.ts <= v.ts + INTERVAL 1 DAY THEN round(v.value, 6) END AS view_value,
  e.event_id AS error, round(e.value, 6) AS error_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts <= e.ts""",
    "label_overlap": f"""WITH {SPANS}
SELECT a.series, a.date, count(*) AS n_overlaps, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1)::BIGINT AS days_shared
FROM spans a JOIN spans b ON a.s <= b.e AND b.s <= a.e GROUP BY 1, 2""",
    "label_uniqueness": f"""WITH {SPANS},
days AS (SELECT series, date, s, e, unnest(range(s, e + 1)) AS t FROM spans),
cover AS (SELECT series, t, count(*) AS c FROM days GROUP BY 1, 2),
own AS (SELECT d.series, d.date, avg(1.0::DOUBLE / c) AS u FROM days d JOIN cover USING (series, t) GROUP BY 1, 2),
met AS (SELECT a.series, a.date, count(*) AS n FROM spans a JOIN spans b ON a.s <= b.e AND b.s <= a.e GROUP BY 1, 2)
SELECT own.series, own.date, n AS n_overlaps, round(u, 6) AS uniqueness FROM own JOIN met USING (series, date)""",
    "purge_by_time": f"""WITH {SPANS}
SELECT series, date FROM spans x WHERE series <> 'N' AND NOT EXISTS (
  SELECT 1 FROM spans t WHERE t.series = 'N' AND year(t.date) = {YEAR} AND x.s <= t.e + 10 AND t.s - 10 <= x.e)""",
    "reality_check": with_(SIGNALS, """each AS (SELECT series, i, r, s, thr, (p >= thr)::INT::DOUBLE AS s_thr FROM rows_, (SELECT unnest([""" + ", ".join(map(str, SCAN)) + """])::DOUBLE AS thr)),
moved AS (SELECT *, abs(s_thr - coalesce(lag(s_thr) OVER w, s_thr)) AS a, abs(s - coalesce(lag(s) OVER w, s)) AS b FROM each WINDOW w AS (PARTITION BY series, thr ORDER BY i)),
diffs AS (SELECT series, thr::VARCHAR AS name, i, (s_thr - s) * greatest(0.0, -r) * 0.5 / 10 - 0.0002 * (s_thr - s) - 0.001 * (a - b) AS d, count(*) OVER (PARTITION BY series, thr) AS n FROM moved)""",
    """own AS (SELECT series, name, avg(d) AS mean, any_value(n) AS n, row_number() OVER (PARTITION BY series ORDER BY round(sqrt(any_value(n)) * avg(d), 12) DESC, name) AS rank FROM diffs GROUP BY 1, 2)""",
    """starts AS (SELECT series, rep, k, (rep * 7919 + k * 104729) % n AS start, n FROM (SELECT series, max(n) AS n FROM own GROUP BY 1), range(2000) a(rep), range(100000) b(k) WHERE k < ceil(n / 20.0))""",
    """ahead AS (SELECT series, name, i, n, coalesce(sum(d) OVER (PARTITION BY series, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, sum(d) OVER (PARTITION BY series, name) AS total FROM diffs)""",
    """pieces AS (SELECT series, rep, start, least(20, n - k * 20) AS len, n FROM starts)""",
    """sums AS (SELECT p.series, x.name, p.rep, any_value(p.n) AS n, sum(CASE WHEN start + len < p.n THEN y.upto - x.upto ELSE x.total - x.upto + y.upto END) / any_value(p.n) AS m
  FROM pieces p JOIN ahead x ON x.series = p.series AND x.i = p.start JOIN ahead y ON y.series = p.series AND y.name = x.name AND y.i = (p.start + p.len) % p.n GROUP BY 1, 2, 3)""",
    """centred AS (SELECT s.series, s.name, rep, rank, round(sqrt(s.n) * mean, 12) AS stat, round(sqrt(s.n) * (m - mean), 12) AS z FROM sums s JOIN own USING (series, name))""",
    """most AS (SELECT *, max(z) OVER (PARTITION BY series, rep ORDER BY rank DESC) AS top FROM centred)""",
    """shares AS (SELECT series, name, rank, avg((z >= stat)::INT) AS p_alone, avg((top >= stat)::INT) AS p FROM most GROUP BY 1, 2, 3)""")
    + "SELECT series, name, round(mean, 6) AS mean, rank::INT AS rank, round(p_alone, 6) AS p_alone, round(max(p) OVER (PARTITION BY series ORDER BY rank), 6) AS p_step FROM shares JOIN own USING (series, name, rank)",
    # The largest, over all beginnings up to a score, of the least mean, over all ends from it on, of the rows between.
    "isotonic_calibration": with_(SIGNALS, FOLDS, FOLD_SCORES, "each AS (SELECT series, fold, p, count(*) AS n, sum(y) AS s FROM scores GROUP BY 1, 2, 3)",
        "sums AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM each WINDOW w AS (PARTITION BY series, fold ORDER BY p))",
        "spans AS (SELECT a.series, a.fold, a.k AS a, b.k AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM sums a JOIN sums b ON a.series = b.series AND a.fold = b.fold AND b.k >= a.k)",
        "least AS (SELECT series, fold, a, b AS k, min(m) OVER (PARTITION BY series, fold, a ORDER BY b DESC) AS m FROM spans)",
        "fit AS (SELECT series, fold, k, max(m) AS v FROM least GROUP BY 1, 2, 3)")
    + "SELECT series, fold, round(min(p), 6) AS low, round(max(p), 6) AS high, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS value FROM fit JOIN sums USING (series, fold, k) GROUP BY series, fold, round(v, 12)",
    "resolved_labels": RESOLVED,
    "resolved_labels_stream": RESOLVED,
    "session_bursts": f"""WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
b AS (SELECT *, sum((before IS NULL OR ts >= before + INTERVAL 6 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS "end", {MOMENTS} FROM b GROUP BY user_id, g""",
    "sliding_vol": f"""WITH a AS (SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS w FROM events, range(4) t(k))
SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(w + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS "end", {MOMENTS} FROM a GROUP BY event_type, w""",
    "metrics_cube": with_(SIGNALS, """marked AS (SELECT *, year(date) AS year, CASE WHEN p >= 0.30 THEN 0.50 WHEN p >= 0.20 THEN 0.25 ELSE 0.0 END::DOUBLE AS band, lag(y) OVER w AS y0, max(CASE WHEN s = 0 THEN i END) OVER w AS off, min(i) OVER w AS first
  FROM rows_ WINDOW w AS (PARTITION BY series ORDER BY i))""",
        "led AS (SELECT *, y = 1 AND coalesce(y0 = 0, false) AS onset, CASE WHEN s = 1 THEN least(i - coalesce(off, first - 1) - 1, 10) END AS lead FROM marked)",
        "scores AS (SELECT grouping(series, year, band) AS level, series, year, band, p, sum(y) AS pos, sum(1 - y) AS neg FROM led GROUP BY GROUPING SETS ("
        + ", ".join("(" + ", ".join([*g, "p"]) + ")" for g in GROUPS) + "))",
        "wins AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY level, series, year, band ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS w FROM scores)",
        "aucs AS (SELECT level, series, year, band, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(w) / (sum(pos) * sum(neg)) END AS auc FROM wins GROUP BY 1, 2, 3, 4)",
        "sums AS (SELECT grouping(series, year, band) AS level, series, year, band, count(*) AS n, avg(y) AS base_rate, avg(s) AS hedge_on_frac, coalesce(sum(s * y) / nullif(sum(s), 0), 0) AS precision, coalesce(sum(s * y) / nullif(sum(y), 0), 0) AS recall,"
        " avg((s = 0 AND y = 1)::INT) / greatest(avg(y), 1e-9) AS false_negative_rate, avg((s = 1 AND y = 0)::INT) AS false_positive_days_frac, avg((p - y) * (p - y)) AS brier,"
        " count(*) FILTER (onset) AS n_onsets, count(*) FILTER (onset AND lead IS NULL) AS n_missed, avg(lead) FILTER (onset) AS lead_mean FROM led GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(g) + ")" for g in GROUPS) + "))")
    + "SELECT s.level::INT AS level, s.series, s.year::INT AS year, s.band, n, n_onsets, n_missed, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("base_rate", "hedge_on_frac", "precision", "recall", "false_negative_rate", "false_positive_days_frac", "brier", "auc", "lead_mean"))
    + " FROM sums s JOIN aucs a ON a.level = s.level AND a.series IS NOT DISTINCT FROM s.series AND a.year IS NOT DISTINCT FROM s.year AND a.band IS NOT DISTINCT FROM s.band",
    # Every full frame is within its bound, and the bound below a tenth of the frame.
    "approx_threshold": f"SELECT 'all' AS series, count(*) - {FRAME - 1} AS frames, count(*) - {FRAME - 1} AS within, count(*) - {FRAME - 1} AS close FROM events",
}
