"""The SQL of the registered queries, for an independent engine.

Written from the definitions, not from the DataFrame code: frames are spelled out,
and each query is one statement over the test tables.
"""

from __future__ import annotations

from ..operators.features import MARKET_FEATURES, SMALL_FEATURES

S252 = "sqrt(252.0)"
BARS = """bars AS (SELECT l_returnflag AS series, l_shipdate::DATE AS date, avg(l_extendedprice) AS close, max(l_extendedprice) AS high, min(l_extendedprice) AS low FROM lineitem GROUP BY 1, 2),
ret AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY series ORDER BY date)) AS lr FROM bars)"""
RAW = """raw AS (SELECT l_shipdate::DATE AS date, avg(l_extendedprice) AS SPY_close, max(l_extendedprice) AS SPY_high, min(l_extendedprice) AS SPY_low,
  avg(l_extendedprice) FILTER (l_returnflag = 'A') AS QQQ_close, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS IWM_close, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS HYG_close,
  avg(l_extendedprice) FILTER (l_linestatus = 'F') AS LQD_close, avg(l_quantity) FILTER (l_linestatus = 'O') AS VIX_close, avg(l_quantity) FILTER (l_linestatus = 'F') AS VIX3M_close
  FROM lineitem GROUP BY 1)"""
COLUMNS = ("SPY_close", "SPY_high", "SPY_low", "QQQ_close", "IWM_close", "HYG_close", "LQD_close", "VIX_close", "VIX3M_close")
FILL = "last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}"
PANEL = RAW + ",\nfilled AS (SELECT date, " + ", ".join(FILL.format(c=c) for c in COLUMNS) + " FROM raw),\npanel AS (SELECT * FROM filled WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS) + ")"
ORDERS = "obars AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)"


def over(first: str, last: str, part: str = "PARTITION BY series ", order: str = "date") -> str:
    return f"OVER ({part}ORDER BY {order} ROWS BETWEEN {first} AND {last})"


def roll(agg: str, x: str, n: int, least: int | None = None, part: str = "PARTITION BY series ", order: str = "date") -> str:
    o = over(f"{n - 1} PRECEDING", "CURRENT ROW", part, order)
    return f"CASE WHEN count({x}) {o} >= {least or n} THEN {agg} {o} END"


def lag(x: str, k: int, part: str = "PARTITION BY series ", order: str = "date") -> str:
    return f"lag({x}, {k}) OVER ({part}ORDER BY {order})"


def vol(x: str, n: int, part: str = "PARTITION BY series ") -> str:
    return f"{roll(f'stddev_pop({x})', x, n, part=part)} * {S252}"


def chg(x: str, k: int, part: str = "PARTITION BY series ") -> str:
    return f"{x} / nullif({lag(x, k, part)}, 0) - 1"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def simple(exprs: dict[str, str], source: str = "ret", extra: tuple[str, ...] = ()) -> str:
    return with_(BARS, *extra) + "SELECT series, date, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in exprs.items()) + f" FROM {source}"


RV = f"rv AS (SELECT *, {vol('lr', 10)} AS rv10 FROM ret)"
FWD = over("1 FOLLOWING", "10 FOLLOWING")
NEXT = over("CURRENT ROW", "10 FOLLOWING")
DRAWDOWN = f"CASE WHEN count(close) {NEXT} = 11 THEN list_min(list_transform(range(2, 12), lambda j: (list(close) {NEXT})[j] / list_max((list(close) {NEXT})[1:j]) - 1)) END"
LABELLED = f"""parts AS (SELECT *, {vol('lr', 10)} AS rv_trail, CASE WHEN count(lr) {FWD} = 10 THEN stddev_pop(lr) {FWD} * {S252} END AS rv_fwd, list(close) {NEXT} AS ahead, count(close) {NEXT} AS n_ahead FROM ret),
thresholds AS (SELECT *, {roll('quantile_cont(rv_trail, 0.75)', 'rv_trail', 252)} AS rv_thresh,
  CASE WHEN n_ahead = 11 THEN list_min(list_transform(range(2, 12), lambda j: ahead[j] / list_max(ahead[1:j]) - 1)) END AS mdd_fwd FROM parts),
labelled AS (SELECT *, (rv_fwd > rv_thresh)::INT::DOUBLE AS label FROM thresholds)"""
SIGNALS = LABELLED + f""",
scored AS (SELECT series, date, label AS y, coalesce((rv_trail > rv_thresh)::INT::DOUBLE, 0.0) AS s, lead(close, 10) OVER (PARTITION BY series ORDER BY date) / close - 1 AS r,
  rv_trail / nullif(rv_trail + rv_thresh, 0) AS p, rv_trail, rv_thresh FROM labelled),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i FROM scored WHERE y IS NOT NULL AND r IS NOT NULL AND p IS NOT NULL)"""
SIGNALS = BARS + ",\n" + SIGNALS
FOLDS = """sizes AS (SELECT series, count(*) AS n FROM rows_ GROUP BY 1 HAVING count(*) > 175),
folds AS (SELECT series, n, k::INT AS fold, 130 + k * ((n - 150) // 5) AS train_end, 150 + k * ((n - 150) // 5) AS test_start,
  CASE WHEN k = 4 THEN n ELSE 150 + (k + 1) * ((n - 150) // 5) END AS test_end FROM sizes, range(5) t(k))"""
ASSIGNED = """assigned AS (SELECT r.*, f.fold, CASE WHEN i < train_end THEN 'train' ELSE 'test' END AS role
  FROM rows_ r JOIN folds f ON r.series = f.series AND (r.i < f.train_end OR (r.i >= f.test_start AND r.i < f.test_end)))"""


def auc_sql(source: str, keys: str, y: str = "y", p: str = "p") -> str:
    """Pairs of one positive and one negative row, ties by half: over distinct
    scores, by the counts below and at each."""
    return f"""SELECT {keys}, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END, 6) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {keys}, {p} AS score, sum({y}) AS pos, sum(1 - {y}) AS neg FROM {source} WHERE {p} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys}, {p})) GROUP BY {keys}"""


W = ""  # windows over the wide panel have no partition
FEATURE_STEPS = f"""l0 AS (SELECT *, ln(SPY_close) - ln({lag('SPY_close', 1, W)}) AS spy, ln(QQQ_close) - ln({lag('QQQ_close', 1, W)}) AS qqq, ln(IWM_close) - ln({lag('IWM_close', 1, W)}) AS iwm,
  HYG_close / LQD_close AS credit, (SPY_high - SPY_low) / SPY_close AS rng FROM panel),
l1 AS (SELECT *, {vol('spy', 10, W)} AS rv10, {vol('spy', 21, W)} AS rv21, {vol('spy', 63, W)} AS rv63, VIX_close AS vix, VIX_close / VIX3M_close - 1 AS vix_slope, {chg('VIX_close', 5, W)} AS vix_chg5,
  {chg('credit', 21, W)} AS credit_ratio_chg21, {chg('credit', 5, W)} AS credit_ratio_chg5, {vol('qqq', 10, W)} AS qqq_rv10, {vol('iwm', 10, W)} AS iwm_rv10,
  SPY_close / ({roll('max(SPY_close)', 'SPY_close', 63, part=W)}) - 1 AS dd_from_peak63, {chg('SPY_close', 21, W)} AS ret21, {chg('SPY_close', 5, W)} AS ret5,
  {roll('skewness(spy)', 'spy', 63, part=W)} AS skew63, {roll('avg(rng)', 'rng', 5, part=W)} AS range5 FROM l0),
l2 AS (SELECT *, rv10 - {lag('rv10', 5, W)} AS rv10_chg5, rv10 / nullif(rv63, 0) AS rv_ratio_10_63, {chg('rv10', 1, W)} AS c1, VIX_close / 100 - rv21 AS vrp FROM l1),
featured AS (SELECT *, {roll('stddev_samp(c1)', 'c1', 21, part=W)} AS volofvol21 FROM l2)"""
WIDE_LABEL = f"""w1 AS (SELECT *, CASE WHEN count(spy) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN stddev_pop(spy) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) * {S252} END AS rv_fwd,
  {roll('quantile_cont(rv10, 0.75)', 'rv10', 252, part=W)} AS rv_thresh FROM featured),
judged AS (SELECT *, (rv_fwd > rv_thresh)::INT::DOUBLE AS label FROM w1)"""
BOOK_STEPS = f"""b0 AS (SELECT *, ln(QQQ_close) - ln({lag('QQQ_close', 1, W)}) AS bk, ln(SPY_close) - ln({lag('SPY_close', 1, W)}) AS spy, HYG_close / LQD_close AS credit FROM panel),
b1 AS (SELECT *, {vol('bk', 10, W)} AS brv10, {vol('bk', 21, W)} AS brv21, {vol('bk', 63, W)} AS brv63, QQQ_close / ({roll('max(QQQ_close)', 'QQQ_close', 63, part=W)}) - 1 AS bdd_from_peak63, {vol('spy', 10, W)} AS spy_rv10,
  ({roll('covar_samp(bk, spy)', 'bk + spy', 63, part=W)}) / ({roll('var_samp(spy)', 'spy', 63, part=W)}) AS beta63 FROM b0)"""
CUT = "cuts AS (SELECT series, max(date) AS cut_date FROM (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY series ORDER BY date))) AS j FROM obars) WHERE j > 2.0 GROUP BY 1)"
CLEAN = "clean AS (SELECT o.*, c.cut_date FROM obars o LEFT JOIN cuts c USING (series) WHERE c.cut_date IS NULL OR o.date > c.cut_date)"
GRID = "grid AS (SELECT d.date, s.series, b.close FROM (SELECT DISTINCT date FROM {t}) d CROSS JOIN (SELECT DISTINCT series FROM {t}) s LEFT JOIN {t} b ON b.date = d.date AND b.series = s.series)"
WEIGHTS = "weights AS (SELECT series, shares * price / sum(shares * price) OVER () AS weight FROM (SELECT o_orderpriority AS series, count(*)::DOUBLE AS shares, max(o_totalprice) AS price FROM orders GROUP BY 1))"
SPLIT = "edge AS (SELECT (max(date) - INTERVAL 18 MONTH)::DATE AS boundary FROM bars), split AS (SELECT series, date, boundary, CASE WHEN date <= boundary THEN 'dev' ELSE 'holdout' END AS part FROM bars, edge)"
NPS = "252 * avg(CASE WHEN r IS NOT NULL THEN s * greatest(0.0, -r) * 0.5 / 10 - 0.0002 * s - 0.001 * abs(s - coalesce(before, s)) END)"
SCAN = with_(SIGNALS) + f""", tried AS (SELECT r.series, r.y, r.r, r.i, t.thr, (p >= thr)::INT::DOUBLE AS s FROM rows_ r, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS thr) t),
seen AS (SELECT *, lag(s) OVER (PARTITION BY series, thr ORDER BY i) AS before FROM tried)
SELECT series, thr, round({NPS}, 6) AS nps, round(avg(s), 6) AS on_frac, round(coalesce(sum(s * y) / nullif(sum(s), 0), 0), 6) AS precision, round(coalesce(sum(s * y) / nullif(sum(y), 0), 0), 6) AS recall FROM seen GROUP BY series, thr"""
LEADS = """marked AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY i) AS y0, max(CASE WHEN s = 0 THEN i END) OVER (PARTITION BY series ORDER BY i) AS off, min(i) OVER (PARTITION BY series ORDER BY i) AS first FROM rows_),
onsets AS (SELECT series, CASE WHEN s = 1 THEN least(i - coalesce(off, first - 1) - 1, 10) END AS lead FROM marked WHERE y = 1 AND y0 = 0)"""
BAND = "CASE WHEN {x} >= {c} THEN {c_lo} WHEN {x} >= {b} THEN {b_lo} WHEN {x} >= 0 THEN {a_lo} END"
BOOT = """base AS (SELECT series, i, y, p, s AS p_base FROM rows_), size AS (SELECT series, count(*) AS n FROM base GROUP BY 1),
starts AS (SELECT series, rep, k, (rep * 7919 + k * 104729) % n AS start, n FROM range(2000) a(rep), size, range(100000) b(k) WHERE k < ceil(n / 20.0)),
sample AS (SELECT x.rep, b.* FROM (SELECT series, rep, (start + j) % n AS i FROM starts, range(20) c(j) WHERE k * 20 + j < n) x JOIN base b USING (series, i))"""


def unrounded_auc(source: str, keys: str, y: str = "y", p: str = "p") -> str:
    return auc_sql(source, keys, y, p).replace("round(", "(").replace(", 6) AS auc", ") AS auc")


WIDE_NAMES = ("urgent", "high", "medium", "unspecified", "low")


def round_all(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


ORACLE: dict[str, str] = {
    "log_returns": simple({"lr": "lr"}),
    "rv_trailing": simple({f"rv{n}": vol("lr", n) for n in (10, 21, 63)}),
    "rv_forward": simple({"rv_fwd": f"CASE WHEN count(lr) {FWD} = 10 THEN stddev_pop(lr) {FWD} * {S252} END"}),
    "fwd_max_drawdown": with_(BARS, LABELLED) + "SELECT series, date, round(mdd_fwd, 6) AS mdd_fwd FROM labelled",
    "rv_threshold": simple({"q75": roll("quantile_cont(rv10, 0.75)", "rv10", 252), "q60": roll("quantile_cont(rv10, 0.60)", "rv10", 252)}, "rv", (RV,)),
    "lags_and_changes": simple({"lag1": lag("close", 1), "lag5": lag("close", 5), "diff5": f"close - {lag('close', 5)}", "chg1": chg("close", 1), "chg21": chg("close", 21)}),
    "return_ahead": simple({"r10": "lead(close, 10) OVER (PARTITION BY series ORDER BY date) / close - 1"}),
    "vol_of_vol": simple({"volofvol21": roll("stddev_samp(chg)", "chg", 21)}, "c", (RV, f"c AS (SELECT *, {chg('rv10', 1)} AS chg FROM rv)")),
    "rolling_mean": simple({"mean5": roll("avg((high - low) / close)", "(high - low) / close", 5)}),
    "below_peak": simple({"dd63": f"close / ({roll('max(close)', 'close', 63)}) - 1"}),
    "rolling_skew": simple({"skew63": roll("skewness(lr)", "lr", 63)}),
    "trailing_rank": with_(BARS, RV, f"held AS (SELECT *, list(rv10) {over('126 PRECEDING', '1 PRECEDING')} AS h, count(rv10) {over('126 PRECEDING', '1 PRECEDING')} AS n FROM rv)")
    + "SELECT series, date, round(CASE WHEN n = 126 AND rv10 IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv10)) / 126.0 END, 6) AS rank126 FROM held",
    "index_level": simple({"level": f"100 * exp(sum(lr) {over('UNBOUNDED PRECEDING', 'CURRENT ROW')})"}),
    "labels": with_(BARS, LABELLED) + f"SELECT series, date, {round_all(('rv_trail', 'rv_thresh', 'rv_fwd', 'mdd_fwd'))}, label FROM labelled",
    "features": with_(PANEL, FEATURE_STEPS) + f"SELECT date, {round_all(MARKET_FEATURES)} FROM featured",
    "book_features": with_(PANEL, BOOK_STEPS) + f"""SELECT date, {round_all(('brv10', 'brv21', 'bdd_from_peak63', 'spy_rv10', 'beta63'))}, round(brv10 / nullif(brv63, 0), 6) AS brv_ratio_10_63, round(brv10 - {lag('brv10', 5, W)}, 6) AS brv10_chg5,
  round(VIX_close, 6) AS vix, round(VIX_close / VIX3M_close - 1, 6) AS vix_slope, round({chg('VIX_close', 5, W)}, 6) AS vix_chg5, round({chg('credit', 21, W)}, 6) AS credit_ratio_chg21 FROM b1""",
    "rolling_beta": with_(PANEL, BOOK_STEPS) + "SELECT date, round(beta63, 6) AS beta63 FROM b1",
    "panel_build": with_(PANEL) + f"SELECT date, {round_all(COLUMNS)} FROM panel",
    "wide_panel": with_(ORDERS, "j AS (SELECT a.date, a.close AS urgent, b.close AS high, c.close AS medium, d.close AS unspecified, e.close AS low FROM obars a "
        + " ".join(f"LEFT JOIN obars {t} ON {t}.date = a.date AND {t}.series = '{v}'" for t, v in (("b", "2-HIGH"), ("c", "3-MEDIUM"), ("d", "4-NOT SPECIFIED"), ("e", "5-LOW"))) + " WHERE a.series = '1-URGENT')",
        "f AS (SELECT date, " + ", ".join(FILL.format(c=c) for c in WIDE_NAMES) + " FROM j)") + f"SELECT date, {round_all(WIDE_NAMES)} FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in WIDE_NAMES),
    "panel_split": with_(BARS, SPLIT) + "SELECT * FROM split",
    "clean_suffix": with_(ORDERS, CUT, CLEAN) + "SELECT series, date, round(close, 6) AS close, cut_date FROM clean",
    "dedup_last": "SELECT o_orderpriority AS series, o_orderdate::DATE AS date, round(arg_max(o_totalprice, o_orderkey), 6) AS close, max(o_orderkey) AS pos FROM orders GROUP BY 1, 2",
    "clean_bars": "SELECT o_orderstatus = 'P' AS interpolated, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0 GROUP BY 1",
    "calendar_align": with_(ORDERS, GRID.format(t="obars")) + "SELECT series, date, round(close, 6) AS close, round(ln(close) - ln(lag(close) OVER (PARTITION BY series ORDER BY date)), 6) AS lr FROM grid",
    "book_weights": with_(WEIGHTS) + "SELECT series, round(weight, 6) AS weight FROM weights",
    "book_index": with_(ORDERS, CUT, CLEAN, GRID.format(t="clean"), WEIGHTS, """moves AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY series ORDER BY date)) AS lr FROM grid),
daily AS (SELECT date, sum(CASE WHEN lr IS NOT NULL THEN weight END) AS ws, sum(weight * lr) AS wr, count(*) FILTER (lr IS NOT NULL AND weight > 0) AS n_names FROM moves JOIN weights USING (series) GROUP BY 1)""")
    + "SELECT date, round(100 * exp(sum(wr / ws) OVER (ORDER BY date)), 6) AS BOOK_close, n_names FROM daily WHERE ws > 0",
    "baseline_persistence": with_(BARS, LABELLED) + "SELECT series, date, coalesce((rv_trail > rv_thresh)::INT::DOUBLE, 0.0) AS persistence FROM labelled",
    "baseline_trailing_pctl": with_(BARS, RV, f"q AS (SELECT *, {roll('quantile_cont(rv10, 0.60)', 'rv10', 252)} AS q60 FROM rv)") + "SELECT series, date, coalesce((rv10 > q60)::INT::DOUBLE, 0.0) AS trailing_pctl FROM q",
    "baseline_term_structure": with_(RAW) + "SELECT date, coalesce((VIX_close >= VIX3M_close)::INT::DOUBLE, 0.0) AS term_structure FROM raw",
    "adaptive_signal": with_(BARS, RV, f"q AS (SELECT *, {roll('quantile_cont(rv10, 0.70)', 'rv10', 126, 60)} AS q70 FROM rv)") + "SELECT series, date, round(q70, 6) AS adaptive_threshold, coalesce((rv10 >= q70)::INT::DOUBLE, 0.0) AS adaptive FROM q",
    "hedge_band": with_(SIGNALS) + "SELECT series, date, round(p, 6) AS p, CASE WHEN p >= 0.30 THEN 0.50 WHEN p >= 0.20 THEN 0.25 ELSE 0.0 END::DOUBLE AS lo, CASE WHEN p >= 0.30 THEN 0.75 WHEN p >= 0.20 THEN 0.50 ELSE 0.10 END::DOUBLE AS hi FROM rows_",
    "hedge_band_rank": with_(BARS, RV, f"held AS (SELECT *, list(rv10) {over('126 PRECEDING', '1 PRECEDING')} AS h, count(rv10) {over('126 PRECEDING', '1 PRECEDING')} AS n FROM rv)",
        "ranked AS (SELECT *, CASE WHEN n = 126 AND rv10 IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv10)) / 126.0 END AS k FROM held)")
    + "SELECT series, date, round(k, 6) AS rank126, CASE WHEN k >= 0.85 THEN 0.50 WHEN k >= 0.70 THEN 0.25 WHEN k >= 0 THEN 0.0 END::DOUBLE AS lo, CASE WHEN k >= 0.85 THEN 0.75 WHEN k >= 0.70 THEN 0.50 WHEN k >= 0 THEN 0.10 END::DOUBLE AS hi FROM ranked",
    "walk_forward_folds": with_(SIGNALS, FOLDS) + "SELECT * FROM folds",
    "fold_assignment": with_(SIGNALS, FOLDS, ASSIGNED) + "SELECT series, fold, role, count(*) AS rows, min(i) AS first, max(i) AS last FROM assigned GROUP BY 1, 2, 3",
    "fold_scaler": with_(SIGNALS, FOLDS, ASSIGNED) + "SELECT series, fold, round(avg(p), 6) AS p_mean, round(coalesce(nullif(stddev_pop(p), 0), 1), 6) AS p_scale, round(avg(r), 6) AS r_mean, round(coalesce(nullif(stddev_pop(r), 0), 1), 6) AS r_scale FROM assigned WHERE role = 'train' GROUP BY 1, 2",
    "auc": with_(SIGNALS) + auc_sql("rows_", "series"),
    "auc_ties": with_(SIGNALS) + auc_sql("rows_", "series", "y", "s"),
    "brier": with_(SIGNALS) + "SELECT series, round(avg((p - y) * (p - y)), 6) AS brier FROM rows_ GROUP BY 1",
    "confusion": with_(SIGNALS) + """SELECT series, round(coalesce(sum(s * y) / nullif(sum(s), 0), 0), 6) AS precision, round(coalesce(sum(s * y) / nullif(sum(y), 0), 0), 6) AS recall,
  round(avg((s = 0 AND y = 1)::INT) / greatest(avg(y), 1e-9), 6) AS false_negative_rate, round(avg((s = 1 AND y = 0)::INT), 6) AS false_positive_days_frac, round(avg(y), 6) AS base_rate,
  round(avg(s), 6) AS hedge_on_frac, count(*) AS n, round(count(*) / 10.0, 6)::DOUBLE AS n_eff FROM rows_ GROUP BY 1""",
    "nps": with_(SIGNALS) + f", seen AS (SELECT *, lag(s) OVER (PARTITION BY series ORDER BY i) AS before FROM rows_) SELECT series, round({NPS}, 6) AS nps FROM seen GROUP BY 1",
    "lead_times": with_(SIGNALS, LEADS) + "SELECT series, count(*) AS n_onsets, count(*) FILTER (lead IS NULL) AS n_missed, round(quantile_cont(lead, 0.5), 6)::DOUBLE AS lead_median, round(avg(lead), 6) AS lead_mean FROM onsets GROUP BY 1",
    "threshold_scan": SCAN,
    "calibration_bins": with_(SIGNALS) + "SELECT series, least(floor(p * 3), 2)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM rows_ GROUP BY 1, 2",
    "evaluate_strategy": with_(SIGNALS, LEADS, "o AS (SELECT series, count(*) AS n_onsets, count(*) FILTER (lead IS NULL) AS n_missed, quantile_cont(lead, 0.5)::DOUBLE AS lead_median, avg(lead) AS lead_mean FROM onsets GROUP BY 1)",
        "seen AS (SELECT *, lag(s) OVER (PARTITION BY series ORDER BY i) AS before FROM rows_)", "ranked AS (" + unrounded_auc("rows_", "series") + ")", BOOT, "drawn_auc AS (" + unrounded_auc("sample", "series, rep") + ")",
        "ends AS (SELECT series, quantile_cont(auc, 0.05) AS a, quantile_cont(auc, 0.95) AS b FROM drawn_auc GROUP BY 1)",
        "brier_ends AS (SELECT series, quantile_cont(v, 0.05) AS c, quantile_cont(v, 0.95) AS d FROM (SELECT series, rep, avg((p - y) * (p - y)) AS v FROM sample GROUP BY 1, 2) GROUP BY 1)")
    + f"""SELECT r.series, round(coalesce(sum(s * y) / nullif(sum(s), 0), 0), 4) AS precision, round(coalesce(sum(s * y) / nullif(sum(y), 0), 0), 4) AS recall, round(avg((s = 0 AND y = 1)::INT) / greatest(avg(y), 1e-9), 4) AS false_negative_rate,
  round(avg((s = 1 AND y = 0)::INT), 4) AS false_positive_days_frac, round(avg(y), 4) AS base_rate, round(avg(s), 4) AS hedge_on_frac, count(*) AS n, round(avg((p - y) * (p - y)), 4) AS brier, round({NPS}, 5) AS nps,
  round(count(*) / 10.0, 1)::DOUBLE AS n_eff, round(any_value(auc), 4) AS auc, any_value(n_onsets) AS n_onsets, any_value(n_missed) AS n_missed, any_value(lead_median) AS lead_median, round(any_value(lead_mean), 6) AS lead_mean,
  round(any_value(a), 4) AS auc_lo, round(any_value(b), 4) AS auc_hi, round(any_value(c), 4) AS brier_lo, round(any_value(d), 4) AS brier_hi
  FROM seen r JOIN o USING (series) JOIN ranked USING (series) JOIN ends USING (series) JOIN brier_ends USING (series) GROUP BY 1""",
    "staleness_auc": with_(PANEL, FEATURE_STEPS, WIDE_LABEL, "base AS (SELECT * FROM judged WHERE label IS NOT NULL)",
        "late AS (" + " UNION ALL ".join(f"SELECT label AS y, '{f}' AS feature, {k} AS lag, lag({f}, {k}) OVER (ORDER BY date) AS p FROM base" for f in SMALL_FEATURES for k in (0, 1, 5)) + ")") + auc_sql("late", "feature, lag"),
    "prefix_invariance": with_(PANEL) + "SELECT i, date, 0::BIGINT AS changed FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM panel) WHERE i IN (300, 500, n - 2, n - 1)",
    "series_audit": "SELECT DISTINCT o_orderpriority AS series FROM orders WHERE o_orderpriority = '5-LOW'",
    "ledger_audit": "SELECT event_type AS data_snapshot_hash, count(*) AS runs FROM events WHERE event_type = 'view' GROUP BY 1",
    "folds_leak": with_(SIGNALS, FOLDS) + "SELECT series, fold FROM folds WHERE train_end - 1 + 10 >= test_start",
    "label_resolve_date": with_(BARS) + "SELECT DISTINCT date, (date + CASE dayofweek(date) WHEN 6 THEN 13 WHEN 0 THEN 12 ELSE 14 END)::DATE AS resolves, strftime(date, '%Y-%m-%d') AS iso FROM bars",
    "manifest_stats": with_(BARS) + "SELECT count(*) AS rows, min(date) AS start, max(date) AS \"end\" FROM bars",
    "row_digest": "SELECT n_nationkey, sha256('=' || n_name || '|=' || n_nationkey || '|=' || n_regionkey) AS digest FROM nation",
    "content_hash": "WITH d AS (SELECT sha256('=' || n_name || '|=' || n_nationkey || '|=' || n_regionkey) AS d FROM nation) SELECT sha256("
    + " || '|' || ".join(f"sum(('0x' || d[{1 + 8 * k}:{8 + 8 * k}])::BIGINT)::VARCHAR" for k in range(8)) + " || '|' || count(*)::VARCHAR) AS digest FROM d",
    "snapshot_union": with_(BARS, SPLIT) + "SELECT series, count(*) AS rows, min(date) AS start, max(date) AS \"end\" FROM split GROUP BY 1",
    "bonferroni": "SELECT n_nationkey, m, round(least(1.0, n_nationkey / 10000.0 * m), 6)::DOUBLE AS p_adjusted FROM nation, (SELECT count(*) AS m FROM orders WHERE o_orderstatus = 'P')",
    "event_series": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS x FROM events GROUP BY 1, 2) SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS hour, "
    + f"round({roll('avg(x)', 'x', 24, part='PARTITION BY event_type ', order='hour')}, 6) AS mean24, round(x / ({roll('max(x)', 'x', 24, part='PARTITION BY event_type ', order='hour')}) - 1, 6) AS below_peak24 FROM h".replace("ORDER BY hour", "ORDER BY h.hour"),
    "tail_rows": with_(PANEL) + "SELECT date, round(SPY_close, 6) AS SPY_close FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM panel) WHERE k BETWEEN 11 AND 15",
    "last_values": with_(BARS) + "SELECT series, round(arg_max(close, date) FILTER (dayofweek(date) <> 5), 6) AS last_close FROM bars GROUP BY 1",
    "bootstrap_sample": with_(SIGNALS, BOOT) + auc_sql("sample", "series, rep"),
    "bootstrap_ci": with_(SIGNALS, BOOT, "whole AS (SELECT series, avg((p - y) * (p - y)) AS point FROM base GROUP BY 1)")
    + "SELECT series, round(any_value(point), 6) AS point, round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.95), 6) AS hi, count(v) AS n_valid FROM (SELECT series, rep, avg((p - y) * (p - y)) AS v FROM sample GROUP BY 1, 2) JOIN whole USING (series) GROUP BY 1",
    "auc_diff": with_(SIGNALS, BOOT, "m AS (" + unrounded_auc("sample", "series, rep") + ")", "b AS (" + unrounded_auc("sample", "series, rep", "y", "p_base") + ")", "wm AS (" + unrounded_auc("base", "series") + ")", "wb AS (" + unrounded_auc("base", "series", "y", "p_base") + ")")
    + "SELECT m.series, round(any_value(wm.auc - wb.auc), 6) AS auc_diff, round(avg((m.auc - b.auc <= 0)::INT), 6) AS p_raw, count(*) AS n_valid FROM m JOIN b ON m.series = b.series AND m.rep = b.rep JOIN wm ON wm.series = m.series JOIN wb ON wb.series = m.series WHERE m.auc IS NOT NULL AND b.auc IS NOT NULL GROUP BY 1",
}
