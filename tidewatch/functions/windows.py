"""Ordered-window expressions over panels.

Every function takes a column and an :class:`Over` (order, and the series it
restarts in) and gives a column; nothing runs.  Missing values are NULL, and a
rolling value is NULL unless its frame is full of values (or has ``least`` of
them), as rolling statistics of research code define it.  Expressions that share an
``Over`` run in one sort and one window stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ANNUAL_DAYS = 252
ANNUALISE = ANNUAL_DAYS**0.5


@dataclass(frozen=True)
class Over:
    """The order of rows, within each series."""

    order: str = "date"
    by: tuple[str, ...] = ("series",)

    def sorted(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.sorted().rowsBetween(first, last)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def when_full(x: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` over the frame where it holds at least ``least`` values of x."""
    return F.when(F.count(x).over(frame) >= least, value.over(frame))


def rolling(x: Column | str, aggregate, n: int, over: Over, least: int | None = None) -> Column:
    """An aggregate of the last ``n`` rows, this one included."""
    x = _col(x)
    return when_full(x, aggregate(x), over.rows(1 - n, 0), n if least is None else least)


def lagged(x: Column | str, k: int, over: Over) -> Column:
    return F.lag(_col(x), k).over(over.sorted())


def difference(x: Column | str, k: int, over: Over) -> Column:
    return _col(x) - lagged(x, k, over)


def change(x: Column | str, k: int, over: Over) -> Column:
    """x over its value k rows before, less 1."""
    return F.try_divide(_col(x), lagged(x, k, over)) - 1


def log_return(x: Column | str, over: Over) -> Column:
    return F.ln(_col(x)) - F.ln(lagged(x, 1, over))


def volatility(returns: Column | str, n: int, over: Over) -> Column:
    """Annualised population deviation of the last n log returns."""
    return rolling(returns, F.stddev_pop, n, over) * ANNUALISE


def volatility_ahead(returns: Column | str, n: int, over: Over) -> Column:
    """The same over the next n rows, this one not included."""
    x = _col(returns)
    return when_full(x, F.stddev_pop(x), over.rows(1, n), n) * ANNUALISE


def drawdown_ahead(price: Column | str, n: int, over: Over) -> Column:
    """The worst fall from a running peak within the next n rows; the peak starts
    at this row's price, the fall is looked for after it."""
    x, frame = _col(price), over.rows(0, n)
    p = F.collect_list(x).over(frame)
    falls = F.transform(F.slice(p, 2, n), lambda v, j: F.try_divide(v, F.array_max(F.slice(p, F.lit(1), j + 2))) - 1)
    return F.when(F.count(x).over(frame) == n + 1, F.array_min(falls))


def rolling_quantile(x: Column | str, q: float, n: int, over: Over, least: int | None = None) -> Column:
    """Exact quantile with linear interpolation."""
    return rolling(x, lambda c: F.percentile(c, F.lit(q)), n, over, least)


def rolling_mean(x: Column | str, n: int, over: Over) -> Column:
    return rolling(x, F.avg, n, over)


def rolling_deviation(x: Column | str, n: int, over: Over) -> Column:
    """Sample deviation."""
    return rolling(x, F.stddev_samp, n, over)


def below_peak(x: Column | str, n: int, over: Over) -> Column:
    return F.try_divide(_col(x), rolling(x, F.max, n, over)) - 1


def rolling_skew(x: Column | str, n: int, over: Over) -> Column:
    """Bias-adjusted skewness."""
    return rolling(x, F.skewness, n, over) * ((n * (n - 1)) ** 0.5 / (n - 2))


def rolling_beta(y: Column | str, x: Column | str, n: int, over: Over) -> Column:
    """Sample covariance of y and x over the sample variance of x.  The variance
    needs a full frame of x, the covariance a full frame of pairs."""
    x, y, frame = _col(x), _col(y), over.rows(1 - n, 0)
    pair = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.try_divide(when_full(pair, F.covar_samp(y, x), frame, n), when_full(x, F.var_samp(x), frame, n))


def filled(x: Column | str, limit: int, over: Over) -> Column:
    """The last value, at most ``limit`` rows old."""
    return F.last(_col(x), ignorenulls=True).over(over.rows(-limit, 0))


def return_ahead(x: Column | str, k: int, over: Over) -> Column:
    return F.try_divide(F.lead(_col(x), k).over(over.sorted()), _col(x)) - 1


def index_level(log_returns: Column | str, base: float, over: Over) -> Column:
    return F.exp(F.sum(_col(log_returns)).over(over.rows(Window.unboundedPreceding, 0))) * base


def switches(signal: Column | str, over: Over) -> Column:
    """How much a signal moves; 0 on the first row."""
    s = _col(signal)
    return F.abs(s - F.coalesce(lagged(s, 1, over), s))


def onset(label: Column | str, over: Over) -> Column:
    return (_col(label) == 1) & (lagged(label, 1, over) == 0)


def lead_time(signal: Column | str, position: Column | str, lookback: int, over: Over) -> Column:
    """Rows for which the signal has been on before this one, at most
    ``lookback``; NULL where it is off."""
    s, i = _col(signal), _col(position)
    sofar = over.rows(Window.unboundedPreceding, 0)
    off, first = F.max(F.when(s == 0, i)).over(sofar), F.min(i).over(sofar)
    return F.when(s == 1, F.least(i - F.coalesce(off, first - 1) - 1, F.lit(lookback)))


def trailing_rank(x: Column | str, n: int, over: Over) -> Column:
    """The share of the n values before this row that are at most this one."""
    x = _col(x)
    frame = over.rows(-n, -1)
    held = F.collect_list(x).over(frame)
    share = F.size(F.filter(held, lambda v: v <= x)) / F.lit(float(n))
    return F.when((F.count(x).over(frame) == n) & x.isNotNull(), share)


def is_above(x: Column, y: Column) -> Column:
    """1.0 or 0.0; missing counts as not above."""
    return F.coalesce((x > y).cast("double"), F.lit(0.0))
