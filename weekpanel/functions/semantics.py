"""Null, NaN and rolling-window rules shared by all time-series operators.

Missing values are NULL (never NaN), rolling aggregates need a full frame of
non-null values, and zero denominators give NULL instead of an ANSI error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def safe_ln(c: Column | str) -> Column:
    c = col(c)
    return F.when(c > 0, F.ln(c))


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def ordered(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    """The window of one entity.  ``keys`` bound the rows of one task."""
    if not keys:
        raise ValueError("a time-series window needs partition keys")
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def rolling(agg, c: Column | str, n: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` are non-null."""
    c, frame = col(c), trailing(w, n)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pairwise-complete correlation; NULL where a side does not vary.

    Spark's own ``corr`` raises on zero variance in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return F.try_divide(cov, sx * sy)


def widest(agg, cols: Sequence[Column]) -> Column:
    """``greatest``/``least`` that also takes a single column."""
    return agg(*cols) if len(cols) > 1 else cols[0]


def rolling_corr(a: Column | str, b: Column | str, n: int, w: WindowSpec) -> Column:
    """Pairwise-complete correlation needing ``n`` complete pairs."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    frame = trailing(w, n)
    return F.when(F.count(F.when(both, a)).over(frame) == n, correlation(a, b, frame))


def forward_fill(c: Column | str, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(so_far(w))


def change(c: Column | str, n: int, w: WindowSpec) -> Column:
    c = col(c)
    return c - F.lag(c, n).over(w)


def pct_change(c: Column | str, n: int, w: WindowSpec) -> Column:
    c = col(c)
    return ratio(c, F.lag(c, n).over(w)) - 1


def log_change(c: Column | str, n: int, w: WindowSpec) -> Column:
    c = col(c)
    return safe_ln(ratio(c, F.lag(c, n).over(w)))


def zscore(c: Column | str, w: WindowSpec) -> Column:
    """Sample z-score over ``w``; 0 where the variance is zero or unknown."""
    c = col(c)
    sd = F.stddev_samp(c).over(w)
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise((c - F.avg(c).over(w)) / sd)


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)
