"""Rolling expressions over one entity's ordered rows.

Every window is partitioned by the entity and ordered by date. (entity, date) is unique in a panel, so a
partition never holds more rows than the calendar has dates, however large the panel is.

In strict mode (the default) a value appears only when the frame holds n non-null inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from factorframe.functions.stats import correlation_over

ENTITY = "code"
TIME = "date"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(by: str = ENTITY, order: str = TIME) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def trailing(n: int, by: str = ENTITY, order: str = TIME) -> WindowSpec:
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def so_far(by: str = ENTITY, order: str = TIME) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def _guard(value: Column, counted: Column, n: int, window: WindowSpec, min_periods: int | None) -> Column:
    need = n if min_periods is None else min_periods
    return F.when(F.count(counted).over(window) >= need, value)


def ref(x, n: int, by: str = ENTITY, order: str = TIME) -> Column:
    """Value n rows ago (n > 0) or n rows ahead (n < 0)."""
    x, w = _col(x), ordered(by, order)
    return F.lag(x, n).over(w) if n >= 0 else F.lead(x, -n).over(w)


def _single(aggregate):
    def build(x, n: int, min_periods: int | None = None, by: str = ENTITY, order: str = TIME) -> Column:
        x, w = _col(x), trailing(n, by, order)
        return _guard(aggregate(x).over(w), x, n, w, min_periods)

    return build


mean = _single(F.avg)
total = _single(F.sum)
std = _single(F.stddev_samp)
var = _single(F.var_samp)
highest = _single(F.max)
lowest = _single(F.min)
skew = _single(F.skewness)  # population moments
kurt = _single(F.kurtosis)  # population moments, excess


def _paired(aggregate):
    def build(x, y, n: int, min_periods: int | None = None, by: str = ENTITY, order: str = TIME) -> Column:
        x, y, w = _col(x), _col(y), trailing(n, by, order)
        both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
        return _guard(aggregate(x, y).over(w), both, n, w, min_periods)

    return build


def corr(x, y, n: int, min_periods: int | None = None, by: str = ENTITY, order: str = TIME) -> Column:
    x, y, w = _col(x), _col(y), trailing(n, by, order)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return _guard(correlation_over(x, y, w), both, n, w, min_periods)


cov = _paired(F.covar_samp)
slope = _paired(F.regr_slope)  # slope(y, x, n): dependent value first


def quantile(x, n: int, p: float, min_periods: int | None = None, by: str = ENTITY, order: str = TIME) -> Column:
    """For short windows; operators.order_windows walks long and growing ones."""
    x, w = _col(x), trailing(n, by, order)
    return _guard(F.percentile(x, F.lit(p)).over(w), x, n, w, min_periods)


def pct_change(x, n: int = 1, by: str = ENTITY, order: str = TIME) -> Column:
    x = _col(x)
    return F.try_divide(x, ref(x, n, by, order)) - 1


def diff(x, n: int = 1, by: str = ENTITY, order: str = TIME) -> Column:
    x = _col(x)
    return x - ref(x, n, by, order)


def cumprod(growth, by: str = ENTITY, order: str = TIME) -> Column:
    """Running product of (1 + growth); growth must stay above -1."""
    return F.exp(F.sum(F.log1p(_col(growth))).over(so_far(by, order)))


def cummax(x, by: str = ENTITY, order: str = TIME) -> Column:
    return F.max(_col(x)).over(so_far(by, order))


def row_index(by: str = ENTITY, order: str = TIME) -> Column:
    return F.row_number().over(ordered(by, order)) - 1
