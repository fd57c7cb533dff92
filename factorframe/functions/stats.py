"""Statistics that stay null, instead of failing, where they are undefined under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate over pairs; null for constant input or fewer than two pairs."""
    return ratio_of_moments(x, y, lambda c: c)


def correlation_over(x: str | Column, y: str | Column, window) -> Column:
    return ratio_of_moments(x, y, lambda c: c.over(window))


def ratio_of_moments(x, y, place) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(
        place(F.covar_pop(x, y)), place(F.stddev_pop(xs)) * place(F.stddev_pop(ys))
    )
