"""Quantiles of long and of growing windows in n log n.

`percentile` over a frame sorts the frame again for every row. Here a series is walked once with a tree of counts over its sorted
values: a value entering or leaving the window changes log n counts, and any order statistic is found in log n steps.
Spark deals the series over the tasks; a series is one entity's values by date.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CountTree:
    """Counts of n ranks as partial sums (Fenwick): add and find the k-th smallest in log n."""

    def __init__(self, n: int):
        self.sums = [0] * (n + 1)
        self.top = 1 << n.bit_length() >> 1

    def add(self, rank: int, count: int) -> None:
        rank += 1
        sums, n = self.sums, len(self.sums)
        while rank < n:
            sums[rank] += count
            rank += rank & -rank

    def find(self, k: int) -> int:
        """Rank of the k-th smallest, k from 0."""
        at, step, sums, n = 0, self.top, self.sums, len(self.sums)
        while step:
            ahead = at + step
            if ahead < n and sums[ahead] <= k:
                at, k = ahead, k - sums[ahead]
            step >>= 1
        return at


def walked_quantile(values: np.ndarray, n: int | None, p: float, least: int) -> np.ndarray:
    """Interpolated p-quantile of the last n values (None: all so far) at each place; NaN is no value, and below `least` values the result."""
    known = ~np.isnan(values)
    distinct, rank = np.unique(values[known], return_inverse=True)
    ranks = np.full(len(values), -1)
    ranks[known] = rank
    tree, inside = CountTree(len(distinct)), 0
    out = np.full(len(values), np.nan)
    ranks, distinct = ranks.tolist(), distinct.tolist()
    for i, r in enumerate(ranks):
        if r >= 0:
            tree.add(r, 1)
            inside += 1
        if n is not None and i >= n and ranks[i - n] >= 0:
            tree.add(ranks[i - n], -1)
            inside -= 1
        if inside >= least and inside:
            spot = p * (inside - 1)
            k = int(spot)
            low = distinct[tree.find(k)]
            out[i] = low if spot == k else low + (distinct[tree.find(k + 1)] - low) * (spot - k)
    return out


def window_quantile(
    df: DataFrame, column: str, name: str, p: float = 0.5, n: int | None = None, min_periods: int | None = None, by: str = "code", order: str = "date"
) -> DataFrame:
    """df plus the p-quantile of the last n rows of each series (None: of all rows so far).

    min_periods defaults to n, or to 1 for a growing window; with fewer values the result is null. (by, order) is unique.
    """
    least = min_periods if min_periods is not None else (n or 1)
    schema = df.withColumn(name, F.lit(None).cast("double")).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        values = table.column("_x").to_numpy()
        found = walked_quantile(values, n, p, least)
        return table.drop_columns(["_x"]).append_column(name, pa.array(found, from_pandas=True))

    return df.withColumn("_x", F.coalesce(F.col(column).cast("double"), F.lit(float("nan")))).groupBy(by).applyInArrow(run, schema)
