"""Quantiles of long windows and by sketches against pandas."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.operators import sketches as S
from factorframe.operators.aggregates import quantile_edges
from factorframe.operators.order_windows import CountTree, walked_quantile, window_quantile


@pytest.mark.parametrize("n, least", [(1, 1), (7, 7), (25, 3), (None, 10)])
@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 1.0])
def test_walk(n, least, p):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=400), 1)
    x[r.random(400) < 0.1] = np.nan
    x[:5] = np.nan
    s = pd.Series(x)
    want = (s.expanding(least) if n is None else s.rolling(n, min_periods=least)).quantile(p)
    np.testing.assert_allclose(walked_quantile(x, n, p, least), want.values, atol=1e-12)


def test_count_tree():
    for n in (1, 2, 3, 8, 9, 100):
        tree, held = CountTree(n), []
        r = np.random.default_rng(n)
        for v in r.integers(0, n, 60):
            tree.add(int(v), 1)
            held = sorted([*held, int(v)])
            assert [tree.find(k) for k in range(len(held))] == held


def test_long_series_in_seconds():
    x = np.random.default_rng(0).normal(size=100_000)
    start = time.time()
    out = walked_quantile(x, None, 0.5, 1)
    assert time.time() - start < 30 and out[-1] == pytest.approx(np.median(x))


def test_window_quantile(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"code": np.repeat(["a", "b", None], 90), "date": np.tile(np.arange(90), 3), "x": r.normal(size=270)})
    pdf.loc[::11, "x"] = np.nan
    df = spark.createDataFrame([(None if c is None else c, int(d), None if np.isnan(x) else float(x)) for c, d, x in pdf.itertuples(index=False)],
                               "code string, date int, x double").orderBy(F.rand(3))
    got = window_quantile(df, "x", "q", 0.25, 20, 5)
    assert got.columns == ["code", "date", "x", "q"]
    got = {(g.code, g.date): g.q for g in got.collect()}
    for code, part in pdf.groupby("code", dropna=False):
        want = part["x"].rolling(20, min_periods=5).quantile(0.25)
        for d, w in zip(part["date"], want):
            g = got[None if pd.isna(code) else code, d]
            assert (g is None and np.isnan(w)) or g == pytest.approx(w)


@pytest.mark.parametrize("shape", ["skewed", "tied", "sorted"])
def test_sketch_error_bound(spark, shape):
    """Merged sketches of 40 uneven days hold the bound on long tails, heavy ties and sorted input."""
    r = np.random.default_rng(8)
    n = 60_000
    x = {"skewed": np.exp(4 * r.normal(size=n)), "tied": np.round(r.normal(size=n)), "sorted": np.arange(n) * 1.0}[shape]
    day = np.minimum((r.exponential(6, n)).astype(int), 39)
    df = spark.createDataFrame(pd.DataFrame({"date": day, "x": x}))
    daily = S.sketch(df, ["date"], ["x"])
    probabilities = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    whole = S.sketch_quantiles(S.merged(daily, []), probabilities)
    first = whole.first()
    assert first.n == n and first.feature == "x"
    at = np.array([first[f"q{i}"] for i in range(len(probabilities))])
    ordered = np.sort(x)
    low, high = np.searchsorted(ordered, at) / n, np.searchsorted(ordered, at, side="right") / n
    error = np.maximum(0, np.maximum(low - probabilities, probabilities - high))
    assert error.max() <= S.rank_error(many=True)
    edges = quantile_edges(df, ["x"], probabilities, approximate=True)
    assert edges.columns == ["feature", *[f"q{i}" for i in range(len(probabilities))], "n_values"]
    at = np.array([edges.first()[f"q{i}"] for i in range(len(probabilities))])
    low, high = np.searchsorted(ordered, at) / n, np.searchsorted(ordered, at, side="right") / n
    assert np.maximum(low - probabilities, probabilities - high).max() <= S.rank_error(many=True)
    calendar = spark.createDataFrame([(d, d) for d in range(40)], "date int, idx int")
    rolling = {r_.date: r_.n for r_ in S.trailing(daily, calendar, 5).collect()}
    assert all(rolling[d] == ((day <= d) & (day > d - 5)).sum() for d in range(40))
