"""Cutting the panel at a date must not change anything dated before it."""

import numpy as np
import pytest
from conftest import days, frame
from pyspark.sql import functions as F

from factorframe.functions import factors as X
from factorframe.operators.picks import dropout_holdings, top_k
from factorframe.operators.regime import classify_regime


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    data = []
    for code in range(6):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))
        for d, c in zip(days(90), close):
            data.append((code, d, float(c * 0.99), float(c * 1.02), float(c * 0.98), float(c), float(rng.integers(1, 100)), float(c * 50)))
    return frame(spark, "code int, date date, open double, high double, low double, close double, volume double, amount double", data)


CUT = days(90)[60]


def compare(full, cut, keys):
    a = full.where(F.col("date") <= F.lit(CUT).cast("date")).orderBy(*keys).toPandas()
    b = cut.orderBy(*keys).toPandas()
    assert len(a) == len(b) > 0
    for column in a.columns:
        if a[column].dtype.kind == "f":
            np.testing.assert_allclose(a[column].values, b[column].values, rtol=1e-12, atol=1e-12)
        else:
            assert a[column].tolist() == b[column].tolist()


def early(panel):
    return panel.where(F.col("date") <= F.lit(CUT).cast("date"))


def test_features(panel):
    compare(X.features(panel, (5, 10, 20)), X.features(early(panel), (5, 10, 20)), ["code", "date"])


def test_features_match_single_factors(panel):
    full = X.features(panel, (5, 10, 20)).orderBy("code", "date").toPandas()
    base = X.with_returns(panel)
    base = base.join(X.market_return(base), "date", "left")
    single = base.select("code", "date", X.volatility(20).alias("std_20"), X.corr_pv(20).alias("corr_20"), X.beta(20).alias("beta_20"),
                         X.ma_ratio(10).alias("ma_10"), X.dist_high(20).alias("high_20")).orderBy("code", "date").toPandas()
    for c in ("std_20", "corr_20", "beta_20", "ma_10", "high_20"):
        np.testing.assert_allclose(full[c].astype(float), single[c].astype(float), rtol=1e-8, atol=1e-10)


def test_regime(panel):
    index = panel.where("code = 0").select("date", "close")
    compare(classify_regime(index, 5, 5), classify_regime(early(index), 5, 5), ["date"])


def test_picks_and_holdings(panel):
    scores = panel.select("code", "date", (F.col("volume") / F.col("close")).alias("score"))
    compare(top_k(scores, 3), top_k(early(scores), 3), ["date", "rank"])
    grid = [("s", 3, 1)]
    compare(dropout_holdings(scores, grid), dropout_holdings(early(scores), grid), ["date", "action", "code"])
