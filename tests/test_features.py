"""The joined window moments against two passes in NumPy: nulls in any input, large levels, constant windows."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.functions import factors as X
from factorframe.plans.registry import rounded


def two_pass(panel, windows):
    p = panel.sort_values(["code", "date"]).reset_index(drop=True)
    p["ret"] = p.groupby("code")["close"].transform(lambda c: c / c.shift(1) - 1)
    p.loc[p["close"].isna(), "ret"] = np.nan
    market = p.groupby("date")["ret"].mean()
    p["market"] = p["date"].map(market)
    rows = []
    for _, g in p.groupby("code", sort=False):
        for i in range(len(g)):
            for n in windows:
                part = g.iloc[max(0, i - n + 1): i + 1]
                whole = {c: len(part) == n and part[c].notna().all() for c in ("ret", "close", "volume", "amount", "market")}
                r, v, c = part["ret"].values, part["volume"].values, part["close"].values
                spread = {x: ((y - y.mean()) ** 2).sum() for x, y in (("r", r), ("v", v), ("c", c))}
                row = {"code": g["code"].iloc[i], "date": g["date"].iloc[i], "n": n}
                row["std"] = r.std(ddof=1) if whole["ret"] else None
                row["vma"] = v.mean() if whole["volume"] else None
                row["vstd"] = v.std(ddof=1) if whole["volume"] else None
                both = whole["volume"] and whole["close"] and spread["v"] > 0 and spread["c"] > 0
                row["corr"] = ((v - v.mean()) * (c - c.mean())).sum() / np.sqrt(spread["v"] * spread["c"]) if both else None
                m2 = spread["r"] / n
                row["skew"] = ((r - r.mean()) ** 3).mean() / m2**1.5 if whole["ret"] and m2 > 0 else None
                row["kurt"] = ((r - r.mean()) ** 4).mean() / m2**2 - 3 if whole["ret"] and m2 > 0 else None
                row["vwap"] = part["amount"].sum() / v.sum() / c[-1] - 1 if whole["volume"] and whole["amount"] and c[-1] == c[-1] else None
                m = part["market"].values
                beta = whole["ret"] and whole["market"] and ((m - m.mean()) ** 2).sum() > 0
                row["beta"] = ((r - r.mean()) * (m - m.mean())).sum() / ((m - m.mean()) ** 2).sum() if beta else None
                rows.append(row)
    return pd.DataFrame(rows)


@pytest.mark.parametrize("level, windows", [(100.0, (5, 7, 10, 17)), (1e9, (5, 7, 10, 17)), (100.0, (5, 20)), (1e9, (27,))])
def test_features_against_two_passes(spark, level, windows):
    r = np.random.default_rng(5)
    rows = []
    for code in ("a", "b", "c"):
        close = 10 * np.exp(np.cumsum(r.normal(size=40) * 0.02))
        for i in range(40):
            volume = level + float(r.integers(0, 30))
            flat = code == "c" and 10 <= i < 30
            rows.append([code, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(close[i]), level if flat else volume, volume * 9.5])
    for at, column in ((7, 3), (50, 4), (63, 2), (90, 3)):
        rows[at][column] = None
    panel = pd.DataFrame(rows, columns=["code", "date", "close", "volume", "amount"])
    df = spark.createDataFrame([(*x[:2], x[2], x[2], x[2], x[2], x[3], x[4]) for x in rows],
                               "code string, date date, open double, high double, low double, close double, volume double, amount double")
    got = X.features(df, windows).toPandas().set_index(["code", "date"])
    for w in two_pass(panel, windows).itertuples(index=False):
        for name in ("std", "vma", "vstd", "corr", "skew", "kurt", "vwap", "beta"):
            have, want = got.loc[(w.code, w.date), f"{name}_{w.n}"], getattr(w, name)
            if want is None or want != want:
                assert have is None or have != have, (w, name, have)
            else:
                assert have == pytest.approx(want, rel=1e-6, abs=1e-7), (w, name)


def test_large_levels_keep_small_spreads(spark):
    rows = [("a", datetime.date(2020, 1, 1 + i), 10.0 + i % 3, v) for i, v in enumerate([1e9, 1e9 + 10, 1e9 + 20, 1e9 + 10, 1e9])]
    df = spark.createDataFrame([(c, d, x, x, x, x, v, v) for c, d, x, v in rows],
                               "code string, date date, open double, high double, low double, close double, volume double, amount double")
    last = X.features(df, (5,)).orderBy("date").collect()[-1]
    assert last.vstd_5 == pytest.approx(np.std([0, 10, 20, 10, 0], ddof=1)) and last.corr_5 is not None


@pytest.mark.parametrize("windows", [(5, 10, 20, 30, 60), (5, 20, 60), (240,), (3, 7, 11, 250), (1,), (9, 8)])
def test_any_window_takes_few_steps(windows):
    """Only short windows look at rows, and every other is the sum of two that were built before it."""
    steps = X.window_steps(windows)
    built = []
    for n, near, far in steps:
        assert (n <= X.DIRECT and far == 0) or (near + far == n and near in built and far in built)
        built.append(n)
    assert len(built) == len(set(built)) and set(windows) <= set(built)
    assert len(built) <= len(windows) * 2 * max(windows).bit_length()
    assert X.window_steps((5, 10, 20, 30, 60)) == [(5, 5, 0), (10, 5, 5), (20, 10, 10), (30, 20, 10), (60, 30, 30)]


def test_features_do_not_depend_on_batches(spark):
    """Batches end inside codes; the rows a window needs are carried on. Every factor of all windows comes from one pass over the rows."""
    r = np.random.default_rng(6)
    first = datetime.date(2020, 1, 1)
    rows = [(code, first + datetime.timedelta(days=i), *[float(x) for x in 10 + r.random(4)], float(r.integers(0, 9)), float(r.integers(1, 99)))
            for code, n in (("a", 70), ("b", 3), (None, 40), ("c", 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")
    out = X.features(df, (5, 20))
    assert out._jdf.queryExecution().executedPlan().toString().count("Window [") <= 8  # one window pass a window length before, and more
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(key)
    whole = {(x.code, x.date): x for x in out.collect()}
    spark.conf.set(key, "4")
    try:
        cut = {(x.code, x.date): x for x in X.features(df, (5, 20)).collect()}
    finally:
        spark.conf.set(key, size)
    assert len(whole) == len(rows) and cut == whole
    assert sum(x.std_20 is not None for x in whole.values()) == (70 - 20) + (40 - 20) + (25 - 20)
    assert whole["b", first].roc_5 is None and any(x.vroc_5 is None and x.roc_5 is not None for x in whole.values())  # volume 0


def test_rounded_is_round(spark):
    r = np.random.default_rng(7)
    numbers = [0.0, -0.0, 0.5, 2.5, -2.5, 1.005, 2.675, -1.0000005, 1e-9, 1e13, 123456789.1234565, 1e300, float("nan"), float("inf"), None,
               *[k / 2e6 for k in range(-60, 60)], *(r.normal(size=3000) * 10.0 ** r.integers(-8, 12, 3000)).tolist(),
               *(r.integers(-10**9, 10**9, 2000) / 1e7).tolist(), *((r.integers(-10**6, 10**6, 2000) + 0.5) / 1e4).tolist()]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").withColumns(
        {f"{kind}{d}": f("x", d) for d in (0, 4, 6, 9) for kind, f in (("a", lambda x, d: rounded(F.col(x), d)), ("b", F.round))})
    wrong = df.where(" OR ".join(f"NOT a{d} <=> b{d}" for d in (0, 4, 6, 9)))
    assert wrong.collect() == []
