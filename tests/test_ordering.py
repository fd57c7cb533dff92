"""Ranks and quantiles against brute force, with and without pieces: hot dates, hot ties, null keys and values, other types."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.operators import ordering as O

SPLIT = {"rows_per_piece": 7}


@pytest.fixture(scope="module")
def skewed():
    """One date holds a third of the rows, and one value a third of that date."""
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=900), 2)
    dates = np.where(np.arange(900) < 300, 0, rng.integers(1, 40, 900))
    values[:100] = 0.5
    values[880:] = np.nan
    return pd.DataFrame({"id": np.arange(900), "date": dates, "x": values})


def spark_frame(spark, pdf):
    rows = [(int(i), int(d), None if np.isnan(x) else float(x)) for i, d, x in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id int, date int, x double")


@pytest.mark.parametrize("options", [{}, SPLIT])
def test_average_ranks(spark, skewed, options):
    out = O.average_ranks(spark_frame(spark, skewed), ["date"], {"x": "r"}, **options).toPandas().sort_values("id")
    want = skewed.groupby("date")["x"].rank()
    np.testing.assert_allclose(out["r"].astype(float).values, want.values)


@pytest.mark.parametrize("options", [{}, SPLIT])
@pytest.mark.parametrize("keys", [["date"], []])
def test_quantiles(spark, skewed, options, keys):
    probabilities = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.8, "e": 1.0}
    out = O.group_quantiles(spark_frame(spark, skewed), keys, "x", probabilities, **options).toPandas()
    for _, row in out.iterrows():
        group = skewed[skewed["date"] == row["date"]] if keys else skewed
        for name, p in probabilities.items():
            assert row[name] == pytest.approx(group["x"].quantile(p), abs=1e-12)
        assert row["n_values"] == group["x"].notna().sum()


def test_positions_are_exact_for_any_cuts(spark, skewed):
    df = spark_frame(spark, skewed)
    for rows_per_piece in (1, 50, 10_000):
        out = O.group_positions(df, ["date"], "x", rows_per_piece=rows_per_piece).toPandas()
        for date, group in out.groupby("date"):
            xs = skewed.loc[skewed["date"] == date, "x"].dropna().values
            for _, row in group.iterrows():
                assert row["before"] == (xs < row["x"]).sum()
                assert row["copies"] == (xs == row["x"]).sum()
                assert row["total"] == len(xs)


@pytest.mark.parametrize("rows_per_piece", [2, 1 << 20])
def test_null_keys_and_other_types(spark, rows_per_piece):
    import datetime

    rows = [(k, f"v{i % 5}", datetime.date(2020, 1, 1 + i % 7), float(i % 4)) for k in (None, "a") for i in range(20)]
    rows.append((None, None, None, None))
    df = spark.createDataFrame(rows, "k string, s string, d date, x double")
    for column in ("s", "d", "x"):
        got = O.average_ranks(df, ["k"], {column: "r"}, rows_per_piece).toPandas()
        assert len(got) == len(rows)
        for key in (None, "a"):
            part = got[got["k"].isna()] if key is None else got[got["k"] == key]
            want = part[column].rank() if column == "x" else part[column].astype(str).where(part[column].notna()).rank()
            np.testing.assert_allclose(part["r"].astype(float), want.astype(float))
    medians = {r.k: r.median for r in O.group_median(df, ["k"], "x", rows_per_piece=rows_per_piece).collect()}
    assert medians == {None: 1.5, "a": 1.5}


def test_first_k_beyond_the_pruned_limit(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = O.first_k(df, ["g"], [F.col("v")], 1500).toPandas()
    for g, part in got.groupby("g"):
        want = sorted((i * 7919) % 5003 for i in range(5000) if i % 2 == g)[:1500]
        assert part.sort_values("rank")["v"].tolist() == want and part["rank"].max() == 1500


def test_bisection_counts_cuts_below(spark):
    """Every number of cuts, values on, between and outside them, NaN above all, null below all; no structure is built per step."""
    rows = [([2.0 * i for i in range(n)], float(v)) for n in range(10) for v in (-1, 0, 1, 2, 5, 6, 17, 18, 19, "nan")] + [([1.0], None), ([], 3.0)]
    out = spark.createDataFrame(rows, "cuts array<double>, value double").select("*", O._below(F.col("cuts"), F.col("value")).alias("n"))
    for r in out.collect():
        assert r.n == sum(r.value is not None and (r.value != r.value or c < r.value) for c in r.cuts), r
    assert "struct" not in str(O._below(F.col("cuts"), F.col("value")))


def test_rank_by_pieces_reads_trades_once(spark, tmp_path):
    """All passes of the ranks start at the weekly panel as written, not at the trades."""
    from factorframe.plans.catalogue import REGISTRY

    spark.sql("""SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id % 50 AS l_suppkey, 1.0D + id % 7 AS l_quantity, 10.0D * (1 + id % 9)
        AS l_extendedprice, timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id % 21 AS int)) AS l_shipdate FROM range(2000)"""
              ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = REGISTRY["cs_rank_split"].run(spark, str(tmp_path))
    assert out.count() > 100 and not [f for f in out.inputFiles() if "lineitem" in f]


def test_counts_move_once_for_cuts_and_positions(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    found = O.group_positions(rows, ["g"], "v", rows_per_piece=900)
    assert found.count() == 2000
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    assert "ReusedExchange" in plan.toString()
