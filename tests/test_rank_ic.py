"""Rank IC of several scores at once, and inputs that are read once."""

import random

import pytest
from conftest import frame
from pyspark.sql import functions as F

from factorframe.functions.stats import correlation
from factorframe.operators import linear as L
from factorframe.operators.drift import drift_report
from factorframe.operators.ic import rank_ic, rank_ics, stratified_ic_numeric
from factorframe.operators.ordering import average_ranks


@pytest.fixture(scope="module")
def scored(spark):
    """Dates of unequal size, a null date, ties, nulls, NaN and infinity."""
    draw = random.Random(7)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0]

    def number(levels):
        return draw.choice(odd) if draw.random() < 0.1 else float(draw.randrange(levels))

    dates = ["2020-01-03"] * 300 + ["2020-01-10"] * 40 + [None] * 25 + ["2020-01-17"] * 2
    rows = [(d, number(1000), number(5), 3.0, number(50)) for d in dates]
    return frame(spark, "date date, a double, b double, flat double, label double", rows)


def by_windows(df, name):
    rows = df.where(F.col(name).isNotNull() & F.col("label").isNotNull())
    ranked = average_ranks(rows, ["date"], {name: "x", "label": "y"})
    found = ranked.groupBy("date").agg(F.round(correlation("x", "y"), 12).alias("ic"), F.count(F.lit(1)).alias("n"))
    return {(name, r.date): (r.ic, r.n) for r in found.where("n >= 3").collect()}


@pytest.mark.parametrize("cells", [1 << 24, 400, 1])
def test_all_scores_at_once_are_the_ranks_of_each(spark, scored, cells):
    names = ["a", "b", "flat"]
    found = rank_ics(scored, ["date"], {x: F.col(x) for x in names}, cells=cells).collect()
    wanted = {k: v for x in names for k, v in by_windows(scored, x).items()}
    assert len(found) == len(wanted) == 9
    for row in found:
        ic, n = wanted[(row.feature, row.date)]
        assert row.n == n and row.ic == (None if ic is None else pytest.approx(ic, abs=1e-11))


def test_other_types_rank_too(spark):
    rows = spark.createDataFrame([(1, chr(97 + i), (i * 7) % 11) for i in range(11)], "g int, score string, label int")
    as_numbers = rows.withColumn("score", F.ascii("score"))
    assert rank_ic(rows, ["g"]).first().ic == rank_ic(as_numbers, ["g"]).first().ic


def counted(spark, df):
    """df, and a counter of how often its rows were computed."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    return df.withColumn("score", seen.asNondeterministic()("score")), calls


def test_inputs_are_computed_once(spark):
    rows = spark.range(400).select((F.col("id") % 4).alias("date"), F.rand(1).alias("score"), F.rand(2).alias("label"), F.rand(3).alias("size"))
    source, calls = counted(spark, rows)
    assert rank_ic(source, ["date"]).count() == 4 and calls.value == 400
    source, calls = counted(spark, rows)
    assert stratified_ic_numeric(source, "size").count() == 5 and calls.value == 400


def test_moments_of_groups_are_those_of_the_aggregate(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("date"), (1e9 + F.rand(1)).alias("x"), F.lit(0.1).alias("flat"), F.when(F.rand(2) > 0.1, F.randn(3)).alias("y"))
    columns = ["x", "flat", "y"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = {r.date: r for r in L.group_moments(rows, ["date"], columns).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in L.moments(rows, ["date"], columns).collect():
        assert found[r.date].n == r.n and found[r.date]._c1_1 == found[r.date]._c0_1 == 0
        for c in ("_m0", "_m1", "_m2", "_c0_0", "_c0_2", "_c2_2"):
            assert found[r.date][c] == pytest.approx(r[c], rel=1e-6, abs=1e-4)


def test_report_plan_holds_only_small_tables(spark):
    wide = spark.range(50).select(F.concat(F.lit("f"), "id").alias("feature"), F.rand(1).alias("psi"), F.lit("low").alias("drift_level"))
    ic = spark.range(5).select(F.to_date(F.lit("2020-01-01")).alias("date"), F.rand(1).alias("rolling_ic"), F.lit(False).alias("drift_warning"))
    report = drift_report(wide.repartition(3).distinct(), ic.distinct(), spark.range(1).select(F.lit(0.8).alias("stability")))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and report.first().n_features == 50
