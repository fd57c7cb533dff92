"""What stays on disk: bars written in slices of codes, no shuffle files of written tables, panels that move once."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from factorframe.functions import factors as X
from factorframe.plans import testbed
from factorframe.plans.catalogue import REGISTRY
from factorframe.session import materialize


def shuffle_files(spark):
    """Of this session's executor, which is the driver."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def gone(spark, before):
    for _ in range(40):
        if shuffle_files(spark) <= before:
            return True
        time.sleep(0.25)
    return False


@pytest.fixture
def folder(spark, tmp_path):
    """Trades of 12 codes and one null code over 40 weeks, two on some days; prices differ by code and date."""
    rows = []
    for code in [*range(1, 13), None]:
        for i in range(40):
            day = datetime.datetime(2020, 1, 3) + datetime.timedelta(days=7 * i)
            for line in range(1, 2 + (i % 5 == 0)):
                price = 100.0 + ((code or 13) * 37 + i * 11 + line) % 29
                rows.append((1000 * (code or 0) + i, 1 + i % 7, code, line, 1.0 + i % 4, price, day))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_shipdate timestamp").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, f"S{c}", 500.0 * c, c % 3) for c in range(1, 13)], "s_suppkey long, s_name string, s_acctbal double, "
                          "s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    before = shuffle_files(spark)
    df = spark.range(5000, numPartitions=4).groupBy((F.col("id") % 1000).alias("code")).count()
    kept = materialize(df)  # df stays in reach, so no garbage collection can remove its files
    assert gone(spark, before) and spark.conf.get(key) == setting
    assert kept.count() == 1000 and df.count() == 1000


@pytest.mark.parametrize("name", ["day", "week"])
def test_bars_in_slices_are_the_same_bars(spark, folder, monkeypatch, name):
    whole = testbed.Tables(spark, folder)
    assert whole.slices == 1
    monkeypatch.setattr(testbed, "SLICE_BYTES", 1)
    cut = testbed.Tables(spark, folder)
    assert cut.slices == testbed.MOST_SLICES
    rows = [sorted(map(tuple, getattr(t, name).collect(), ), key=str) for t in (whole, cut.keep(name))]
    assert rows[0] == rows[1] and len(rows[0]) == 13 * 40
    files = set(getattr(cut, name).inputFiles())
    assert len(files) >= testbed.MOST_SLICES and set(getattr(cut.keep(name), name).inputFiles()) == files  # kept once


def test_a_slice_is_chosen_before_the_shuffles(spark, folder):
    part = testbed.Tables(spark, folder).week.where(F.pmod(F.xxhash64("code"), F.lit(4)) == 1)
    plan = part._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, x in enumerate(plan) if "Aggregate" in x or "Repartition" in x) < next(i for i, x in enumerate(plan) if "xxhash64" in x)


@pytest.mark.parametrize("windows", [X.SHORT_WINDOWS, X.LONG_WINDOWS])
def test_the_panel_of_features_moves_once(spark, folder, windows):
    out = X.features(testbed.Tables(spark, folder).keep("day").day, windows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert out.count() == 13 * 40


def test_trade_summary_reads_the_trades_once(spark, folder):
    out = REGISTRY["trade_summary"].run(spark, folder)
    assert not [x for x in out.inputFiles() if "lineitem" in x]
    found = {r.action: (r.n_trades, r.total_amount) for r in out.collect()}
    assert set(found) == {"BUY", "SELL"} and all(n > 0 and total > 0 for n, total in found.values())
