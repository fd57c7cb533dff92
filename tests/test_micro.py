"""Hand-made fixtures: ties, nulls, flat input, boundaries and brute-force twins of the iterative rules."""

import datetime
import math
import random

import numpy as np
import pytest
from conftest import days, frame
from pyspark.sql import functions as F

from factorframe.functions import flags
from factorframe.operators import crossval, drift, filters, ic, labels, picks, quality, risk, significance
from factorframe.operators.experiments import protocol_check
from factorframe.operators.normalize import neutralize
from factorframe.operators.portfolio import drawdown, pick_forward_returns
from factorframe.sources import panel as source
from factorframe.sources import writers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def pairs(spark, per_date):
    out = []
    for day, (scores, targets) in zip(days(len(per_date)), per_date):
        out += [(day, i, float(s), float(y)) for i, (s, y) in enumerate(zip(scores, targets))]
    return frame(spark, "date date, code int, score double, label double", out)


def test_rank_ic_ties_constant_and_small_dates(spark):
    df = pairs(spark, [((1, 1, 2, 3), (4, 3, 2, 1)), ((5, 5, 5, 5), (1, 2, 3, 4)), ((1, 2), (1, 2)), ((1, 2, 3), (1, 2, 3))])
    out = {str(r["date"]): r["ic"] for r in ic.daily_rank_ic(df).collect()}
    want = np.corrcoef([1.5, 1.5, 3, 4], [4, 3, 2, 1])[0, 1]
    assert out == {"2020-01-01": pytest.approx(want), "2020-01-04": pytest.approx(1.0)}
    legacy = {str(r["date"]): r["ic"] for r in ic.daily_rank_ic(df, legacy_scale=True).collect()}
    assert legacy["2020-01-01"] == pytest.approx(want * 3 / 4) and legacy["2020-01-02"] == 0


def test_newey_west_against_loop(spark):
    rng = np.random.default_rng(1)
    x = np.convolve(rng.normal(size=120), np.ones(5) / 5, "valid") + 0.02
    df = frame(spark, "date date, x double", list(zip(days(len(x)), map(float, x))))
    for lags in (None, 5, 500):
        got = significance.newey_west(df, "x", [], max_lags=lags).first()
        n = len(x)
        used = max(1, min(int(n**0.25) if lags is None else lags, n - 1))
        e = x - x.mean()
        var = (e @ e) / n + 2 * sum((1 - k / (used + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, used + 1))
        assert got["lags"] == used
        assert got["nw_se"] == pytest.approx(math.sqrt(max(var, 0) / n), abs=1e-12)
    flat = frame(spark, "date date, x double", [(d, 0.5) for d in days(9)])
    assert significance.newey_west(flat, "x", []).first()["t_nw"] == 0


def test_normal_cdf(spark):
    out = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], "x double").select(significance.normal_cdf("x").alias("p"), "x")
    for r in out.collect():
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(r["x"] / math.sqrt(2))), abs=2e-7)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.04]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = {r["id"]: r["p_adjusted"] for r in significance.benjamini_hochberg(df).collect()}
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    best, want = 1.0, {}
    for place in range(len(p), 0, -1):
        i = order[place - 1]
        best = min(best, p[i] * len(p) / place)
        want[i] = best
    assert got == pytest.approx(want)
    bonf = {r["id"]: r["p_adjusted"] for r in significance.bonferroni(df).collect()}
    assert bonf[4] == 1.0 and bonf[0] == pytest.approx(0.06)


def test_psi_edges(spark):
    def psi(base, now, bins=10):
        make = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "f double")
        return drift.psi(make(base), make(now), ["f"], bins).first()["psi"]

    same = list(range(100))
    assert psi(same, same) == pytest.approx(0)
    assert psi(same, [1000, 2000]) is None
    base, now = [0] * 50 + list(range(1, 51)), [0] * 10 + list(range(1, 51))
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    e, a = np.histogram(base, edges)[0].astype(float), np.histogram(now, edges)[0].astype(float)
    e, a = np.clip(e / e.sum(), 1e-6, None), np.clip(a / a.sum(), 1e-6, None)
    e, a = e / e.sum(), a / a.sum()
    assert psi(base, now) == pytest.approx(float(((a - e) * np.log(a / e)).sum()))
    short, later = [1.0, 2.0, 5.0], [1.0, 1.5, 4.9, 5.0]
    edges = np.linspace(1, 5, 11)
    e, a = np.histogram(short, edges)[0].astype(float), np.histogram(later, edges)[0].astype(float)
    e, a = np.clip(e / e.sum(), 1e-6, None), np.clip(a / a.sum(), 1e-6, None)
    e, a = e / e.sum(), a / a.sum()
    assert psi(short, later) == pytest.approx(float(((a - e) * np.log(a / e)).sum()))


def test_flat_runs(spark):
    values = [1, 2, 2, 2, 2, 3, 4, 4, 4, 4, 4, 5]
    df = frame(spark, "date date, close double", [(d, float(v)) for d, v in zip(days(len(values)), values)])
    out = filters.flat_runs(df, "close", min_length=5).collect()
    assert [(r["close"], r["length"]) for r in out] == [(4.0, 5)]


def test_walk_forward_clamps_month_ends(spark):
    out = crossval.walk_forward(spark, "2019-08-31", "2023-01-01", 1.0, 6, 0.5, 0).orderBy("fold").collect()
    assert [str(r["train_start"]) for r in out][:3] == ["2019-08-31", "2020-02-29", "2020-08-29"]
    strict = crossval.walk_forward(spark, "2015-01-31", "2020-01-01", 2.0, 6, 1.0, 20, gap_mode="strict").first()
    assert (strict["valid_start"] - strict["train_end"]).days == 28


def test_purged_folds_do_not_leak(spark):
    dates = days(100)
    cal = frame(spark, "date date, idx bigint", [(d, i) for i, d in enumerate(dates)])
    out = crossval.purged_kfold(cal, 5, 20).toPandas()
    for fold, group in out.groupby("fold"):
        test = group[group["role"] == "test"]["date"]
        assert len(test) == 20
        for d in group[group["role"] == "train"]["date"]:
            assert (test.min() - d).days > 28 + 28 or (d - test.max()).days > 14


def test_industry_cap_equals_greedy(spark):
    rng = random.Random(5)
    score_rows, industry_rows, want = [], [], set()
    for day in days(30):
        names = [(day, i, round(rng.uniform(-1, 1), 3)) for i in range(25)]
        score_rows += names
        counts, chosen = {}, []
        for _, code, _ in sorted(names, key=lambda r: (-r[2], r[1])):
            group = code % 4 if code < 22 else "Other"
            if len(chosen) < 8 and counts.get(group, 0) < 2:
                counts[group] = counts.get(group, 0) + 1
                chosen.append(code)
        want |= {(day, c) for c in chosen}
    industry_rows = [(i, str(i % 4)) for i in range(22)]
    scores = frame(spark, "date date, code int, score double", score_rows)
    industry = spark.createDataFrame(industry_rows, "code int, industry string")
    got = {(str(r["date"]), r["code"]) for r in picks.industry_cap(scores, industry, 8, 0.25).collect()}
    assert got == want


def brute_dropout(by_date, k, n_drop):
    held, out = None, []
    for date in sorted(by_date):
        score = by_date[date]
        top = [c for c, _ in sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
        if held is None:
            sells, buys = [], top
        else:
            sells = sorted(held - set(top), key=lambda c: (score.get(c, -999.0), c))[:n_drop]
            buys = [c for c in top if c not in held][: len(sells)]
        held = (held or set()) - set(sells) | set(buys)
        out += [(date, c, "SELL") for c in sells] + [(date, c, "BUY") for c in buys] + [(date, c, "HOLD") for c in held]
    return set(out)


def test_dropout_holdings(spark):
    rng = random.Random(9)
    by_date = {}
    for day in days(40):
        by_date[day] = {c: round(rng.gauss(0, 1), 3) for c in range(15) if rng.random() < 0.85}
    df = frame(spark, "date date, code int, score double", [(d, c, s) for d, m in by_date.items() for c, s in m.items()])
    grid = [("a", 3, 1), ("b", 5, 2), ("c", 4, 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # dates split across Arrow batches
    try:
        out = picks.dropout_holdings(df, grid).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, k, n_drop in grid:
        got = {(str(r["date"]), r["code"], r["action"]) for r in out if r["strategy"] == name}
        assert got == brute_dropout(by_date, k, n_drop)
        for day in by_date:
            mine = [r for r in out if r["strategy"] == name and str(r["date"]) == day]
            sells, buys = (sum(r["action"] == a for r in mine) for a in ("SELL", "BUY"))
            assert sum(r["action"] == "HOLD" for r in mine) <= k and sells <= n_drop and (day == days(1)[0] or buys <= sells)


def test_forward_returns_use_the_next_open(spark):
    bars = frame(spark, "code int, date date, open double, close double", [(1, d, 10.0 + i, 50.0 + i) for i, d in enumerate(days(8))])
    chosen = frame(spark, "code int, date date", [(1, days(8)[0]), (1, days(8)[7])])
    out = pick_forward_returns(chosen, bars, (2, 10)).collect()
    assert len(out) == 1 and out[0]["rec_price"] == 11.0
    assert out[0]["ret_2d"] == pytest.approx(2 / 11) and out[0]["ret_10d"] is None
    close = pick_forward_returns(chosen, bars, (2,), price="close", lag=0).orderBy("date").collect()
    assert close[0]["ret_2d"] == pytest.approx(2 / 50)


def test_labels_and_grades(spark):
    assert labels.parse_label("xs_ret_60d") == ("xs_ret", 60) and labels.parse_label("nope") == ("ret", 20)
    df = frame(spark, "date date, code int, x double", [(days(1)[0], i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])]
               + [(days(2)[1], i, 1.0) for i in range(4)])
    grades = {(str(r["date"]), r["code"]): r["grade"] for r in labels.quantile_grades(df, ["date"], "x").collect()}
    assert [grades[(days(1)[0], i)] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert all(grades[(days(2)[1], i)] == 2 for i in range(4))


def test_validation_of_bad_bars(spark):
    schema = "code string, date date, open double, high double, low double, close double, volume double"
    d = days(6)
    good = [("a", x, 10.0, 11.0, 9.0, 10.0, 5.0) for x in d]
    bad = [
        ("b", d[0], 10.0, 9.0, 11.0, 10.0, 5.0), ("b", d[1], 20.0, 11.0, 9.0, 10.0, 5.0), ("b", d[2], 10.0, 11.0, 9.0, 12.5, 0.0),
        ("b", d[3], 10.0, 11.0, 9.0, 10.0, 5.0), ("b", d[3], 10.0, 11.0, 9.0, 10.0, 5.0), ("b", d[4], 10.0, 11.0, 9.0, None, None),
    ]
    df = frame(spark, schema, good + bad)
    issues = {(r["code"], r["type"]): (r["n"], r["sample_dates"]) for r in quality.validate_panel(df).collect()}
    assert {k[0] for k in issues} == {"b"}
    assert issues[("b", "low_gt_high")] == (1, d[0])
    assert issues[("b", "extreme_price_jump")] == (1, d[2])  # 12.5 / 10; the way back is exactly 20 %
    assert issues[("b", "zero_vol_price_change")] == (1, d[2])
    assert issues[("b", "duplicate_dates")][0] == 1 and issues[("b", "duplicate_rows")][0] == 2
    summary = {r["code"]: r["passed"] for r in quality.validation_summary(df, quality.validate_panel(df)).collect()}
    assert summary == {"a": True, "b": False}


def test_flags_with_nulls(spark):
    df = spark.createDataFrame(
        [("ST x", 0.0, 0.0), (None, None, None), ("plain", 1.0, 0.0)], "name string, volume double, amount double"
    ).select(flags.is_st().alias("st"), flags.is_suspended().alias("halt"))
    assert rows(df) == [(True, True), (None, True), (False, False)]
    codes = spark.createDataFrame([("sh688001",), ("SZ300001",), ("bj430001",), ("sh600000",)], "code string")
    assert [r[0] for r in codes.select(flags.board_class()).collect()] == ["star", "chinext", "bj", "main"]


def test_fama_macbeth_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(2)
    data = [(d, *map(float, rng.normal(size=4))) for d in days(3) for _ in range(40)]
    df = frame(spark, "date date, a double, b double, c double, ret double", data)
    out = risk.fama_macbeth(df, ["a", "b", "c"]).toPandas().pivot(index="date", columns="factor", values="factor_return")
    for day in days(3):
        block = np.array([r[1:] for r in data if r[0] == day])
        design = np.column_stack([np.ones(len(block)), block[:, :3]])
        want = np.linalg.lstsq(design, block[:, 3], rcond=None)[0]
        got = out.loc[out.index.astype(str) == day, ["a", "b", "c"]].values[0]
        np.testing.assert_allclose(got, want[1:], atol=1e-10)


def test_neutral_residuals_have_no_industry_mean(spark):
    rng = np.random.default_rng(4)
    data = [(days(1)[0], i, float(rng.normal()), str(i % 3), float(rng.normal())) for i in range(30)]
    df = frame(spark, "date date, code int, v double, ind string, size double", data)
    out = neutralize(df, "v", "ind", "size").groupBy("ind").agg(F.avg("residual").alias("m"), F.covar_pop("residual", "size").alias("c"))
    assert all(abs(r["m"]) < 1e-12 for r in out.collect())


def test_protocol(spark):
    schema = "project int, phase string, start_date date, end_date date"
    log = frame(spark, schema, [
        (1, "exploration", "2020-01-01", "2020-06-30"), (1, "confirmation", "2020-06-30", "2020-12-31"),
        (2, "exploration", "2020-01-01", "2020-06-30"), (2, "confirmation", "2020-07-01", "2020-12-31"),
        (3, "confirmation", "2020-01-01", "2020-02-01"), (3, "confirmation", "2021-01-01", "2021-02-01"),
    ])
    got = {r["project"]: (r["ok"], r["message"]) for r in protocol_check(log, ["project"]).collect()}
    assert got == {1: (False, "test ranges overlap"), 2: (True, "ok"), 3: (False, "more than one confirmation")}


def test_drawdown(spark):
    df = frame(spark, "date date, return double", list(zip(days(4), [0.1, -0.5, 0.2, 1.0])))
    got = [r["drawdown"] for r in drawdown(df).orderBy("date").collect()]
    assert got == pytest.approx([0, -0.5, -0.4, 0])


def test_csv_panel(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    head = "日期,开盘,最高,最低,收盘,成交量\n"
    (tmp_path / "csv" / "sh.600000.csv").write_text(head + "2020-01-01,1,2,0.5,1.5,100\n2020-01-02,x,2,0.5,1.6,200\n", encoding="utf-8")
    (tmp_path / "csv" / "SZ000001.csv").write_text(head + "2020-01-02,3,4,2.5,3.5,\n2019-01-02,3,4,2.5,3.5,7\nbad,1,1,1,1,1\n", encoding="utf-8")
    df = source.open_panel(spark, str(tmp_path / "csv"), "csv")
    assert rows(df.select("code", F.col("date").cast("string"), "open", "volume"), "code", "date") == [
        ("000001", "2019-01-02", 3.0, 7.0), ("000001", "2020-01-02", 3.0, None),
        ("600000", "2020-01-01", 1.0, 100.0), ("600000", "2020-01-02", None, 200.0),
    ]
    late = source.read_csv_panel(spark, str(tmp_path / "csv"), start="2020-01-02")
    assert late.count() == 2
    derived = filters.with_flags(filters.derive_missing(df)).where("code = '600000'").orderBy("date").collect()
    assert derived[1]["preclose"] == 1.5 and derived[1]["amount"] == pytest.approx(320.0) and derived[0]["is_st"] is None


def test_csv_panel_lists_its_folders_once(spark, tmp_path):
    """The header comes from one file with text, and the folders of the codes are listed by one job of a few tasks."""
    for i in range(60):
        folder = tmp_path / "csv" / f"symbol={i:06d}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("" if i % 2 else f"日期,开盘,最高,最低,收盘,成交量,股票代码\n2020-01-01,1,2,0.5,{i}.5,100,{i}\n", encoding="utf-8")
    (tmp_path / "csv" / "_SUCCESS").write_text("")
    key, tracker = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.statusTracker()
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("csv listing", "")
    try:
        df = source.read_csv_panel(spark, str(tmp_path / "csv"), code_folder="symbol")
        listings = [j for j in tracker.getJobIdsForGroup("csv listing") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s).numTasks > 1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(listings) == 1 and spark.conf.get(key) == before
    assert tracker.getStageInfo(tracker.getJobInfo(listings[0]).stageIds[0]).numTasks <= 4 * spark.sparkContext.defaultParallelism
    got = rows(df.select("code", "close", "volume"), "code")
    assert got == [(f"{i:06d}", i + 0.5, 100.0) for i in range(0, 60, 2)]
    (tmp_path / "none").mkdir()
    assert source._first_file(spark, str(tmp_path / "none")) is None and source._first_file(spark, str(tmp_path / "csv" / "symbol=*")) is None


def test_industry_benchmark_starts_at_the_written_weeks(spark):
    from factorframe.plans.catalogue import REGISTRY

    files = REGISTRY["industry_exposure_benchmark"].run(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_instrument_file_with_mark_and_header(spark, tmp_path):
    (tmp_path / "all.txt").write_text("﻿code\tstart\tend\nsh600000\t2010-01-01\t2020-01-01\nsh600000\t2021-01-01\t2022-01-01\n", encoding="utf-8")
    out = source.read_instruments(spark, str(tmp_path / "all.txt"))
    assert rows(out.select("code", F.col("start_date").cast("string")), "start_date") == [("sh600000", "2010-01-01"), ("sh600000", "2021-01-01")]


def test_experiment_log_round_trip(spark, tmp_path):
    record = [("t", "exploration", "first", "r1", ["2020-01-01", "2020-02-01"], {"k": "1"}, {"nw_p_value": 0.01})]
    df = spark.createDataFrame(record, writers.EXPERIMENT_SCHEMA)
    writers.append_experiments(df, str(tmp_path / "log"))
    writers.append_experiments(df, str(tmp_path / "log"))
    back = writers.read_experiments(spark, str(tmp_path / "log"))
    assert back.count() == 2 and back.first()["metrics"]["nw_p_value"] == 0.01


def test_interval_overlap_against_all_pairs(spark):
    from factorframe.operators.joins import interval_overlap

    rng = random.Random(8)
    calendar = days(1500, "2018-01-01")

    def make(n):
        out = []
        for i in range(n):
            a, b = sorted(rng.choices(range(1500), k=2))
            out.append((i, calendar[a], calendar[min(b, a + rng.choice([0, 3, 40, 900]))]))
        out += [(n, calendar[7], calendar[7]), (n + 1, calendar[7], calendar[8]), (n + 2, "1969-12-20", "1970-01-09"), (n + 3, "1969-12-30", "1969-12-30"),
                (n + 4, calendar[9], calendar[3])]  # one day, before the epoch, reversed
        return out + [(100 + i, calendar[700], calendar[700 + i % 3]) for i in range(12)]  # a busy day of equal starts

    a, b = make(40), make(25)
    schema = "id int, start_date date, end_date date"
    want = {(x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2] and x[1] <= x[2] and y[1] <= y[2]}
    out = interval_overlap(frame(spark, schema, a), frame(spark, schema, b)).collect()
    assert len(out) == len(want) and {(r["left_id"], r["right_id"]) for r in out} == want


def test_forward_shift_edges(spark):
    from factorframe.operators.joins import shift_forward

    cal = frame(spark, "date date, idx bigint", [(d, i) for i, d in enumerate(["2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"])])
    df = frame(spark, "id int, start date, stop date", [
        (1, "2019-12-01", "2021-01-01"), (2, "2020-01-04", "2021-01-01"), (3, "2020-01-07", "2021-01-01"), (4, "2020-02-01", "2021-01-01"),
    ])
    got = {r["id"]: str(r["start"]) for r in shift_forward(df, cal, "start", 1, "stop").collect()}
    assert got == {1: "2020-01-03", 2: "2020-01-07", 3: "2021-01-01", 4: "2020-02-01"}


def test_bin_counts_send_counts_and_not_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(x, None) for x in (None, 0.5, 1.0, 1.5, 2.0, -0.0, 3.0, 3.5, nan, -inf)], "f double, g double").repartition(3)
    found = drift.bin_counts(rows, {"f": [0.0, 1.0, 2.0, 3.0], "g": [1.0, 2.0]})
    got = {}
    for r in found.collect():
        got[r["feature"], r["_bin"]] = got.get((r["feature"], r["_bin"]), 0) + r["_n"]
    assert got == {("f", 1): 2, ("f", 2): 2, ("f", 3): 2}
    open_end = drift.bin_counts(rows, {"f": [2.0, 3.0, nan]}).groupBy("_bin").agg(F.sum("_n").alias("n")).collect()
    assert {r["_bin"]: r["n"] for r in open_end} == {1: 1, 2: 3}
    assert drift.bin_counts(rows, {}).count() == 0


def test_psi_counts_wide_rows(spark, monkeypatch):
    counted = []
    plain = drift.bin_counts
    monkeypatch.setattr(drift, "bin_counts", lambda rows, edges: counted.append(plain(rows, edges)) or counted[-1])
    rows = spark.range(300).select(F.rand(1).alias("f"), F.rand(2).alias("g"))
    found = {r["feature"]: r["psi"] for r in drift.psi(rows, rows, ["f", "g"]).collect()}
    assert found == {"f": pytest.approx(0), "g": pytest.approx(0)}
    assert len(counted) == 2 and all(c.count() <= 20 * c.rdd.getNumPartitions() for c in counted)


def test_contributions_join_no_second_panel(spark, monkeypatch):
    from factorframe.plans import research_queries as Q
    from factorframe.plans.testbed import Tables

    plans = []
    monkeypatch.setattr(Q, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    lines = spark.createDataFrame(
        [(o, 1, 1, s, 10.0, 100.0 + o + s, 0.1, datetime.date(2020, 1, 3) + datetime.timedelta(days=7 * o)) for o in range(45) for s in (1, 2)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date")
    suppliers = spark.createDataFrame([(1, 5.0), (2, 6.0)], "s_suppkey long, s_acctbal double")
    tables = Tables(spark, "/nowhere")
    monkeypatch.setattr(tables, "read", {"lineitem": lines, "supplier": suppliers}.__getitem__)
    found = {(r["code"], r["date"], r["feature"]) for r in Q.contributions(tables).collect()}
    assert {f for _, _, f in found} == {"size", "momentum", "volatility"}
    assert len(plans) == 1 and plans[0].count("Join") == 2
