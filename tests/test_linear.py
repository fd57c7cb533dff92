"""Linear models from moments against NumPy: ridge paths, folds, rank-deficient systems, search, permutation importance."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorframe.operators import linear as L
from factorframe.operators.risk import fama_macbeth

START = datetime.date(2020, 1, 1)
FEATURES = ["a", "b", "c"]


def panel(spark, n_dates=40, n_codes=60, seed=1, noise=0.5):
    """a drives the label, b is noise, c is a plus noise; large offsets, some nulls."""
    r = np.random.default_rng(seed)
    rows = []
    for d in range(n_dates):
        a, b = r.normal(size=n_codes), r.normal(size=n_codes)
        c = a + 0.3 * r.normal(size=n_codes)
        y = a + noise * r.normal(size=n_codes)
        for k in range(n_codes):
            rows.append((k, START + datetime.timedelta(days=d), float(a[k]) + 1e6, None if r.random() < 0.02 else float(b[k]), float(c[k]) * 50 - 3, float(y[k])))
    return spark.createDataFrame(rows, "code int, date date, a double, b double, c double, label double"), rows


def ridge(x, y, penalty):
    mx, my, sx, sy = x.mean(0), y.mean(), x.std(0), y.std()
    z, t = (x - mx) / sx, (y - my) / sy
    b = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(x.shape[1]), z.T @ t / len(z)) * sy / sx
    return b, my - mx @ b


def splits_of(spark, n_dates, folds=2):
    rows = [(f, START + datetime.timedelta(days=d), "test" if d * folds // n_dates == f else "train") for f in range(folds) for d in range(n_dates)]
    return spark.createDataFrame(rows, "fold int, date date, role string")


def test_every_penalty_of_every_fold(spark):
    rows, raw = panel(spark)
    trials = L.trial_table(spark, FEATURES, [0.0, 0.1, 5.0], [FEATURES, ["a", "b"]])
    got = {(m.fold, m.trial): m for m in L.fold_models(rows, FEATURES, splits_of(spark, 40), trials).collect()}
    assert len(got) == 12
    for fold in (0, 1):
        train = np.array([r[2:] for r in raw if None not in r and (((r[1] - START).days * 2 // 40) != fold)], float)
        for trial in range(6):
            cols = [0, 1, 2] if trial < 3 else [0, 1]
            b, intercept = ridge(train[:, cols], train[:, 3], [0.0, 0.1, 5.0][trial % 3])
            m = got[fold, trial]
            assert m.n == len(train)
            np.testing.assert_allclose([m.coefficients[c] for c in cols], b, rtol=1e-6)
            assert m.intercept == pytest.approx(intercept, rel=1e-6)
            assert trial < 3 or m.coefficients[2] is None


def test_rank_deficient_dates(spark):
    r = np.random.default_rng(5)
    rows = []
    for d in range(3):
        x = r.normal(size=(40, 3))
        if d == 1:
            x[:, 1] = 2 * x[:, 0] - 7  # a combination of the first
        if d == 2:
            x[:, 0] = 4.0  # flat
        y = x @ [1.0, 2.0, 3.0] + 0.1
        rows += [(START + datetime.timedelta(days=d), *map(float, x[i]), float(y[i])) for i in range(40)]
    rows += [(START, float("nan"), 1.0, 1.0, 1.0), (START, float("inf"), 1.0, 1.0, 1.0), (START, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double, ret double")
    got = {((f.date - START).days, f.factor): (f.factor_return, f.n) for f in fama_macbeth(df, FEATURES).collect()}
    want = {0: [1, 2, 3], 1: [5, None, 3], 2: [None, 2, 3]}
    for d, betas in want.items():
        for f, b in zip(FEATURES, betas):
            value, n = got[d, f]
            assert n == 40 and (value is None if b is None else value == pytest.approx(b, rel=1e-8))


def test_search_finds_the_planted_optimum(spark):
    """Only a carries the label, so its set wins, in the grid and by halving."""
    rows, _ = panel(spark, noise=2.0)
    trials = L.trial_table(spark, FEATURES, [0.01, 30.0], [["b"], ["a"], ["b", "c"], ["c"]])
    splits = splits_of(spark, 40)
    grid = {r.trial: r for r in L.ridge_search(rows, FEATURES, splits, trials).collect()}
    assert len(grid) == 8 and all(r.n_days == 40 for r in grid.values())
    winner = [t for t, r in grid.items() if r.best]
    assert len(winner) == 1 and grid[winner[0]].subset == 1
    rungs = L.halving_search(rows, FEATURES, splits, trials, share=2).collect()
    assert [sum(r.rung == k for r in rungs) for k in range(4)] == [8, 4, 2, 1]
    assert [sum(r.rung == k and r.kept for r in rungs) for k in range(4)] == [4, 2, 1, 1]
    last = [r for r in rungs if r.rung == 3]
    assert last[0].trial == winner[0] and last[0].ic_mean == pytest.approx(grid[winner[0]].ic_mean)


def test_search_moves_a_row_once_for_all_trials(spark, monkeypatch):
    """The ranked rows are the test rows, however many trials there are, and every trial has its own correlations."""
    rows, raw = panel(spark)
    splits, trials = splits_of(spark, 40), L.trial_table(spark, FEATURES, [0.1, 5.0], [FEATURES, ["a"], ["b"]])
    moved, plain = [], L.rank_ics
    monkeypatch.setattr(L, "rank_ics", lambda r, *args, **kw: (moved.append(r.count()), plain(r, *args, **kw))[1])
    L.ridge_search(rows, FEATURES, splits, trials).collect()
    assert moved == [sum(None not in r for r in raw)]
    models = L.fold_models(rows, FEATURES, splits, trials)
    got = {(r.trial, r.date): r.ic for r in L.trial_ics(rows, models, FEATURES, splits).collect()}
    assert len(got) == 6 * 40 and len({type(t) for t, _ in got}) == 1
    fitted = {(m.fold, m.trial): m for m in models.collect()}
    for trial, day in ((0, 3), (3, 30), (5, 12)):
        x = np.array([r[2:] for r in raw if None not in r and (r[1] - START).days == day], float)
        m = fitted[int(day >= 20), trial]
        score = x[:, :3] @ [b or 0.0 for b in m.coefficients]
        ranks = [np.argsort(np.argsort(v)) for v in (score, x[:, 3])]
        assert got[trial, START + datetime.timedelta(days=day)] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-9)
    assert L.trial_ics(rows, models.where("trial < 0"), FEATURES, splits).count() == 0


@pytest.mark.parametrize("rows_per_part", [1 << 20, 9])
def test_permutation_importance(spark, rows_per_part):
    rows, _ = panel(spark)
    splits = splits_of(spark, 40)
    models = L.fold_models(rows.withColumn("z", F.lit(3.0)), [*FEATURES, "z"], splits, L.trial_table(spark, [*FEATURES, "z"], [0.1], [["a", "b", "z"]]))
    got = {(r.fold, r.feature): r.importance for r in L.permutation_importance(
        rows.withColumn("z", F.lit(3.0)), models, [*FEATURES, "z"], splits, rows_per_part=rows_per_part).collect()}
    for fold in (0, 1):
        assert abs(got[fold, "c"]) < 1e-12 and abs(got[fold, "z"]) < 1e-12  # without a coefficient, and flat
        assert abs(got[fold, "b"]) < 0.05 < 0.5 < got[fold, "a"]


def test_moments_move_as_sums_and_not_as_rows(spark):
    rows = spark.range(4000, numPartitions=3).select(
        (F.col("id") % 5).alias("date"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("side"), F.rand(1).alias("x"), F.randn(2).alias("y"))
    found = L.group_moments(rows, ["date", "side"], ["x", "y"], groups=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow add" in plan[plan.index("Exchange hashpartitioning"):] and plan.count("Exchange") == 1
    got = {(r.date, r.side): r for r in found.collect()}
    want = {(r.date, r.side): r for r in L.moments(rows, ["date", "side"], ["x", "y"]).collect()}
    assert got.keys() == want.keys() and len(got) == 15
    for key, r in want.items():
        assert got[key].n == r.n and list(got[key])[3:] == pytest.approx(list(r)[3:])


def test_permuted_rows_move_once(spark, monkeypatch):
    from factorframe.operators import ic

    plans = []
    plain = ic.materialize
    monkeypatch.setattr(ic, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    rows, _ = panel(spark)
    splits = splits_of(spark, 40)
    models = L.fold_models(rows, FEATURES, splits, L.trial_table(spark, FEATURES, [0.1]))
    models = spark.createDataFrame(models.collect(), models.schema)
    assert L.permutation_importance(rows, models, FEATURES, splits).count() == 2 * len(FEATURES)
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(fold") == 1
