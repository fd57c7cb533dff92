"""Linear models from moments: one aggregate over the rows, then every fold, penalty and feature set from its small tables.

Rows are read once into counts, means and centred cross products per date, which partial aggregates merge without
cancellation. Dates add up to the training set of a fold, and one symmetric system per fold is solved by
elimination on arrays inside Spark, once per penalty and feature set. Tables after the first aggregate have a row per date,
fold or model, whatever the panel holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from factorframe.operators.ic import icir_summary, rank_ics
from factorframe.operators.ordering import ROWS_PER_PIECE
from factorframe.session import materialize

# a pivot that elimination leaves with less of its unit variance is a combination of earlier columns
TOLERANCE = 1e-10


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every column is a finite number."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(kept)


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moments(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by..., n, _m{i} (means) and _c{i}_{j} (centred cross products, i <= j) of the complete rows."""
    n = F.count(F.lit(1))
    return complete(rows, columns).groupBy(*by).agg(
        n.alias("n"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[(F.covar_pop(columns[i], columns[j]) * n).alias(f"_c{i}_{j}") for i, j in _pairs(len(columns))],
    )


# A task hands on the moments of its groups when it holds this many.
GROUPS_PER_TASK = 1 << 16


def group_moments(rows: DataFrame, by: Sequence[str], columns: Sequence[str], groups: int = GROUPS_PER_TASK) -> DataFrame:
    """The columns of `moments` for few groups, such as dates, by array arithmetic per batch of rows.

    Dozens of covariance aggregates in one node are not compiled. Rows stay where they are: a task adds up the moments of the groups it
    meets, `groups` of them at most, and only those move, to be merged as partial aggregates are.
    """
    k = len(columns)
    pairs = _pairs(k)
    upper = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])
    narrow = complete(rows, columns).select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    key_types = [to_arrow_type(narrow.schema[c].dataType) for c in by]
    numbers = [*[f"_m{i}" for i in range(k)], *[f"_c{i}_{j}" for i, j in pairs]]
    names = [*by, "n", *numbers]
    schema = T.StructType([*[narrow.schema[c] for c in by], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in numbers]])

    def laid(keys: list[tuple], n: np.ndarray, mean: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        fixed = [pa.array([key[i] for key in keys], t) for i, t in enumerate(key_types)]
        cells = [*mean.T, *products.T]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in cells]], names=names)

    def grouped(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """An order of the rows by group, where each group starts in it, its number of rows and its keys."""
        mixed = np.zeros(rows.num_rows, np.int64)
        for c in by:
            codes = pa.chunked_array([rows.column(c)] if isinstance(rows, pa.RecordBatch) else rows.column(c).chunks).combine_chunks()
            codes = codes.dictionary_encode(null_encoding="encode")
            mixed = np.unique(mixed * len(codes.dictionary) + np.asarray(codes.indices), return_inverse=True)[1]
        order = np.argsort(mixed, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(mixed[order]) > 0))
        heads = rows.select(list(by)).take(pa.array(order[first]))
        return order, first, np.diff(np.append(first, len(order))), list(zip(*[heads.column(c).to_pylist() for c in by]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        n, mean, products = np.zeros(0, np.int64), np.zeros((0, k)), np.zeros((0, len(pairs)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            order, first, size, keys = grouped(batch)
            x = np.stack([np.asarray(batch.column(f"_x{i}")) for i in range(k)])[:, order]
            near = x - np.repeat(x[:, first], size, axis=1)  # exactly zero for a flat column
            shift = np.add.reduceat(near, first, axis=1) / size
            near -= np.repeat(shift, size, axis=1)
            fresh_products = np.column_stack([np.add.reduceat(near[i] * near[j], first) for i, j in pairs])
            fresh_mean = (x[:, first] + shift).T
            if place and len(place) + len(keys) > groups:
                yield laid(list(place), n, mean, products)
                place, n, mean, products = {}, n[:0], mean[:0], products[:0]
            at = np.array([place.setdefault(key, len(place)) for key in keys])
            grown = len(place) - len(n)
            if grown:
                n, mean, products = (np.concatenate([a, np.zeros((grown, *a.shape[1:]), a.dtype)]) for a in (n, mean, products))
            both = (n[at] + size)[:, None]
            away = np.where(n[at][:, None] > 0, fresh_mean - mean[at], 0.0)
            products[at] += fresh_products + away[:, upper[0]] * away[:, upper[1]] * (n[at][:, None] * size[:, None] / both)
            mean[at] = np.where(n[at][:, None] > 0, mean[at] + away * (size[:, None] / both), fresh_mean)
            n[at] += size
        if place:
            yield laid(list(place), n, mean, products)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.Table.from_batches(list(batches), arrow_schema)  # a row per group and task that met it
        if parts.num_rows == 0:
            return
        order, first, size, keys = grouped(parts)
        n = np.asarray(parts.column("n").combine_chunks())[order]
        table = np.column_stack([np.asarray(parts.column(c).combine_chunks()) for c in numbers])[order]
        total, mean = np.add.reduceat(n, first), table[first, :k]
        away = table[:, :k] - np.repeat(mean, size, axis=0)
        shift = np.add.reduceat(n[:, None] * away, first) / total[:, None]
        away -= np.repeat(shift, size, axis=0)
        products = np.add.reduceat(table[:, k:] + n[:, None] * away[:, upper[0]] * away[:, upper[1]], first)
        yield laid(keys, total, mean + shift, products)

    arrow_schema = to_arrow_schema(schema)
    return narrow.mapInArrow(add, schema).repartition(*by).mapInArrow(merge, schema)


def pooled(parts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Moments of several groups taken together. parts: rows of `moments` with the columns of by."""
    totals = parts.groupBy(*by).agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(f"_m{i}")) / F.sum("n")).alias(f"_whole{i}") for i in range(k)])
    both = parts.join(F.broadcast(totals), list(by))  # one row per group of dates

    def apart(i: int) -> Column:
        return F.col(f"_m{i}") - F.col(f"_whole{i}")

    return both.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[F.first(f"_whole{i}").alias(f"_m{i}") for i in range(k)],
        *[F.sum(F.col(f"_c{i}_{j}") + F.col("n") * apart(i) * apart(j)).alias(f"_c{i}_{j}") for i, j in _pairs(k)],
    )


def systems(moment_rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """by..., n, mean and deviation of the k features and the target (last), and the rows of their correlation system.

    Each of the k rows holds a feature's correlations with the features and, last, with the target. Flat columns correlate with nothing.
    """
    def correlation(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.coalesce(F.try_divide(F.col(f"_c{i}_{j}"), F.sqrt(F.col(f"_c{i}_{i}") * F.col(f"_c{j}_{j}"))), F.lit(0.0))

    return moment_rows.select(
        *by, "n",
        F.array(*[F.col(f"_m{i}") for i in range(k + 1)]).alias("mean"),
        F.array(*[F.sqrt(F.col(f"_c{i}_{i}") / F.col("n")) for i in range(k + 1)]).alias("deviation"),
        F.array(*[F.array(*[correlation(i, j) for j in range(k + 1)]) for i in range(k)]).alias("system"),
    )


def eliminated(system: Column, k: int, allowed: Column | None = None) -> Column:
    """Solutions of a symmetric system of k rows with unit or larger diagonal and the right side last: array<double>.

    Columns are taken in order; one that is a combination of those before it, or that is not allowed, is left out: its entry is
    null and the others solve the system without it.
    """
    def step(state: Column, p: Column) -> Column:
        rows, used = state["rows"], state["used"]
        pivot = rows[p][p]
        usable = pivot > TOLERANCE
        if allowed is not None:
            usable = usable & allowed[p]
        reduced = F.transform(rows, lambda row, i: F.transform(
            row, lambda x, j: F.when(i == p, x / pivot).otherwise(x - row[p] * rows[p][j] / pivot)))
        return F.struct(F.when(usable, reduced).otherwise(rows).alias("rows"), F.concat(used, F.array(usable)).alias("used"))

    start = F.struct(system.alias("rows"), F.array().cast("array<boolean>").alias("used"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step, lambda s: F.transform(
        s["rows"], lambda row, i: F.when(s["used"][i], row[k])))


def solve(system_rows: DataFrame, k: int, penalty: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """Adds coefficients (array, null where a feature is left out) and intercept, in the units of the rows.

    With a penalty: mean squared error of the standardised target plus penalty times the squared standardised coefficients.
    """
    system = F.col("system")
    if penalty is not None:
        system = F.transform(system, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, x + penalty).otherwise(x)))
    standard = eliminated(system, k, allowed)
    scaled = F.transform(F.col("_b"), lambda b, i: b * F.try_divide(F.col("deviation")[k], F.col("deviation")[i]))
    total = F.aggregate(F.zip_with(F.slice("mean", 1, k), "coefficients", lambda m, b: m * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return system_rows.withColumn("_b", standard).withColumn("coefficients", scaled).withColumn("intercept", F.col("mean")[k] - total).drop("_b")


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], on: Sequence[str] = (), name: str = "score") -> DataFrame:
    """rows x models of equal `on`, with the model's score. models: a bounded table (folds x trials) of `solve`."""
    small = F.broadcast(models)
    both = rows.join(small, list(on)) if on else rows.crossJoin(small)
    return both.withColumn(name, linear_score(features, F.col("coefficients"), F.col("intercept")))


def linear_score(features: Sequence[str], coefficients: Column, intercept: Column) -> Column:
    """Plain arithmetic, which is compiled: a function over arrays would be interpreted for every row."""
    score = intercept
    for i, f in enumerate(features):
        b = F.get(coefficients, F.lit(i))
        score = score + F.coalesce(F.col(f).cast("double") * b, F.when(b.isNull(), 0.0))
    return score


def ridge_train_score(rows: DataFrame, features: Sequence[str], train: Column, test: Column, label: str = "label", penalty: float = 0.0) -> DataFrame:
    """Fit on the rows where train holds and score the rows where test holds: code, date, label, score."""
    k = len(features)
    one = moments(rows.where(train).withColumn("_set", F.lit(0)), ["_set"], [*features, label])
    model = solve(systems(one, ["_set"], k), k, F.lit(float(penalty))).select("coefficients", "intercept")
    return predict(rows.where(test), model, features).select("code", "date", label, "score")


def trial_table(spark, features: Sequence[str], penalties: Sequence[float], subsets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """trial, penalty, subset (number), allowed (which features take part): every penalty with every feature set."""
    subsets = subsets or [features]
    cells = [(float(p), s, [f in subset for f in features]) for s, subset in enumerate(subsets) for p in penalties]
    rows = [F.struct(F.lit(i).alias("trial"), F.lit(p).alias("penalty"), F.lit(s).alias("subset"), F.array(*[F.lit(x) for x in allowed]).alias("allowed"))
            for i, (p, s, allowed) in enumerate(cells)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def fold_models(rows: DataFrame, features: Sequence[str], splits: DataFrame, trials: DataFrame, label: str = "label") -> DataFrame:
    """fold, trial, penalty, subset, n, coefficients, intercept for every fold and trial, from one pass over the rows.

    splits: fold, date, role as the splitters of crossval give them.
    """
    k = len(features)
    daily = group_moments(rows, ["date"], [*features, label])
    train = F.broadcast(splits.where(F.col("role") == "train").select("fold", "date"))
    system = systems(pooled(materialize(daily).join(train, "date"), ["fold"], k + 1), ["fold"], k)
    every = system.crossJoin(F.broadcast(trials))  # folds x trials
    return solve(every, k, F.col("penalty"), F.col("allowed")).select("fold", "trial", "penalty", "subset", "n", "coefficients", "intercept")


def trial_ics(rows: DataFrame, models: DataFrame, features: Sequence[str], splits: DataFrame, label: str = "label") -> DataFrame:
    """trial, date, ic, n of the test rows: each date scored by the models of the fold that tests it.

    A row carries the scores of all trials side by side, so rows move once for all of them and a date's labels are ranked once.
    """
    trials = sorted(r["trial"] for r in models.select("trial").distinct().collect())  # a row per trial
    if not trials:
        return rank_ics(rows.crossJoin(models.select("trial")), ["trial", "date"], {"": F.lit(0.0)}, label).drop("feature")
    one = [F.first(F.when(F.col("trial") == t, F.struct("coefficients", "intercept")), ignorenulls=True).alias(f"_trial{t}") for t in trials]
    by_fold = F.broadcast(models.groupBy("fold").agg(*one))  # a row per fold
    dates = F.broadcast(splits.where(F.col("role") == "test").select("fold", "date"))
    tested = complete(rows, [*features, label]).select("date", label, *features).join(dates, "date").join(by_fold, "fold")
    scores = {str(t): linear_score(features, F.col(f"_trial{t}.coefficients"), F.col(f"_trial{t}.intercept")) for t in trials}
    ics = rank_ics(tested, ["date"], scores, label, name="trial").where(F.col("ic").isNotNull())
    return ics.withColumn("trial", F.col("trial").cast(models.schema["trial"].dataType))


def ridge_search(rows: DataFrame, features: Sequence[str], splits: DataFrame, trials: DataFrame, label: str = "label") -> DataFrame:
    """Rank IC over the test dates of all folds per trial: trial, penalty, subset, n_days, ic_mean, icir, best. Nothing is cached."""
    models = materialize(fold_models(rows, features, splits, trials, label))
    summary = icir_summary(trial_ics(rows, models, features, splits, label), ["trial"]).join(F.broadcast(trials), "trial")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("ic_mean", 10)), "trial"))  # one row per trial
    return summary.withColumn("best", place == 1).select("trial", "penalty", "subset", "n_days", "ic_mean", "icir", "best")


def halving_search(rows: DataFrame, features: Sequence[str], splits: DataFrame, trials: DataFrame, label: str = "label", share: int = 3) -> DataFrame:
    """Successive halving: rung, trial, penalty, subset, n_days, ic_mean, kept.

    A rung scores all trials that are left in one job, on every share^j-th test date of the calendar (j falls to 0 at the last rung), and
    keeps the best 1 / share of them, rounded up. Models are fitted once for all rungs, on all train dates of their fold.
    """
    models = materialize(fold_models(rows, features, splits, trials, label))
    count = trials.count()
    rungs = 0
    while count > share ** rungs:
        rungs += 1
    order = Window.orderBy("date")  # one row per test date
    places = materialize(splits.where(F.col("role") == "test").select("fold", "date").withColumn("_place", F.row_number().over(order) - 1))
    left, done = trials, []
    for rung in range(rungs + 1):
        dates = places.where(F.col("_place") % (share ** (rungs - rung)) == 0).select("fold", "date", F.lit("test").alias("role"))
        chosen = models.join(F.broadcast(left.select("trial")), "trial")
        ic = trial_ics(rows, chosen, features, dates, label).groupBy("trial").agg(F.count("ic").alias("n_days"), F.avg("ic").alias("ic_mean"))
        place = F.row_number().over(Window.orderBy(F.desc(F.round("ic_mean", 10)), "trial"))  # one row per trial
        survivors = -(-count // share) if rung < rungs else 1
        judged = materialize(ic.withColumn("kept", place <= survivors).withColumn("rung", F.lit(rung)))
        done.append(judged)
        left, count = judged.where("kept").select("trial"), survivors
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.join(F.broadcast(trials), "trial").select("rung", "trial", "penalty", "subset", "n_days", "ic_mean", "kept")


def permutation_importance(
    rows: DataFrame, models: DataFrame, features: Sequence[str], splits: DataFrame, label: str = "label", entity: str = "code",
    rows_per_part: int = ROWS_PER_PIECE,
) -> DataFrame:
    """fold, feature, importance: how much of a fold's mean rank IC goes when the feature's values change hands inside each test date.

    models: fold, coefficients, intercept (one model per fold). In the order of a hash each name takes the value of the next one, the last
    that of the first; dates of over rows_per_part names do so inside parts of about that size. All features and folds are one job: a
    linear score changes by coefficient times the difference of values.
    """
    dates = F.broadcast(splits.where(F.col("role") == "test").select("fold", "date"))
    tested = complete(rows, [*features, label]).select("date", entity, label, *features).join(dates, "date")
    parts = materialize(tested.groupBy("fold", "date").agg(F.ceil(F.count(F.lit(1)) / rows_per_part).alias("_parts")))  # a row per date
    digest = F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.col("date").cast("string")).cast("binary"))
    placed, group = tested.withColumn("_hash", F.unhex(digest)), ["fold", "date"]  # bytes order like their digits
    if not parts.where("_parts > 1").isEmpty():
        part = F.pmod(F.crc32(F.lower(F.hex("_hash")).cast("binary")), F.col("_parts"))
        placed, group = placed.join(F.broadcast(parts), ["fold", "date"]).withColumn("_part", part), ["fold", "date", "_part"]
    # without parts rows move once, by date, for the order and the ranks; what a fold's model holds is added after that
    order = Window.partitionBy(*group).orderBy("_hash", entity)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.struct(*features)
    turned = placed.withColumn("_next", F.coalesce(F.lead(values).over(order), F.first(values).over(whole)))
    moved = predict(turned, models.select("fold", "coefficients", "intercept"), features, ["fold"])
    changed = {f: F.col("score") + F.coalesce(F.col("coefficients")[i], F.lit(0.0)) * (F.col("_next")[f] - F.col(f)) for i, f in enumerate(features)}
    ic = rank_ics(moved, ["fold", "date"], {"": F.col("score"), **changed}, label).where(F.col("ic").isNotNull())
    means = materialize(ic.groupBy("fold", "feature").agg(F.avg("ic").alias("_ic")))
    base = means.where("feature = ''").select("fold", F.col("_ic").alias("_base"))
    return means.where("feature <> ''").join(F.broadcast(base), "fold").select("fold", "feature", (F.col("_base") - F.col("_ic")).alias("importance"))
