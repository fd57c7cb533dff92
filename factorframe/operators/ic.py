"""Information coefficients: per-date correlation of scores with later returns, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factorframe.functions.stats import correlation
from factorframe.operators.labels import forward_return, quantile_grades
from factorframe.operators.ordering import average_ranks, date_sized, first_k, group_median, match
from factorframe.operators.significance import newey_west
from factorframe.session import materialize

MIN_NAMES = 3
MIN_POOLED = 10
MIN_SERIES = 5


def _rank_correlation(x: str, y: str) -> Column:
    """Correlation of ranks without the last rounding noise, so that unrelated ranks give exactly zero."""
    return F.round(correlation(x, y), 12)


def align(scores: DataFrame, labels: DataFrame, on: Sequence[str] = ("date", "code")) -> DataFrame:
    """Rows present on both sides, with both values."""
    return scores.join(labels, list(on)).where(F.col("score").isNotNull() & F.col("label").isNotNull())


# A group of up to this many numbers is ranked in one task; larger ones go by pieces (ordering.average_ranks).
CELLS_PER_GROUP = 1 << 24
RANKED_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Average-tie ranks; NaN ties with NaN above all numbers, as in Spark's order."""
    order = np.argsort(x)
    ascending = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    if x.dtype.kind == "f":
        new[1:] &= ~(np.isnan(ascending[1:]) & np.isnan(ascending[:-1]))
    first = np.flatnonzero(new)
    copies = np.diff(np.append(first, len(x)))
    ranks = np.empty(len(x))
    ranks[order] = np.repeat(first + (copies + 1) / 2, copies)
    return ranks


def _spearman(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    spread = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(x @ y / spread) if spread > 0 else None


def _group_ics(table: pa.Table, n_scores: int) -> tuple[list[int], list[float | None], list[int]]:
    """Number, correlation and row count of each score of one group against its label, over the rows that have both."""
    columns = [table.column(i).combine_chunks() for i in range(n_scores + 1)]  # the label is the last
    known = [np.asarray(c.is_valid()) for c in columns]
    values = [np.asarray(pc.fill_null(c, 0)) for c in columns]
    whole = None
    places, ics, counts = [], [], []
    for i in range(n_scores):
        both = known[i] & known[-1]
        n = int(both.sum())
        if n == 0:
            continue
        if n == len(both):
            whole = _average_ranks(values[-1]) if whole is None else whole
            labels = whole
        else:
            labels = _average_ranks(values[-1][both])
        places.append(i)
        ics.append(_spearman(_average_ranks(values[i][both]), labels))
        counts.append(n)
    return places, ics, counts


def rank_ics(
    rows: DataFrame, by: Sequence[str], scores: Mapping[str, Column], label: str = "label", min_names: int = MIN_NAMES,
    name: str = "feature", cells: int = CELLS_PER_GROUP,
) -> DataFrame:
    """Spearman correlation per group of several scores of the same rows with one label: name, by..., ic, n.

    Rows move once, with all their scores, and one task ranks a group. It stops taking in a group of over `cells` numbers and marks it;
    marked groups then go the way of large groups, by pieces. Inputs other than plain numbers go that way at once.
    """
    keys, names = list(by), list(scores)
    narrow = rows.select(*keys, *[c.alias(f"_s{i}") for i, c in enumerate(scores.values())], F.col(label).alias("_label")).where(
        F.col("_label").isNotNull())
    inputs = [f"_s{i}" for i in range(len(names))]
    types = dict(narrow.dtypes)
    called = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_place") + 1).alias(name)
    shown = [called, *keys, F.round("ic", 12).alias("ic"), "n"]

    def by_pieces(part: DataFrame) -> DataFrame:
        long = part.select(*keys, "_label", F.posexplode(F.array(*inputs)).alias("_place", "_score")).where(F.col("_score").isNotNull())
        group = ["_place", *keys]
        ranked = average_ranks(long.select(*group, "_score", "_label"), group, {"_score": "_x", "_label": "_y"})
        return ranked.groupBy(*group).agg(_rank_correlation("_x", "_y").alias("ic"), F.count(F.lit(1)).alias("n"))

    if any(types[c] not in RANKED_TYPES for c in (*inputs, "_label")):
        found = by_pieces(narrow)
    else:
        limit = max(1, cells // (len(inputs) + 1))
        key_types = [to_arrow_type(narrow.schema[k].dataType) for k in keys]
        wanted = [*inputs, "_label"]

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, taken = [], 0
            for batch in batches:
                taken += batch.num_rows
                if taken <= limit:
                    kept.append(batch.select(wanted))
                else:
                    kept = []
            places, ics, counts = ([-1], [None], [taken]) if taken > limit else _group_ics(pa.Table.from_batches(kept), len(inputs))
            fixed = [pa.array([k.as_py()] * len(places), t) for k, t in zip(key, key_types)]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(places, pa.int32()), pa.array(ics, pa.float64()), pa.array(counts, pa.int64())],
                names=[*keys, "_place", "ic", "n"])

        schema = T.StructType([*[narrow.schema[k] for k in keys], T.StructField("_place", T.IntegerType()),
                               T.StructField("ic", T.DoubleType()), T.StructField("n", T.LongType())])
        every = materialize(narrow.groupBy(*keys).applyInArrow(run, schema))  # a row per group and score
        found, marked = every.where("_place >= 0"), every.where("_place < 0")
        if not marked.isEmpty():
            large = match(narrow, F.broadcast(marked.select(*keys, F.lit(1).alias("_large"))), keys, "inner").drop("_large")
            found = found.unionByName(by_pieces(large).select(*keys, "_place", "ic", "n"))
    return found.select(*shown).where((F.col("n") >= min_names))


def rank_ic(
    pairs: DataFrame,
    by: Sequence[str],
    score: str = "score",
    label: str = "label",
    min_names: int = MIN_NAMES,
    legacy_scale: bool = False,
) -> DataFrame:
    """Spearman correlation per group with average ties: by..., ic, n.

    legacy_scale multiplies by (n-1)/n and reports constant input as 0.
    """
    out = rank_ics(pairs, by, {score: F.col(score)}, label, min_names, "_name").drop("_name")
    if legacy_scale:
        out = out.withColumn("ic", F.coalesce(F.col("ic") * (F.col("n") - 1) / F.col("n"), F.lit(0.0)))
    return out.where(F.col("ic").isNotNull())


def daily_rank_ic(scores: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """Rank IC per date. Pass one aligned frame (date, score, label) or scores and labels to align."""
    pairs = scores if labels is None else align(scores, labels)
    return rank_ic(pairs, ["date"], **options)


def pooled_rank_ic(pairs: DataFrame, by: Sequence[str] = (), min_rows: int = MIN_POOLED) -> DataFrame:
    """Spearman over whole groups; null when a group has fewer than min_rows rows."""
    rows = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    keys = list(by)
    if not keys:
        rows, keys = rows.withColumn("_pool", F.lit(0)), ["_pool"]
    ranked = average_ranks(rows.select(*keys, "score", "label"), keys, {"score": "_s", "label": "_l"})
    out = ranked.groupBy(*keys).agg(_rank_correlation("_s", "_l").alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ic", F.when(F.col("n") >= min_rows, F.col("ic"))).select(*by, "ic", "n")


def daily_ic(pairs: DataFrame, by: Sequence[str] = ("date",), min_names: int = MIN_NAMES) -> DataFrame:
    """Pearson correlation per date."""
    both = F.col("score").isNotNull() & F.col("label").isNotNull()
    return (
        pairs.where(both)
        .groupBy(*by)
        .agg(correlation("score", "label").alias("ic"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= min_names) & F.col("ic").isNotNull())
    )


def icir_summary(
    ic: DataFrame, by: Sequence[str] = (), max_lags: int | str | None = None, min_days: int = MIN_SERIES,
    lag_bound: int | None = None,
) -> DataFrame:
    """Mean, deviation, their ratio, positive share and tests per IC series; nulls when a series is too short."""
    keys = list(by)
    tests = newey_west(ic, "ic", keys, max_lags=max_lags, lag_bound=lag_bound)
    enough = F.col("n_samples") >= min_days

    def shown(c: Column) -> Column:
        return F.when(enough, c)

    return tests.select(
        *keys,
        F.col("n_samples").alias("n_days"),
        shown(F.col("mean")).alias("ic_mean"),
        shown(F.col("std")).alias("ic_std"),
        shown(F.when(F.col("std") > 0, F.try_divide("mean", "std"))).alias("icir"),
        shown(F.col("positive_ratio")).alias("ic_positive_ratio"),
        shown(F.when(F.col("std") > 0, F.col("t_naive"))).alias("naive_t_stat"),
        shown(F.col("t_nw")).alias("nw_t_stat"),
        shown(F.col("p_nw")).alias("nw_p_value"),
        (enough & F.col("significant")).alias("nw_significant"),
    )


def ic_decay(
    panel: DataFrame, scores: Column, horizons: Sequence[int] = (5, 10, 20, 60), min_names: int = 11, min_days: int = 5
) -> DataFrame:
    """IC summary per holding horizon; each horizon is its own lag order.

    scores: the score as a Column over the panel, so scores and all labels come from one window pass.
    """
    wide = panel.select(
        "code", "date", scores.alias("score"), *[forward_return("close", h).alias(f"_h{h}") for h in horizons]
    ).where(F.col("score").isNotNull())
    stack = ", ".join(f"{h}, _h{h}" for h in horizons)
    pairs = wide.select("date", "score", F.expr(f"stack({len(horizons)}, {stack}) AS (horizon, label)"))
    ic = rank_ic(pairs, ["horizon", "date"], min_names=min_names)
    out = icir_summary(ic.withColumn("_lag", F.col("horizon")), ["horizon"], max_lags="_lag", lag_bound=max(horizons))
    return out.where(F.col("n_days") >= min_days)


def stratified_ic(pairs: DataFrame, group: str, min_group: int = 11, min_total: int = 20) -> DataFrame:
    """Pooled rank IC per category: group, ic, n. Small groups, and inputs that are small overall, give no rows."""
    ic = pooled_rank_ic(pairs.where(F.col(group).isNotNull()), [group])
    total = ic.agg(F.sum("n").alias("_total"))
    return ic.crossJoin(F.broadcast(total)).where(
        (F.col("_total") >= min_total) & (F.col("n") >= min_group)
    ).drop("_total")


def stratified_ic_numeric(pairs: DataFrame, value: str, bins: int = 5, **limits: int) -> DataFrame:
    """Pooled rank IC per quantile bin (0 = lowest) of a numeric column over all rows.

    Rows and grades are written once: edges and ranks take several passes each, and none repeats what pairs are made of.
    """
    rows = materialize(pairs.select(value, "score", "label").where(
        F.col(value).isNotNull() & F.col("score").isNotNull() & F.col("label").isNotNull()
    ))
    binned = materialize(quantile_grades(rows, [], value, bins, small_group=None).select("score", "label", "grade"))
    return stratified_ic(binned, "grade", **limits)


def autocorrelation(series: DataFrame, value: str, max_lag: int = 20, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Pearson correlation of a series with itself 1..max_lag rows back. Needs 2 * max_lag rows."""
    keys = list(by)
    rows = series.where(F.col(value).isNotNull())
    if not keys:
        rows, keys = rows.withColumn("_series", F.lit(0)), ["_series"]
    ordered = Window.partitionBy(*keys).orderBy(order)
    lagged = rows.select(
        *keys, F.col(value).alias("_x"), *[F.lag(value, k).over(ordered).alias(f"_x{k}") for k in range(1, max_lag + 1)]
    )
    wide = lagged.groupBy(*keys).agg(
        F.count("_x").alias("_n"), *[correlation("_x", f"_x{k}").alias(f"_c{k}") for k in range(1, max_lag + 1)]
    )
    pairs = ", ".join(f"{k}, _c{k}" for k in range(1, max_lag + 1))
    return (
        wide.where(F.col("_n") >= 2 * max_lag)
        .select(*keys, "_n", F.expr(f"stack({max_lag}, {pairs}) AS (lag, autocorrelation)"))
        .where(F.col("lag") < F.floor(F.col("_n") / 2))
        .select(*by, "lag", "autocorrelation")
    )


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: keep..., feature, value."""
    return df.unpivot(list(keep), list(features), "feature", "value")


def factor_ic(df: DataFrame, features: Sequence[str], label: str = "label", min_names: int = MIN_NAMES) -> DataFrame:
    """Daily rank IC of every feature at once: feature, date, ic, n."""
    return rank_ics(df, ["date"], {f: F.col(f) for f in features}, label, min_names).where(F.col("ic").isNotNull())


def factor_ic_table(df: DataFrame, features: Sequence[str], label: str = "label", max_lags: int | None = None) -> DataFrame:
    return icir_summary(factor_ic(df, features, label), ["feature"], max_lags)


def direction_accuracy(pairs: DataFrame, min_names: int = 10) -> DataFrame:
    """Per date: share of names whose side of the score median agrees with the sign of the label."""
    rows = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    medians = group_median(rows, ["date"], "score", "_median")
    hit = ((F.col("score") > F.col("_median")) == (F.col("label") > 0)).cast("double")
    return (
        rows.join(date_sized(medians), "date")
        .groupBy("date")
        .agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_names)
    )


def ensemble_mean(models: Sequence[DataFrame], min_models: int = 2) -> DataFrame:
    """Average score per (date, code) over the models that scored it; at least min_models of them."""
    stacked = models[0].select("date", "code", "score")
    for model in models[1:]:
        stacked = stacked.unionByName(model.select("date", "code", "score"))
    return (
        stacked.groupBy("date", "code")
        .agg(F.avg("score").alias("score"), F.count("score").alias("n_models"))
        .where(F.col("n_models") >= min_models)
    )


def ndcg_at_k(graded: DataFrame, k: int, score: str = "score", grade: str = "grade") -> DataFrame:
    """NDCG@k per date. Ties are broken by code. Dates without any gain get null."""
    gain = (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(1 + F.col("_place"))

    def best(order):
        ranked = first_k(graded.select("date", "code", score, grade), ["date"], order, k, "_place")
        return ranked.groupBy("date").agg(F.sum(gain).alias("_gain"))

    dcg = best([F.desc(score), F.col("code")]).withColumnRenamed("_gain", "dcg")
    ideal = best([F.desc(grade), F.col("code")]).withColumnRenamed("_gain", "ideal")
    return dcg.join(date_sized(ideal), "date").select("date", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"))
