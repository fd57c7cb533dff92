"""Exact order statistics inside groups of any size, by one plan for every size.

``rank() over (partition by date)`` sends a whole date to one task, and ``percentile`` keeps a whole group in
one buffer. Neither holds when one date carries a third of all rows. The operators here

1. cut large groups into pieces, at cuts from a sample of their values,
2. find positions inside a piece,
3. add the exact row counts of the earlier pieces.

Positions of values (`group_positions`) collapse equal values with a partial aggregate first, so ties never travel as rows; ranks of
rows (`average_ranks`) deal the rows themselves, and those of a frequent value freely, since they all tie. The cuts only balance work. Positions are exact whatever the cuts are, and any orderable type has them. Null keys are a group
like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.session import materialize

ROWS_PER_PIECE = 1 << 20
SAMPLES_PER_PIECE = 16
SALTS = 64


def _with_group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the right keys go."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _cuts(counts: DataFrame, group: Sequence[str], value: str, rows_per_piece: int) -> DataFrame:
    """The cuts of each group above rows_per_piece distinct values; at most one row per rows_per_piece input rows.

    A value is sampled by its hash, so a group gives about SAMPLES_PER_PIECE samples per piece, and every such sample that
    is a multiple of that number in order is a cut. The copies are read too, so that counts move once for the cuts and the positions.
    """
    step = min(SAMPLES_PER_PIECE, rows_per_piece)
    rate = max(1, rows_per_piece // step)
    sampled = F.when(F.pmod(F.xxhash64(value), F.lit(rate)) == 0, F.col(value))
    found = counts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_distinct"), F.sum("copies").alias("_rows"), F.sort_array(F.collect_list(sampled)).alias("_sample"))
    every = F.filter("_sample", lambda x, i: i % step == step - 1)
    large = (F.col("_distinct") > rows_per_piece) & (F.col("_rows") > rows_per_piece)
    return found.where(large).select(*group, every.alias("_cuts"))


def group_positions(df: DataFrame, keys: Sequence[str], value: str, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """One row per distinct non-null value of a group: its copies, and how many rows are below it.

    Columns: keys, value, ``copies``, ``before`` (rows with a smaller value), ``total`` (rows of the group).
    """
    base, group = _with_group(df, keys)
    counts = base.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("copies"))
    # groups with cuts have over rows_per_piece distinct values each, so these two tables stay a tiny share of the rows
    placed = match(counts, F.broadcast(_cuts(counts, group, value, rows_per_piece)), group).withColumn(
        "_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(_below(F.col("_cuts"), F.col(value)))
    )
    by_piece = Window.partitionBy(*group).orderBy("_piece")
    earlier = (
        placed.where(F.col("_cuts").isNotNull())
        .groupBy(*group, "_piece")
        .agg(F.sum("copies").alias("_rows"))
        .select(
            *group,
            "_piece",
            (F.sum("_rows").over(by_piece.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy(*group)).alias("_rows_of_group"),
        )
    )
    piece = Window.partitionBy(*group, "_piece")
    inside = piece.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.drop("_cuts").withColumns({
        "_upto": F.sum("copies").over(inside) - F.col("copies"), "_in_piece": F.sum("copies").over(piece)})
    return match(counted, F.broadcast(earlier), [*group, "_piece"]).select(
        *keys,
        value,
        "copies",
        (F.coalesce("_offset", F.lit(0)) + F.col("_upto")).alias("before"),
        F.coalesce("_rows_of_group", "_in_piece").alias("total"),
    )


POWERS = [1 << i for i in reversed(range(31))]


def _below(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are below value, by bisection: steps of falling powers of two, none past the last cut below."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    steps = F.slice(F.array(*[F.lit(p) for p in POWERS]), -bits, bits)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _row_cuts(df: DataFrame, group: Sequence[str], columns: Sequence[str], rows_per_piece: int) -> DataFrame | None:
    """Per group of over rows_per_piece rows and per column i of them, cuts _cut{i} from a sample of its rows; None without such groups.

    A frequent value is sampled often and so becomes a cut itself. The table has at most one row per rows_per_piece input rows, and
    one cut per that many. It is written, so that all later steps see the same cuts.
    """
    n = [F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)]
    sizes = df.groupBy(*group).agg(*n)
    is_large = reduce(lambda x, y: x | y, [F.col(f"_n{i}") > rows_per_piece for i in range(len(columns))])
    large = materialize(sizes.where(is_large))
    if large.isEmpty():
        return None
    step = min(SAMPLES_PER_PIECE, rows_per_piece)
    rate = max(1, rows_per_piece // step)
    inside = match(df.select(*group, *columns), F.broadcast(large), group, "inner").withColumn("_chosen", F.rand(5) * rate < 1)

    def cut(i: int, c: str) -> Column:
        sample = F.sort_array(F.collect_list(F.when(F.col("_chosen") & (F.col(f"_n{i}") > rows_per_piece), F.col(c))))
        return F.array_distinct(F.filter(sample, lambda x, at: at % step == step - 1)).alias(f"_cut{i}")

    return materialize(inside.groupBy(*group).agg(*[cut(i, c) for i, c in enumerate(columns)]))


def average_ranks(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """df plus one average-tie rank column per entry of values ({column: rank column name}); null values have null ranks.

    Rows are dealt once per column, by (group, piece), and ranked inside the piece. Groups of over rows_per_piece rows have several
    pieces: a piece between each two neighbouring cuts, and one for each cut, whose rows all tie and are dealt freely. Counts of the
    earlier pieces, from a table of a few rows per large group, are added.
    """
    base, group = _with_group(df, keys)
    columns = list(values)
    cuts = _row_cuts(base, group, columns, rows_per_piece)
    free = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(SALTS)).cast("int")
    placed = base if cuts is None else match(base, F.broadcast(cuts), group)
    for i, c in enumerate(columns):
        piece = F.when(F.col(c).isNull(), -1)
        if cuts is not None:
            at = _below(F.col(f"_cut{i}"), F.col(c))
            several = F.col(f"_cut{i}").isNotNull()
            piece = piece.when(several, 2 * at + F.coalesce(F.get(F.col(f"_cut{i}"), at) == F.col(c), F.lit(False)).cast("int"))
        placed = placed.withColumn(f"_piece{i}", piece.otherwise(0))
    if cuts is not None:
        pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("_column"), F.col(f"_piece{i}").alias("_piece")) for i in range(len(columns))]))
        counted = placed.where(F.col("_cut0").isNotNull()).select(*group, pieces.alias("_p")).where("_p._piece >= 0").groupBy(
            *group, "_p._column", "_p._piece").agg(F.count(F.lit(1)).alias("_copies"))
        earlier = Window.partitionBy(*group, "_column").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)  # pieces, not rows
        offsets = materialize(counted.withColumn("_offset", F.sum("_copies").over(earlier) - F.col("_copies")))
    for i, c in enumerate(columns):
        piece = F.col(f"_piece{i}")
        ties = (piece < 0) | (piece % 2 == 1)
        inside = Window.partitionBy(*group, piece, F.when(ties, free).otherwise(0)).orderBy(c)
        # rank is one more than the rows below, the running count takes in the ties
        rank = (F.rank().over(inside) + F.count(F.lit(1)).over(inside)) / 2
        placed = placed.withColumn(f"_rank{i}", F.when(F.col(c).isNotNull(), rank))
        if cuts is not None:
            mine = F.broadcast(offsets.where(F.col("_column") == i).drop("_column").withColumnRenamed("_piece", f"_piece{i}"))
            inner = F.when(ties, (F.col("_copies") + 1) / 2).otherwise(F.col(f"_rank{i}"))
            placed = match(placed, mine, [*group, f"_piece{i}"]).withColumn(
                f"_rank{i}", F.when(F.col(c).isNotNull(), F.coalesce("_offset", F.lit(0)) + inner)).drop("_copies", "_offset")
    return placed.select(*df.columns, *[F.col(f"_rank{i}").alias(values[c]) for i, c in enumerate(columns)])


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Exact linearly interpolated quantiles of a number column, one output column per entry of probabilities."""
    positions, group = _with_group(group_positions(df, keys, value, rows_per_piece), keys)

    def order_stat(position: Column) -> Column:
        hit = (F.col("before") <= position) & (position < F.col("before") + F.col("copies"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggregates = [F.max("total").alias("_total")]
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("total") - 1)
        aggregates += [
            order_stat(F.floor(spot)).alias(f"_lo_{name}"),
            order_stat(F.ceil(spot)).alias(f"_hi_{name}"),
        ]
    stats = positions.groupBy(*group).agg(*aggregates)
    columns = []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return stats.select(*keys, *columns, F.col("_total").alias("n_values"))


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **options: int) -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5}, **options).drop("n_values")


# Spark prunes row_number() <= k before the shuffle up to this k (spark.sql.optimizer.windowGroupLimitThreshold)
PRUNED_K = 1000


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """df with each row's place in its group by order, for groups of any size; rows equal in all of order share the first place."""
    marked = df.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    places = group_positions(marked.select(*keys, "_order"), keys, "_order", rows_per_piece)
    return match(marked, places.select(*keys, "_order", (F.col("before") + 1).alias(name)), [*keys, "_order"]).drop("_order")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, in two levels beyond PRUNED_K.

    Up to PRUNED_K, Spark itself keeps k rows per group and task before the shuffle. Beyond, each of SALTS parts of a group finds
    its own first k, so the last window sees at most SALTS * k rows of a group.
    """
    group = list(keys) or [F.lit(0)]
    if k > PRUNED_K:
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
              .withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k).drop("_salt", "_place"))
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def date_sized(df: DataFrame) -> DataFrame:
    """Mark a table with at most a few rows per calendar date for broadcast.

    A DATE key has under 37 000 values per century, so such a table stays at a few megabytes whatever the panel holds.
    """
    return F.broadcast(df)
