"""Factor sets over a bar panel, as plain window expressions.

Single factors are window expressions over a panel that already carries ret and move (with_returns). features() builds the
whole set: returns first, then moments per window, then the factors, on columns of numbers in Arrow batches. All windows share the
same partitioning and order, so Spark exchanges and sorts the panel once (twice with the market join for beta).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorframe.functions import rolling as R
from factorframe.operators.ordering import date_sized
from factorframe.session import materialize

SHORT_WINDOWS = (5, 10, 20, 30, 60)
LONG_WINDOWS = (*SHORT_WINDOWS, 120, 240)
RSI_WINDOW = 14


def with_returns(panel: DataFrame) -> DataFrame:
    """Add ret (relative change) and move (absolute change) of close."""
    return panel.withColumns({"ret": R.pct_change("close", 1), "move": R.diff("close", 1)})


def kbar() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "kmid": (c - o) / o,
        "klen": (h - l) / o,
        "kup": (h - F.greatest(o, c)) / o,
        "klow": (F.least(o, c) - l) / o,
    }


def roc(n: int) -> Column:
    return R.pct_change("close", n)


def ma_ratio(n: int) -> Column:
    return F.try_divide(R.mean("close", n), F.col("close"))


def ma_cross(short: int = 5, long: int = 60) -> Column:
    return F.try_divide(R.mean("close", short), R.mean("close", long))


def volatility(n: int) -> Column:
    return R.std("ret", n)


def dist_high(n: int) -> Column:
    return F.try_divide(R.highest("close", n), F.col("close")) - 1


def dist_low(n: int) -> Column:
    return F.try_divide(R.lowest("close", n), F.col("close")) - 1


def beta(n: int, market: str = "market") -> Column:
    return F.try_divide(R.cov("ret", market, n), R.var(market, n))


def volume_roc(n: int) -> Column:
    return R.pct_change("volume", n)


def volume_mean(n: int) -> Column:
    return R.mean("volume", n)


def volume_std(n: int) -> Column:
    return R.std("volume", n)


def corr_pv(n: int) -> Column:
    return R.corr("volume", "close", n)


def illiquidity() -> Column:
    return F.try_divide(F.abs("ret"), F.col("volume"))


def rsi(n: int = RSI_WINDOW) -> Column:
    """100 - 100 / (1 + mean gain / mean loss); 100 when there is no loss."""
    gain = R.mean(F.greatest(F.col("move"), F.lit(0.0)), n)
    loss = R.mean(F.greatest(-F.col("move"), F.lit(0.0)), n)
    steady = R.mean("move", n).isNotNull()
    return F.when(steady, F.when(loss > 0, 100 - 100 / (1 + gain / loss)).otherwise(100.0))


def vwap_dev(n: int) -> Column:
    return F.try_divide(F.try_divide(R.total("amount", n), R.total("volume", n)), F.col("close")) - 1


def momentum_12_1(skip: int = 21, span: int = 252) -> Column:
    """Return from span rows ago to skip rows ago."""
    return F.try_divide(R.ref("close", skip), R.ref("close", span)) - 1


WINDOW_FACTORS = ("roc", "ma", "std", "high", "low", "vroc", "vma", "vstd", "corr", "skew", "kurt", "vwap")


def market_return(panel: DataFrame) -> DataFrame:
    """Equal-weight mean of ret per date: date, market."""
    return panel.groupBy("date").agg(F.avg("ret").alias("market"))


# Inputs of the window moments: how many central moments each needs, and the pairs whose products count.
MOMENTS = {"ret": 4, "close": 2, "volume": 2, "amount": 1}
PAIRS = (("volume", "close"),)
MARKET_MOMENTS = {"market": 2}
MARKET_PAIRS = (("ret", "market"),)
# A spread below the last bits of the values themselves is rounding noise of a constant window.
NOISE = 1e-15


DIRECT = 8  # windows up to this length may look at rows


def window_steps(windows: Sequence[int]) -> list[tuple[int, int, int]]:
    """(n, near, far) in the order of building, far 0 for windows built from rows.

    A window is the sum of two earlier ones where possible; otherwise of the longest earlier one of at least its half, or its half, and the
    rest, which are built first. So any length takes a logarithmic number of steps.
    """
    steps: list[tuple[int, int, int]] = []
    done: list[int] = []

    def build(n: int) -> None:
        if n in done:
            return
        near = next((d for d in sorted(done, reverse=True) if n - d in done), None)
        if near is None and n > DIRECT:
            near = next((d for d in sorted(done, reverse=True) if n // 2 <= d < n), n - n // 2)
            build(near)
            build(n - near)
        steps.append((n, near, n - near) if near is not None else (n, n, 0))
        done.append(n)

    for n in sorted(windows):
        build(n)
    return steps


@dataclass(frozen=True)
class Values:
    """Numbers of consecutive rows and which of them are there, with the null rules of Spark's arithmetic."""

    v: np.ndarray
    ok: np.ndarray

    def lag(self, k: int, row: np.ndarray) -> Values:
        """k rows back inside a code; row counts the rows of a code from 1."""
        if k == 0:
            return self
        v, ok = np.zeros(len(self.v)), np.zeros(len(self.v), bool)
        v[k:], ok[k:] = self.v[:-k], self.ok[:-k]
        return Values(v, ok & (row > k))

    def over(self, other: Values) -> Values:
        """Quotient; null where the divisor is 0."""
        return Values(self.v / other.v, self.ok & other.ok & (other.v != 0))

    def minus(self, number: float) -> Values:
        return Values(self.v - number, self.ok)


def _above(x: np.ndarray, y: np.ndarray | float) -> np.ndarray:
    """x > y, NaN above all numbers."""
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def _total(parts: list[np.ndarray]) -> np.ndarray:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _power(x: np.ndarray, k: int) -> np.ndarray:
    power = x
    for _ in range(k - 1):
        power = power * x
    return power


# The statistics of one window: "m1".."m4" and input for mean and central sums, "c" and a pair for its central product sum, "hi", "lo".
Stats = dict[tuple[str, ...], Values]


def _first_stats(x: dict[str, Values], row: np.ndarray, n: int, moments: dict[str, int], pairs) -> Stats:
    """Statistics of the last n rows from the rows themselves; null unless all n values are there."""
    out: Stats = {}
    away = {}
    for name, most in moments.items():
        past = [x[name].lag(i, row) for i in range(n)]
        ok = np.logical_and.reduce([p.ok for p in past])
        mean = _total([p.v for p in past]) / n
        away[name] = [p.v - mean for p in past]
        out["m1", name] = Values(mean, ok)
        for k in range(2, most + 1):
            out[f"m{k}", name] = Values(_total([_power(d, k) for d in away[name]]), ok)
        if name == "close":
            out["hi",] = Values(reduce(np.maximum, [p.v for p in past]), ok)
            out["lo",] = Values(reduce(np.fmin, [p.v for p in past]), ok)
    for a, b in pairs:
        out["c", a, b] = Values(_total([v * w for v, w in zip(away[a], away[b])]), out["m1", a].ok & out["m1", b].ok)
    return out


def _joined_stats(a: Stats, b: Stats, near: int, far: int, moments: dict[str, int], pairs) -> Stats:
    """Statistics of n = near + far rows: the near window a and the far one b that ended near rows ago, by the update formulas for
    central moments of joined samples. Nothing but the difference of the two means enters, so large levels do not cancel."""
    n = near + far
    out: Stats = {("hi",): Values(np.maximum(a["hi",].v, b["hi",].v), a["hi",].ok & b["hi",].ok),
                  ("lo",): Values(np.fmin(a["lo",].v, b["lo",].v), a["lo",].ok & b["lo",].ok)}
    away = {}
    for x, most in moments.items():
        p = {k: a[f"m{k}", x].v for k in range(1, most + 1)}
        q = {k: b[f"m{k}", x].v for k in range(1, most + 1)}
        ok = a["m1", x].ok & b["m1", x].ok
        d = away[x] = q[1] - p[1]
        out["m1", x] = Values(p[1] + d * (far / n), ok)
        if most >= 2:
            out["m2", x] = Values(p[2] + q[2] + d * d * (near * far / n), ok)
        if most >= 4:
            out["m3", x] = Values(p[3] + q[3] + _power(d, 3) * (near * far * (near - far) / n**2)
                                  + 3 * d * (near * q[2] - far * p[2]) / n, ok)
            out["m4", x] = Values(p[4] + q[4] + _power(d, 4) * (near * far * (near * near - near * far + far * far) / n**3)
                                  + 6 * d * d * (near * near * q[2] + far * far * p[2]) / n**2
                                  + 4 * d * (near * q[3] - far * p[3]) / n, ok)
    for x, y in pairs:
        one, other = a["c", x, y], b["c", x, y]
        out["c", x, y] = Values(one.v + other.v + away[x] * away[y] * (near * far / n), one.ok & other.ok)
    return out


def _rsi(move: Values, row: np.ndarray, n: int) -> Values:
    past = [move.lag(i, row) for i in reversed(range(n))]
    gain = _total([np.maximum(p.v, 0.0) for p in past]) / n
    loss = _total([np.maximum(-p.v, 0.0) for p in past]) / n
    return Values(np.where(_above(loss, 0.0), 100 - 100 / (1 + gain / loss), 100.0), np.logical_and.reduce([p.ok for p in past]))


def _window_factors(x: dict[str, Values], row: np.ndarray, n: int, stats: Stats, with_beta: bool) -> dict[str, Values]:
    """Every factor of one window from its statistics; null statistics of incomplete windows give null factors."""

    def spread(name: str) -> Values:
        m2, floor = stats["m2", name], NOISE * np.abs(stats["m1", name].v)
        return Values(np.where(_above(m2.v, n * floor * floor), m2.v, 0.0), m2.ok)

    def root(s: Values, by: float = 1) -> Values:
        return Values(np.sqrt(s.v / by), s.ok)

    close, volume, ret = x["close"], x["volume"], spread("ret")
    second = ret.v / n
    both = Values(root(spread("volume")).v * root(spread("close")).v, stats["c", "volume", "close"].ok)
    out = {
        f"roc_{n}": close.over(close.lag(n, row)).minus(1),
        f"ma_{n}": stats["m1", "close"].over(close),
        f"std_{n}": root(ret, n - 1),
        f"high_{n}": stats["hi",].over(close).minus(1),
        f"low_{n}": stats["lo",].over(close).minus(1),
        f"vroc_{n}": volume.over(volume.lag(n, row)).minus(1),
        f"vma_{n}": stats["m1", "volume"],
        f"vstd_{n}": root(spread("volume"), n - 1),
        f"corr_{n}": stats["c", "volume", "close"].over(both),
        f"skew_{n}": Values(stats["m3", "ret"].v / n, ret.ok).over(Values(np.power(second, 1.5), ret.ok)),
        f"kurt_{n}": Values(stats["m4", "ret"].v / n, ret.ok).over(Values(second * second, ret.ok)).minus(3),
        f"vwap_{n}": stats["m1", "amount"].over(stats["m1", "volume"]).over(close).minus(1),
    }
    if with_beta:
        out[f"beta_{n}"] = stats["c", "ret", "market"].over(spread("market"))
    return out


def _series_factors(x: dict[str, Values], row: np.ndarray, windows: Sequence[int], with_beta: bool) -> dict[str, Values]:
    """rsi and the factors of every window, for rows in order."""
    moments = MOMENTS | (MARKET_MOMENTS if with_beta else {})
    pairs = (*PAIRS, *(MARKET_PAIRS if with_beta else ()))
    stats: dict[int, Stats] = {}
    with np.errstate(all="ignore"):
        for n, near, far in window_steps(windows):
            if far:
                past = {name: s.lag(near, row) for name, s in stats[far].items()}
                stats[n] = _joined_stats(stats[near], past, near, far, moments, pairs)
            else:
                stats[n] = _first_stats(x, row, n, moments, pairs)
        out = {f"rsi_{RSI_WINDOW}": _rsi(x["move"], row, RSI_WINDOW)}
        for n in windows:
            out |= _window_factors(x, row, n, stats[n], with_beta)
    return out


def features(panel: DataFrame, windows: Sequence[int] = SHORT_WINDOWS, with_beta: bool = True) -> DataFrame:
    """code, date and one column per factor and window; a factor is null unless its window holds all its inputs.

    A sliding frame visits each of its rows for every aggregate, so the set shares one group of central moments, and only windows of
    at most DIRECT rows look at rows: 10 = 5 + 5, 20 = 10 + 10, 30 = 20 + 10 and so on, each from a lagged shorter one. Any other length
    is built from halves. Rows are dealt once by code and walked in order, a batch at a time with the last rows of the batch before.
    """
    base = with_returns(panel.repartition("code")).withColumn("_row", F.row_number().over(R.ordered()))
    inputs = ["move", *MOMENTS]
    if with_beta:
        # a row per date, written so that the shuffle it takes goes before the rows move
        base = base.join(date_sized(materialize(market_return(base))), "date", "left")
        inputs += [*MARKET_MOMENTS]
    numbers = base.withColumns({x: F.col(x).cast("double") for x in inputs})
    fixed = {**{name: c.alias(name) for name, c in kbar().items()}, "illiq": illiquidity().alias("illiq")}
    # of one code per task and in the order of its rows, which the returns have asked for already
    rows = numbers.select("code", "date", *fixed.values(), "_row", *inputs).sortWithinPartitions("code", "_row")
    shown = ["code", "date", *fixed]
    history = max(RSI_WINDOW, *windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            work = batch.select(["_row", *inputs])
            old = 0 if before is None else before.num_rows
            if old:
                work = pa.Table.from_batches([before, work]).combine_chunks().to_batches()[0]
            before = work.slice(max(0, work.num_rows - history))
            x = {c: Values(pc.fill_null(work.column(c), 0.0).to_numpy(), np.asarray(work.column(c).is_valid())) for c in inputs}
            found = _series_factors(x, work.column("_row").to_numpy(), windows, with_beta)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in shown], *[pa.array(f.v[old:], mask=~f.ok[old:]) for f in found.values()]],
                names=[*shown, *found])

    names = [f"rsi_{RSI_WINDOW}", *[f"{f}_{n}" for n in windows for f in (*WINDOW_FACTORS, *(("beta",) if with_beta else ()))]]
    schema = T.StructType([*[rows.schema[c] for c in shown], *[T.StructField(c, T.DoubleType()) for c in names]])
    return rows.mapInArrow(run, schema)
