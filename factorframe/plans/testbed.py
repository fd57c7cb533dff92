"""Panel, scores, labels and dimensions derived from the given tables.

code = supplier key, price = extended price / quantity, volume = quantity, amount = extended price.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators.labels import forward_return
from factorframe.operators.resample import resample
from factorframe.session import materialize
from factorframe.sources.panel import trade_calendar


# Bars are written in slices of codes, one per so many bytes of trades, since their shuffles are larger than the bars.
SLICE_BYTES = 256 << 20
MOST_SLICES = 4  # each reads the trades again


class Tables:
    """DataFrames over one data folder, lazy but for those that several branches of a plan read: these are written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: set[str] = set()

    def keep(self, *names: str) -> Tables:
        """Write the named bars once, so that everything derived from them afterwards starts at the files."""
        for name in names:
            if name not in self._kept:
                self.__dict__[name] = materialize(getattr(self, name), "code", self.slices)
                self._kept.add(name)
        return self

    @cached_property
    def slices(self) -> int:
        trades = int(str(self.read("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of its files
        return min(MOST_SLICES, 1 + trades // SLICE_BYTES)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """Line items as trades: code, date, seq (total order inside a day), px, qty, amt."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("code"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("amt"),
        )

    @cached_property
    def day(self) -> DataFrame:
        """Daily bars. One aggregate with map-side combine: a hot code never meets a single task as rows."""
        return self.ticks.groupBy("code", "date").agg(
            F.min_by("px", "seq").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("amt").alias("amount"),
        )

    @cached_property
    def week(self) -> DataFrame:
        return resample(self.day, "week")

    @cached_property
    def score(self) -> DataFrame:
        """Four-row reversal: -(close / Ref(close, 4) - 1)."""
        return self.week.select("code", "date", (-R.pct_change("close", 4)).alias("score")).where(
            F.col("score").isNotNull()
        )

    @cached_property
    def score2(self) -> DataFrame:
        """Relative volume: Mean(volume, 8) / volume."""
        return self.week.select(
            "code", "date", F.try_divide(R.mean("volume", 8), F.col("volume")).alias("score")
        ).where(F.col("score").isNotNull())

    @cached_property
    def scored(self) -> DataFrame:
        """score and label (4 rows ahead) of each code and date, where both exist. One window pass, no join."""
        return materialize(self.week.select(
            "code", "date", (-R.pct_change("close", 4)).alias("score"), forward_return("close", 4).alias("label")
        ).where(F.col("score").isNotNull() & F.col("label").isNotNull()))

    @cached_property
    def scored2(self) -> DataFrame:
        return materialize(self.week.select(
            "code",
            "date",
            F.try_divide(R.mean("volume", 8), F.col("volume")).alias("score"),
            forward_return("close", 4).alias("label"),
        ).where(F.col("score").isNotNull() & F.col("label").isNotNull()))

    @cached_property
    def benchmark(self) -> DataFrame:
        """Equal-weight market return per week: date, bench."""
        return (
            self.week.select("date", R.pct_change("close", 1).alias("ret"))
            .groupBy("date")
            .agg(F.avg("ret").alias("bench"))
            .where(F.col("bench").isNotNull())
        )

    @cached_property
    def industry(self) -> DataFrame:
        supplier = self.read("supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey")
        nation = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("industry"))
        return supplier.join(nation, "s_nationkey").select("code", "industry")

    @cached_property
    def names(self) -> DataFrame:
        """code, name, listed code with an exchange prefix. Names of low balances carry the ST mark."""
        mark = F.when(F.col("s_acctbal") < 1000, F.lit("*ST ")).otherwise("")
        head = F.element_at(F.array(*[F.lit(h) for h in CODE_HEADS]), (F.col("s_suppkey") % 4 + 1).cast("int"))
        return self.read("supplier").select(
            F.col("s_suppkey").alias("code"),
            F.concat(mark, "s_name").alias("name"),
            F.concat(head, F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("listed"),
        )

    @cached_property
    def quoted(self) -> DataFrame:
        """Weekly panel with pct_chg, preclose, name and listed code."""
        return self.week.select(
            "*", (100 * R.pct_change("close", 1)).alias("pct_chg"), R.ref("close", 1).alias("preclose")
        ).join(self.names, "code")

    @cached_property
    def calendar(self) -> DataFrame:
        return trade_calendar(self.week)

    @cached_property
    def day_calendar(self) -> DataFrame:
        return trade_calendar(self.day)


CODE_HEADS = ("sh600", "sz300", "sh688", "bj430")

# The same derivations as SQL, for the second engine. name -> (dependencies, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "panel_day": ((), """
        SELECT code, date,
               max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
               max(CASE WHEN rd = 1 THEN px END) AS close, sum(qty) AS volume, sum(amt) AS amount
        FROM (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
                     l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS amt,
                     row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                       ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
                     row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                       ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rd
              FROM lineitem) t
        GROUP BY code, date"""),
    "wk": (("panel_day",), """
        SELECT code, week_end AS date,
               max(CASE WHEN rn = 1 THEN open END) AS open, max(high) AS high, min(low) AS low,
               max(CASE WHEN rd = 1 THEN close END) AS close, sum(volume) AS volume, sum(amount) AS amount
        FROM (SELECT *, row_number() OVER (PARTITION BY code, week_end ORDER BY date) AS rn,
                     row_number() OVER (PARTITION BY code, week_end ORDER BY date DESC) AS rd
              FROM (SELECT *, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week_end
                    FROM panel_day) d) t
        GROUP BY code, week_end"""),
    "score": (("wk",), """
        SELECT * FROM (SELECT code, date,
          -(close / lag(close, 4) OVER (PARTITION BY code ORDER BY date) - 1) AS score FROM wk) t
        WHERE score IS NOT NULL"""),
    "score2": (("wk",), """
        SELECT code, date, m / volume AS score
        FROM (SELECT *, avg(volume) OVER w AS m, count(volume) OVER w AS c FROM wk
              WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) t
        WHERE c = 8"""),
    "label": (("wk",), """
        SELECT * FROM (SELECT code, date, lead(close, 4) OVER w / lead(close, 1) OVER w - 1 AS label FROM wk
                       WINDOW w AS (PARTITION BY code ORDER BY date)) t
        WHERE label IS NOT NULL"""),
    "sl": (("score", "label"), "SELECT code, date, score, label FROM score JOIN label USING (code, date)"),
    "sl2": (("score2", "label"), "SELECT code, date, score, label FROM score2 JOIN label USING (code, date)"),
    "bench": (("wk",), """
        SELECT date, avg(r) AS bench
        FROM (SELECT date, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM wk) t
        GROUP BY date HAVING avg(r) IS NOT NULL"""),
    "names": ((), """
        SELECT s_suppkey AS code, CASE WHEN s_acctbal < 1000 THEN '*ST ' ELSE '' END || s_name AS name,
               (CASE s_suppkey % 4 WHEN 0 THEN 'sh600' WHEN 1 THEN 'sz300' WHEN 2 THEN 'sh688' ELSE 'bj430' END)
                 || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS listed
        FROM supplier"""),
    "quoted": (("wk", "names"), """
        SELECT w.*, 100 * (close / lag(close) OVER p - 1) AS pct_chg, lag(close) OVER p AS preclose, name, listed
        FROM wk w JOIN names USING (code) WINDOW p AS (PARTITION BY code ORDER BY date)"""),
    "cal": (("wk",), "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM wk) d"),
    "dcal": (("panel_day",),
             "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel_day) d"),
    "inst": (("wk",), "SELECT code, min(date) AS start_date, max(date) AS end_date FROM wk GROUP BY code"),
    "industry": ((), """
        SELECT s_suppkey AS code, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "ic": (("sl",), """
        SELECT date, round(corr(rs, rl), 12) AS ic, count(*) AS n
        FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY score)
                        + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs,
                     rank() OVER (PARTITION BY date ORDER BY label)
                        + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl
              FROM sl) t
        GROUP BY date HAVING count(*) >= 3 AND isfinite(corr(rs, rl))"""),
    "ic2": (("sl2",), """
        SELECT date, round(corr(rs, rl), 12) AS ic, count(*) AS n
        FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY score)
                        + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS rs,
                     rank() OVER (PARTITION BY date ORDER BY label)
                        + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl
              FROM sl2) t
        GROUP BY date HAVING count(*) >= 3 AND isfinite(corr(rs, rl))"""),
}


def with_ctes(*names: str, extra: str = "") -> str:
    """WITH clause for the named derivations and what they need; extra holds further CTE text."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in CTES[name][0]:
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
