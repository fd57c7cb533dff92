"""Readers of bar panels: per-entity CSV files, parquet folders, and views over them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted header spellings -> canonical column.
COLUMN_ALIASES = {
    "date": "date", "日期": "date", "trade_date": "date",
    "open": "open", "开盘": "open", "Open": "open",
    "high": "high", "最高": "high", "High": "high",
    "low": "low", "最低": "low", "Low": "low",
    "close": "close", "收盘": "close", "Close": "close",
    "volume": "volume", "成交量": "volume", "Volume": "volume", "vol": "volume",
    "amount": "amount", "成交额": "amount", "Amount": "amount",
    "turnover": "turnover_rate", "换手率": "turnover_rate", "turnover_rate": "turnover_rate",
    "pct_chg": "pct_chg", "涨跌幅": "pct_chg", "pctChange": "pct_chg", "change": "pct_chg",
    "preclose": "preclose", "前收盘": "preclose", "PreClose": "preclose",
    "amplitude": "amplitude", "振幅": "amplitude",
    "code": "code", "代码": "code", "股票代码": "code", "name": "name", "名称": "name", "股票名称": "name",
}

# Columns a panel must have, and those read as numbers.
REQUIRED = ("date", "open", "high", "low", "close", "volume")
NUMERIC = ("open", "high", "low", "close", "volume", "amount", "turnover_rate", "pct_chg", "preclose", "amplitude")

# Columns a projection may name; anything else in a request is ignored.
SELECTABLE = (
    "date", "code", "open", "high", "low", "close", "volume", "amount", "pct_chg", "turnover_rate", "amplitude", "is_st",
    "is_suspended", "name",
)

BAR_SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")]
)


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Rename known header spellings, ignoring surrounding blanks. Unknown columns stay."""
    renames = {c: aliases[c.strip()] for c in df.columns if c.strip() in aliases and aliases[c.strip()] != c}
    return df.withColumnsRenamed(renames)


def coerce_types(df: DataFrame, numeric: Sequence[str] = NUMERIC, date: str = "date") -> DataFrame:
    """Bad numbers and bad dates become null instead of failing the job."""
    changes = {c: F.col(c).try_cast("double") for c in numeric if c in df.columns}
    if date in df.columns:
        as_text = F.col(date).cast("string")
        changes[date] = F.coalesce(as_text.try_cast("date"), F.try_to_date(as_text, "yyyyMMdd"), F.try_to_date(as_text, "yyyy/M/d"))
    return df.withColumns(changes)


def code_from_file(name: str | Column) -> Column:
    """Six digits from the last separator-delimited token of a file name without its extension."""
    name = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    token = F.element_at(F.split(stem, r"[._\-]"), -1)
    digits = F.regexp_extract(token, r"(\d{6})", 1)
    return F.when(digits != "", digits)


def _first_file(spark: SparkSession, path: str) -> str | None:
    """A file with text under path, found without listing the rest; None for patterns and where there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())

    def search(folder) -> str | None:
        entries = fs.listStatusIterator(folder)
        while entries.hasNext():
            entry = entries.next()
            if entry.getPath().getName().startswith((".", "_")):
                continue
            found = search(entry.getPath()) if entry.isDirectory() else entry.getPath().toString() if entry.getLen() > 0 else None
            if found:
                return found
        return None

    return search(top) if fs.exists(top) else None


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists many folders with a task each, up to 10 000; a few per core share them here. Listing happens as a reader loads a path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_csv_panel(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    aliases: Mapping[str, str] = COLUMN_ALIASES,
    header: Sequence[str] | None = None,
    code_folder: str | None = None,
) -> DataFrame:
    """All per-entity CSV files under path as one panel; the code comes from the file name, or from the folder code_folder=<code>.

    header gives the columns of the files when it is known; otherwise one file tells them. Files sharing a folder must share one header order.
    """
    def reader():
        return spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8")

    if not header and (one := _first_file(spark, path)):
        header = reader().csv(one).columns  # a scan for the header would list all files a second time
    named = reader().schema(T.StructType([T.StructField(h, T.StringType()) for h in header])) if header else reader()
    with _few_listing_tasks(spark):
        raw = named.csv(path)
    columns = [F.col(f"`{c}`") for c in raw.columns if c != code_folder and aliases.get(c.strip().lstrip("﻿")) != "code"]
    # a folder's code may have been read as a number
    code = F.lpad(F.col(code_folder).cast("string"), 6, "0") if code_folder else code_from_file(F.col("_metadata.file_name"))
    df = coerce_types(normalize_columns(raw.select(*columns, code.alias("code")), aliases))
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    df = df.where(F.col("code").isNotNull() & F.col("date").isNotNull())
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def read_parquet_panel(spark: SparkSession, path: str) -> DataFrame:
    """Union by column name over all files of a folder."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", False).parquet(path)


def open_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    readers = {"parquet": read_parquet_panel, "csv": read_csv_panel}
    if fmt not in readers:
        raise ValueError(f"unsupported format {fmt!r}; use one of {sorted(readers)}")
    return readers[fmt](spark, path)


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def sql_query(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None, **args) -> DataFrame:
    """Run SQL over registered views, with bound parameters."""
    register_views(views or {})
    return spark.sql(text, args=args or None)


def whitelist(df: DataFrame, columns: Sequence[str] | None, allowed: Sequence[str] = SELECTABLE) -> DataFrame:
    """Keep the requested columns that are allowed and exist; everything when none is left."""
    chosen = [c for c in (columns or []) if c in allowed and c in df.columns]
    return df.select(*chosen) if chosen else df


def code_list(panel: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Distinct codes, from a reference list when there is one."""
    return (reference if reference is not None else panel).select("code").distinct().orderBy("code")


def trade_calendar(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """date, idx: distinct dates in order. The single-partition window sees one row per calendar date."""
    dates = panel.select("date").distinct().where(F.col("date").isNotNull())
    if start:
        dates = dates.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        dates = dates.where(F.col("date") <= F.lit(end).cast("date"))
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def weekday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday to Friday dates, for use when no bars define a calendar."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    ).where(F.weekday("date") < 5)
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def instruments(panel: DataFrame) -> DataFrame:
    """First and last date per code."""
    return panel.groupBy("code").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated symbol, start, end; tolerates a byte-order mark and a header line."""
    raw = spark.read.option("sep", "\t").schema("code string, start_date string, end_date string").csv(path)
    return raw.select(
        F.regexp_replace(F.trim("code"), "^﻿", "").alias("code"),
        F.col("start_date").try_cast("date").alias("start_date"),
        F.col("end_date").try_cast("date").alias("end_date"),
    ).where(F.col("start_date").isNotNull())


def industry_dim(df: DataFrame, code: str = "code", industry: str = "industry") -> DataFrame:
    """code (six digits), industry; rows without either dropped, one row per code."""
    cleaned = df.select(
        F.lpad(F.trim(F.col(code).cast("string")), 6, "0").alias("code"), F.col(industry).alias("industry")
    ).na.drop()
    return cleaned.groupBy("code").agg(F.max("industry").alias("industry"))


def sample_codes(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows of n codes chosen by a seeded hash: the same codes on every run and on every cluster."""
    codes = panel.select("code").distinct()
    chosen = codes.orderBy(F.md5(F.concat_ws("|", F.col("code").cast("string"), F.lit(str(seed)))), "code").limit(n)
    return panel.join(chosen, "code", "left_semi")


def delisted_union(lists: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Union of per-exchange delisted lists with their own headers: code, name, list_date, delist_date, exchange.

    lists: exchange -> (frame, {source column: canonical column}).
    """
    target = ["code", "name", "list_date", "delist_date"]
    out = None
    for exchange, (df, renames) in lists.items():
        part = df.withColumnsRenamed(dict(renames))
        part = part.select(*[c for c in target if c in part.columns], F.lit(exchange).alias("exchange"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_delisted(universe: DataFrame, delisted: DataFrame) -> DataFrame:
    """Universe codes plus the delisted ones, so that past cross-sections keep names that later vanished."""
    return universe.select("code").unionByName(delisted.select("code")).distinct()
