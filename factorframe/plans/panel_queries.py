"""Scan, projection, filter, join and aggregate queries over the derived panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.functions import flags
from factorframe.operators import aggregates as A
from factorframe.operators import filters as FL
from factorframe.operators import joins as J
from factorframe.operators import sketches as S
from factorframe.operators.labels import parse_label_columns
from factorframe.operators.resample import resample
from factorframe.plans.registry import query
from factorframe.plans.testbed import with_ctes
from factorframe.session import fresh_folder
from factorframe.sources import panel as SRC
from factorframe.sources import writers as OUT

BAR = {"code": "int", "date": "date", "open": 9, "high": 9, "low": 9, "close": 9, "volume": 4, "amount": 3}


scratch = fresh_folder


# ---- scans, sources, sinks -------------------------------------------------------------------------------------------


@query(
    "canonical_columns",
    {"date": "date", "code": "int", "open": 9, "close": 9, "volume": 4, "turnover_rate": 4},
    with_ctes("panel_day") + "SELECT date, code, open, close, volume, volume / 100 AS turnover_rate FROM panel_day",
)
def canonical_columns(t):
    messy = t.day.select(
        F.col("date").alias("日期"), "code", F.col("open").alias(" Open "), F.col("close").alias("收盘"),
        F.col("volume").alias("vol"), (F.col("volume") / 100).alias("换手率"),
    )
    return SRC.normalize_columns(messy)


@query("scan_csv_panel", BAR, with_ctes("panel_day") + "SELECT * FROM panel_day")
def scan_csv_panel(t):
    """One folder of CSV files per code, with foreign headers."""
    folder = scratch(t.spark)
    names = {"date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量", "amount": "成交额"}
    rows = t.day.select(F.lpad(F.col("code").cast("string"), 6, "0").alias("symbol"), F.col("code").alias("股票代码"),
                        *[F.col(c).alias(n) for c, n in names.items()])
    # a file per code: each task moves its own into place (version 2), where version 1 has the driver move all of them one by one
    writer = rows.repartition("symbol").write.partitionBy("symbol").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.option("header", True).csv(folder)
    return SRC.read_csv_panel(t.spark, folder, code_folder="symbol")


@query("write_panel", BAR, with_ctes("panel_day") + "SELECT * FROM panel_day")
def write_panel(t):
    folder = scratch(t.spark)
    OUT.write_panel(t.day, folder)
    return SRC.read_parquet_panel(t.spark, folder)


@query(
    "scan_parquet_panel",
    {**BAR, "source": "str"},
    with_ctes("panel_day") + """SELECT code, date, open, high, low, close, volume,
      CASE WHEN date >= DATE '1998-01-01' THEN amount END AS amount,
      CASE WHEN date < DATE '1998-01-01' THEN 'old' END AS source FROM panel_day""",
)
def scan_parquet_panel(t):
    """Two folders with different columns, read as one panel by column name."""
    folder = scratch(t.spark)
    cut = F.lit("1998-01-01").cast("date")
    t.day.where(F.col("date") < cut).drop("amount").withColumn("source", F.lit("old")).write.parquet(f"{folder}/part=1")
    t.day.where(F.col("date") >= cut).write.parquet(f"{folder}/part=2")
    return SRC.read_parquet_panel(t.spark, folder)


@query(
    "open_panel",
    {"code": "int", "n": "int", "first_date": "date"},
    with_ctes("panel_day") + "SELECT code, count(*) AS n, min(date) AS first_date FROM panel_day GROUP BY code",
)
def open_panel(t):
    folder = scratch(t.spark)
    OUT.write_panel(t.day, folder)
    return SRC.open_panel(t.spark, folder, "parquet").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date")
    )


@query(
    "sql_query",
    {"industry": "str", "n_codes": "int", "avg_close": 5},
    with_ctes("panel_day", "industry") + """SELECT industry, count(DISTINCT code) AS n_codes, avg(close) AS avg_close
      FROM panel_day JOIN industry USING (code) WHERE date >= DATE '1996-01-01' GROUP BY industry""",
)
def sql_query(t):
    text = """SELECT industry, count(DISTINCT code) AS n_codes, avg(close) AS avg_close
              FROM daily_data JOIN industry_data USING (code) WHERE date >= :start GROUP BY industry"""
    views = {"daily_data": t.day, "industry_data": t.industry}
    return SRC.sql_query(t.spark, text, views, start="1996-01-01")


@query("code_list", {"code": "int"}, with_ctes("panel_day") + "SELECT DISTINCT code FROM panel_day")
def code_list(t):
    return SRC.code_list(t.day)


@query(
    "trade_calendar",
    {"date": "date", "idx": "int"},
    with_ctes("panel_day") + """SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx
      FROM (SELECT DISTINCT date FROM panel_day WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') d""",
)
def trade_calendar(t):
    return SRC.trade_calendar(t.day, "1996-01-01", "1999-12-31")


@query("instruments_range", {"code": "int", "start_date": "date", "end_date": "date"}, with_ctes("inst") + "SELECT * FROM inst")
def instruments_range(t):
    return SRC.instruments(t.week)


@query(
    "industry_dim",
    {"code": "str", "industry": "str"},
    with_ctes("industry") + "SELECT lpad(CAST(code AS VARCHAR), 6, '0') AS code, industry FROM industry",
)
def industry_dim(t):
    return SRC.industry_dim(t.industry)


@query(
    "sample_codes",
    BAR,
    with_ctes("wk") + """SELECT * FROM wk WHERE code IN (
      SELECT code FROM (SELECT DISTINCT code FROM wk) c ORDER BY md5(CAST(code AS VARCHAR) || '|42'), code LIMIT 7)""",
)
def sample_codes(t):
    return SRC.sample_codes(t.week, 7)


@query(
    "write_report",
    {"code": "int", "trading_days": "int", "avg_close": 4},
    with_ctes("wk") + "SELECT code, count(*) AS trading_days, avg(close) AS avg_close FROM wk GROUP BY code",
)
def write_report(t):
    folder = scratch(t.spark)
    stats = t.week.groupBy("code").agg(F.count(F.lit(1)).alias("trading_days"), F.avg("close").alias("avg_close"))
    OUT.write_report({"statistics": stats}, folder)
    return t.spark.read.option("header", True).schema("code bigint, trading_days bigint, avg_close double").csv(
        f"{folder}/statistics"
    )


@query(
    "delisted_union",
    {"code": "str", "name": "str", "list_date": "date", "delist_date": "date", "exchange": "str"},
    with_ctes("inst", "names", extra="""x AS (SELECT lpad(CAST(code AS VARCHAR), 6, '0') AS code, name, start_date, end_date,
        listed FROM inst JOIN names USING (code) WHERE end_date < (SELECT max(date) FROM wk))""")
    + """SELECT code, name, start_date AS list_date, end_date AS delist_date,
                CASE WHEN listed LIKE 'sh%' THEN 'SSE' ELSE 'SZSE' END AS exchange FROM x""",
)
def delisted_union(t):
    """Codes whose last bar precedes the calendar's end, from two lists with different headers."""
    last = t.week.agg(F.max("date").alias("last"))
    gone = (
        SRC.instruments(t.week).join(t.names, "code").crossJoin(F.broadcast(last)).where(F.col("end_date") < F.col("last"))
        .withColumn("code", F.lpad(F.col("code").cast("string"), 6, "0"))
    )
    shanghai = F.col("listed").startswith("sh")
    first = gone.where(shanghai).select(
        F.col("code").alias("公司代码"), F.col("name").alias("公司简称"), F.col("start_date").alias("上市日期"),
        F.col("end_date").alias("暂停上市日期"),
    )
    second = gone.where(~shanghai).select(
        F.col("code").alias("证券代码"), F.col("name").alias("证券简称"), F.col("start_date").alias("上市日期"),
        F.col("end_date").alias("终止上市日期"),
    )
    return SRC.delisted_union(
        {
            "SSE": (first, {"公司代码": "code", "公司简称": "name", "上市日期": "list_date", "暂停上市日期": "delist_date"}),
            "SZSE": (second, {"证券代码": "code", "证券简称": "name", "上市日期": "list_date", "终止上市日期": "delist_date"}),
        }
    )


# ---- projections, filters, derived columns ---------------------------------------------------------------------------


@query(
    "stock_price",
    BAR,
    with_ctes("panel_day") + "SELECT * FROM panel_day WHERE code = 3 AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'",
)
def stock_price(t):
    return FL.stock_price(t.day, 3, "1995-01-01", "1999-12-31")


@query(
    "price_history_multi",
    {"code": "int", "date": "date", "close": 9, "volume": 4},
    with_ctes("panel_day") + """SELECT code, date, close, volume FROM panel_day
      WHERE code IN (1, 4, 7) AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'""",
)
def price_history_multi(t):
    return FL.price_history(t.day, [1, 4, 7], "1995-01-01", "1999-12-31", ["code", "date", "close", "volume", "drop table"])


@query(
    "cross_section",
    {"code": "int", "name": "str", "close": 9, "pct_chg": 6},
    with_ctes("quoted") + """SELECT code, name, close, pct_chg FROM quoted
      WHERE date = (SELECT max(date) FROM wk WHERE date <= DATE '1998-06-05') AND NOT contains(name, 'ST')""",
)
def cross_section(t):
    return FL.cross_section(FL.with_flags(t.quoted), "1998-06-05", ["code", "name", "close", "pct_chg"])


@query("column_whitelist", BAR, with_ctes("wk") + "SELECT * FROM wk")
def column_whitelist(t):
    """Nothing in the request is allowed, so every column stays."""
    return SRC.whitelist(t.week, ["secret", "1; drop"])


@query(
    "derive_missing",
    {"code": "int", "date": "date", "amount": 3, "pct_chg": 6, "preclose": 9, "turnover_rate": 4},
    with_ctes("wk") + """SELECT code, date, volume * close AS amount, 100 * (close / lag(close) OVER w - 1) AS pct_chg,
      lag(close) OVER w AS preclose, CAST(NULL AS DOUBLE) AS turnover_rate FROM wk WINDOW w AS (PARTITION BY code ORDER BY date)""",
)
def derive_missing(t):
    return FL.derive_missing(t.week.drop("amount"))


@query(
    "flag_st",
    {"code": "int", "name": "str", "is_st": "bool"},
    "SELECT p_partkey AS code, p_type AS name, contains(p_type, 'ST') AS is_st FROM part",
)
def flag_st(t):
    return t.read("part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("name")).withColumn("is_st", flags.is_st())


_DENSE = """dense AS (SELECT g.code, g.date, p.close, p.volume, p.amount, p.code IS NOT NULL AS traded
  FROM (SELECT i.code, c.date FROM inst i JOIN cal c ON c.date BETWEEN i.start_date AND i.end_date) g
  LEFT JOIN wk p ON p.code = g.code AND p.date = g.date)"""


@query(
    "flag_suspended",
    {"code": "int", "date": "date", "is_suspended": "bool"},
    with_ctes("inst", "cal", extra=_DENSE)
    + "SELECT code, date, coalesce(volume, 0) = 0 AND coalesce(amount, 0) = 0 AS is_suspended FROM dense",
)
def flag_suspended(t):
    dense = J.densify(t.week, t.calendar, ["volume", "amount"])
    return dense.select("code", "date", flags.is_suspended().alias("is_suspended"))


@query(
    "flag_one_price",
    {"code": "int", "date": "date", "is_limit": "bool"},
    with_ctes("panel_day") + "SELECT code, date, high = low AND high = close AND volume > 0 AS is_limit FROM panel_day",
)
def flag_one_price(t):
    return FL.with_flags(t.day).select("code", "date", "is_limit")


_BOARD = """CASE WHEN listed LIKE 'sh688%' OR listed LIKE 'sh689%' THEN 'star' WHEN listed LIKE 'sz300%' OR listed LIKE 'sz301%'
  THEN 'chinext' WHEN listed LIKE 'bj%' THEN 'bj' ELSE 'main' END"""


@query("board_class", {"listed": "str", "board": "str"}, with_ctes("names") + f"SELECT listed, {_BOARD} AS board FROM names")
def board_class(t):
    return t.names.select("listed", flags.board_class(F.upper("listed")).alias("board"))


@query(
    "limit_flags",
    {"code": "int", "date": "date", "limit_buy": "bool", "limit_sell": "bool"},
    with_ctes("quoted", extra=f"""b AS (SELECT code, date, close, pct_chg / 100 AS chg,
        CASE {_BOARD} WHEN 'main' THEN 0.099 WHEN 'bj' THEN 0.299 ELSE 0.199 END AS th FROM quoted)""")
    + """SELECT code, date, coalesce(chg >= th, false) OR close IS NULL AS limit_buy,
                coalesce(chg <= -th, false) OR close IS NULL AS limit_sell FROM b""",
)
def limit_flags(t):
    board = flags.board_class("listed")
    change = F.col("pct_chg") / 100
    return t.quoted.select(
        "code", "date", flags.limit_buy(change, "close", board).alias("limit_buy"),
        flags.limit_sell(change, "close", board).alias("limit_sell"),
    )


@query(
    "code_normalize",
    {"code": "int", "plain": "str", "prefixed": "str", "beijing": "bool"},
    """SELECT code, plain, CASE WHEN left(plain, 2) IN ('00', '30', '12', '15') THEN 'sz'
              WHEN left(plain, 2) IN ('83', '87', '43', '92', '88') THEN 'bj' ELSE 'sh' END || plain AS prefixed,
              plain LIKE '8%' OR plain LIKE '4%' OR plain LIKE '920%' AS beijing
       FROM (SELECT p_partkey AS code, lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS plain FROM part) t""",
)
def code_normalize(t):
    raw = t.read("part").select(
        F.col("p_partkey").alias("code"), F.concat(F.lit("SZ."), F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0")).alias("raw")
    )
    return raw.select(
        "code", flags.plain_code("raw").alias("plain"), flags.prefixed_code("raw").alias("prefixed"), flags.is_beijing("raw").alias("beijing")
    )


_KEEP = """SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS qty
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
        ORDER BY l_orderkey {d}, l_linenumber {d}, l_partkey {d}, l_extendedprice {d}) AS rn FROM lineitem) t WHERE rn = 1"""
_TICK = {"code": "int", "date": "date", "px": 9, "qty": 4}


@query("dedupe_keep_last", _TICK, _KEEP.format(d="DESC"))
def dedupe_keep_last(t):
    return FL.dedupe(t.ticks.drop("amt"), ["code", "date"], "seq", "last")


@query("dedupe_keep_first", _TICK, _KEEP.format(d="ASC"))
def dedupe_keep_first(t):
    return FL.dedupe(t.ticks.drop("amt"), ["code", "date"], "seq", "first")


@query(
    "min_rows_filter",
    {"code": "int", "date": "date", "close": 9},
    with_ctes("wk") + """SELECT code, date, close FROM wk
      WHERE code IN (SELECT code FROM wk GROUP BY code HAVING count(*) >= 290)""",
)
def min_rows_filter(t):
    return FL.min_rows_filter(t.week, 290)


_SHIFT = """SELECT i.code, coalesce(c2.date, i.end_date) AS start_date, i.end_date
  FROM {src} i JOIN (SELECT i.code, min(c.idx) AS k FROM {src} i JOIN cal c ON c.date >= i.start_date GROUP BY i.code) m
    ON m.code = i.code LEFT JOIN cal c2 ON c2.idx = m.k + {n}"""


@query(
    "universe_filter",
    {"code": "str", "start_date": "date", "end_date": "date"},
    with_ctes("inst", "names", "cal", extra="""base AS (SELECT listed AS code, start_date, end_date FROM inst JOIN names USING (code)
      WHERE listed NOT LIKE 'bj%' AND NOT contains(name, 'ST'))""")
    + f"SELECT * FROM ({_SHIFT.format(src='base', n=250)}) s WHERE start_date <= end_date",
)
def universe_filter(t):
    listed = SRC.instruments(t.week).join(t.names, "code").select(F.col("listed").alias("code"), "name", "start_date", "end_date")
    st = listed.where(flags.is_st()).select("code")
    return FL.universe_filter(listed.drop("name"), t.calendar, st, "bj", 250)


@query(
    "index_members",
    {"code": "int", "present": "bool"},
    "SELECT c_custkey AS code, c_custkey IN (SELECT l_suppkey FROM lineitem) AS present FROM customer",
)
def index_members(t):
    """Constituents (here the customer keys) split into those with bars and those missing from the panel."""
    traded = SRC.instruments(t.day)
    members = t.read("customer").select(F.col("c_custkey").alias("code"))
    have = FL.index_members(traded, members).select("code", F.lit(True).alias("present"))
    return have.unionByName(FL.missing_members(traded, members).select("code", F.lit(False).alias("present")))


_SEGMENTS = {"train": ("1995-01-01", "1997-12-31"), "valid": ("1998-01-01", "1998-12-31"), "test": ("1999-01-01", "2000-12-31")}


@query(
    "segment_split",
    {"code": "int", "date": "date", "segment": "str"},
    with_ctes("wk") + """SELECT * FROM (SELECT code, date, CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'train'
      WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'valid'
      WHEN date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN 'test' END AS segment FROM wk) q WHERE segment IS NOT NULL""",
)
def segment_split(t):
    return FL.segment_split(t.week, _SEGMENTS).select("code", "date", "segment")


@query(
    "range_check",
    {"code": "int", "start_date": "date", "end_date": "date", "inside": "bool"},
    with_ctes("inst", "cal") + """SELECT code, start_date, CAST(end_date + 30 AS DATE) AS end_date,
      start_date >= (SELECT min(date) FROM cal) AND end_date + 30 <= (SELECT max(date) FROM cal) AS inside FROM inst""",
)
def range_check(t):
    ranges = SRC.instruments(t.week).withColumn("end_date", F.date_add("end_date", 30))
    return FL.range_check(t.calendar, ranges)


@query(
    "type_coerce",
    {"event_id": "int", "value": 4, "k": "int", "day": "date"},
    """SELECT event_id, TRY_CAST(value || CASE WHEN event_type = 'error' THEN 'x' ELSE '' END AS DOUBLE) AS value,
              TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events""",
)
def type_coerce(t):
    e = t.read("events")
    text = e.select(
        "event_id",
        F.concat(F.col("value").cast("string"), F.when(F.col("event_type") == "error", "x").otherwise("")).alias("value"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
    )
    return SRC.coerce_types(text, ["value"], "day")


# ---- joins -----------------------------------------------------------------------------------------------------------


@query(
    "inner_align",
    {"code": "int", "date": "date", "score": 7, "label": 7},
    with_ctes("sl") + "SELECT * FROM sl",
)
def inner_align(t):
    from factorframe.operators.ic import align
    from factorframe.operators.labels import label_returns

    return align(t.score, label_returns(t.week, 4))


@query(
    "left_lookup_default",
    {"code": "int", "date": "date", "industry": "str"},
    with_ctes("wk", "industry") + """SELECT wk.code, date, coalesce(industry, 'Other') AS industry FROM wk
      LEFT JOIN (SELECT * FROM industry WHERE industry < 'NATION_2') i USING (code)""",
)
def left_lookup_default(t):
    return J.lookup(t.week.select("code", "date"), t.industry.where(F.col("industry") < "NATION_2"), "code", "industry", "Other")


@query(
    "semi_join",
    BAR,
    with_ctes("wk", "ic") + "SELECT * FROM wk WHERE date IN (SELECT date FROM ic WHERE ic > 0)",
)
def semi_join(t):
    from factorframe.operators.ic import daily_rank_ic

    return FL.keep_dates(t.week, daily_rank_ic(t.scored).where(F.col("ic") > 0))


@query(
    "anti_join",
    BAR,
    with_ctes("wk", "names") + "SELECT * FROM wk WHERE code NOT IN (SELECT code FROM names WHERE contains(name, 'ST'))",
)
def anti_join(t):
    return t.week.join(t.names.where(flags.is_st()), "code", "left_anti")


@query(
    "calendar_index_join",
    {"code": "int", "date": "date", "idx": "int"},
    with_ctes("cal") + "SELECT code, date, idx FROM wk JOIN cal USING (date)",
)
def calendar_index_join(t):
    return J.calendar_index(t.week.select("code", "date"), t.calendar)


@query(
    "asof_forward_shift",
    {"code": "int", "start_date": "date", "end_date": "date"},
    with_ctes("cal", extra="""listing AS (SELECT code, CAST(min(date) - 3 AS DATE) AS start_date, max(date) AS end_date
      FROM wk GROUP BY code)""") + _SHIFT.format(src="listing", n=60),
)
def asof_forward_shift(t):
    listing = SRC.instruments(t.week).withColumn("start_date", F.date_sub("start_date", 3))
    return J.shift_forward(listing, t.calendar, "start_date", 60, "end_date")


_TERMS = """terms AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e
  FROM orders GROUP BY o_custkey),
years AS (SELECT y AS id, make_date(y, 1, 1) AS s, make_date(y, 6, 30) AS e FROM
  (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) q)"""


@query(
    "interval_overlap",
    {"left_id": "int", "right_id": "int", "start_date": "date", "end_date": "date"},
    f"""WITH {_TERMS} SELECT t.id AS left_id, y.id AS right_id, greatest(t.s, y.s) AS start_date, least(t.e, y.e) AS end_date
        FROM terms t JOIN years y ON t.s <= y.e AND y.s <= t.e""",
)
def interval_overlap(t):
    """Order terms of customers against the first half of each year."""
    orders = t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    terms = orders.groupBy("id").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"))
    years = orders.select(F.year("d").alias("id")).distinct().select(
        "id", F.make_date("id", F.lit(1), F.lit(1)).alias("start_date"), F.make_date("id", F.lit(6), F.lit(30)).alias("end_date")
    )
    return J.interval_overlap(terms, years)


@query(
    "densify",
    {"code": "int", "date": "date", "close": 9, "volume": 4, "traded": "bool"},
    with_ctes("inst", "cal", extra=_DENSE) + "SELECT code, date, close, volume, traded FROM dense",
)
def densify(t):
    return J.densify(t.week, t.calendar, ["close", "volume"])


@query(
    "offset_row_join",
    {"code": "int", "date": "date", "score": 7, "entry": 9, "exit": 9},
    with_ctes("score", extra="""later AS (SELECT code, date, lead(open, 1) OVER w AS entry, lead(open, 6) OVER w AS exit FROM wk
      WINDOW w AS (PARTITION BY code ORDER BY date))""")
    + "SELECT code, date, score, entry, exit FROM score JOIN later USING (code, date)",
)
def offset_row_join(t):
    return t.score.join(J.later_prices(t.week, {"entry": 1, "exit": 6}), ["code", "date"])


@query(
    "membership_pit",
    {"code": "int", "date": "date", "close": 9},
    with_ctes("wk", extra="""iv AS (SELECT l_suppkey AS code, CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e
      FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey
      UNION ALL SELECT l_suppkey, CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
      WHERE l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY l_suppkey)""")
    + "SELECT code, date, close FROM wk WHERE EXISTS (SELECT 1 FROM iv WHERE iv.code = wk.code AND wk.date BETWEEN iv.s AND iv.e)",
)
def membership_pit(t):
    line = t.read("lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("d"), "l_returnflag")

    def span(rows):
        return rows.groupBy("code").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"))

    early = line.where((F.col("l_returnflag") == "R") & (F.col("d") < F.lit("1998-01-01").cast("date")))
    late = line.where((F.col("l_returnflag") == "A") & (F.col("d") >= F.lit("1999-01-01").cast("date")))
    return J.membership(t.week, span(early).unionByName(span(late)))


# ---- aggregations ----------------------------------------------------------------------------------------------------


@query(
    "statistics_by_code",
    {"code": "int", "trading_days": "int", "first_date": "date", "last_date": "date", "avg_close": 5, "std_close": 5,
     "total_volume": 3, "avg_turnover": 5, "avg_pct_chg": 6},
    with_ctes("quoted") + """SELECT code, count(*) AS trading_days, min(date) AS first_date, max(date) AS last_date,
      avg(close) AS avg_close, stddev_samp(close) AS std_close, sum(volume) AS total_volume, avg(volume / 100) AS avg_turnover,
      avg(pct_chg) AS avg_pct_chg FROM quoted GROUP BY code""",
)
def statistics_by_code(t):
    return A.statistics_by_code(t.quoted.withColumn("turnover_rate", F.col("volume") / 100))


@query("resample_week", BAR, with_ctes("wk") + "SELECT * FROM wk")
def resample_week(t):
    return resample(t.day, "week")


@query(
    "resample_month",
    BAR,
    with_ctes("panel_day") + """SELECT code, m AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount
      FROM (SELECT *, last_day(date) AS m FROM panel_day) q GROUP BY code, m""",
)
def resample_month(t):
    return resample(t.day, "month")


@query(
    "monthly_returns",
    {"year": "int", **{f"m{m}": 7 for m in range(1, 13)}},
    with_ctes("bench", extra="mr AS (SELECT year(date) AS y, month(date) AS m, product(1 + bench) - 1 AS r FROM bench GROUP BY 1, 2)")
    + "SELECT y AS year, " + ", ".join(f"max(CASE WHEN m = {m} THEN r END) AS m{m}" for m in range(1, 13)) + " FROM mr GROUP BY y",
)
def monthly_returns(t):
    return A.monthly_return_grid(t.benchmark, "bench")


@query(
    "score_histogram",
    {"bin": "int", "lower": 6, "upper": 6, "n": "int"},
    with_ctes("score", extra="""s AS (SELECT min(score) AS lo, max(score) AS hi,
      least(100, greatest(20, floor(count(*) / 10.0))) AS b FROM score)""")
    + """SELECT bin, min(lo) + (bin - 1) * min(hi - lo) / min(b) AS lower, min(lo) + bin * min(hi - lo) / min(b) AS upper, count(*) AS n
         FROM (SELECT least(floor((score - lo) / ((hi - lo) / b)) + 1, b) AS bin, lo, hi, b FROM score, s) q GROUP BY bin""",
)
def score_histogram(t):
    return A.histogram(t.score, "score")


@query(
    "quantile_edges",
    {"feature": "str", "q0": 5, "q1": 5, "q2": 5, "q3": 5, "q4": 5, "n_values": "int"},
    with_ctes("wk") + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, quantile_cont({c}, 0) AS q0, quantile_cont({c}, 0.25) AS q1, median({c}) AS q2,
            quantile_cont({c}, 0.8) AS q3, quantile_cont({c}, 1) AS q4, count({c}) AS n_values FROM wk"""
        for c in ("close", "volume", "amount")
    ),
)
def quantile_edges(t):
    return A.quantile_edges(t.week, ["close", "volume", "amount"], [0, 0.25, 0.5, 0.8, 1])


_SKETCH_AT = (0.0, 0.1, 0.5, 0.9, 1.0)


@query(
    "sketch_quantiles",
    {"date": "date", "n": "int", "within_bound": "bool"},
    with_ctes("wk", "cal", extra="m AS (SELECT date, count(close) AS k FROM wk GROUP BY date)")
    + "SELECT c.date, sum(m.k) AS n, true AS within_bound FROM cal c JOIN cal b ON b.idx BETWEEN c.idx - 51 AND c.idx JOIN m ON m.date = b.date GROUP BY c.date",
)
def sketch_quantiles(t):
    """A year of weeks up to each week, from one sketch per week, held against the ranks of all rows of its window."""
    calendar = t.calendar
    found = S.sketch_quantiles(S.trailing(S.sketch(t.week, ["date"], ["close"]), calendar, 52), _SKETCH_AT)
    weeks = calendar.select("date", "idx")
    windows = weeks.withColumn("at", F.explode(F.sequence(F.col("idx"), F.least(F.col("idx") + 51, F.lit(weeks.count() - 1))))).join(
        weeks.select(F.col("idx").alias("at"), F.col("date").alias("upto")), "at").select("date", "upto")
    rows = t.week.select("date", "close").join(F.broadcast(windows), "date").select(F.col("upto").alias("date"), "close")
    error = S.observed_error(rows, found, ["date"], "close", _SKETCH_AT)
    return error.select("date", "n", (F.col("error") <= S.rank_error(many=True)).alias("within_bound"))


@query(
    "distinct_dates",
    {"n_dates": "int", "first_date": "date", "last_date": "date"},
    with_ctes("panel_day") + "SELECT count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM panel_day",
)
def distinct_dates(t):
    return A.distinct_dates(t.day)


@query(
    "market_snapshot",
    {"code": "int", "name": "str", "pct_chg": 6},
    with_ctes("quoted") + """SELECT code, name, pct_chg FROM quoted WHERE date = DATE '1998-06-05' AND NOT contains(name, 'ST')
      ORDER BY pct_chg DESC NULLS LAST, code LIMIT 20""",
)
def market_snapshot(t):
    return A.market_snapshot(FL.with_flags(t.quoted), "1998-06-05", 20)


# ---- sorts, set operations, scalar functions -------------------------------------------------------------------------


@query(
    "sort_multi",
    {"code": "int", "date": "date", "amount": 3},
    with_ctes("wk") + "SELECT code, date, amount FROM wk ",
)
def sort_multi(t):
    return t.week.select("code", "date", "amount").orderBy(F.desc("amount"), "code", "date")


@query(
    "rank_sort_nulls",
    {"code": "int", "date": "date", "pct_chg": 6, "place": "int"},
    with_ctes("quoted") + """SELECT code, date, pct_chg, row_number() OVER (PARTITION BY date ORDER BY pct_chg DESC NULLS LAST, code) AS place
      FROM quoted""",
)
def rank_sort_nulls(t):
    from factorframe.operators.ordering import row_numbers

    rows = t.quoted.select("code", "date", "pct_chg")
    return row_numbers(rows, ["date"], [F.col("pct_chg").isNull(), -F.col("pct_chg"), F.col("code")], "place")


@query(
    "union_by_name",
    {"code": "int", "date": "date", "close": 9, "score": 7},
    with_ctes("wk", "score") + "SELECT code, date, close, NULL AS score FROM wk UNION ALL SELECT code, date, NULL, score FROM score",
)
def union_by_name(t):
    return t.week.select("code", "date", "close").unionByName(t.score, allowMissingColumns=True)


@query(
    "calendar_union",
    {"date": "date"},
    with_ctes("panel_day") + "SELECT DISTINCT date FROM panel_day UNION SELECT CAST(o_orderdate AS DATE) FROM orders",
)
def calendar_union(t):
    return t.day.select("date").union(t.read("orders").select(F.col("o_orderdate").cast("date"))).distinct()


@query(
    "set_diff",
    {"code": "int", "date": "date"},
    with_ctes("score", "score2") + "SELECT code, date FROM score2 EXCEPT SELECT code, date FROM score WHERE score > 0",
)
def set_diff(t):
    return t.score2.select("code", "date").subtract(t.score.where(F.col("score") > 0).select("code", "date"))


@query(
    "set_intersect",
    {"code": "int", "date": "date"},
    with_ctes("score", "score2") + "SELECT code, date FROM score2 INTERSECT SELECT code, date FROM score WHERE score > 0",
)
def set_intersect(t):
    return t.score2.select("code", "date").intersect(t.score.where(F.col("score") > 0).select("code", "date"))


@query(
    "string_functions",
    {"code": "int", "padded": "str", "lowered": "str", "stripped": "str", "has": "bool", "starts": "bool"},
    """SELECT p_partkey AS code, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, lower(p_brand) AS lowered,
              regexp_replace(p_brand, '^Brand#', '') AS stripped, contains(p_name, 'red') AS has, starts_with(p_type, 'ECO') AS starts
       FROM part""",
)
def string_functions(t):
    return t.read("part").select(
        F.col("p_partkey").alias("code"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
        F.lower("p_brand").alias("lowered"), F.regexp_replace("p_brand", "^Brand#", "").alias("stripped"),
        F.contains(F.col("p_name"), F.lit("red")).alias("has"), F.col("p_type").startswith("ECO").alias("starts"),
    )


@query(
    "date_functions",
    {"id": "int", "text": "str", "next_month": "date", "half_year": "date", "scaled": "date", "y": "int", "m": "int"},
    """SELECT o_orderkey AS id, strftime(d, '%Y%m%d') AS text, CAST(d + INTERVAL 1 MONTH AS DATE) AS next_month,
              CAST(d + INTERVAL 6 MONTH AS DATE) AS half_year, CAST(d + CAST(floor((o_orderkey % 60) * 7 / 5) AS INTEGER) AS DATE) AS scaled,
              year(d) AS y, month(d) AS m FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) q""",
)
def date_functions(t):
    d = F.col("o_orderdate").cast("date")
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"), F.date_format(d, "yyyyMMdd").alias("text"), F.add_months(d, 1).alias("next_month"),
        F.add_months(d, 6).alias("half_year"), F.date_add(d, F.floor((F.col("o_orderkey") % 60) * 7 / 5).cast("int")).alias("scaled"),
        F.year(d).alias("y"), F.month(d).alias("m"),
    )


@query(
    "math_functions",
    {"code": "int", "date": "date", "ln_amount": 6, "root": 5, "clipped": 6, "sign": "int"},
    with_ctes("quoted") + """SELECT code, date, ln(amount) AS ln_amount, sqrt(volume) AS root, greatest(-10, least(10, pct_chg)) AS clipped,
      CAST(sign(pct_chg) AS BIGINT) AS sign FROM quoted WHERE pct_chg IS NOT NULL""",
)
def math_functions(t):
    return t.quoted.where(F.col("pct_chg").isNotNull()).select(
        "code", "date", F.log("amount").alias("ln_amount"), F.sqrt("volume").alias("root"),
        F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("pct_chg"))).alias("clipped"), F.sign("pct_chg").alias("sign"),
    )


@query(
    "json_map_array",
    {"event_type": "str", "n": "int", "k_sum": "int", "first_ids": "str"},
    """SELECT event_type, count(*) AS n, sum(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)) AS k_sum,
              array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 5), ',') AS first_ids FROM events GROUP BY event_type""",
)
def json_map_array(t):
    """Parse a JSON snapshot and keep a short sample list; the list is built from a bounded set, not a whole group."""
    from factorframe.operators.ordering import first_k

    e = t.read("events").withColumn("k", F.from_json("props", "k bigint").k)
    sums = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))
    sample = first_k(e.select("event_type", "event_id"), ["event_type"], [F.col("event_id")], 5).groupBy("event_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("first_ids")
    )
    return sums.join(sample, "event_type")


@query(
    "parse_label",
    {"code": "int", "kind": "str", "horizon": "int"},
    """SELECT code, CASE WHEN regexp_matches(name, '^(ret|xs_ret|alpha|up_down)_(\\d+)d$')
                THEN regexp_extract(name, '^(ret|xs_ret|alpha|up_down)_(\\d+)d$', 1) ELSE 'ret' END AS kind,
              CASE WHEN regexp_matches(name, '^(ret|xs_ret|alpha|up_down)_(\\d+)d$')
                THEN CAST(regexp_extract(name, '^(ret|xs_ret|alpha|up_down)_(\\d+)d$', 2) AS BIGINT) ELSE 20 END AS horizon
       FROM (SELECT p_partkey AS code, (CASE p_size % 5 WHEN 0 THEN 'ret' WHEN 1 THEN 'xs_ret' WHEN 2 THEN 'alpha' WHEN 3 THEN 'up_down'
                    ELSE 'other' END) || '_' || CAST(p_size AS VARCHAR) || 'd' AS name FROM part) q""",
)
def parse_label(t):
    kinds = F.array(*[F.lit(k) for k in ("ret", "xs_ret", "alpha", "up_down", "other")])
    name = F.concat(F.element_at(kinds, F.col("p_size") % 5 + 1), F.lit("_"), F.col("p_size").cast("string"), F.lit("d"))
    kind, horizon = parse_label_columns(name)
    return t.read("part").select(F.col("p_partkey").alias("code"), kind.alias("kind"), horizon.alias("horizon"))
