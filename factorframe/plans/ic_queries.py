"""Information-coefficient and significance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators import ic as IC
from factorframe.operators import significance as T
from factorframe.operators.labels import forward_return, quantile_grades
from factorframe.plans.registry import query
from factorframe.plans.sql import ICIR_COLUMNS, sql_icir, sql_newey_west, sql_normal_cdf, sql_rank_ic
from factorframe.plans.testbed import with_ctes
from factorframe.session import materialize

FACTORS = ("roc_5", "ma_5", "std_5", "vroc_5", "illiq", "klen", "kmid", "max_10", "min_10", "vma_10")

# Ten factors and a label per row, as SQL
FACTOR_CTE = """fx AS MATERIALIZED (
  SELECT code, date, close / lag(close, 5) OVER w - 1 AS roc_5,
         CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 / close END AS ma_5,
         CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS std_5,
         volume / lag(volume, 5) OVER w - 1 AS vroc_5, abs(ret) / nullif(volume, 0) AS illiq,
         (high - low) / open AS klen, (close - open) / open AS kmid,
         CASE WHEN count(close) OVER w10 = 10 THEN max(close) OVER w10 / close - 1 END AS max_10,
         CASE WHEN count(close) OVER w10 = 10 THEN min(close) OVER w10 / close - 1 END AS min_10,
         CASE WHEN count(volume) OVER w10 = 10 THEN avg(volume) OVER w10 END AS vma_10,
         lead(close, 4) OVER w / lead(close, 1) OVER w - 1 AS label
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret FROM wk) t
  WINDOW w AS (PARTITION BY code ORDER BY date), w5 AS (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w10 AS (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
fl AS MATERIALIZED (
  UNPIVOT (SELECT * FROM fx WHERE label IS NOT NULL) ON """ + ", ".join(FACTORS) + " INTO NAME feature VALUE value)"


def factor_frame(t):
    """The ten factors and the label: two window passes over one exchange, written once for the branches and callers that read them."""
    if "factor_frame" in t.__dict__:
        return t.__dict__["factor_frame"]
    base = t.week.withColumn("ret", R.pct_change("close", 1))
    t.__dict__["factor_frame"] = materialize(base.select(
        "code",
        "date",
        R.pct_change("close", 5).alias("roc_5"),
        (R.mean("close", 5) / F.col("close")).alias("ma_5"),
        R.std("ret", 5).alias("std_5"),
        R.pct_change("volume", 5).alias("vroc_5"),
        F.try_divide(F.abs("ret"), F.col("volume")).alias("illiq"),
        ((F.col("high") - F.col("low")) / F.col("open")).alias("klen"),
        ((F.col("close") - F.col("open")) / F.col("open")).alias("kmid"),
        (R.highest("close", 10) / F.col("close") - 1).alias("max_10"),
        (R.lowest("close", 10) / F.col("close") - 1).alias("min_10"),
        R.mean("volume", 10).alias("vma_10"),
        forward_return("close", 4).alias("label"),
    ))
    return t.__dict__["factor_frame"]


@query("daily_rank_ic", {"date": "date", "ic": 8, "n": "int"}, with_ctes("ic") + "SELECT * FROM ic")
def daily_rank_ic(t):
    return IC.daily_rank_ic(t.scored)


@query(
    "rank_ic_pooled",
    {"industry": "str", "ic": 8, "n": "int"},
    with_ctes("sl", "industry", extra="j AS (SELECT * FROM sl JOIN industry USING (code))")
    + f"SELECT * FROM {sql_rank_ic('j', 'industry', min_names=10)} q",
)
def rank_ic_pooled(t):
    return IC.pooled_rank_ic(t.scored.join(t.industry, "code"), ["industry"])


@query(
    "daily_ic",
    {"date": "date", "ic": 8, "n": "int"},
    with_ctes("sl") + """SELECT date, corr(score, label) AS ic, count(*) AS n FROM sl GROUP BY date
                         HAVING count(*) >= 3 AND isfinite(corr(score, label))""",
)
def daily_ic(t):
    return IC.daily_ic(t.scored)


@query("icir_summary", ICIR_COLUMNS, with_ctes("ic") + f"SELECT * FROM {sql_icir('ic', lags='4')} q")
def icir_summary(t):
    return IC.icir_summary(IC.daily_rank_ic(t.scored), max_lags=4)


_DECAY = with_ctes(
    "score",
    extra=f"""h AS MATERIALIZED (
      SELECT code, date, horizon, lead(close, CAST(horizon AS INTEGER)) OVER w / lead(close, 1) OVER w - 1 AS label
      FROM (SELECT * FROM wk CROSS JOIN (VALUES (5), (10), (20), (60)) v(horizon)) x
      WINDOW w AS (PARTITION BY code, horizon ORDER BY date)),
    p AS MATERIALIZED (SELECT horizon, date, score, label FROM score JOIN h USING (code, date) WHERE label IS NOT NULL),
    hic AS MATERIALIZED (SELECT * FROM {sql_rank_ic('p', 'horizon, date', min_names=11)} q)""",
)


@query(
    "ic_decay",
    {"horizon": "int", **ICIR_COLUMNS},
    _DECAY + f"SELECT * FROM {sql_icir('hic', by='horizon', lags='horizon')} q WHERE n_days >= 5",
)
def ic_decay(t):
    return IC.ic_decay(t.week, -R.pct_change("close", 4))


@query(
    "stratified_ic_cat",
    {"industry": "str", "ic": 8, "n": "int"},
    with_ctes("sl", "industry", extra="j AS (SELECT * FROM sl JOIN industry USING (code))")
    + f"SELECT * FROM {sql_rank_ic('j', 'industry', min_names=11)} q",
)
def stratified_ic_cat(t):
    return IC.stratified_ic(t.scored.join(t.industry, "code"), "industry")


@query(
    "stratified_ic_num",
    {"grade": "int", "ic": 8, "n": "int"},
    with_ctes(
        "sl",
        extra="""s AS (SELECT sl.*, ln(amount) AS size FROM sl JOIN wk USING (code, date)),
        e AS (SELECT quantile_cont(size, 0.2) a, quantile_cont(size, 0.4) b, quantile_cont(size, 0.6) c,
                     quantile_cont(size, 0.8) d FROM s),
        g AS (SELECT score, label, CASE WHEN size <= a THEN 0 WHEN size <= b THEN 1 WHEN size <= c THEN 2
                                        WHEN size <= d THEN 3 ELSE 4 END AS grade FROM s, e)""",
    )
    + f"SELECT * FROM {sql_rank_ic('g', 'grade', min_names=11)} q",
)
def stratified_ic_num(t):
    pairs = t.week.select(
        F.log("amount").alias("size"),
        (-R.pct_change("close", 4)).alias("score"),
        forward_return("close", 4).alias("label"),
    )
    return IC.stratified_ic_numeric(pairs, "size")


@query(
    "ic_autocorrelation",
    {"lag": "int", "autocorrelation": 7},
    with_ctes("ic", extra="""s AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ic)""")
    + """SELECT b.i - a.i AS lag, corr(a.ic, b.ic) AS autocorrelation FROM s a JOIN s b ON b.i - a.i BETWEEN 1 AND 20
         WHERE (SELECT count(*) FROM s) >= 40 GROUP BY b.i - a.i""",
)
def ic_autocorrelation(t):
    return IC.autocorrelation(IC.daily_rank_ic(t.scored), "ic", 20)


_FACTOR_IC = with_ctes("wk", extra=FACTOR_CTE + f""",
fic AS MATERIALIZED (SELECT * FROM {sql_rank_ic('fl', 'feature, date', 'value')} q)""")


@query("factor_ic", {"feature": "str", "date": "date", "ic": 7, "n": "int"}, _FACTOR_IC + "SELECT * FROM fic")
def factor_ic(t):
    return IC.factor_ic(factor_frame(t), FACTORS)


@query("factor_ic_table", {"feature": "str", **ICIR_COLUMNS}, _FACTOR_IC + f"SELECT * FROM {sql_icir('fic', 'feature', '4')} q")
def factor_ic_table(t):
    return IC.factor_ic_table(factor_frame(t), FACTORS, max_lags=4)


@query(
    "direction_accuracy",
    {"date": "date", "accuracy": 8, "n": "int"},
    with_ctes("sl", extra="m AS (SELECT date, median(score) AS med FROM sl GROUP BY date)")
    + """SELECT date, avg(CASE WHEN (score > med) = (label > 0) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
         FROM sl JOIN m USING (date) GROUP BY date HAVING count(*) >= 10""",
)
def direction_accuracy(t):
    return IC.direction_accuracy(t.scored)


@query(
    "ensemble_mean",
    {"date": "date", "code": "int", "score": 7, "n_models": "int"},
    with_ctes("score", "score2")
    + """SELECT date, code, avg(score) AS score, count(*) AS n_models
         FROM (SELECT * FROM score UNION ALL SELECT * FROM score2) u GROUP BY date, code HAVING count(*) >= 2""",
)
def ensemble_mean(t):
    return IC.ensemble_mean([t.score, t.score2])


_GRADED = """
g0 AS (SELECT date, quantile_cont(label, 0.2) a, quantile_cont(label, 0.4) b, quantile_cont(label, 0.6) c,
              quantile_cont(label, 0.8) d, count(*) AS n FROM sl GROUP BY date),
g AS (SELECT sl.*, CASE WHEN n < 5 THEN 2 WHEN label <= a THEN 0 WHEN label <= b THEN 1 WHEN label <= c THEN 2
                        WHEN label <= d THEN 3 ELSE 4 END AS grade FROM sl JOIN g0 USING (date))"""


@query(
    "ndcg_at_k",
    {"date": "date", "ndcg": 7},
    with_ctes("sl", extra=_GRADED)
    + """SELECT date, CASE WHEN ideal > 0 THEN dcg / ideal END AS ndcg FROM (
           SELECT date, sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(1 + i) END) AS dcg,
                  sum(CASE WHEN j <= 5 THEN (pow(2, grade) - 1) / log2(1 + j) END) AS ideal
           FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS i,
                        row_number() OVER (PARTITION BY date ORDER BY grade DESC, code) AS j FROM g) r
           GROUP BY date) q""",
)
def ndcg_at_k(t):
    return IC.ndcg_at_k(quantile_grades(t.scored, ["date"], "label"), 5)


NW_COLUMNS = {"n_samples": "int", "mean": 7, "std": 7, "lags": "int", "nw_se": 8, "t_naive": 5, "t_nw": 5, "p_naive": 5,
              "p_nw": 5, "significant": "bool"}


@query("newey_west", {"feature": "str", **NW_COLUMNS}, _FACTOR_IC + f"SELECT * FROM {sql_newey_west('fic', 'ic', 'feature')} q")
def newey_west(t):
    return T.newey_west(IC.factor_ic(factor_frame(t), FACTORS), "ic", ["feature"])


@query(
    "normal_cdf",
    {"date": "date", "code": "int", "z": 6, "p": 6},
    with_ctes("score", extra="s AS (SELECT date, avg(score) m, stddev_samp(score) d FROM score GROUP BY date)")
    + f"""SELECT date, code, z, {sql_normal_cdf('z')} AS p
          FROM (SELECT date, code, (score - m) / d AS z FROM score JOIN s USING (date) WHERE d > 0) q""",
)
def normal_cdf(t):
    from factorframe.operators.normalize import cs_zscore

    return cs_zscore(t.score, ["score"]).where(F.col("score").isNotNull()).select(
        "date", "code", F.col("score").alias("z"), T.normal_cdf("score").alias("p")
    )


# One exploratory test per industry and direction: the family whose p values get corrected
_FAMILY = with_ctes(
    "sl", "industry",
    extra=f"""j AS (SELECT * FROM sl JOIN industry USING (code)),
    jic AS MATERIALIZED (SELECT industry, date, corr(score, label) AS ic, count(*) AS n FROM j GROUP BY industry, date
        HAVING count(*) >= 3 AND isfinite(corr(score, label))),
    fam AS MATERIALIZED (SELECT industry, p_nw AS p FROM {sql_newey_west('jic', 'ic', 'industry')} q)""",
)


def test_family(t):
    ic = IC.daily_ic(t.scored.join(t.industry, "code"), ["industry", "date"])
    return T.newey_west(ic, "ic", ["industry"]).select("industry", F.col("p_nw").alias("p"))


ADJUSTED = {"industry": "str", "p": 5, "p_adjusted": 5, "threshold": 7, "significant": "bool"}


@query(
    "bonferroni",
    ADJUSTED,
    _FAMILY + """SELECT industry, p, least(p * m, 1.0) AS p_adjusted, 0.05 / m AS threshold, least(p * m, 1.0) < 0.05 AS significant
                 FROM (SELECT *, count(*) OVER () AS m FROM fam) q""",
)
def bonferroni(t):
    return T.bonferroni(test_family(t))


_BH = """SELECT industry, p, least(adj, 1.0) AS p_adjusted, 0.05 AS threshold, least(adj, 1.0) < 0.05 AS significant FROM (
           SELECT a.industry, a.p, min(b.s) AS adj
           FROM (SELECT *, row_number() OVER (ORDER BY p, industry) AS r FROM fam) a
           JOIN (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, industry) AS s,
                        row_number() OVER (ORDER BY p, industry) AS r FROM fam) b ON b.r >= a.r
           GROUP BY a.industry, a.p) q"""


@query("fdr_bh", ADJUSTED, _FAMILY + _BH)
def fdr_bh(t):
    return T.benjamini_hochberg(test_family(t), tie="industry")


@query(
    "paired_ic_test",
    {"n_common": "int", "mean_a": 7, "mean_b": 7, "diff_p": 5, "diff_significant": "bool", "winner": "str", "verdict": "str"},
    with_ctes("ic", "ic2", extra="""d AS MATERIALIZED (SELECT date, a.ic - b.ic AS x FROM ic a JOIN ic2 b USING (date))""")
    + f"""SELECT n_samples AS n_common, ma AS mean_a, mb AS mean_b, CASE WHEN n_samples > 20 THEN p_nw END AS diff_p,
                 CASE WHEN n_samples > 20 THEN significant END AS diff_significant,
                 CASE WHEN ma > mb THEN 'reversal' ELSE 'volume' END AS winner,
                 CASE WHEN n_samples > 20 AND significant THEN 'significant' ELSE 'not significant' END AS verdict
          FROM {sql_newey_west('d', 'x')} nw, (SELECT avg(ic) AS ma FROM ic) q1, (SELECT avg(ic) AS mb FROM ic2) q2""",
)
def paired_ic_test(t):
    return T.paired_test(IC.daily_rank_ic(t.scored), IC.daily_rank_ic(t.scored2), "reversal", "volume")
