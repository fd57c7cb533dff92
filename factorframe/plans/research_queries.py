"""Experiment control, modelling and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorframe.functions import rolling as R
from factorframe.operators import crossval as C
from factorframe.operators import experiments as E
from factorframe.operators import linear as L
from factorframe.operators import modelling as M
from factorframe.operators import regime as G
from factorframe.operators import drift as D
from factorframe.operators.drift import importance_stability
from factorframe.operators.ic import icir_summary, daily_rank_ic
from factorframe.operators.labels import forward_return
from factorframe.plans.factor_queries import index_close
from factorframe.plans.ic_queries import ADJUSTED, FACTOR_CTE, FACTORS, _BH, _FAMILY, factor_frame, test_family
from factorframe.plans.monitor_queries import _FOLDS as FOLDS_CTE
from factorframe.plans.monitor_queries import _LONG as PSI_CTE
from factorframe.plans.monitor_queries import _REGIME as REGIME_CTE
from factorframe.plans.monitor_queries import SPLIT, _RAW, faulty_bars
from factorframe.plans.panel_queries import BAR, scratch
from factorframe.plans.portfolio_queries import styles, targets
from factorframe.plans.registry import query
from factorframe.plans.sql import ICIR_COLUMNS, sql_icir, sql_rank_ic, sql_ranks, sql_score, sql_solved, sql_system
from factorframe.plans.testbed import with_ctes
from factorframe.session import materialize
from factorframe.sources import writers as OUT
from factorframe.sources.panel import trade_calendar
from factorframe.streaming import bars as Z

# ---- sinks that need derived results ---------------------------------------------------------------------------------


@query("write_picks", {"date": "date", "code": "int", "rank": "int", "n_picks": "int"},
       with_ctes("tgt") + "SELECT date, code, rank, count(*) OVER (PARTITION BY date) AS n_picks FROM tgt")
def write_picks(t):
    folder = scratch(t.spark)
    OUT.write_picks(targets(t), folder, "reversal", {"k": "10"})
    picks = t.spark.read.option("header", True).schema("code bigint, date date, score double, rank int").csv(f"{folder}/picks")
    meta = t.spark.read.schema("date string, n_picks bigint, model_id string").json(f"{folder}/meta")
    return picks.join(meta.select(F.to_date("date", "yyyyMMdd").alias("date"), "n_picks"), "date")


def experiment_records(t):
    """One exploration record per industry, with the p value of its IC."""
    return test_family(t).select(
        F.lit("1995-01-01T00:00:00").alias("timestamp"), F.lit("exploration").alias("phase"), F.col("industry").alias("description"),
        F.lit("").alias("recorder_id"), F.array(F.lit("1995-01-01"), F.lit("2001-12-31")).alias("test_data_range"),
        F.create_map(F.lit("label"), F.lit("ret_4d")).alias("config_summary"), F.create_map(F.lit("nw_p_value"), F.col("p")).alias("metrics"),
    )


@query("read_experiments", {"phase": "str", "description": "str", "p": 5, "range_start": "str"},
       _FAMILY + "SELECT 'exploration' AS phase, industry AS description, p, '1995-01-01' AS range_start FROM fam")
def read_experiments(t):
    folder = scratch(t.spark)
    OUT.append_experiments(experiment_records(t), folder)
    return OUT.read_experiments(t.spark, folder).select(
        "phase", "description", F.col("metrics")["nw_p_value"].alias("p"), F.col("test_data_range")[0].alias("range_start")
    )


# ---- experiment control ----------------------------------------------------------------------------------------------

_LOG = """lg AS (SELECT o_custkey AS project, CASE WHEN o_orderpriority = '1-URGENT' THEN 'confirmation' ELSE 'exploration' END AS phase,
  CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e FROM orders),
pc AS (SELECT project, count(CASE WHEN phase = 'exploration' THEN 1 END) AS n_exploration,
  count(CASE WHEN phase = 'confirmation' THEN 1 END) AS n_confirmation FROM lg GROUP BY project),
ov AS (SELECT a.project, count(*) AS k FROM lg a JOIN lg b ON a.project = b.project AND a.phase = 'exploration' AND b.phase = 'confirmation'
  AND a.s <= b.e AND b.s <= a.e JOIN pc ON pc.project = a.project AND n_confirmation = 1 GROUP BY a.project)"""


def project_log(t):
    d = F.col("o_orderdate").cast("date")
    return t.read("orders").select(
        F.col("o_custkey").alias("project"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "confirmation").otherwise("exploration").alias("phase"),
        d.alias("start_date"), F.date_add(d, 30).alias("end_date"),
    )


@query("experiment_counts", {"project": "int", "n_exploration": "int", "n_confirmation": "int"}, f"WITH {_LOG} SELECT * FROM pc")
def experiment_counts(t):
    return E.experiment_counts(project_log(t), ["project"])


@query(
    "protocol_check",
    {"project": "int", "n_overlaps": "int", "ok": "bool", "message": "str"},
    f"""WITH {_LOG} SELECT project, coalesce(k, 0) AS n_overlaps, n_confirmation <= 1 AND coalesce(k, 0) = 0 AS ok,
        CASE WHEN n_confirmation > 1 THEN 'more than one confirmation' WHEN coalesce(k, 0) > 0 THEN 'test ranges overlap' ELSE 'ok' END AS message
        FROM pc LEFT JOIN ov USING (project)""",
)
def protocol_check(t):
    return E.protocol_check(project_log(t), ["project"])


@query("corrected_significance", {**{k: v for k, v in ADJUSTED.items() if k != "industry"}, "description": "str"},
       _FAMILY + f"SELECT industry AS description, p, p_adjusted, threshold, significant FROM ({_BH}) z")
def corrected_significance(t):
    return E.corrected_significance(experiment_records(t), "fdr_bh")


_VARIANTS = with_ctes("sl", "sl2", extra=f"""v AS (SELECT sl.date, label, 'reversal' AS variant, sl.score FROM sl JOIN sl2 USING (code, date, label)
      UNION ALL SELECT sl2.date, label, 'volume', sl2.score FROM sl JOIN sl2 USING (code, date, label)
      UNION ALL SELECT sl2.date, label, 'blend', sl.score + sl2.score / 10 FROM sl JOIN sl2 USING (code, date, label)),
      vic AS MATERIALIZED (SELECT * FROM {sql_rank_ic('v', 'variant, date')} q)""")


def variants(t):
    rows = t.week.select(
        "date", forward_return("close", 4).alias("label"), (-R.pct_change("close", 4)).alias("reversal"),
        F.try_divide(R.mean("volume", 8), F.col("volume")).alias("volume"),
    )
    return rows.where(F.col("reversal").isNotNull() & F.col("volume").isNotNull()).withColumn("blend", F.col("reversal") + F.col("volume") / 10)


@query(
    "compare_variants",
    {"variant": "str", **ICIR_COLUMNS, "winner": "bool"},
    _VARIANTS + f"SELECT *, icir = max(icir) OVER () AS winner FROM {sql_icir('vic', 'variant', '4')} q",
)
def compare_variants(t):
    return E.compare_variants(variants(t), ["reversal", "volume", "blend"], max_lags=4)


@query(
    "compare_experiments",
    {"experiment": "str", "variant": "str", **ICIR_COLUMNS, "winner": "bool"},
    _VARIANTS + f"""SELECT m.experiment, q.*, row_number() OVER (PARTITION BY m.experiment ORDER BY icir DESC NULLS LAST, variant) = 1 AS winner
      FROM {sql_icir('vic', 'variant', '4')} q JOIN (VALUES ('E1 single', 'reversal'), ('E1 single', 'volume'), ('E2 blend', 'reversal'), ('E2 blend', 'blend'),
        ('E3 all', 'reversal'), ('E3 all', 'volume'), ('E3 all', 'blend')) m(experiment, variant) USING (variant)""",
)
def compare_experiments(t):
    groups = {"E1 single": ["reversal", "volume"], "E2 blend": ["reversal", "blend"], "E3 all": ["reversal", "volume", "blend"]}
    return E.compare_experiments(variants(t), groups, max_lags=4)


@query(
    "param_sweep",
    {"k": "int", "mean_return": 6, "best": "bool"},
    with_ctes("score", "label", extra="""r AS (SELECT s.date, label, row_number() OVER (PARTITION BY s.date ORDER BY score DESC, s.code) AS rank
      FROM score s LEFT JOIN label l ON l.code = s.code AND l.date = s.date),
      g AS (SELECT k, date, avg(label) AS x FROM r JOIN (VALUES (5), (10), (20)) v(k) ON rank <= k WHERE label IS NOT NULL GROUP BY k, date),
      m AS (SELECT k, avg(x) AS mean_return FROM g GROUP BY k)""") + "SELECT *, mean_return = max(mean_return) OVER () AS best FROM m",
)
def param_sweep(t):
    from factorframe.operators.labels import label_returns

    returns = label_returns(t.week, 4).where(F.col("label").isNotNull()).withColumnRenamed("label", "ret")
    return E.sweep_top_k(t.score, returns, [5, 10, 20])


_WINDOWS = tuple(range(2, 22))


@query(
    "sweep_windows",
    {"length": "int", **ICIR_COLUMNS, "best": "bool"},
    with_ctes("wk", extra="l AS (SELECT *, lead(close, 4) OVER w / lead(close, 1) OVER w - 1 AS label FROM wk WINDOW w AS (PARTITION BY code ORDER BY date)), sw AS ("
              + " UNION ALL ".join(f"""SELECT {n} AS length, date, label, -(close / m - 1) AS score FROM (SELECT date, label, close,
      CASE WHEN count(close) OVER w = {n} THEN avg(close) OVER w END AS m FROM l WINDOW w AS (PARTITION BY code ORDER BY date ROWS {n - 1} PRECEDING)) q
      WHERE label IS NOT NULL AND m IS NOT NULL""" for n in _WINDOWS)
              + f"), wic AS MATERIALIZED (SELECT * FROM {sql_rank_ic('sw', 'length, date')} q)")
    + f"SELECT *, icir = max(icir) OVER () AS best FROM {sql_icir('wic', 'length', '4')} q",
)
def sweep_windows(t):
    return E.sweep_windows(t.week, "close", _WINDOWS, forward_return("close", 4), 4)


_TABLES = with_ctes("wk", "sl", "ic", "bench", extra=FACTOR_CTE + ",\n" + PSI_CTE + ",\n" + REGIME_CTE)


@query(
    "write_report_tables",
    {"report": "str", "row": "str", "measure": "str", "value": 6},
    _TABLES + """SELECT 'ic' AS report, strftime(date, '%Y-%m-%d') AS "row", 'ic' AS measure, ic AS value FROM ic
      UNION ALL SELECT 'psi', feature, 'psi', psi FROM pt
      UNION ALL SELECT 'regimes', regime, 'ic_mean', avg(ic) FROM ic JOIN rg USING (date) GROUP BY regime HAVING count(*) > 5
      UNION ALL SELECT 'regimes', regime, 'n_days', count(*) FROM ic JOIN rg USING (date) GROUP BY regime HAVING count(*) > 5""",
)
def write_report_tables(t):
    """IC, drift and regime tables written as CSV and JSON in one folder, and read back."""
    folder = scratch(t.spark)
    ic = daily_rank_ic(t.keep("week").scored)
    rows = factor_frame(t).drop("label")
    cut = F.lit(SPLIT).cast("date")
    drift = D.psi_table(rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut), FACTORS)
    regimes = G.regime_ic(ic, G.classify_regime(index_close(t), 12, 12))
    OUT.write_report({"ic": ic, "psi": drift}, folder, "csv")
    OUT.write_report({"regimes": regimes}, folder, "json")
    back = [
        OUT.read_report(t.spark, f"{folder}/ic", "date", ["ic"], "csv"),
        OUT.read_report(t.spark, f"{folder}/psi", "feature", ["psi"], "csv"),
        OUT.read_report(t.spark, f"{folder}/regimes", "regime", ["ic_mean", "n_days"], "json"),
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


# ---- modelling -------------------------------------------------------------------------------------------------------

_MODEL_FEATURES = ("roc_5", "ma_5", "std_5", "vroc_5", "klen", "kmid", "max_10", "min_10")


def _periods():
    d = F.col("date")

    def before(text):
        return d < F.lit(text).cast("date")

    return before("1999-01-01"), ~before("1999-01-01") & before("2000-01-01"), ~before("2000-01-01")


def model_rows(t):
    return factor_frame(t).na.drop(subset=[*_MODEL_FEATURES, "label"])


_FIT_ROWS = FACTOR_CTE + f""",
mr AS MATERIALIZED (SELECT * FROM fx WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*_MODEL_FEATURES, 'label'))})"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "train_score",
    {"code": "int", "date": "date", "label": 6, "score": 6},
    recursive(with_ctes("wk", extra=_FIT_ROWS + f""",
      sy AS (SELECT *, list_transform(m, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = j THEN x + 0.01 ELSE x END)) AS m1
        FROM {sql_system("(SELECT *, 0 AS g FROM mr WHERE date < DATE '1999-01-01')", 'g', _MODEL_FEATURES, 'label')} q),
      s0 AS (SELECT g, n, mean, dev, m1 AS m, list_transform(range({len(_MODEL_FEATURES)}), lambda x: true) AS allowed FROM sy),
      {sql_solved('fit', 's0', 'g', len(_MODEL_FEATURES))}"""))
    + f"SELECT code, date, label, {sql_score(_MODEL_FEATURES)} AS score FROM mr, fit WHERE date >= DATE '2000-01-01'",
)
def train_score(t):
    train, _, test = _periods()
    return L.ridge_train_score(model_rows(t), _MODEL_FEATURES, train, test, penalty=0.01)


@query("train_score_boosting", {"n_days": "int", "ic_mean": 6, "icir": 6})
def train_score_boosting(t):
    train, _, test = _periods()
    scored = M.train_score(model_rows(t), _MODEL_FEATURES, train, test, kind="boosting", maxIter=5, maxDepth=4)
    return icir_summary(daily_rank_ic(scored), max_lags=4)


@query("feature_importance", {"feature": "str", "importance": 6})
def feature_importance(t):
    train, _, _ = _periods()
    model = M.fit_model(model_rows(t).where(train), _MODEL_FEATURES, kind="boosting", maxIter=5, maxDepth=4)
    return M.feature_importance(model, _MODEL_FEATURES, t.spark)


@query("grid_search_models", {"trial": "int", "params": "str", "ic_mean": 6, "icir": 6, "best": "bool"})
def grid_search_models(t):
    train, valid, _ = _periods()
    grid = [{"kind": "linear", "regParam": 0.001}, {"kind": "linear", "regParam": 1.0}, {"kind": "boosting", "maxIter": 3, "maxDepth": 3}]
    return M.grid_search(model_rows(t), _MODEL_FEATURES, train, valid, grid)


_PENALTIES = (0.001, 0.1, 10.0)
_SUBSETS = (_MODEL_FEATURES, ("roc_5", "ma_5", "std_5", "max_10", "min_10"), ("vroc_5", "klen", "kmid"))
_TRIALS = ", ".join(
    f"({s * len(_PENALTIES) + i}, {p}, {s}, [{', '.join(str(f in subset).lower() for f in _MODEL_FEATURES)}])"
    for s, subset in enumerate(_SUBSETS) for i, p in enumerate(_PENALTIES))
# every fold and trial fitted on the fold's train dates, and the rank IC of each on its test dates
_SEARCH = recursive(with_ctes("wk", "cal", extra=FOLDS_CTE + ", " + _FIT_ROWS + f""",
  tr(trial, penalty, subset, allowed) AS (VALUES {_TRIALS}),
  sy AS MATERIALIZED {sql_system("(SELECT mr.*, fold FROM mr JOIN sp ON sp.date = mr.date AND role = 'train')", 'fold', _MODEL_FEATURES, 'label')},
  s0 AS (SELECT fold, trial, n, mean, dev, allowed,
      list_transform(m, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = j THEN x + penalty ELSE x END)) AS m FROM sy, tr),
  {sql_solved('fit', 's0', 'fold, trial', len(_MODEL_FEATURES))},
  fs AS (SELECT trial, mr.date, label, {sql_score(_MODEL_FEATURES)} AS score
    FROM mr JOIN sp ON sp.date = mr.date AND role = 'test' JOIN fit ON fit.fold = sp.fold),
  tic AS MATERIALIZED (SELECT * FROM {sql_rank_ic('fs', 'trial, date')} q)"""))


def _search_inputs(t):
    calendar = trade_calendar(factor_frame(t))  # written once, with every date of the weekly panel
    return model_rows(t), _MODEL_FEATURES, materialize(C.purged_kfold(calendar, 5, 20)), L.trial_table(t.spark, _MODEL_FEATURES, _PENALTIES, _SUBSETS)


@query(
    "grid_search",
    {"trial": "int", "penalty": 6, "subset": "int", "n_days": "int", "ic_mean": 6, "icir": 6, "best": "bool"},
    _SEARCH + f""" SELECT trial, penalty, subset, n_days, ic_mean, icir, row_number() OVER (ORDER BY round(ic_mean, 10) DESC, trial) = 1 AS best
      FROM {sql_icir('tic', 'trial')} q JOIN tr USING (trial)""",
)
def grid_search(t):
    return L.ridge_search(*_search_inputs(t))


def _rung(rung: int, left: str, step: int, keep: int) -> str:
    return f"""r{rung} AS MATERIALIZED (SELECT {rung} AS rung, trial, n_days, ic_mean, row_number() OVER (ORDER BY round(ic_mean, 10) DESC, trial) <= {keep} AS kept
      FROM (SELECT trial, count(*) AS n_days, avg(ic) AS ic_mean FROM tic JOIN {left} USING (trial) JOIN pl USING (date) WHERE place % {step} = 0 GROUP BY trial) q)"""


@query(
    "halving_search",
    {"rung": "int", "trial": "int", "penalty": 6, "subset": "int", "n_days": "int", "ic_mean": 6, "kept": "bool"},
    _SEARCH + ", pl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM sp WHERE role = 'test'),"
    + _rung(0, "tr", 9, 3) + ", k0 AS (SELECT trial FROM r0 WHERE kept)," + _rung(1, "k0", 3, 1) + ", k1 AS (SELECT trial FROM r1 WHERE kept),"
    + _rung(2, "k1", 1, 1) + """ SELECT rung, trial, penalty, subset, n_days, ic_mean, kept
      FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) q JOIN tr USING (trial)""",
)
def halving_search(t):
    return L.halving_search(*_search_inputs(t))


_PERMUTED = _SEARCH + f""", ho AS (SELECT *, md5(code || '|' || date) AS h FROM mr),
  pe AS (SELECT sp.fold, mr.date, label, intercept, coefficients, {', '.join(_MODEL_FEATURES)},
      {', '.join(f'coalesce(lead({f}) OVER w, first_value({f}) OVER w) AS n_{f}' for f in _MODEL_FEATURES)}
    FROM ho mr JOIN sp ON sp.date = mr.date AND role = 'test' JOIN fit ON fit.fold = sp.fold AND trial = 1
    WINDOW w AS (PARTITION BY sp.fold, mr.date ORDER BY h, code)),
  ps AS ({' UNION ALL '.join(f"SELECT fold, date, label, '{g}' AS feature, {sql_score([f if f != g else 'n_' + f for f in _MODEL_FEATURES])} AS score FROM pe"
                             for g in ('', *_MODEL_FEATURES))}),
  pic AS (SELECT fold, feature, avg(ic) AS ic FROM {sql_rank_ic('ps', 'fold, feature, date')} q GROUP BY fold, feature),
  imp AS MATERIALIZED (SELECT a.fold, a.feature, b.ic - a.ic AS importance FROM pic a JOIN pic b ON b.fold = a.fold AND b.feature = '' WHERE a.feature <> '')"""


def fold_importance(t):
    rows, features, splits, trials = _search_inputs(t)
    models = L.fold_models(rows, features, splits, trials.where("trial = 1"))
    return L.permutation_importance(rows, models, features, splits)


@query("permutation_importance", {"fold": "int", "feature": "str", "importance": 6}, _PERMUTED + " SELECT * FROM imp")
def permutation_importance(t):
    return fold_importance(t)


@query(
    "fold_importance_stability",
    {"n_folds": "int", "n_pairs": "int", "stability": 6},
    _PERMUTED + f""", ip AS (SELECT a.fold, round(a.importance, 9) AS x, round(b.importance, 9) AS y FROM imp a JOIN imp b ON b.fold = a.fold + 1 AND b.feature = a.feature),
      rr AS (SELECT fold, corr(rx, ry) AS rho FROM {sql_ranks('ip', 'fold', {'x': 'rx', 'y': 'ry'}, 'fold')} q GROUP BY fold HAVING count(*) > 5)
      SELECT (SELECT count(DISTINCT fold) FROM imp) AS n_folds, count(rho) AS n_pairs, coalesce(avg(rho), 0) AS stability FROM rr""",
)
def fold_importance_stability(t):
    return importance_stability(fold_importance(t).withColumn("importance", F.round("importance", 9)))


_CONTRIB_FEATURES = ("size", "momentum", "volatility")
_CONTRIB = """cr AS (SELECT s.code, s.date, size, momentum, volatility, label FROM sty s JOIN label l ON l.code = s.code AND l.date = s.date),
cl AS (""" + " UNION ALL ".join(
    f"SELECT code, date, label, '{f}' AS feature, {f} AS value FROM cr WHERE {f} IS NOT NULL" for f in _CONTRIB_FEATURES
) + """), cb AS (SELECT feature, regr_slope(label, value) AS b, avg(value) AS m FROM cl GROUP BY feature),
cc AS MATERIALIZED (SELECT code, date, feature, value, b * (value - m) AS contribution FROM cl JOIN cb USING (feature))"""


def contributions(t):
    # styles and labels are windows over the same rows, so one pass gives both
    labelled = t.week.withColumn("label", forward_return("close", 4)).where(F.col("code").isNotNull() & F.col("date").isNotNull())
    rows = materialize(styles(t, labelled, ["label"]).where(F.col("label").isNotNull()))
    return M.linear_contributions(rows, _CONTRIB_FEATURES, M.univariate_coefficients(rows, _CONTRIB_FEATURES))


@query(
    "contribution_importance",
    {"feature": "str", "mean_abs": 5, "std": 5, "share": 6, "place": "int"},
    with_ctes("sty", "label", extra=_CONTRIB) + """SELECT feature, mean_abs, std, sum(mean_abs) OVER (ORDER BY mean_abs DESC, feature) / sum(mean_abs) OVER () AS share,
      row_number() OVER (ORDER BY mean_abs DESC, feature) AS place
      FROM (SELECT feature, avg(abs(contribution)) AS mean_abs, stddev_pop(contribution) AS std FROM cc GROUP BY feature) q""",
)
def contribution_importance(t):
    return M.contribution_importance(contributions(t))


@query(
    "features_for_share",
    {"n_features": "int"},
    with_ctes("sty", "label", extra=_CONTRIB) + """SELECT count(CASE WHEN share < 0.9 THEN 1 END) + 1 AS n_features FROM
      (SELECT sum(mean_abs) OVER (ORDER BY mean_abs DESC, feature) / sum(mean_abs) OVER () AS share
       FROM (SELECT feature, avg(abs(contribution)) AS mean_abs FROM cc GROUP BY feature) q) z""",
)
def features_for_share(t):
    return M.features_for_share(M.contribution_importance(contributions(t)))


@query(
    "explain_row",
    {"feature": "str", "value": 6, "contribution": 6},
    with_ctes("sty", "label", extra=_CONTRIB) + "SELECT feature, value, contribution FROM cc WHERE code = 3 AND date = DATE '1998-06-05'",
)
def explain_row(t):
    return M.explain_row(contributions(t), 3, "1998-06-05")


# ---- streaming -------------------------------------------------------------------------------------------------------


def upserted(t) -> str:
    """A first load with stale recent closes, then an update of the recent dates: the stream ends at the true panel."""
    folder = scratch(t.spark)
    recent = F.col("date") >= F.lit("2001-01-01").cast("date")
    first = t.day.withColumns({"close": F.when(recent, F.col("close") * 2).otherwise(F.col("close")), "ingest": F.lit(1)})
    for load in (first, t.day.where(recent).withColumn("ingest", F.lit(2))):
        load.write.mode("append").parquet(f"{folder}/in")
        Z.start_upsert(Z.stream_files(t.spark, f"{folder}/in", first.schema), f"{folder}/bars", f"{folder}/ckpt").awaitTermination()
    return folder + "/bars"


@query("stream_upsert_bars", BAR, with_ctes("panel_day") + "SELECT * FROM panel_day")
def stream_upsert_bars(t):
    return Z.current_bars(t.spark, upserted(t))


@query("stream_refresh_instruments", {"code": "int", "start_date": "date", "end_date": "date"},
       with_ctes("panel_day") + "SELECT code, min(date) AS start_date, max(date) AS end_date FROM panel_day GROUP BY code")
def stream_refresh_instruments(t):
    """Instrument ranges after the upsert and a compaction."""
    target = upserted(t)
    Z.compact_bars(t.spark, target)
    return Z.refresh_dimensions(t.spark, target)[1]


@query(
    "stream_adjust_events",
    {"code": "int", "date": "date", "prev_close": 9, "close": 9, "change": 8},
    with_ctes("panel_day") + """SELECT code, date, prev_close, close, close / prev_close - 1 AS change FROM
      (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS prev_close FROM panel_day) q WHERE abs(close / prev_close - 1) > 0.11""",
)
def stream_adjust_events(t):
    """Three arrivals per code, the second behind the first: every third day comes late, and corrects the jumps around it."""
    folder = scratch(t.spark)
    cut, late = F.lit("1998-06-01").cast("date"), F.unix_date("date") % 3 == 0
    bars = t.day.select("code", "date", "close")
    early = F.col("date") < cut
    for load in (bars.where(early & ~late), bars.where(early & late), bars.where(~early)):
        load.write.mode("append").parquet(f"{folder}/in")
        events = Z.adjust_events(Z.stream_files(t.spark, f"{folder}/in", bars.schema), lateness_days=None)
        writer = events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
        writer.trigger(availableNow=True).start().awaitTermination()
    return Z.settled_events(t.spark.read.parquet(f"{folder}/out"))


_TICK_BARS = """SELECT user_id AS code, date_trunc('day', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks FROM events GROUP BY 1, 2"""


def ticks(t, rows):
    return rows.select(
        F.col("user_id").alias("code"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume")
    )


@query(
    "stream_ohlcv_bars",
    {"code": "int", "day": "date", "open": 4, "high": 4, "low": 4, "close": 4, "n_ticks": "int"},
    f"SELECT code, CAST(start AS DATE) AS day, open, high, low, close, n_ticks FROM ({_TICK_BARS}) b",
)
def stream_ohlcv_bars(t):
    """Daily bars from the event stream: the append sink holds the windows the watermark has passed, the rest are closed after it."""
    folder = scratch(t.spark)
    schema = t.read("events").schema
    stream = Z.stream_files(t.spark, f"{t.folder}/event*.parquet", schema)
    bars = Z.ohlcv(ticks(t, stream.withColumn("ts", Z.utc_instant(F.col("ts")))))
    writer = bars.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
    writer.trigger(availableNow=True).start().awaitTermination()
    every = ticks(t, t.read("events").withColumn("ts", Z.utc_instant(F.col("ts"))))
    done = Z.closed_windows(t.spark.read.schema(bars.schema).parquet(f"{folder}/out"), every)
    return done.withColumn("day", Z.utc_wall(F.col("start")).cast("date"))


_SLIDING = """SELECT user_id AS code, strftime(s, '%Y-%m-%d %H') AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
              arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks
       FROM (SELECT *, unnest([h, h - INTERVAL 6 HOUR]) AS s FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS h FROM events) e) w
       GROUP BY 1, 2"""
_SLIDING_BAR = {"code": "int", "start": "str", "open": 4, "high": 4, "low": 4, "close": 4, "n_ticks": "int"}


@query("static_ohlcv_bars", _SLIDING_BAR, _SLIDING)
def static_ohlcv_bars(t):
    """Sliding windows: 12 hours wide, every 6 hours."""
    bars = Z.ohlcv(ticks(t, t.read("events")), "12 hours", "6 hours")
    return bars.withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("stream_sliding_bars", _SLIDING_BAR, _SLIDING)
def stream_sliding_bars(t):
    """The same windows from a stream of panes; those the watermark has not passed are closed after it."""
    folder = scratch(t.spark)
    stream = Z.stream_files(t.spark, f"{t.folder}/event*.parquet", t.read("events").schema)
    bars = Z.sliding_ohlcv(ticks(t, stream.withColumn("ts", Z.utc_instant(F.col("ts")))), "12 hours", "6 hours")
    writer = bars.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
    writer.trigger(availableNow=True).start().awaitTermination()
    every = ticks(t, t.read("events").withColumn("ts", Z.utc_instant(F.col("ts"))))
    done = Z.closed_windows(t.spark.read.schema(bars.schema).parquet(f"{folder}/out"), every, "12 hours", "6 hours")
    return done.withColumn("start", F.date_format(Z.utc_wall(F.col("start")), "yyyy-MM-dd HH"))


@query(
    "stream_validate",
    {"side": "str", "code": "int", "n": "int"},
    f"""WITH {_RAW}, mk AS (SELECT *, low > high OR open < low OR open > high OR close < low OR close > high AS bad FROM raw)
        SELECT 'good' AS side, code, count(DISTINCT date) AS n FROM mk WHERE NOT bad GROUP BY code
        UNION ALL SELECT 'rejected', code, count(*) FROM mk WHERE bad GROUP BY code""",
)
def stream_validate(t):
    folder = scratch(t.spark)
    bars = faulty_bars(t)
    bars.write.parquet(f"{folder}/in")
    stream = Z.stream_files(t.spark, f"{folder}/in", bars.schema)
    for running in Z.start_validation(stream, f"{folder}/good", f"{folder}/rejected", f"{folder}/ckpt"):
        running.awaitTermination()
    good = Z.good_bars(t.spark, f"{folder}/good").select(F.lit("good").alias("side"), "code")
    rejected = t.spark.read.parquet(f"{folder}/rejected/batch=*").select(F.lit("rejected").alias("side"), "code")
    return good.unionByName(rejected).groupBy("side", "code").agg(F.count(F.lit(1)).alias("n"))
