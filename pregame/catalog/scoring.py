"""Forecast scoring on labelled documents, quality reports, event sums and id maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.catalog.base import query, rounded, rounded_sql
from pregame.catalog import tables as G
from pregame.catalog.tables import read
from pregame.functions import scalars as C
from pregame.operators import events as E
from pregame.operators import forecasts as X
from pregame.operators import identity as I
from pregame.operators import quality as Q

MODELS = {"alpha": 7, "beta": 13, "gamma": 29}


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per labelled document and model: probability, truth, sides and winner."""
    docs = read(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = docs.join(read(spark, folder, "labels"), "doc_id")
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(k).alias("k")) for m, k in MODELS.items()]))
    p = (F.col("n_chars") * F.col("m.k") % 1001) / 1000.0
    won = F.col("quality") == 1
    return rows.withColumn("m", models).select(
        F.col("doc_id").cast("string").alias("game_id"), F.col("lang").alias("holdout_season"), "m.model_name",
        p.alias("home_win_probability"), F.col("quality").alias("home_team_win"),
        F.concat(F.lit("h"), F.col("doc_id") % 5).alias("home_team"), F.concat(F.lit("a"), F.col("doc_id") % 7).alias("away_team"),
        F.when(F.col("toxic") == 1, "").when(won, F.concat(F.lit("h"), F.col("doc_id") % 5)).otherwise(
            F.concat(F.lit("a"), F.col("doc_id") % 7)).alias("actual_winner"),
        F.date_add(F.lit("2024-04-01").cast("date"), (F.col("doc_id") % 20).cast("int")).alias("game_date"),
    )


FORECASTS = """f AS (SELECT CAST(d.doc_id AS VARCHAR) AS game_id, lang AS holdout_season, model_name,
  (n_chars * k % 1001) / 1000.0 AS p, quality AS y, 'h' || (d.doc_id % 5) AS home_team, 'a' || (d.doc_id % 7) AS away_team,
  CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'h' || (d.doc_id % 5) ELSE 'a' || (d.doc_id % 7) END AS actual_winner,
  CAST(DATE '2024-04-01' + CAST(d.doc_id % 20 AS INTEGER) AS DATE) AS game_date
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES ('alpha', 7), ('beta', 13), ('gamma', 29)) m(model_name, k)),
metrics AS (SELECT holdout_season, model_name,
  -avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss, avg((q - y) * (q - y)) AS brier_score,
  avg(CAST((q >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy, CAST(count(*) AS DOUBLE) AS n_games,
  avg(CASE WHEN greatest(q, 1 - q) >= 0.55 THEN CAST((q >= 0.5) = (y = 1) AS DOUBLE) END) AS accuracy_conf_55,
  avg(CAST(greatest(q, 1 - q) >= 0.55 AS DOUBLE)) AS coverage_conf_55,
  avg(CASE WHEN greatest(q, 1 - q) >= 0.6 THEN CAST((q >= 0.5) = (y = 1) AS DOUBLE) END) AS accuracy_conf_60,
  avg(CAST(greatest(q, 1 - q) >= 0.6 AS DOUBLE)) AS coverage_conf_60,
  avg(CASE WHEN greatest(q, 1 - q) >= 0.65 THEN CAST((q >= 0.5) = (y = 1) AS DOUBLE) END) AS accuracy_conf_65,
  avg(CAST(greatest(q, 1 - q) >= 0.65 AS DOUBLE)) AS coverage_conf_65
  FROM (SELECT *, CAST(least(greatest(p, 1e-6), 1 - 1e-6) AS DOUBLE) AS q FROM f) GROUP BY holdout_season, model_name)"""
_METRICS = ["log_loss", "brier_score", "accuracy", "n_games"] + [f"{k}_conf_{t}" for t in (55, 60, 65) for k in ("accuracy", "coverage")]
PICKS = """picks AS (SELECT *, greatest(p, 1 - p) AS c, CASE WHEN p >= 0.5 THEN home_team ELSE away_team END AS raw,
  CASE WHEN greatest(p, 1 - p) >= 0.6 THEN 'strong' WHEN greatest(p, 1 - p) >= 0.55 THEN 'lean' ELSE 'pass' END AS rule FROM
  (SELECT * REPLACE (CAST(p AS DOUBLE) AS p) FROM f)),
ruled AS (SELECT *, CASE WHEN rule <> 'pass' AND actual_winner <> '' THEN raw = actual_winner END AS ok FROM picks)"""


def _metrics(spark, folder):
    return X.probability_metrics(_forecasts(spark, folder), "home_team_win", "home_win_probability", ["holdout_season", "model_name"])


@query(rounded_sql("SELECT * FROM metrics", _METRICS, with_=FORECASTS))
def probability_metrics(spark, folder):
    return rounded(_metrics(spark, folder))


@query(rounded_sql("""SELECT m.model_name, CAST(b.bin AS INTEGER) AS bin, (b.bin - 1) / 10.0 AS lower, b.bin / 10.0 AS upper,
  coalesce(n, 0) AS n_games, pr AS predicted_home_win_rate, ac AS actual_home_win_rate, pr - ac AS calibration_error
  FROM (SELECT DISTINCT model_name FROM f) m CROSS JOIN (SELECT unnest(range(1, 11)) AS bin) b
  LEFT JOIN (SELECT model_name, greatest(ceil(CAST(p AS DOUBLE) * 10), 1) AS bin, count(*) AS n, avg(p) AS pr, avg(y) AS ac FROM f GROUP BY ALL) x
  ON x.model_name = m.model_name AND x.bin = b.bin""",
  ["lower", "upper", "predicted_home_win_rate", "actual_home_win_rate", "calibration_error"], with_=FORECASTS))
def calibration_bins(spark, folder):
    return rounded(X.calibration(_forecasts(spark, folder), "home_team_win", "home_win_probability", ["model_name"]))


def _band(t):
    return (f"SELECT holdout_season, 'confidence_{t}' AS rule_name, model_name AS selected_model, 'accuracy_conf_{t}' AS selection_metric, "
            f"accuracy_conf_{t} AS selection_value, coverage_conf_{t} AS coverage FROM metrics WHERE coverage_conf_{t} >= 0.1 "
            f"QUALIFY row_number() OVER (PARTITION BY holdout_season ORDER BY accuracy_conf_{t} DESC, coverage_conf_{t} DESC, log_loss, model_name) = 1")


@query(rounded_sql("""SELECT holdout_season, 'overall_log_loss' AS rule_name, model_name AS selected_model, 'log_loss' AS selection_metric,
  log_loss AS selection_value, 1.0 AS coverage FROM metrics
  QUALIFY row_number() OVER (PARTITION BY holdout_season ORDER BY log_loss, brier_score, model_name) = 1 UNION ALL """
  + " UNION ALL ".join(_band(t) for t in (55, 60, 65)), ["selection_value", "coverage"], with_=FORECASTS))
def model_selection(spark, folder):
    return rounded(X.selection_rules(_metrics(spark, folder)))


@query(rounded_sql("""SELECT game_id, model_name, c AS win_confidence, c - 0.5 AS win_edge, raw AS raw_win_pick, rule AS win_pick_rule,
  CASE WHEN rule = 'pass' THEN '' ELSE raw END AS rule_win_pick, ok AS rule_win_correct FROM ruled""",
  ["win_confidence", "win_edge"], with_=f"{FORECASTS}, {PICKS}"))
def win_pick_rules(spark, folder):
    out = X.win_picks(_forecasts(spark, folder))
    return rounded(out.select("game_id", "model_name", "win_confidence", "win_edge", "raw_win_pick", "win_pick_rule",
                              "rule_win_pick", "rule_win_correct"))


@query(rounded_sql("""SELECT m.model_name, r.rule, count(x.rule) AS games, count(x.ok) AS picks, coalesce(CAST(count_if(x.ok) AS DOUBLE), 0.0) AS hits,
  CASE WHEN count(x.ok) > 0 THEN count_if(x.ok) / count(x.ok) END AS accuracy, count(x.rule) / any_value(m.n) AS coverage,
  avg(x.c) AS avg_confidence FROM (SELECT model_name, count(*) AS n FROM ruled GROUP BY ALL) m
  CROSS JOIN (VALUES ('pass'), ('lean'), ('strong'), ('actionable')) r(rule)
  LEFT JOIN ruled x ON x.model_name = m.model_name AND (x.rule = r.rule OR (r.rule = 'actionable' AND x.rule <> 'pass'))
  GROUP BY m.model_name, r.rule""", ["hits", "accuracy", "coverage", "avg_confidence"], with_=f"{FORECASTS}, {PICKS}"))
def win_pick_summary(spark, folder):
    return rounded(X.summarize_picks(X.win_picks(_forecasts(spark, folder)), ["model_name"]))


@query(rounded_sql("""SELECT game_date, count(*) AS games, count_if(rule = 'pass') AS pass_games, count_if(rule = 'lean') AS lean_games,
  count_if(rule = 'strong') AS strong_games, count(ok) AS picks, CAST(count_if(ok) AS DOUBLE) AS hits,
  CASE WHEN count(ok) > 0 THEN count_if(ok) / count(ok) END AS accuracy FROM ruled GROUP BY game_date""",
  ["hits", "accuracy"], with_=f"{FORECASTS}, {PICKS}"))
def daily_pick_rules(spark, folder):
    return rounded(X.daily_rules(X.win_picks(_forecasts(spark, folder)), "game_date"))


@query(rounded_sql("""SELECT a.game_id, a.c AS win_confidence, CAST(b.raw = a.raw AS INTEGER) + CAST(g.raw = a.raw AS INTEGER) AS agreement_models,
  b.raw = a.raw AND g.raw = a.raw AS models_agree, CASE WHEN b.raw = a.raw AND g.raw = a.raw THEN a.rule ELSE 'pass' END AS win_pick_rule,
  CASE WHEN b.raw = a.raw AND g.raw = a.raw THEN a.ok END AS rule_win_correct
  FROM (SELECT * FROM ruled WHERE model_name = 'alpha') a JOIN (SELECT * FROM ruled WHERE model_name = 'beta') b USING (game_id)
  JOIN (SELECT * FROM ruled WHERE model_name = 'gamma') g USING (game_id)""", ["win_confidence"], with_=f"{FORECASTS}, {PICKS}"))
def agreement_pick_rules(spark, folder):
    out = X.agreement_picks(_forecasts(spark, folder), "alpha", ["beta", "gamma", "absent"])
    return rounded(out.select("game_id", "win_confidence", "agreement_models", "models_agree", "win_pick_rule", "rule_win_correct"))


def _totals(spark, folder):
    o = read(spark, folder, "orders")
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    return o.select(
        k.alias("game_id"), F.year("o_orderdate").alias("season"), ((v % 97) / 10.0).alias("expected_home_runs"),
        ((k % 83) / 10.0).alias("expected_away_runs"), (v % 11).cast("double").alias("home_score"),
        (k % 9).cast("double").alias("away_score"), F.when(k % 4 != 0, 6.5 + k % 5).cast("double").alias("total_line"),
    )


TOTALS = """t AS (SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season,
  CAST((CAST(floor(o_totalprice) AS BIGINT) % 97) / 10.0 AS DOUBLE) AS eh, CAST((o_orderkey % 83) / 10.0 AS DOUBLE) AS ea,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 11 AS DOUBLE) AS hs, CAST(o_orderkey % 9 AS DOUBLE) AS as_,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(6.5 + o_orderkey % 5 AS DOUBLE) END AS tl FROM orders)"""


@query(rounded_sql("""SELECT game_id, eh + ea - tl AS ou_margin, CASE WHEN eh + ea - tl > 0 THEN 'over' WHEN eh + ea - tl <= 0 THEN 'under' ELSE '' END AS raw_ou_pick,
  CASE WHEN abs(eh + ea - tl) > 1.5 THEN 'strong' WHEN abs(eh + ea - tl) > 0.5 THEN 'lean' ELSE 'pass' END AS ou_pick_rule,
  CASE WHEN abs(eh + ea - tl) > 0.5 THEN (eh + ea > tl) = (hs + as_ > tl) END AS rule_ou_correct FROM t""", ["ou_margin"], with_=TOTALS))
def total_pick_rules(spark, folder):
    rows = _totals(spark, folder).withColumns({
        "expected_total_runs": F.col("expected_home_runs") + F.col("expected_away_runs"),
        "actual_total": F.col("home_score") + F.col("away_score"),
    })
    return rounded(X.total_picks(rows).select("game_id", "ou_margin", "raw_ou_pick", "ou_pick_rule", "rule_ou_correct"))


@query(rounded_sql("""SELECT season, avg(abs(eh - hs)) AS home_mae, avg(abs(ea - as_)) AS away_mae, avg(abs(eh + ea - hs - as_)) AS total_mae,
  sqrt(avg(pow(eh + ea - hs - as_, 2))) AS total_rmse, avg(CAST(abs(eh + ea - hs - as_) <= 1 AS DOUBLE)) AS total_within_1,
  avg(CAST(abs(eh + ea - hs - as_) <= 2 AS DOUBLE)) AS total_within_2, avg(CAST(abs(eh + ea - hs - as_) <= 3 AS DOUBLE)) AS total_within_3,
  avg(abs((hs - as_) - (eh - ea))) AS run_diff_mae, CAST(count(*) AS DOUBLE) AS n_games FROM t GROUP BY season""",
  ["home_mae", "away_mae", "total_mae", "total_rmse", "total_within_1", "total_within_2", "total_within_3", "run_diff_mae"], with_=TOTALS))
def expected_run_metrics(spark, folder):
    return rounded(X.runs_metrics(_totals(spark, folder), ["season"]))


@query(rounded_sql("""SELECT total_line, avg(CAST((eh + ea > total_line) = (hs + as_ > total_line) AS DOUBLE)) AS ou_accuracy,
  avg(CAST(eh + ea > total_line AS DOUBLE)) AS over_pick_rate, avg(CAST(hs + as_ > total_line AS DOUBLE)) AS actual_over_rate,
  avg(abs(eh + ea - total_line)) AS mean_abs_margin, avg(CAST(abs(eh + ea - total_line) <= 0.5 AS DOUBLE)) AS pass_rate_0_5,
  avg(CAST(abs(eh + ea - total_line) > 0.5 AS DOUBLE)) AS lean_or_strong_rate_0_5, avg(CAST(abs(eh + ea - total_line) > 1.5 AS DOUBLE)) AS strong_rate_1_5,
  CAST(count(*) AS DOUBLE) AS n_games FROM t CROSS JOIN (SELECT unnest([6.5, 7.5, 8.5, 9.5, 10.5])::DOUBLE AS total_line) GROUP BY total_line""",
  ["ou_accuracy", "over_pick_rate", "actual_over_rate", "mean_abs_margin", "pass_rate_0_5", "lean_or_strong_rate_0_5", "strong_rate_1_5"], with_=TOTALS))
def synthetic_total_metrics(spark, folder):
    return rounded(X.total_line_metrics(_totals(spark, folder)))


@query(rounded_sql("""SELECT model_name, count(*) AS runs, avg(log_loss) AS log_loss_mean, stddev_samp(log_loss) AS log_loss_std, median(log_loss) AS log_loss_median
  FROM metrics GROUP BY model_name""", ["log_loss_mean", "log_loss_std", "log_loss_median"], with_=FORECASTS))
def model_leaderboard(spark, folder):
    return rounded(X.leaderboard(_metrics(spark, folder), ["model_name"], ["log_loss"]))


_VARIANTS = f"""{FORECASTS}, v AS (SELECT variant, model_name, count(*) AS runs, avg(x) AS log_loss_mean, stddev_samp(x) AS log_loss_std, median(x) AS log_loss_median
  FROM (SELECT 'base' AS variant, model_name, log_loss AS x FROM metrics UNION ALL SELECT 'worse', model_name, log_loss + 0.25 FROM metrics) GROUP BY ALL)"""


@query(rounded_sql("SELECT * FROM v ORDER BY log_loss_mean, variant, model_name LIMIT 5", ["log_loss_mean", "log_loss_std", "log_loss_median"], with_=_VARIANTS))
def best_model_variants(spark, folder):
    """Two labelled runs together, the five best lines."""
    base = _metrics(spark, folder)
    runs = {"base": base, "worse": base.withColumn("log_loss", F.col("log_loss") + 0.25)}
    return rounded(X.best(X.variant_summary(runs, ["model_name"], ["log_loss"]), ["log_loss_mean", "variant", "model_name"], 5))


@query("""SELECT 'o_orderpriority' AS "column", avg(CAST(coalesce(try_cast(o_orderpriority AS DOUBLE), 0) = 0 AS DOUBLE)) AS rate FROM orders
  UNION ALL SELECT 'share', avg(CAST(o_custkey % 4 = 0 AS DOUBLE)) FROM orders UNION ALL SELECT 'gaps', avg(CAST(o_orderkey % 8 < 3 AS DOUBLE)) FROM orders""")
def zero_or_blank_shares(spark, folder):
    orders = read(spark, folder, "orders").withColumns({
        "share": F.col("o_custkey") % 4, "gaps": F.when(F.col("o_orderkey") % 8 >= 3, F.col("o_orderkey"))})
    return Q.zero_or_blank_rates(orders, ["o_orderpriority", "share", "gaps"])


_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(rounded_sql(f"""SELECT 'l_quantity' AS left_column, 'thirds' AS right_column, corr(a, b) AS correlation
  FROM (SELECT {_RANKS.format("l_quantity")} AS a, {_RANKS.format("floor(l_quantity / 3)")} AS b FROM lineitem)""", ["correlation"]))
def lineitem_rank_correlations(spark, folder):
    lines = read(spark, folder, "lineitem").withColumn("thirds", F.floor(F.col("l_quantity") / 3))
    return rounded(Q.rank_correlations(lines, ["l_quantity", "thirds", "l_discount"], 0.5))


_STABLE = """e AS (SELECT year(o_orderdate) AS season, CAST(o_custkey % 100 AS VARCHAR) AS feature, sum(floor(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY ALL),
 tops AS (SELECT 'v' AS which, feature, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY v DESC, feature) AS r FROM e) WHERE r <= 20 GROUP BY ALL
  UNION ALL SELECT 'n', feature, count(*) FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY n DESC, feature) AS r FROM e) WHERE r <= 20 GROUP BY ALL)"""


@query(f"""WITH {_STABLE} SELECT 'stable' AS kind, feature FROM tops WHERE c >= 3 GROUP BY feature HAVING count(*) = 2
  UNION ALL SELECT DISTINCT 'watch', feature FROM tops WHERE c = 1""")
def stable_and_watched_features(spark, folder):
    from pregame.plans.predictions import stable_and_watch, top_stability

    rows = read(spark, folder, "orders").groupBy(
        F.year("o_orderdate").alias("holdout_season"), (F.col("o_custkey") % 100).cast("string").alias("feature")
    ).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    sets = stable_and_watch(top_stability(rows, "v", 20), top_stability(rows, "n", 20))
    return sets["stable"].select(F.lit("stable").alias("kind"), "feature").unionByName(sets["watch"].select(F.lit("watch").alias("kind"), "feature"))


@query("""SELECT o_orderkey, CAST(CASE WHEN p >= 0.5 AND h <= a THEN a + 1 ELSE h END AS INTEGER) AS predicted_home_score,
  CAST(CASE WHEN p < 0.5 AND a <= h THEN h + 1 ELSE a END AS INTEGER) AS predicted_away_score FROM (SELECT o_orderkey,
  round_even(CAST(o_orderkey % 19 AS DOUBLE) / 2, 0) AS h, round_even(CAST(o_custkey % 17 AS DOUBLE) / 2, 0) AS a, (o_orderkey % 101) / 100.0 AS p FROM orders)""")
def winner_consistent_scores(spark, folder):
    rows = read(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 19 / 2.0).alias("h"), (F.col("o_custkey") % 17 / 2.0).alias("a"),
        (F.col("o_orderkey") % 101 / 100.0).alias("p"),
    )
    return X.consistent_score(rows, "h", "a", "p").select("o_orderkey", "predicted_home_score", "predicted_away_score")


# -- quality -------------------------------------------------------------------------------


def _sheet(spark, folder):
    o = read(spark, folder, "orders")
    return o.select(
        "o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_orderdate").cast("timestamp").alias("game_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice").cast("double")).alias("total_last_10"),
        F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 10).cast("double")).alias("rest_days"), "o_orderpriority",
        (F.col("o_orderkey") % 2).cast("int").alias("won"),
    )


SHEET = """s AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS TIMESTAMP) AS game_date,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS total_last_10,
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 10 AS DOUBLE) END AS rest_days, o_orderpriority, CAST(o_orderkey % 2 AS INTEGER) AS won FROM orders)"""


def _null_row(c, numeric=True):
    extra = (f"count_if({c} = 0) / count(*) AS zero_rate, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(median({c}) AS DOUBLE) AS median"
             if numeric else "CAST(NULL AS DOUBLE) AS zero_rate, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median")
    return f'SELECT \'{c}\' AS "column", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, 1 - count({c}) / count(*) AS null_rate, {extra} FROM s'


@query(rounded_sql(" UNION ALL ".join(_null_row(c, c not in ("game_date", "o_orderpriority")) for c in
  ("o_orderkey", "season", "game_date", "total_last_10", "rest_days", "o_orderpriority", "won")), ["null_rate", "zero_rate"], with_=SHEET))
def null_rate_report(spark, folder):
    return rounded(Q.null_rates(_sheet(spark, folder)).drop("dtype"))


# (column, value in SQL, value as an expression Spark reads too); the tracking and the empty one stay out.
_MODEL_COLUMNS = [
    ("home_score", "CAST(o_custkey % 11 AS DOUBLE)"), ("statcast_pitches", "CAST(o_custkey % 90 AS DOUBLE)"),
    ("sp_whiff_rate_diff", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END"),
    ("rest_diff", "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 6 AS DOUBLE) END"),
    ("is_late", "o_orderpriority = '5-LOW'"), ("never_known", "CASE WHEN o_orderkey < 0 THEN CAST(o_orderkey AS DOUBLE) END"),
]
_MODEL_SQL = "m AS (SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season, " + ", ".join(
    f"{text} AS {name}" for name, text in _MODEL_COLUMNS) + " FROM orders)"


def _model_table(spark, folder):
    orders = read(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("game_id"), F.year("o_orderdate").alias("season"),
                         *[F.expr(text).alias(name) for name, text in _MODEL_COLUMNS])


def _set_row(name, status, reason):
    return f"SELECT '{name}' AS \"column\", '{status}' AS status, '{reason}' AS reason, count({name}) AS non_null, 1 - count({name}) / count(*) AS null_rate FROM m"


@query(rounded_sql(" UNION ALL ".join([
    *[_set_row(c, "excluded", "identifier_or_target") for c in ("season", "home_score")],
    *[_set_row(c, "excluded", "mlb_only_tracking") for c in ("statcast_pitches", "sp_whiff_rate_diff")],
    *[_set_row(c, "included", "npb_public_or_proxy") for c in ("rest_diff", "is_late")], _set_row("never_known", "excluded", "all_null"),
]), ["null_rate"], with_=_MODEL_SQL))
def feature_set_report(spark, folder):
    return rounded(Q.feature_set(_model_table(spark, folder)))


@query(f"WITH {_MODEL_SQL} SELECT game_id, season, home_score, rest_diff, is_late FROM m")
def model_ready_features(spark, folder):
    table = _model_table(spark, folder)
    return Q.model_ready(table, Q.feature_set(table))


@query(rounded_sql("""SELECT season, count(*) AS rows, CAST(min(game_date) AS DATE) AS first_date, CAST(max(game_date) AS DATE) AS last_date,
  avg(won) AS home_win_rate FROM s GROUP BY season""", ["home_win_rate"], with_=SHEET))
def season_report(spark, folder):
    out = Q.season_summary(_sheet(spark, folder), target="won")
    return rounded(out.withColumns({c: F.to_date(c) for c in ("first_date", "last_date")}))


def _ready(c):
    return (f'SELECT season, \'{c}\' AS "column", count(*) AS rows, avg(CAST({c} IS NULL AS DOUBLE)) AS null_rate_all, '
            f"avg(CASE WHEN month(game_date) >= 5 THEN CAST({c} IS NULL AS DOUBLE) END) AS null_rate_may_onward, "
            f"count_if(month(game_date) >= 5 AND {c} IS NOT NULL) AS non_null_may_onward FROM s GROUP BY season")


@query(rounded_sql(f"{_ready('total_last_10')} UNION ALL {_ready('rest_days')}", ["null_rate_all", "null_rate_may_onward"], with_=SHEET))
def rolling_readiness_report(spark, folder):
    return rounded(Q.rolling_readiness(_sheet(spark, folder)))


@query(rounded_sql("""SELECT 'total_last_10' AS "column", count(total_last_10) / count(*) AS non_null_rate, count(DISTINCT total_last_10) AS n_distinct FROM s
  UNION ALL SELECT 'rest_days', count(rest_days) / count(*), count(DISTINCT rest_days) FROM s""", ["non_null_rate"], with_=SHEET))
def feature_diagnostics(spark, folder):
    return rounded(Q.diagnostics(_sheet(spark, folder), ["total_last_10", "rest_days"]))


@query("""SELECT t.table_name, count(DISTINCT k) AS n_keys, round_even(count(DISTINCT k) * 100.0 / (SELECT count(*) FROM customer), 1) AS percent_of_base FROM (
  SELECT 'orders' AS table_name, o_custkey AS k FROM orders UNION ALL SELECT 'rush', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'any', o_custkey FROM orders) t JOIN customer ON k = c_custkey GROUP BY t.table_name""")
def table_coverage(spark, folder):
    orders = read(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rush = orders.filter("o_orderpriority = '1-URGENT'")
    return Q.distinct_coverage({"orders": orders, "rush": rush}, "c_custkey", read(spark, folder, "customer"))


@query("SELECT source, lang, count(*) AS n_rows FROM documents GROUP BY source, lang")
def rows_per_source_and_mode(spark, folder):
    return Q.mode_counts(read(spark, folder, "documents"), ["source", "lang"])


_COVER = "SELECT '{n}' AS metric, CAST({v} AS DOUBLE) AS value, {p} AS percent FROM c"
_SHARE = "round_even(CAST({v} AS DOUBLE) / games * 100.0, 1)"
_METRICS_OF = {
    "scheduled_games": ("games", None), "covered_games": ("a", "s"), "batting_log_games": ("b", "s"), "pitching_log_games": ("p", "s"), "lineup_games": ("l", "s"),
    "batting_rows": ("br", None), "pitching_rows": ("pr", None), "lineup_rows": ("lr", None), "games_with_home_starter": ("games", "s"), "games_with_away_starter": ("aw", "s"),
    "player_id_missing": ("0", "0.0"), "mean_lineup_rows": ("m", None), "games_with_18_lineup_rows": ("f", None), "games_with_two_starters": ("t", None),
}


def _cover(n, v, p):
    return _COVER.format(n=n, v=v, p="CAST(NULL AS DOUBLE)" if p is None else p if p != "s" else _SHARE.format(v=v))


@query(f"""WITH {G.GAMES_SQL}, {G.BATTING_SQL}, {G.PITCHING_SQL}, {G.LINEUPS_SQL},
  lg AS (SELECT game_id, count(*) AS n FROM lineups GROUP BY 1), pg AS (SELECT game_id, sum(is_start) AS s FROM pitcher_logs GROUP BY 1),
  c AS (SELECT (SELECT count(*) FROM games) AS games, (SELECT count(*) FROM games WHERE game_no % 2 = 0) AS aw,
   (SELECT count(*) FROM (SELECT game_id FROM batting_logs UNION SELECT game_id FROM pitcher_logs UNION SELECT game_id FROM lineups)) AS a,
   (SELECT count(DISTINCT game_id) FROM batting_logs) AS b, (SELECT count(DISTINCT game_id) FROM pitcher_logs) AS p, (SELECT count(*) FROM lg) AS l,
   (SELECT count(*) FROM batting_logs) AS br, (SELECT count(*) FROM pitcher_logs) AS pr, (SELECT count(*) FROM lineups) AS lr,
   (SELECT round_even(avg(n), 2) FROM lg) AS m, (SELECT count(*) FROM lg WHERE n >= 18) AS f, (SELECT count(*) FROM pg WHERE s = 2) AS t)
  """ + " UNION ALL ".join(_cover(n, *vp) for n, vp in _METRICS_OF.items()))
def schedule_coverage(spark, folder):
    even = F.col("game_id").cast("bigint") % 2 == 0
    games = G.games(spark, folder).select("game_id", "home_sp_id", F.when(even, F.col("away_sp_id")).otherwise(" ").alias("away_sp_id"))
    return Q.coverage_report(games, G.batting_logs(spark, folder), G.pitcher_logs(spark, folder), G.lineups(spark, folder))


# -- events --------------------------------------------------------------------------------


def _pitches(spark, folder):
    """Site events as pitches: the user bats, the event kind decides flags, value is the exit speed."""
    e = read(spark, folder, "events")
    i, v = F.col("event_id"), F.col("value")
    return e.select(
        F.date_format("ts", "yyyyMMdd").alias("game_pk"), F.to_date("ts").cast("timestamp").alias("game_date"),
        F.col("user_id").alias("batter"), (i % 40).alias("pitcher"), F.lit("HOM").alias("home_team"), F.lit("AWY").alias("away_team"),
        F.when(i % 2 == 0, "Top").otherwise("Bot").alias("inning_topbot"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("events"),
        F.when(F.col("event_type") == "click", "swinging_strike").when(F.col("event_type") == "error", "foul_tip").otherwise("ball").alias("description"),
        F.when(v > 10, F.floor(v)).cast("double").alias("launch_speed"), F.when(v > 20, (i % 60).cast("double")).alias("launch_angle"),
        F.when(v > 10, (i % 7).cast("double")).alias("launch_speed_angle"), F.when(i % 3 == 0, F.floor(v)).cast("double").alias("woba_value"),
        F.when(i % 4 == 0, (i % 5).cast("double")).alias("estimated_woba_using_speedangle"),
        F.when(i % 5 != 0, (80 + i % 20).cast("double")).alias("release_speed"), F.when(i % 6 != 0, (i % 900).cast("double")).alias("release_spin_rate"),
        F.element_at(F.array(*[F.lit(t) for t in ("ff", "si", "fc", "sl", "cu", "ch", "fs")]), (i % 7 + 1).cast("int")).alias("pitch_type"),
    )


_pt = lambda t, n: f"CAST(count_if(event_id % 7 = {n}) AS DOUBLE) AS statcast_pitch_{t}"
EVENT_SUMS = """CAST(count_if(event_type <> 'view') AS DOUBLE) AS {pa}, CAST(count_if(value > 10) AS DOUBLE) AS {bb},
  CAST(count_if(value > 10 AND floor(value) >= 95) AS DOUBLE) AS {hh}, CAST(count_if(value > 10 AND event_id % 7 = 6) AS DOUBLE) AS {br},
  CAST(count_if(event_type IN ('click', 'error')) AS DOUBLE) AS statcast_whiffs, CAST(count(*) AS DOUBLE) AS statcast_pitches,
  CAST(sum(CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE 0 END) AS DOUBLE) AS {xs}, CAST(count_if(event_id % 4 = 0) AS DOUBLE) AS {xc},
  CAST(sum(CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE 0 END) AS DOUBLE) AS {ws}, CAST(count_if(event_id % 3 = 0) AS DOUBLE) AS {wc},
  CAST(sum(CASE WHEN value > 10 THEN floor(value) ELSE 0 END) AS DOUBLE) AS {ls},
  CAST(sum(CASE WHEN event_id % 5 <> 0 THEN 80 + event_id % 20 ELSE 0 END) AS DOUBLE) AS statcast_release_speed_sum,
  CAST(count_if(event_id % 5 <> 0) AS DOUBLE) AS statcast_release_speed_count,
  CAST(sum(CASE WHEN event_id % 5 <> 0 AND event_id % 7 < 3 THEN 80 + event_id % 20 ELSE 0 END) AS DOUBLE) AS statcast_fastball_release_speed_sum,
  CAST(count_if(event_id % 5 <> 0 AND event_id % 7 < 3) AS DOUBLE) AS statcast_fastball_release_speed_count,
  CAST(sum(CASE WHEN event_id % 6 <> 0 THEN event_id % 900 ELSE 0 END) AS DOUBLE) AS statcast_spin_rate_sum,
  CAST(count_if(event_id % 6 <> 0) AS DOUBLE) AS statcast_spin_rate_count, """ + ", ".join(
    _pt(t, n) for n, t in enumerate(("ff", "si", "fc", "sl", "cu", "ch", "fs")))
_BAT = dict(pa="statcast_pa", bb="statcast_batted_balls", hh="statcast_hard_hit_balls", br="statcast_barrels", xs="statcast_xwoba_sum",
            xc="statcast_xwoba_count", ws="statcast_woba_sum", wc="statcast_woba_count", ls="statcast_launch_speed_sum")
_PIT = {k: E.ALLOWED[v] for k, v in _BAT.items()}


def _event_sql(player, team, names):
    return (f"SELECT strftime(ts, '%Y%m%d') AS game_id, CAST(ts AS DATE) AS game_date, CAST(year(ts) AS INTEGER) AS season, "
            f"CAST({player} AS VARCHAR) AS player_id, CASE WHEN event_id % 2 = 0 THEN '{team[0]}' ELSE '{team[1]}' END AS team, "
            f"{EVENT_SUMS.format(**names)} FROM events GROUP BY 1, 2, 3, 4, 5")


@query(_event_sql("user_id", ("AWY", "HOM"), _BAT))
def batter_event_sums(spark, folder):
    return E.event_quality(_pitches(spark, folder), "batter").withColumn("game_date", F.to_date("game_date"))


@query(_event_sql("event_id % 40", ("HOM", "AWY"), _PIT))
def pitcher_event_sums(spark, folder):
    return E.event_quality(_pitches(spark, folder), "pitcher").withColumn("game_date", F.to_date("game_date"))


@query("""SELECT u.user_id, u.game_id, u.team, x.n AS statcast_pitches FROM (
  SELECT DISTINCT user_id, strftime(ts, '%Y%m%d') AS game_id, CASE WHEN user_id % 2 = 0 THEN 'AWY' ELSE 'HOM' END AS team FROM events) u
  LEFT JOIN (SELECT user_id, strftime(ts, '%Y%m%d') AS game_id, CASE WHEN event_id % 2 = 0 THEN 'AWY' ELSE 'HOM' END AS team,
    CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL) x ON x.user_id = u.user_id AND x.game_id = u.game_id AND x.team = u.team""")
def logs_with_event_sums(spark, folder):
    logs = read(spark, folder, "events").select(
        "user_id", F.date_format("ts", "yyyyMMdd").alias("game_id"), C.canonical_id("user_id").alias("player_id"),
        F.when(F.col("user_id") % 2 == 0, "AWY").otherwise("HOM").alias("team"),
    ).distinct()
    out = E.merge_quality(logs, E.event_quality(_pitches(spark, folder), "batter"))
    return out.select("user_id", "game_id", "team", "statcast_pitches")


# -- ids -----------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS external_player_id, min(c_custkey) AS player_id FROM supplier
  JOIN customer ON split_part(s_name, '#', 2) = split_part(c_name, '#', 2) GROUP BY s_suppkey HAVING count(DISTINCT c_custkey) = 1""")
def external_player_ids(spark, folder):
    provider = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("external_player_id"), F.concat(F.lit("P. "), F.split_part("s_name", F.lit("#"), F.lit(2)), F.lit(" Jr.")).alias("player_name")
    )
    register = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("mlbam_id"), F.lit("p").alias("name_first"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("name_last"),
        F.lit(None).cast("string").alias("name_given"), F.lit(1990).alias("mlb_played_first"), F.lit(2030).alias("mlb_played_last"),
    )
    return I.external_player_ids(provider, register, 2024).select("external_player_id", "player_id")


@query("""SELECT l_orderkey * 10 + l_linenumber AS external_game_id, min(o_orderkey) AS game_id
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_suppkey % 9 AS h, l_partkey % 9 AS a FROM lineitem) l
  JOIN orders ON CAST(o_orderdate AS DATE) = d AND o_custkey % 9 = h AND o_orderkey % 9 = a
  GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1""")
def external_game_ids(spark, folder):
    provider = read(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("external_game_id"), F.col("l_shipdate").cast("timestamp").alias("game_date"),
        F.concat(F.lit("h"), F.col("l_suppkey") % 9).alias("home_team"), F.concat(F.lit("a"), F.col("l_partkey") % 9).alias("away_team"),
    )
    games = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").cast("timestamp").alias("game_date"),
        F.concat(F.lit("H"), F.col("o_custkey") % 9).alias("home_team"), F.concat(F.lit("A"), F.col("o_orderkey") % 9).alias("away_team"),
    )
    return I.external_game_ids(provider, games).select("external_game_id", "game_id")


# -- reviews and stability -----------------------------------------------------------------


@query(rounded_sql("""SELECT game_id, eh + ea > 8 AS picked_home, hs <> as_ AS review_scored, CASE WHEN hs > as_ THEN 'H' WHEN as_ > hs THEN 'A' ELSE '' END AS review_actual_winner,
  CASE WHEN hs <> as_ THEN (eh + ea > 8) = (hs > as_) END AS review_win_correct, abs(eh + ea - hs - as_) AS review_total_abs_error FROM t""",
  ["review_total_abs_error"], with_=TOTALS))
def prediction_review(spark, folder):
    from pregame.plans.predictions import review

    t = _totals(spark, folder)
    home = F.col("expected_home_runs") + F.col("expected_away_runs") > 8
    predictions = t.select("game_id", F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), F.when(home, "H").otherwise("A").alias("win_pick"),
                           home.alias("picked_home"), F.col("expected_home_runs").alias("pred_home_score"), F.col("expected_away_runs").alias("pred_away_score"))
    out = review(predictions, t.select("game_id", "home_score", "away_score"))["review"]
    return rounded(out.select("game_id", "picked_home", "review_scored", "review_actual_winner", "review_win_correct", "review_total_abs_error"))


@query(rounded_sql("""SELECT feature, count(DISTINCT season) AS top_count, avg(rank) AS mean_rank, avg(v) AS mean_value FROM (
  SELECT *, row_number() OVER (PARTITION BY season ORDER BY v DESC, feature) AS rank FROM (
    SELECT year(o_orderdate) AS season, CAST(o_custkey % 100 AS VARCHAR) AS feature, sum(floor(o_totalprice)) AS v FROM orders GROUP BY ALL))
  WHERE rank <= 20 GROUP BY feature""", ["mean_rank", "mean_value"]))
def feature_stability(spark, folder):
    from pregame.plans.predictions import top_stability

    rows = read(spark, folder, "orders").groupBy(
        F.year("o_orderdate").alias("holdout_season"), (F.col("o_custkey") % 100).cast("string").alias("feature")
    ).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("importance"))
    return rounded(top_stability(rows, "importance", 20))


@query("""SELECT o_orderkey, array_to_string(list_transform(list_sort(list_filter([
  {'s': abs(a), 't': 'sp_fip_diff:' || CASE WHEN a >= 0 THEN 'home' ELSE 'away' END}, {'s': abs(b), 't': 'lineup_woba_diff:' || CASE WHEN b >= 0 THEN 'home' ELSE 'away' END},
  {'s': abs(c), 't': 'team_woba_diff:' || CASE WHEN c >= 0 THEN 'home' ELSE 'away' END}], lambda x: x.s IS NOT NULL), 'DESC')[1:2], lambda x: x.t), ',') AS reasons
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 11 - 5.0 END AS a, o_custkey % 7 - 3.0 AS b, o_custkey % 13 - 6.0 AS c FROM orders)""")
def key_reasons(spark, folder):
    from pregame.plans.predictions import key_reasons as reasons

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, folder, "orders").select("o_orderkey", F.when(k % 4 != 0, k % 11 - 5.0).alias("sp_fip_diff"),
                                                (c % 7 - 3.0).alias("lineup_woba_diff"), (c % 13 - 6.0).alias("team_woba_diff"))
    picked = reasons(["sp_fip_diff", "lineup_woba_diff", "team_woba_diff"], 2)
    return rows.select("o_orderkey", F.array_join(picked, ",").alias("reasons"))
