"""Models trained on features derived from orders and lines; only closed-form fits have a SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pregame.catalog import tables as T
from pregame.catalog.base import query, rounded, rounded_sql
from pregame.operators import ordered as O
from pregame.operators import forecasts as X
from pregame.plans import features as P
from pregame.plans import models as M
from pregame.session import settle

FEATURES = ["home_form", "away_form", "home_runs_avg", "away_runs_avg", "form_gap"]


def _sheet(spark, folder):
    """Games with each side's form over the ten games before."""
    rows = P.team_games(T.games(spark, folder))
    form = O.running_columns(rows, ["team", "season"], P.game_order(), {
        "form": O.last_rows("win", 10), "runs_avg": O.last_rows("runs_for", 10),
    })
    side = lambda flag, name: form.filter(F.col("is_home") == flag).select(
        "game_id", F.col("form").alias(f"{name}_form"), F.col("runs_avg").alias(f"{name}_runs_avg"))
    out = T.games(spark, folder).join(side(1, "home"), "game_id").join(side(0, "away"), "game_id")
    return out.withColumns({
        "form_gap": F.col("home_form") - F.col("away_form"),
        "home_team_win": (F.col("home_score") > F.col("away_score")).cast("int"),
    })


@query()
def elo_probabilities(spark, folder):
    """One chain per season."""
    games = _sheet(spark, folder)
    return rounded(M.elo(games, ["season"]))


@query()
def season_holdout_forecasts(spark, folder):
    return M.oof_predictions(_sheet(spark, folder), ["elo", "logistic", "logistic_l1"], None, FEATURES)


@query()
def season_holdout_metrics(spark, folder):
    oof = M.oof_predictions(_sheet(spark, folder), ["elo", "logistic"], None, FEATURES)
    return X.probability_metrics(oof, "home_team_win", "home_win_probability", ["holdout_season", "model_name"])


def _ridge_sql(d: int) -> str:
    """Ridge fits of all earlier seasons: moments of the filled rows, then Gauss-Jordan steps on [A | home, away]."""
    ks = range(1, d + 1)
    each = lambda text: "[" + ", ".join(text.format(k=k) for k in ks) + "]"
    scaled = "(z[{k}] - mu[{k}]) / sd[{k}]"
    cell = lambda i, j: f"sum({scaled.format(k=i)} * {scaled.format(k=j)}) + {float(i == j)}"
    rows = ", ".join("[" + ", ".join([*[cell(i, j) for j in ks], *[f"sum({scaled.format(k=i)} * ({y} - y{y[0]}))" for y in ("home_score", "away_score")]]) + "]" for i in ks)
    forecast = lambda column, y: f"greatest({y} + " + " + ".join(
        f"m[{k}][{column}] * (coalesce(x[{k}], fill[{k}]) - mu[{k}]) / sd[{k}]" for k in ks) + ", 0.0)"
    return f"""cuts AS (SELECT DISTINCT season AS cut FROM games WHERE season > (SELECT min(season) FROM games)),
 earlier AS (SELECT cut, f.* FROM cuts JOIN f ON f.season < cut),
 fills AS (SELECT cut, {each("median(x[{k}])")} AS fill FROM earlier GROUP BY cut),
 filled AS (SELECT cut, home_score, away_score, {each("coalesce(x[{k}], fill[{k}])")} AS z FROM earlier JOIN fills USING (cut)),
 moments AS (SELECT cut, {each("avg(z[{k}])")} AS mu,
   {each("CASE WHEN stddev_pop(z[{k}]) > 0 THEN stddev_pop(z[{k}]) ELSE 1.0 END")} AS sd, avg(home_score) AS yh, avg(away_score) AS ya FROM filled GROUP BY cut),
 system AS (SELECT cut, [{rows}] AS m FROM filled JOIN moments USING (cut) GROUP BY cut),
 steps AS (SELECT cut, 1 AS k, m FROM system UNION ALL
   SELECT cut, k + 1, list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + 3}), lambda j:
     CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM steps WHERE k <= {d}),
 forecasts AS (SELECT f.game_id, f.season, {forecast(d + 1, "yh")} AS expected_home_runs, {forecast(d + 2, "ya")} AS expected_away_runs
   FROM f LEFT JOIN (SELECT * FROM steps WHERE k = {d + 1}) s ON s.cut = f.season LEFT JOIN moments mo ON mo.cut = f.season LEFT JOIN fills fi ON fi.cut = f.season)"""


SHEET_SQL = f"""{T.GAMES_SQL}, {T.TEAM_GAMES_SQL},
 side AS (SELECT game_id, is_home, avg(win) OVER w AS form, avg(runs_for) OVER w AS runs_avg FROM team_games
   WINDOW w AS (PARTITION BY team, season ORDER BY game_date, game_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT g.game_id, g.season, g.home_score, g.away_score, [h.form, a.form, h.runs_avg, a.runs_avg, h.form - a.form] AS x
   FROM games g JOIN side h ON g.game_id = h.game_id AND h.is_home = 1 JOIN side a ON g.game_id = a.game_id AND a.is_home = 0)"""


@query(rounded_sql("""SELECT game_id, season, CASE WHEN season > (SELECT min(season) FROM games) THEN expected_home_runs END AS expected_home_runs,
  CASE WHEN season > (SELECT min(season) FROM games) THEN expected_away_runs END AS expected_away_runs,
  CASE WHEN season > (SELECT min(season) FROM games) THEN expected_home_runs + expected_away_runs END AS expected_total_runs,
  CASE WHEN season > (SELECT min(season) FROM games) THEN expected_home_runs - expected_away_runs END AS expected_run_diff FROM forecasts""",
  M.RUNS_COLUMNS, with_=f"RECURSIVE {SHEET_SQL}, {_ridge_sql(len(FEATURES))}"))
def expected_run_forecasts(spark, folder):
    """Ridge fits of both sides for every season from one pass of sums, each on all earlier seasons."""
    out = M.with_expected_runs(settle(_sheet(spark, folder)), None, "ridge", FEATURES)
    return rounded(out.select("game_id", "season", *M.RUNS_COLUMNS))


@query("""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER () AS c FROM orders)
  SELECT o_orderkey, n <= greatest(1, CAST(floor(c * 0.8) AS BIGINT)) AS is_train FROM s""")
def temporal_split(spark, folder):
    rows = T.read(spark, folder, "orders").select("o_orderkey", "o_orderdate", F.lit(1).alias("y"))
    train, test = M.temporal_split(rows, date="o_orderdate", key="o_orderkey", target="y")
    mark = lambda df, flag: df.select("o_orderkey", F.lit(flag).alias("is_train"))
    return mark(train, True).unionByName(mark(test, False))


@query("SELECT o_orderkey, year(o_orderdate) < 2001 AS is_train FROM orders")
def season_split(spark, folder):
    rows = T.read(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.lit(1).alias("y"))
    train, test = M.holdout(rows, target="y")
    mark = lambda df, flag: df.select("o_orderkey", F.lit(flag).alias("is_train"))
    return mark(train, True).unionByName(mark(test, False))
