"""Scoring of upcoming games with trained models, reviews of past predictions, stability of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalars import zone_time
from pregame.operators import forecasts as X
from pregame.operators.joins import require_columns, with_missing
from pregame.plans import models as M

# Bands of the two over/under signals and the differences that may be given as reasons.
MARGIN_BANDS = (0.5, 1.5)
EDGE_BANDS = (0.03, 0.08)
REASON_COLUMNS = ["sp_fip_diff", "lineup_woba_diff", "bullpen_fatigue_diff", "team_woba_diff"]
IDENTITY = ["game_id", "game_date", "home_team", "away_team"]


def with_total_line(df: DataFrame, lines: DataFrame | None = None, constant: float | None = None, name: str = "total_line") -> DataFrame:
    """The game's own line, else the one in `lines`, else `constant`."""
    out = with_missing(df, {name: "double"})
    if lines is not None:
        require_columns(lines, ["game_id", "total_line"], "total lines")
        spare = lines.select("game_id", F.col("total_line").cast("double").alias("_line"))
        out = out.join(spare, "game_id", "left").withColumn(name, F.coalesce(name, "_line")).drop("_line")
    return out if constant is None else out.withColumn(name, F.coalesce(name, F.lit(float(constant))))


def _when_known(line: str, value: Column, empty: str | None = "") -> Column:
    return F.when(F.col(line).isNotNull(), value).otherwise(F.lit(empty))


def add_win_signal(df: DataFrame, model: M.Fitted, mode: str) -> DataFrame:
    out = model.score(df)
    p = F.col(M.PROBABILITY)
    return out.withColumns({
        "away_win_probability": 1 - p, "model_name": F.lit(model.name), "prediction_mode": F.lit(mode),
        "win_pick": F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team")),
    })


def add_runs_signal(df: DataFrame, home: M.Fitted, away: M.Fitted, bands: tuple[float, float] = MARGIN_BANDS) -> DataFrame:
    """Predicted scores, their margin to `total_line`, and the pass/lean/strong band of the margin."""
    out = away.score(home.score(df))
    score = lambda c: F.greatest(F.col(c), F.lit(0.0))
    out = out.withColumns({"pred_home_score": score("expected_home_runs"), "pred_away_score": score("expected_away_runs")})
    out = out.withColumn("pred_total", F.col("pred_home_score") + F.col("pred_away_score")).drop("expected_home_runs", "expected_away_runs")
    margin = F.col("pred_total") - F.col("total_line")
    return out.withColumns({
        "runs_ou_margin": margin, "runs_ou_pick": _when_known("total_line", F.when(margin > 0, "over").otherwise("under")),
        "runs_ou_confidence": _when_known("total_line", X.margin_rule(margin, *bands), None),
    })


def add_over_signal(df: DataFrame, model: M.Fitted, probability: str = "direct_prob_over", bands: tuple[float, float] = EDGE_BANDS) -> DataFrame:
    """Over probability of a directly trained model with the band of its distance from one half."""
    line = F.coalesce("market_total_line", "total_line") if "market_total_line" in df.columns else F.col("total_line")
    out = model.score(df.withColumn("market_total_line", line))
    p = F.col(probability)
    return out.withColumns({
        "direct_prob_under": 1 - p, "direct_ou_pick": F.when(p >= 0.5, "over").otherwise("under"),
        "direct_ou_edge": F.abs(p - 0.5), "direct_ou_confidence": X.margin_rule(p - 0.5, *bands),
    })


def add_results(df: DataFrame) -> DataFrame:
    """Actual winner and total for scored games, and whether each present signal was right."""
    home, away = F.col("home_score"), F.col("away_score")
    winner = F.when(home > away, F.col("home_team")).when(away > home, F.col("away_team"))
    out = df.withColumns({"actual_total": home + away, "actual_winner": winner})
    known = F.col("total_line").isNotNull() & F.col("actual_total").isNotNull()
    out = out.withColumn("actual_ou", F.when(known, F.when(F.col("actual_total") > F.col("total_line"), "over").otherwise("under")))
    if "win_pick" in out.columns:
        out = out.withColumn("win_correct", F.col("win_pick") == F.col("actual_winner"))
    if "pred_total" in out.columns:
        out = out.withColumn("total_abs_error", F.abs(F.col("pred_total") - F.col("actual_total")))
    picks = [s for s in ("runs", "direct") if f"{s}_ou_pick" in out.columns]
    return out.withColumns({f"{s}_ou_correct": F.when(known, F.col(f"{s}_ou_pick") == F.col("actual_ou")) for s in picks})


def predict_games(
    features: DataFrame, win: M.Fitted, runs: tuple[M.Fitted, M.Fitted], over: M.Fitted | None = None, mode: str = "confirmed_lineup",
    lines: DataFrame | None = None, total_line: float | None = None,
) -> DataFrame:
    """Win, score and over/under signals of every game side by side."""
    rows = features if "total_line" in features.columns else with_missing(features, {"market_total_line": "double"}).withColumn(
        "total_line", F.col("market_total_line"))
    rows = with_total_line(rows, lines, total_line)
    out = add_runs_signal(add_win_signal(rows, win, mode), *runs)
    out = add_over_signal(out, over) if over is not None else out
    return add_results(out) if {"home_score", "away_score"} <= set(out.columns) else out


def final_win_model(df: DataFrame, name: str, features: Sequence[str], seed: int = 42) -> M.Fitted:
    return M.fit_classifier(name, df, features, seed=seed)


def final_runs_models(df: DataFrame, name: str, features: Sequence[str], seed: int = 42) -> tuple[M.Fitted, M.Fitted]:
    scored = df.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return (M.fit_regressor(name, scored, features, "home_score", seed, "expected_home_runs"),
            M.fit_regressor(name, scored, features, "away_score", seed + 1, "expected_away_runs"))


def final_over_model(df: DataFrame, name: str, features: Sequence[str], lines: DataFrame | None = None, constant: float | None = None, seed: int = 42) -> M.Fitted:
    """Trained on whether the actual total beat the line; the closing line never serves as a feature."""
    rows = with_total_line(df, lines, constant, "market_total_line")
    total = F.col("home_score") + F.col("away_score")
    rows = rows.withColumn("market_total_over", (total > F.col("market_total_line")).cast("int")).filter(F.col("market_total_over").isNotNull())
    kept = [f for f in features if f not in ("market_closing_total_line", "market_total_over")]
    return M.fit_classifier(name, rows, kept, target="market_total_over", seed=seed, out="direct_prob_over")


def key_reasons(columns: Sequence[str] = REASON_COLUMNS, most: int = 4) -> Column:
    """Up to `most` differences by size, each as `<column>:home` or `<column>:away`."""
    offers = [
        F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)).alias("size"), F.concat(F.lit(f"{c}:"), F.when(F.col(c) >= 0, "home").otherwise("away")).alias("text")))
        for c in columns
    ]
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*offers)), asc=False), 1, most)
    return F.transform(ranked, lambda r: r["text"])


def readable(predictions: DataFrame, schedule: DataFrame | None = None, zone: str = "Asia/Seoul", lean: float = 0.55, strong: float = 0.60) -> DataFrame:
    """Local time, matchup, winner-consistent score and recommendation per game."""
    out = predictions
    if schedule is not None:
        out = out.join(schedule.select("game_id", *[c for c in ("status", "home_sp_name", "away_sp_name") if c in schedule.columns]), "game_id", "left")
    out = X.consistent_score(out, "pred_home_score", "pred_away_score", M.PROBABILITY)
    home_picked = F.col("win_pick") == F.col("home_team")
    confidence = F.when(home_picked, F.col(M.PROBABILITY)).otherwise(1 - F.col(M.PROBABILITY))
    own = F.when(home_picked, F.col("predicted_home_score")).otherwise(F.col("predicted_away_score"))
    other = F.when(home_picked, F.col("predicted_away_score")).otherwise(F.col("predicted_home_score"))
    return out.select(
        "game_id", zone_time("game_date", zone).alias("local_time"), F.concat_ws(" @ ", "away_team", "home_team").alias("matchup"),
        F.concat(F.col("win_pick"), F.lit(" "), own, F.lit(":"), other).alias("score_prediction"),
        F.when(confidence >= strong, "strong").when(confidence >= lean, "lean").otherwise("pass").alias("recommendation"),
        confidence.alias("pick_confidence"), "pred_home_score", "pred_away_score",
        *[c for c in ("status", "home_sp_name", "away_sp_name") if c in out.columns],
    )


def review(predictions: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Predictions next to final scores (game_id, home_score, away_score), and a one-row summary."""
    final = scores.select("game_id", F.col("home_score").cast("double").alias("review_home_score"), F.col("away_score").cast("double").alias("review_away_score"))
    out = predictions.join(final, "game_id", "left")
    home, away = F.col("review_home_score"), F.col("review_away_score")
    out = out.withColumn("review_scored", F.coalesce(home != away, F.lit(False)))
    out = out.withColumn("review_actual_winner", F.when(F.col("review_scored"), F.when(home > away, F.col("home_team")).otherwise(F.col("away_team"))).otherwise(""))
    out = out.withColumn("review_win_correct", F.when(F.col("review_scored"), F.col("win_pick") == F.col("review_actual_winner")))
    if {"pred_home_score", "pred_away_score"} <= set(out.columns):
        error = F.abs(F.col("pred_home_score") + F.col("pred_away_score") - home - away)
        out = out.withColumns({"review_actual_total": home + away, "review_total_abs_error": error})
    hits = F.col("review_win_correct").cast("double")
    values = [F.count(F.lit(1)).alias("games"), F.count_if("review_scored").alias("scored_games"),
              F.coalesce(F.sum(hits), F.lit(0.0)).alias("win_hits"), F.avg(hits).alias("win_accuracy")]
    if "review_total_abs_error" in out.columns:
        values.append(F.avg(F.when(F.col("review_scored"), F.col("review_total_abs_error"))).alias("total_mae"))
    return {"review": out, "summary": out.agg(*values)}


def top_stability(importances: DataFrame, value: str, top: int = 20) -> DataFrame:
    """How often each feature is among a season's top ones, with its mean rank and value there."""
    rank = F.row_number().over(Window.partitionBy("holdout_season").orderBy(F.desc(value), "feature"))
    best = importances.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.groupBy("feature").agg(
        F.count_distinct("holdout_season").alias("top_count"), F.avg("rank").alias("mean_rank"), F.avg(value).alias("mean_value"))


def stable_and_watch(first: DataFrame, second: DataFrame, often: int = 3) -> dict[str, DataFrame]:
    """Features stable in both rankings, and features seen only once in either."""
    pick = lambda df, condition: df.filter(condition).select("feature")
    many, once = F.col("top_count") >= often, F.col("top_count") == 1
    return {"stable": pick(first, many).intersect(pick(second, many)), "watch": pick(first, once).union(pick(second, once)).distinct()}
