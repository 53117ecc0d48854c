"""Scoring of probability forecasts, calibration, pick rules and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.operators.joins import require_columns
from pregame.operators.medians import group_text, middles, small_table
from pregame.operators.ordered import latest_per_key
from pregame.schemas import THRESHOLDS
from pregame.session import settle

# Clipping of probabilities and the totals lines that are always scored.
PROBABILITY_FLOOR = 1e-6
TOTAL_LINES = (6.5, 7.5, 8.5, 9.5, 10.5)
RULES = ("pass", "lean", "strong")


def _percent(threshold: float) -> int:
    return int(threshold * 100)


def probability_metrics(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Log loss, Brier score, accuracy and, per confidence threshold, accuracy and coverage.

    One aggregate with partial sums per task, for the whole frame or per key.
    """
    prob = F.least(F.greatest(F.col(p).cast("double"), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    truth = F.col(y).cast("int")
    hit = ((prob >= 0.5).cast("int") == truth).cast("double")
    confidence = F.greatest(prob, 1 - prob)
    values = {
        "log_loss": -F.avg(F.when(truth == 1, F.log(prob)).otherwise(F.log(1 - prob))),
        "brier_score": F.avg(F.pow(prob - truth, 2)),
        "accuracy": F.avg(hit),
        "n_games": F.count(F.lit(1)).cast("double"),
    }
    for t in thresholds:
        values[f"accuracy_conf_{_percent(t)}"] = F.avg(F.when(confidence >= t, hit))
        values[f"coverage_conf_{_percent(t)}"] = F.avg((confidence >= t).cast("double"))
    return df.groupBy(*by).agg(*[v.alias(n) for n, v in values.items()])


def calibration(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Predicted and actual rate per probability bin; bins without rows are kept."""
    prob = F.col(p).cast("double")
    inside = F.greatest(F.ceil(prob * bins), F.lit(1)).cast("int")
    binned = df.filter(prob.between(0, 1)).groupBy(*by, inside.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_games"), F.avg(prob).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual")
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(binned, [*by, "bin"], "left").select(
        *by,
        "bin",
        ((F.col("bin") - 1) / bins).alias("lower"),
        (F.col("bin") / bins).alias("upper"),
        F.coalesce("n_games", F.lit(0)).alias("n_games"),
        F.col("predicted").alias("predicted_home_win_rate"),
        F.col("actual").alias("actual_home_win_rate"),
        (F.col("predicted") - F.col("actual")).alias("calibration_error"),
    )


def selection_rules(
    metrics: DataFrame, thresholds: Sequence[float] = THRESHOLDS, min_coverage: float = 0.10
) -> DataFrame:
    """Per season the model with least log loss and, per confidence band, the most accurate one."""
    require_columns(metrics, ["holdout_season", "model_name", "log_loss", "brier_score"], "metrics")
    choice = lambda rule, metric, value, coverage, rank: F.struct(
        F.lit(rule).alias("rule_name"), F.lit(metric).alias("selection_metric"), value.alias("selection_value"),
        coverage.alias("coverage"), rank.alias("rank"),
    )
    name = F.col("model_name")
    # Smaller rank is better: sort keys are negated where more is better.
    ranks = lambda *keys: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    loss = F.col("log_loss")
    offers = [choice("overall_log_loss", "log_loss", loss, F.lit(1.0), ranks(loss, F.col("brier_score"), F.lit(0.0)))]
    for t in thresholds:
        accuracy, coverage = f"accuracy_conf_{_percent(t)}", f"coverage_conf_{_percent(t)}"
        if accuracy in metrics.columns and coverage in metrics.columns:
            a, c = F.col(accuracy), F.col(coverage)
            allowed = (F.coalesce(c, F.lit(0.0)) >= min_coverage) & a.isNotNull()
            offer = choice(f"confidence_{_percent(t)}", accuracy, a, c, ranks(-a, -c, loss))
            offers.append(F.when(allowed, offer))
    flat = metrics.select("holdout_season", name, F.explode(F.array_compact(F.array(*offers))).alias("o"))
    flat = flat.select("holdout_season", F.col("model_name").alias("selected_model"), "o.*")
    best = latest_per_key(flat, ["holdout_season", "rule_name"], ["rank", "selected_model"], newest=False)
    return best.select(
        "holdout_season", "rule_name", "selected_model", "selection_metric", "selection_value", "coverage"
    )


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ascending `order` (best model per season)."""
    return latest_per_key(df, keys, order, newest=False)


# -- picks ---------------------------------------------------------------------------------


def _check_thresholds(lean: float, strong: float) -> None:
    if lean < 0.5:
        raise ValueError("lean threshold must be at least 0.5")
    if strong < lean:
        raise ValueError("strong threshold must be greater than or equal to lean threshold")


def _rule(confidence: Column, lean: float, strong: float) -> Column:
    return F.when(confidence >= strong, "strong").when(confidence >= lean, "lean").otherwise("pass")


def _correct(rule: str, pick: str, winner: str) -> Column:
    scored = F.col(winner).isNotNull() & (F.trim(F.col(winner)) != "")
    return F.when((F.col(rule) != "pass") & scored, F.col(pick) == F.col(winner))


def win_picks(
    df: DataFrame,
    probability: str = "home_win_probability",
    home: str = "home_team",
    away: str = "away_team",
    winner: str = "actual_winner",
    lean: float = 0.55,
    strong: float = 0.60,
) -> DataFrame:
    """Add confidence, raw pick, pass/lean/strong rule and, for scored rows, correctness."""
    _check_thresholds(lean, strong)
    require_columns(df, [probability, home, away], "predictions")
    p = F.col(probability)
    confidence = F.greatest(p, 1 - p)
    out = df.withColumns({
        "win_confidence": confidence,
        "win_edge": confidence - 0.5,
        "raw_win_pick": F.when(p >= 0.5, F.col(home)).otherwise(F.col(away)),
        "win_pick_rule": _rule(confidence, lean, strong),
    })
    out = out.withColumn("rule_win_pick", F.when(F.col("win_pick_rule") == "pass", "").otherwise(F.col("raw_win_pick")))
    if winner in df.columns:
        out = out.withColumn("rule_win_correct", _correct("win_pick_rule", "rule_win_pick", winner))
    return out


def agreement_picks(
    oof: DataFrame, primary: str, challengers: Sequence[str], lean: float = 0.55, strong: float = 0.60
) -> DataFrame:
    """Keep the primary model's pick only where every present challenger picks the same side.

    Challengers are brought next to the primary row by one aggregation over the game key.
    """
    require_columns(oof, ["model_name", "home_win_probability", "home_team", "away_team"], "oof")
    keys = [c for c in ("holdout_season", "game_id") if c in oof.columns]
    if "game_id" not in keys:
        keys = [c for c in ("holdout_season", "game_date", "home_team", "away_team") if c in oof.columns]
    names = {r.model_name for r in oof.select("model_name").distinct().collect()}
    if primary not in names:
        raise ValueError(f"primary model {primary!r} is not present")
    present = [c for c in challengers if c in names]
    out = win_picks(oof.filter(F.col("model_name") == primary), lean=lean, strong=strong)
    if present:
        others = win_picks(oof.filter(F.col("model_name").isin(*present)), lean=lean, strong=strong)
        wide = []
        for c in present:
            label = c.replace("/", "_")
            is_c = F.col("model_name") == c
            wide += [
                F.max(F.when(is_c, F.col("raw_win_pick"))).alias(f"{label}_raw_win_pick"),
                F.max(F.when(is_c, F.col("win_confidence"))).alias(f"{label}_win_confidence"),
            ]
        out = out.join(others.groupBy(*keys).agg(*wide), keys, "left")
    labels = [c.replace("/", "_") for c in present]
    agrees = {
        f"{c}_agrees": F.coalesce(F.col(f"{c}_raw_win_pick") == F.col("raw_win_pick"), F.lit(False)) for c in labels
    }
    out = out.withColumns(agrees) if agrees else out
    count = sum((F.col(c).cast("int") for c in agrees), F.lit(0))
    out = out.withColumns({
        "agreement_models": count,
        "agreement_required": F.lit(len(present)),
        "models_agree": count == len(present),
    })
    out = out.withColumn("win_pick_rule", F.when(F.col("models_agree"), F.col("win_pick_rule")).otherwise("pass"))
    out = out.withColumn("rule_win_pick", F.when(F.col("win_pick_rule") == "pass", "").otherwise(F.col("raw_win_pick")))
    if "actual_winner" in oof.columns:
        out = out.withColumn("rule_win_correct", _correct("win_pick_rule", "rule_win_pick", "actual_winner"))
    return out


def margin_rule(margin: Column, lean: float, strong: float) -> Column:
    size = F.abs(margin)
    return F.when(size > strong, "strong").when(size > lean, "lean").otherwise("pass")


def total_picks(
    df: DataFrame,
    predicted: str = "expected_total_runs",
    line: str = "total_line",
    actual: str = "actual_total",
    lean: float = 0.5,
    strong: float = 1.5,
) -> DataFrame:
    """Over/under picks out of the distance between a predicted total and its line.

    A game that lands on its line counts as under; without a line there is no pick.
    """
    if strong < lean:
        raise ValueError("strong margin must be greater than or equal to lean margin")
    margin = F.col(predicted) - F.col(line)
    out = df.withColumns({
        "ou_margin": margin,
        "ou_size": F.abs(margin),
        "raw_ou_pick": F.when(margin > 0, "over").when(margin <= 0, "under").otherwise(""),
        "ou_pick_rule": margin_rule(margin, lean, strong),
    })
    out = out.withColumn("rule_ou_pick", F.when(F.col("ou_pick_rule") == "pass", "").otherwise(F.col("raw_ou_pick")))
    if actual in df.columns:
        beat = F.when(F.col(actual) > F.col(line), "over").when(F.col(actual) <= F.col(line), "under")
        out = out.withColumn("rule_ou_correct", F.when(F.col("ou_pick_rule") != "pass", F.col("rule_ou_pick") == beat))
    return out


def summarize_picks(
    df: DataFrame,
    by: Sequence[str] = (),
    rule: str = "win_pick_rule",
    correct: str = "rule_win_correct",
    confidence: str = "win_confidence",
    mean_name: str = "avg_confidence",
) -> DataFrame:
    """Games, picks, hits, accuracy, coverage and mean confidence for pass, lean, strong, actionable."""
    require_columns(df, [rule], "predictions")
    known = correct in df.columns
    picked = F.col(correct).isNotNull() if known else F.lit(True)
    hit = F.sum(F.when(picked, F.col(correct).cast("double"))) if known else F.lit(None).cast("double")
    mean = F.sum(confidence) if confidence in df.columns else F.lit(None).cast("double")
    scored = F.count(F.col(confidence)) if confidence in df.columns else F.lit(0)
    per_rule = df.groupBy(*by, F.col(rule).alias("rule")).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(picked).alias("picks"), hit.alias("hits"),
        mean.alias("total"), scored.alias("known"),
    )
    # Everything below works on a handful of rows per key.
    spread = per_rule.withColumn(
        "rule", F.explode(F.when(F.col("rule") == "pass", F.array("rule")).otherwise(F.array("rule", F.lit("actionable"))))
    )
    summed = spread.groupBy(*by, "rule").agg(*[F.sum(c).alias(c) for c in ("games", "picks", "hits", "total", "known")])
    totals = per_rule.groupBy(*by).agg(F.sum("games").alias("all_games"))
    every = totals.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in (*RULES, "actionable")])))
    joined = every.join(summed, [*by, "rule"], "left")
    picks = F.coalesce("picks", F.lit(0))
    hits = F.coalesce("hits", F.lit(0.0)) if known else F.lit(None).cast("double")
    return joined.select(
        *by,
        "rule",
        F.coalesce("games", F.lit(0)).alias("games"),
        picks.alias("picks"),
        hits.alias("hits"),
        F.when(picks > 0, hits / picks).alias("accuracy"),
        (F.coalesce("games", F.lit(0)) / F.col("all_games")).alias("coverage"),
        F.when(F.col("known") > 0, F.col("total") / F.col("known")).alias(mean_name),
    )


def daily_rules(df: DataFrame, date: str, rule: str = "win_pick_rule", correct: str = "rule_win_correct") -> DataFrame:
    """Per date the number of pass, lean and strong rows and the actionable hit rate."""
    actionable = (F.col(rule) != "pass") & F.col(correct).isNotNull()
    hits = F.sum(F.when(actionable, F.col(correct).cast("double")))
    picks = F.count_if(actionable)
    counts = [F.count_if(F.col(rule) == r).alias(f"{r}_games") for r in RULES]
    return df.groupBy(date).agg(
        F.count(F.lit(1)).alias("games"), *counts, picks.alias("picks"), F.coalesce(hits, F.lit(0.0)).alias("hits"),
        F.when(picks > 0, hits / picks).alias("accuracy"),
    )


# -- runs ----------------------------------------------------------------------------------


def runs_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors of predicted home, away, total and difference of runs."""
    home, away = F.col("expected_home_runs"), F.col("expected_away_runs")
    true_home, true_away = F.col("home_score"), F.col("away_score")
    total_error = F.abs(home + away - true_home - true_away)
    within = {f"total_within_{k}": F.avg((total_error <= float(k)).cast("double")) for k in (1, 2, 3)}
    values = {
        "home_mae": F.avg(F.abs(home - true_home)),
        "away_mae": F.avg(F.abs(away - true_away)),
        "total_mae": F.avg(total_error),
        "total_rmse": F.sqrt(F.avg(F.pow(total_error, 2))),
        **within,
        "run_diff_mae": F.avg(F.abs((true_home - true_away) - (home - away))),
        "n_games": F.count(F.lit(1)).cast("double"),
    }
    return df.groupBy(*by).agg(*[v.alias(n) for n, v in values.items()])


def total_line_metrics(df: DataFrame, by: Sequence[str] = (), lines: Sequence[float] = TOTAL_LINES) -> DataFrame:
    """Over/under accuracy against fixed totals; every row is spread over the few lines in place."""
    spread = df.withColumn("total_line", F.explode(F.array(*[F.lit(float(x)) for x in lines])))
    predicted = F.col("expected_home_runs") + F.col("expected_away_runs")
    actual = F.col("home_score") + F.col("away_score")
    margin, line = F.abs(predicted - F.col("total_line")), F.col("total_line")
    share = lambda condition: F.avg(condition.cast("double"))
    values = {
        "ou_accuracy": share((predicted > line) == (actual > line)),
        "over_pick_rate": share(predicted > line),
        "actual_over_rate": share(actual > line),
        "mean_abs_margin": F.avg(margin),
        "pass_rate_0_5": share(margin <= 0.5),
        "lean_or_strong_rate_0_5": share(margin > 0.5),
        "strong_rate_1_5": share(margin > 1.5),
        "n_games": F.count(F.lit(1)).cast("double"),
    }
    return spread.groupBy(*by, "total_line").agg(*[v.alias(n) for n, v in values.items()])


def leaderboard(df: DataFrame, by: Sequence[str], metrics: Sequence[str], wins: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and median per metric; share of rows below zero for `wins`.

    Medians come from narrowed histograms (`operators.medians`), so no task holds a group; `df` is written once.
    The groups, models or variants, are few.
    """
    df = settle(df.select(*dict.fromkeys([*by, *metrics, *wins])))
    values = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        values += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    values += [F.avg((F.col(w) < 0).cast("double")).alias(f"{w}_win_rate") for w in wins]
    out = df.groupBy(*by).agg(*values).withColumn("_g", group_text(by))
    found = middles(df, metrics, by)
    lines = [(g, *[sum(found[g, m]) / 2 if (g, m) in found else None for m in metrics]) for g in {g for g, _ in found}]
    medians = small_table(df.sparkSession, lines, [("_g", pa.string()), *[(f"{m}_median", pa.float64()) for m in metrics]])
    order = [*by, "runs", *[f"{m}_{kind}" for m in metrics for kind in ("mean", "std", "median")], *[f"{w}_win_rate" for w in wins]]
    return out.join(medians, "_g", "left").select(*order)


def variant_summary(runs: dict[str, DataFrame], by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Leaderboard rows over several labelled runs together, with columns `variant` and `by`."""
    stacked = None
    for label, df in runs.items():
        part = df.withColumn("variant", F.lit(label))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return leaderboard(stacked, ["variant", *by], metrics)


def best(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first `rows` rows in ascending `order`, NULL last; Spark keeps that many per task."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(rows)


def consistent_score(df: DataFrame, home: str, away: str, probability: str) -> DataFrame:
    """Rounded scores whose winner is the picked side: the picked side gets loser + 1 if needed."""
    h, a = F.bround(F.greatest(F.col(home), F.lit(0.0)), 0), F.bround(F.greatest(F.col(away), F.lit(0.0)), 0)
    picks_home = F.col(probability) >= 0.5
    return df.withColumns({
        "predicted_home_score": F.when(picks_home & (h <= a), a + 1).otherwise(h).cast("int"),
        "predicted_away_score": F.when(~picks_home & (a <= h), h + 1).otherwise(a).cast("int"),
    })
