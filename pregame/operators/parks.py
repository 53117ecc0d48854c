"""Venue run and home-run factors from earlier seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalars import safe_divide, zero_filled
from pregame.operators.joins import require_columns


def park_factors(games: DataFrame, batting: DataFrame, lag_seasons: int = 1, min_games: int = 20) -> DataFrame:
    """Per-game runs and home runs of a venue over those of its season, to be used `lag_seasons` later.

    Season totals are sums of the venue totals, so the games are aggregated once.
    """
    require_columns(games, ["game_id", "season", "venue_id", "venue_name", "home_score", "away_score"], "games")
    require_columns(batting, ["home_runs"], "batting")
    homers = batting.groupBy("game_id").agg(F.sum(zero_filled(F.col("home_runs").cast("double"))).alias("homers"))
    runs = F.col("home_score").cast("double") + F.col("away_score").cast("double")
    played = (
        games.select("game_id", F.col("season").cast("int").alias("season"), "venue_id", "venue_name", runs.alias("runs"))
        .dropna(subset=["season", "venue_id", "runs"])
        .join(homers, "game_id", "left")
    )
    # One row per game and venue first, so that distinct games can be counted by plain sums.
    per_game = played.groupBy("season", "venue_id", "venue_name", "game_id").agg(
        F.sum("runs").alias("runs"), F.sum(zero_filled("homers")).alias("homers")
    )
    venue = per_game.groupBy("season", "venue_id", "venue_name").agg(
        F.count(F.lit(1)).alias("source_games"), F.sum("runs").alias("runs"), F.sum("homers").alias("homers")
    )
    season = per_game.groupBy("season").agg(
        F.count_distinct("game_id").alias("all_games"), F.sum("runs").alias("all_runs"), F.sum("homers").alias("all_homers")
    )
    rate = lambda total, n: F.col(total) / F.col(n)
    known = venue.filter(F.col("venue_name").isNotNull()).join(season, "season")
    return known.filter(F.col("source_games") >= min_games).select(
        "venue_id",
        "venue_name",
        (F.col("season") + lag_seasons).alias("season"),
        F.col("season").alias("source_season"),
        "source_games",
        (rate("runs", "source_games") / rate("all_runs", "all_games")).alias("park_factor_run"),
        safe_divide(rate("homers", "source_games"), rate("all_homers", "all_games")).alias("park_factor_hr"),
        F.lit(f"empirical_previous_{lag_seasons}_season").alias("source"),
    )
