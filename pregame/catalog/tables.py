"""Standard tables derived from the star-schema test tables.

An order is a game: the customer's nation plays the nation of the order's lowest-numbered
supplier. Line rows are batting logs, (order, supplier) groups are pitching logs. Every stat is an
integer function of the row, so sums are exact. The SQL twins below are the same definitions for
the reference query engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.session import configure


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


Table = Callable[..., DataFrame]
_shared: dict[tuple[str, str, str], DataFrame] = {}


def shared(build: Table) -> Table:
    """Keep a derived table for the session, as many queries read the same one.

    It is held in memory and on disk and can be rebuilt from the source, so a lost executor
    costs time only. A query that reads a table once takes `once`, the plan itself: only the columns that it
    needs are made then, and nothing is kept.
    """

    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, build.__name__)
        if key not in _shared:
            _shared[key] = build(spark, folder).persist()
        return _shared[key]

    get.__doc__ = build.__doc__
    get.once = build
    return get


def _mod(value: Column, n: int, offset: int = 0) -> Column:
    return (value % n + offset).cast("double")


@shared
def games(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.count(F.lit(1)).alias("n"),
        F.min("l_suppkey").alias("away_sp"),
        F.max("l_suppkey").alias("home_sp"),
    )
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nation = read(spark, folder, "nation").select("n_nationkey", "n_name")
    customer = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("home_team"), F.col("n_nationkey").alias("venue")
    )
    away = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("away_team")
    )
    joined = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(home, F.col("o_custkey") == F.col("c_custkey"))
        .join(away, F.col("away_sp") == F.col("s_suppkey"))
        # A nation that plays itself sends its second team away.
        .withColumn("away_team", F.when(F.col("home_team") == F.col("away_team"), F.concat("away_team", F.lit(" II"))).otherwise(F.col("away_team")))
    )
    v = F.col("venue")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("game_id"),
        F.col("o_orderdate").cast("timestamp").alias("game_date"),
        F.year("o_orderdate").alias("season"),
        "home_team",
        "away_team",
        F.col("home_sp").cast("string").alias("home_sp_id"),
        F.col("away_sp").cast("string").alias("away_sp_id"),
        (F.col("q") % 11).cast("double").alias("home_score"),
        ((F.col("q") * 7 + F.col("n")) % 9).cast("double").alias("away_score"),
        v.cast("string").alias("venue_id"),
        (20.0 + v).alias("venue_latitude"),
        (-120.0 + 3.0 * v).alias("venue_longitude"),
        F.bround((-120.0 + 3.0 * v) / 15.0, 0).alias("venue_timezone_offset"),
    )


def _lines_of_games(spark: SparkSession, folder: str, columns: list[str], of: Table | None = None) -> DataFrame:
    g = (of or games)(spark, folder).select("game_id", "game_date", "season", "home_team", "away_team", "home_sp_id", "away_sp_id")
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("game_id"), *columns)
    return lines.join(g, "game_id")


@shared
def batting_logs(spark: SparkSession, folder: str, of: Table | None = None) -> DataFrame:
    """One row per (order, part, side); the side follows the part number's parity."""
    rows = _lines_of_games(spark, folder, ["l_partkey", "l_quantity", "l_linenumber", "l_returnflag"], of)
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    team = F.when(F.col("l_partkey") % 2 == 0, F.col("home_team")).otherwise(F.col("away_team"))
    hand = F.when(F.col("l_returnflag") == "A", "R").when(F.col("l_returnflag") == "R", "L")
    stats = {
        "at_bats": _mod(q, 4, 3), "hits": _mod(q, 3), "doubles": _mod(n, 2), "triples": _mod(q * n, 2),
        "home_runs": _mod(q + n, 2), "walks": _mod(q, 2), "hit_by_pitch": _mod(n, 3), "sacrifice_flies": _mod(q + 1, 2),
        "total_bases": _mod(q, 7), "plate_appearances": _mod(q, 4, 5), "strikeouts": _mod(q * 3 + n, 3),
        "statcast_batted_balls": _mod(q, 4), "statcast_hard_hit_balls": _mod(q, 2), "statcast_barrels": _mod(n, 2),
        "statcast_xwoba_sum": _mod(q, 5), "statcast_xwoba_count": _mod(q, 4),
        "statcast_woba_sum": _mod(n, 5), "statcast_woba_count": _mod(q, 4), "statcast_launch_speed_sum": _mod(q * 10, 400),
    }
    keyed = rows.select(
        "game_id", "game_date", "season", F.col("l_partkey").cast("string").alias("player_id"), team.alias("team"),
        hand.alias("hand"), *[c.alias(name) for name, c in stats.items()],
    )
    return keyed.groupBy("game_id", "game_date", "season", "player_id", "team").agg(
        F.min("hand").alias("opposing_pitcher_hand"), *[F.sum(name).alias(name) for name in stats]
    )


@shared
def pitcher_logs(spark: SparkSession, folder: str, of: Table | None = None) -> DataFrame:
    """One row per (order, supplier); the highest supplier starts for home, the lowest for away."""
    rows = _lines_of_games(spark, folder, ["l_suppkey", "l_quantity", "l_linenumber"], of)
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    stats = {
        "innings_pitched": _mod(q, 6, 1), "hits": _mod(q, 5), "home_runs": _mod(q, 2), "walks": _mod(n, 4),
        "hit_by_pitch": _mod(q * n, 2), "strikeouts": _mod(q, 8), "batters_faced": _mod(q, 3) * 9, "pitches": _mod(q, 40, 20),
        "earned_runs": _mod(q + n, 4), "saves": _mod(q, 2), "holds": _mod(n, 2), "games_finished": _mod(q + n, 3),
        "save_opportunities": _mod(q, 3), "blown_saves": _mod(n, 3), "statcast_pitches": _mod(q, 40, 20),
        "statcast_whiffs": _mod(q, 9), "statcast_batted_balls_allowed": _mod(q, 7),
        "statcast_hard_hit_balls_allowed": _mod(q, 4), "statcast_barrels_allowed": _mod(n, 2),
        "statcast_xwoba_allowed_sum": _mod(q, 5), "statcast_xwoba_allowed_count": _mod(q, 6),
        "statcast_fastball_release_speed_sum": _mod(q * 95, 1000), "statcast_fastball_release_speed_count": _mod(q, 11),
        "statcast_pitch_ff": _mod(q, 10), "statcast_pitch_si": _mod(q, 4), "statcast_pitch_fc": _mod(n, 3),
        "statcast_pitch_sl": _mod(q, 6), "statcast_pitch_cu": _mod(n, 4), "statcast_pitch_ch": _mod(q, 5),
        "statcast_pitch_fs": _mod(q, 3),
    }
    keyed = rows.select(
        "game_id", "game_date", "season", "home_team", "away_team", "home_sp_id", "away_sp_id",
        F.col("l_suppkey").cast("string").alias("player_id"), F.col("l_suppkey").alias("s"),
        *[c.alias(name) for name, c in stats.items()],
    )
    ids = ["game_id", "game_date", "season", "player_id", "s", "home_team", "away_team", "home_sp_id", "away_sp_id"]
    summed = keyed.groupBy(*ids).agg(*[F.sum(name).alias(name) for name in stats])
    starts_home, starts_away = F.col("player_id") == F.col("home_sp_id"), F.col("player_id") == F.col("away_sp_id")
    home = starts_home | (~starts_away & (F.col("s") % 2 == 0))
    return summed.select(
        "game_id", "game_date", "season", "player_id",
        F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        (starts_home | starts_away).cast("double").alias("is_start"),
        (F.col("s") % 3 == 0).cast("double").alias("is_closer"),
        (F.col("s") % 2 == 0).cast("double").alias("is_high_leverage"),
        *stats,
    )


@shared
def lineups(spark: SparkSession, folder: str, of: Table | None = None) -> DataFrame:
    """The parts of each order and side, as batting slots by line number.

    A third of the players has no log for the game (id shifted by one), so profiles are looked up
    in earlier games.
    """
    rows = _lines_of_games(spark, folder, ["l_partkey", "l_linenumber", "l_quantity", "l_returnflag"], of)
    team = F.when(F.col("l_partkey") % 2 == 0, F.col("home_team")).otherwise(F.col("away_team"))
    player = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") + 2).otherwise(F.col("l_partkey"))
    slots = rows.select(
        "game_id", "game_date", "season", team.alias("team"), player.cast("string").alias("player_id"),
        F.col("l_linenumber").cast("double").alias("slot"), (F.col("l_quantity").cast("bigint") % 3).alias("kind"),
    )
    kind = F.col("kind")
    return slots.groupBy("game_id", "game_date", "season", "team", "player_id").agg(
        F.min("slot").alias("batting_order"), F.min("kind").alias("kind")
    ).select(
        "game_id", "game_date", "season", "team", "player_id", "batting_order",
        F.when(kind == 0, "L").when(kind == 1, "R").otherwise("S").alias("bats"),
        F.lit("confirmed").alias("prediction_mode"),
        (kind / 4.0).alias("lineup_confidence"),
        F.when(kind > 0, (kind - 1).cast("double")).alias("is_available"),
        F.lit(None).cast("double").alias("is_expected_starter"),
        F.when(kind == 2, F.lit(1.0)).alias("rest_signal"),
        F.when(kind == 0, "Day-to-Day").when(kind == 1, "available").alias("injury_status"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        k.cast("string").alias("game_id"), _mod(k, 60, 40).alias("temperature"), _mod(k, 20).alias("wind_speed"),
        F.when(k % 2 == 0, "in").otherwise("out").alias("wind_direction"), _mod(k, 100).alias("humidity"),
        (k % 7 == 0).cast("double").alias("is_dome"),
    )


def market_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines for two thirds of the orders, with odds of both signs."""
    k = F.col("o_orderkey")
    return read(spark, folder, "orders").filter(k % 3 != 0).select(
        k.cast("string").alias("game_id"),
        (_mod(k, 8, 6) + 0.5).alias("opening_total_line"),
        F.when(k % 5 != 0, _mod(k, 9, 6)).alias("current_total_line"),
        _mod(k, 10, 5).alias("closing_total_line"),
        (_mod(k, 400) - 200.0).alias("over_odds"),
        (200.0 - _mod(k, 300)).alias("under_odds"),
        (_mod(k, 300) - 150.0).alias("opening_home_moneyline"),
        (_mod(k, 280) - 140.0).alias("current_home_moneyline"),
        (150.0 - _mod(k, 300)).alias("opening_away_moneyline"),
        (140.0 - _mod(k, 280)).alias("current_away_moneyline"),
        F.when(k % 4 == 0, (k % 10).cast("string")).alias("home_sp_id_at_open"),
        F.when(k % 4 == 1, (k % 10).cast("string")).alias("away_sp_id_at_open"),
        F.when(k % 7 == 0, F.lit(1.0)).alias("home_sp_changed"),
    )


GAMES_SQL = """
lines AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n, min(l_suppkey) AS away_sp, max(l_suppkey) AS home_sp
  FROM lineitem GROUP BY l_orderkey),
games AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_id, o_orderkey AS game_no, CAST(o_orderdate AS TIMESTAMP) AS game_date,
         CAST(year(o_orderdate) AS INTEGER) AS season, hn.n_name AS home_team,
         CASE WHEN hn.n_name = an.n_name THEN an.n_name || ' II' ELSE an.n_name END AS away_team,
         CAST(home_sp AS VARCHAR) AS home_sp_id, CAST(away_sp AS VARCHAR) AS away_sp_id,
         CAST(q % 11 AS DOUBLE) AS home_score, CAST((q * 7 + n) % 9 AS DOUBLE) AS away_score,
         CAST(hn.n_nationkey AS VARCHAR) AS venue_id, CAST(20.0 + hn.n_nationkey AS DOUBLE) AS venue_latitude,
         CAST(-120.0 + 3.0 * hn.n_nationkey AS DOUBLE) AS venue_longitude,
         CAST(round_even((-120.0 + 3.0 * hn.n_nationkey) / 15.0, 0) AS DOUBLE) AS venue_timezone_offset
  FROM orders JOIN lines ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation hn ON c_nationkey = hn.n_nationkey
  JOIN supplier ON away_sp = s_suppkey JOIN nation an ON s_nationkey = an.n_nationkey)"""

TEAM_GAMES_SQL = """
team_games AS (
  SELECT game_id, game_no, game_date, season, home_team AS team, away_team AS opponent, 1 AS is_home,
         venue_latitude, venue_longitude, venue_timezone_offset, home_score AS runs_for, away_score AS runs_allowed,
         CAST(home_score > away_score AS DOUBLE) AS win FROM games
  UNION ALL
  SELECT game_id, game_no, game_date, season, away_team, home_team, 0, venue_latitude, venue_longitude,
         venue_timezone_offset, away_score, home_score, CAST(away_score > home_score AS DOUBLE) FROM games)"""

_SQL_BATTING = {
    "at_bats": "q % 4 + 3", "hits": "q % 3", "doubles": "n % 2", "triples": "(q * n) % 2", "home_runs": "(q + n) % 2",
    "walks": "q % 2", "hit_by_pitch": "n % 3", "sacrifice_flies": "(q + 1) % 2", "total_bases": "q % 7",
    "plate_appearances": "q % 4 + 5", "strikeouts": "(q * 3 + n) % 3", "statcast_batted_balls": "q % 4",
    "statcast_hard_hit_balls": "q % 2", "statcast_barrels": "n % 2", "statcast_xwoba_sum": "q % 5",
    "statcast_xwoba_count": "q % 4", "statcast_woba_sum": "n % 5", "statcast_woba_count": "q % 4",
    "statcast_launch_speed_sum": "(q * 10) % 400",
}
_SQL_PITCHING = {
    "innings_pitched": "q % 6 + 1", "hits": "q % 5", "home_runs": "q % 2", "walks": "n % 4", "hit_by_pitch": "(q * n) % 2",
    "strikeouts": "q % 8", "batters_faced": "(q % 3) * 9", "pitches": "q % 40 + 20", "earned_runs": "(q + n) % 4",
    "saves": "q % 2", "holds": "n % 2", "games_finished": "(q + n) % 3", "save_opportunities": "q % 3",
    "blown_saves": "n % 3", "statcast_pitches": "q % 40 + 20", "statcast_whiffs": "q % 9",
    "statcast_batted_balls_allowed": "q % 7", "statcast_hard_hit_balls_allowed": "q % 4", "statcast_barrels_allowed": "n % 2",
    "statcast_xwoba_allowed_sum": "q % 5", "statcast_xwoba_allowed_count": "q % 6",
    "statcast_fastball_release_speed_sum": "(q * 95) % 1000", "statcast_fastball_release_speed_count": "q % 11",
    "statcast_pitch_ff": "q % 10", "statcast_pitch_si": "q % 4", "statcast_pitch_fc": "n % 3", "statcast_pitch_sl": "q % 6",
    "statcast_pitch_cu": "n % 4", "statcast_pitch_ch": "q % 5", "statcast_pitch_fs": "q % 3",
}
_sums = lambda stats: ", ".join(f"CAST(sum({e}) AS DOUBLE) AS {n}" for n, e in stats.items())

BATTING_SQL = f"""
batting_logs AS (
  SELECT game_id, game_no, game_date, season, player_id, team, min(hand) AS opposing_pitcher_hand, {_sums(_SQL_BATTING)}
  FROM (SELECT g.game_id, g.game_no, g.game_date, g.season, CAST(l_partkey AS VARCHAR) AS player_id,
               CASE WHEN l_partkey % 2 = 0 THEN home_team ELSE away_team END AS team,
               CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'L' END AS hand,
               CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n
        FROM lineitem JOIN games g ON l_orderkey = g.game_no)
  GROUP BY game_id, game_no, game_date, season, player_id, team)"""

PITCHING_SQL = f"""
pitcher_logs AS (
  SELECT game_id, game_no, game_date, season, CAST(s AS VARCHAR) AS player_id,
         CASE WHEN s = home_sp OR (s <> away_sp AND s % 2 = 0) THEN home_team ELSE away_team END AS team,
         CAST(s = home_sp OR s = away_sp AS DOUBLE) AS is_start, CAST(s % 3 = 0 AS DOUBLE) AS is_closer,
         CAST(s % 2 = 0 AS DOUBLE) AS is_high_leverage, {_sums(_SQL_PITCHING)}
  FROM (SELECT g.game_id, g.game_no, g.game_date, g.season, home_team, away_team, l_suppkey AS s,
               CAST(home_sp_id AS BIGINT) AS home_sp, CAST(away_sp_id AS BIGINT) AS away_sp,
               CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n
        FROM lineitem JOIN games g ON l_orderkey = g.game_no)
  GROUP BY game_id, game_no, game_date, season, home_team, away_team, s, home_sp, away_sp)"""

LINEUPS_SQL = """
lineups AS (
  SELECT game_id, game_no, game_date, season, team, player_id, min(slot) AS batting_order, min(kind) AS kind
  FROM (SELECT g.game_id, g.game_no, g.game_date, g.season,
               CASE WHEN l_partkey % 2 = 0 THEN home_team ELSE away_team END AS team,
               CAST(CASE WHEN l_partkey % 3 = 0 THEN l_partkey + 2 ELSE l_partkey END AS VARCHAR) AS player_id,
               CAST(l_linenumber AS DOUBLE) AS slot, CAST(l_quantity AS BIGINT) % 3 AS kind
        FROM lineitem JOIN games g ON l_orderkey = g.game_no)
  GROUP BY game_id, game_no, game_date, season, team, player_id)"""
