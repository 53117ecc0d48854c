"""Pitch events to per-game player sums, and their merge into player logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalars import canonical_id, first_letter, number
from pregame.operators.joins import require_columns
from pregame.schemas import PITCH_TYPES

# Event texts and limits which define the quality flags.
WHIFFS = ("swinging_strike", "swinging_strike_blocked", "foul_tip")
FASTBALLS = ("FF", "SI", "FC")
HARD_HIT_SPEED = 95
BARREL_CLASS = 6
BARREL_SPEED, BARREL_ANGLES = 98, (26, 30)
REQUIRED = ["game_pk", "game_date", "batter", "pitcher", "home_team", "away_team", "inning_topbot"]
PITCH_KEY = ["game_pk", "at_bat_number", "pitch_number"]
GROUP = ["game_id", "game_date", "season", "player_id", "team"]

# Names of the sums when they are counted against a pitcher.
ALLOWED = {
    "statcast_pa": "statcast_batters_faced",
    "statcast_xwoba_sum": "statcast_xwoba_allowed_sum",
    "statcast_xwoba_count": "statcast_xwoba_allowed_count",
    "statcast_woba_sum": "statcast_woba_allowed_sum",
    "statcast_woba_count": "statcast_woba_allowed_count",
    "statcast_batted_balls": "statcast_batted_balls_allowed",
    "statcast_hard_hit_balls": "statcast_hard_hit_balls_allowed",
    "statcast_barrels": "statcast_barrels_allowed",
    "statcast_launch_speed_sum": "statcast_launch_speed_allowed_sum",
}


def combine_pitches(df: DataFrame) -> DataFrame:
    """Drop repeats of a pitch, if the frame carries the pitch key at all."""
    return df.dropDuplicates(PITCH_KEY) if set(PITCH_KEY) <= set(df.columns) else df


def event_quality(events: DataFrame, role: str) -> DataFrame:
    """24 sums per (game, player, team) for `role` "batter" or "pitcher".

    All flags are computed inside the aggregate, so tasks send partial sums only and a busy
    player is never gathered in one place.
    """
    if role not in ("batter", "pitcher"):
        raise ValueError("role must be batter or pitcher")
    require_columns(events, REQUIRED, "events")
    types = dict(events.dtypes)

    def known(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("double")
        return number(name) if types[name] == "string" else F.col(name).cast("double")

    def text(name: str) -> Column:
        return F.col(name) if name in types else F.lit(None).cast("string")

    speed, angle = known("launch_speed"), known("launch_angle")
    batted = speed.isNotNull() | angle.isNotNull() | text("bb_type").isNotNull()
    if "launch_speed_angle" in types:
        barrel = known("launch_speed_angle") == BARREL_CLASS
    else:
        barrel = (speed >= BARREL_SPEED) & angle.between(*BARREL_ANGLES)
    kind = F.upper(text("pitch_type"))
    fast = kind.isin(*FASTBALLS)
    values = {"xwoba": known("estimated_woba_using_speedangle"), "woba": known("woba_value")}
    release, spin = known("release_speed"), known("release_spin_rate")
    count = lambda condition: F.count_if(condition).cast("double")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0.0))
    sums = {
        "statcast_pa": count(text("events").isNotNull()),
        "statcast_batted_balls": count(batted),
        "statcast_hard_hit_balls": count(batted & (speed >= HARD_HIT_SPEED)),
        "statcast_barrels": count(batted & barrel),
        "statcast_whiffs": count(text("description").isin(*WHIFFS)),
        "statcast_pitches": F.count(F.lit(1)).cast("double"),
        **{f"statcast_{n}_sum": total(v) for n, v in values.items()},
        **{f"statcast_{n}_count": count(v.isNotNull()) for n, v in values.items()},
        "statcast_launch_speed_sum": total(F.when(batted, speed)),
        "statcast_release_speed_sum": total(release),
        "statcast_release_speed_count": count(release.isNotNull()),
        "statcast_fastball_release_speed_sum": total(F.when(fast, release)),
        "statcast_fastball_release_speed_count": count(fast & release.isNotNull()),
        "statcast_spin_rate_sum": total(spin),
        "statcast_spin_rate_count": count(spin.isNotNull()),
        **{f"statcast_pitch_{t.lower()}": count(kind == t) for t in PITCH_TYPES},
    }
    top = F.coalesce(F.lower("inning_topbot") == "top", F.lit(False))
    at_bat_home = ~top if role == "batter" else top
    date = F.col("game_date") if types["game_date"] != "string" else F.try_to_timestamp("game_date")
    keys = {
        "game_id": canonical_id("game_pk"),
        "game_date": date.cast("timestamp"),
        "season": F.year(date),
        "player_id": canonical_id(role),
        "team": F.when(at_bat_home, F.col("home_team")).otherwise(F.col("away_team")),
    }
    keyed = events.withColumns({f"_{n}": c for n, c in keys.items()})
    keyed = keyed.dropna(subset=[f"_{n}" for n in keys])
    out = keyed.groupBy(*[F.col(f"_{n}").alias(n) for n in keys]).agg(*[v.alias(n) for n, v in sums.items()])
    return out.withColumnsRenamed(ALLOWED) if role == "pitcher" else out


def merge_quality(logs: DataFrame, quality: DataFrame) -> DataFrame:
    """Attach the event sums to player logs; logs without events keep NULL."""
    keys = ["game_id", "player_id", "team"]
    sums = [c for c in quality.columns if c.startswith("statcast_")]
    return logs.drop(*sums).join(quality.select(*keys, *sums), keys, "left")


def with_opposing_hand(events: DataFrame) -> DataFrame:
    """Upper-cased first letter of the pitcher's hand as `opposing_pitcher_hand`."""
    value = first_letter("p_throws") if "p_throws" in events.columns else F.lit(None).cast("string")
    return events.withColumn("opposing_pitcher_hand", value)
