"""The standard tables and the step that brings any input into their form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregame.functions.scalars import canonical_id, not_nan, number
from pregame.operators.joins import require_columns

# Fixed values, down to the table definitions: column names of the standard tables and the feature table,
# the columns that are no features, pick thresholds, and lineup slot weights.
BATTING_STATS = [
    "at_bats", "hits", "doubles", "triples", "home_runs", "walks",
    "hit_by_pitch", "sacrifice_flies", "total_bases", "plate_appearances", "strikeouts",
]
PITCHING_STATS = [
    "innings_pitched", "hits", "home_runs", "walks", "hit_by_pitch",
    "strikeouts", "batters_faced", "pitches", "earned_runs",
]
ROLE_SIGNALS = ["saves", "holds", "games_finished", "save_opportunities", "blown_saves"]
PITCH_TYPES = ["FF", "SI", "FC", "SL", "CU", "CH", "FS"]
BATTING_QUALITY = [
    "statcast_pa", "statcast_batted_balls", "statcast_hard_hit_balls", "statcast_barrels",
    "statcast_xwoba_sum", "statcast_xwoba_count", "statcast_woba_sum", "statcast_woba_count",
    "statcast_launch_speed_sum",
]
PITCHING_QUALITY = [
    "statcast_batters_faced", "statcast_pitches", "statcast_whiffs",
    "statcast_batted_balls_allowed", "statcast_hard_hit_balls_allowed", "statcast_barrels_allowed",
    "statcast_xwoba_allowed_sum", "statcast_xwoba_allowed_count",
    "statcast_woba_allowed_sum", "statcast_woba_allowed_count",
    "statcast_launch_speed_allowed_sum", "statcast_release_speed_sum", "statcast_release_speed_count",
    "statcast_fastball_release_speed_sum", "statcast_fastball_release_speed_count",
    "statcast_spin_rate_sum", "statcast_spin_rate_count",
    "statcast_pitch_ff", "statcast_pitch_si", "statcast_pitch_fc", "statcast_pitch_sl",
    "statcast_pitch_cu", "statcast_pitch_ch", "statcast_pitch_fs",
]
WEATHER = ["temperature", "wind_speed", "wind_direction", "humidity", "is_dome"]
PARK_FACTORS = ["park_factor_run", "park_factor_hr"]
TARGET = "home_team_win"
NON_FEATURES = {
    "game_id", "game_date", "season", "home_team", "away_team", "home_score", "away_score",
    "actual_total", "home_sp_id", "away_sp_id", "venue_id", "prediction_mode",
    "market_closing_total_line", "market_total_over", TARGET,
}
THRESHOLDS = (0.55, 0.60, 0.65)
SLOT_WEIGHTS = {1: 0.12, 2: 0.12, 3: 0.13, 4: 0.13, 5: 0.12, 6: 0.11, 7: 0.10, 8: 0.09, 9: 0.08}
OTHER_SLOT_WEIGHT = 0.10


def table(text: str = "", ids: str = "", numbers: str = "", times: str = "", ints: str = "") -> T.StructType:
    """Schema from name lists; `id` fields are strings in one canonical spelling."""
    fields = [T.StructField(n, T.StringType(), metadata={"id": True}) for n in ids.split()]
    fields += [T.StructField(n, T.TimestampType()) for n in times.split()]
    fields += [T.StructField(n, T.IntegerType()) for n in ints.split()]
    fields += [T.StructField(n, T.StringType()) for n in text.split()]
    fields += [T.StructField(n, T.DoubleType()) for n in numbers.split()]
    return T.StructType(fields)


GAMES = table(
    ids="game_id home_sp_id away_sp_id venue_id", times="game_date", ints="season",
    text="home_team away_team home_sp_hand away_sp_hand venue_name source",
    numbers="home_score away_score venue_latitude venue_longitude venue_timezone_offset",
)
BATTING_LOGS = table(
    ids="game_id player_id", times="game_date", ints="season", text="team opposing_pitcher_hand",
    numbers=" ".join(BATTING_STATS + BATTING_QUALITY),
)
PITCHER_LOGS = table(
    ids="game_id player_id", times="game_date", ints="season", text="team role",
    numbers=" ".join(
        PITCHING_STATS + ["is_start", "is_closer", "is_high_leverage"] + ROLE_SIGNALS + PITCHING_QUALITY
    ),
)
LINEUPS = table(
    ids="game_id player_id", times="game_date captured_at", ints="season",
    text="team player_name bats prediction_mode lineup_source injury_status",
    numbers="batting_order lineup_confidence is_available is_expected_starter rest_signal",
)
WEATHER_TABLE = table(
    ids="game_id", text="wind_direction weather_condition weather_source",
    numbers="temperature wind_speed humidity is_dome",
)
PARK_FACTOR_TABLE = table(ids="venue_id", ints="season", numbers=" ".join(PARK_FACTORS))
VENUES = table(ids="venue_id", text="venue_name", numbers="latitude longitude timezone_offset is_dome")
MARKET_LINES = table(
    ids="game_id home_sp_id_at_open away_sp_id_at_open",
    numbers="opening_total_line current_total_line closing_total_line over_odds under_odds "
    "opening_home_moneyline opening_away_moneyline current_home_moneyline current_away_moneyline "
    "home_sp_changed away_sp_changed starter_change_count",
)


def conform(
    df: DataFrame, schema: T.StructType, required: Sequence[str] = (), name: str = "table", keep_extra: bool = False
) -> DataFrame:
    """Cast the columns `df` has to the types of `schema`; bad values become NULL, never an error.

    Identifiers get one spelling, NaN becomes NULL. Columns that are absent stay absent, so a
    plan can tell "not collected" from "unknown".
    """
    require_columns(df, list(required), name)
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in schema.fields:
        if field.name not in have:
            continue
        source, value = have[field.name], F.col(field.name)
        if (field.metadata or {}).get("id"):
            value = canonical_id(value)
        elif isinstance(field.dataType, (T.DoubleType, T.IntegerType)):
            if isinstance(source, T.StringType):
                value = number(value)
            else:
                value = not_nan(value.cast("double")) if isinstance(source, T.FractionalType) else value
            value = value.cast(field.dataType)
        elif isinstance(source, T.StringType) and isinstance(field.dataType, T.TimestampType):
            value = F.try_to_timestamp(value)
        else:
            value = value.cast(field.dataType)
        out.append(value.alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()] if keep_extra else []
    return df.select(*out, *extra)


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns with absent ones added and NULL read as 0."""
    values = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns
    }
    return df.withColumns(values)


def align(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Columns of a training table in its order, absent ones as NULL; further columns stay last."""
    known = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in reference]
    return df.select(*known, *[c for c in df.columns if c not in set(reference)])


def feature_columns(df: DataFrame, exclude: Sequence[str] = (), exclude_market: bool = False) -> list[str]:
    """Numeric columns that may feed a model: not reserved, with at least one known value."""
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
        and f.name not in NON_FEATURES
        and f.name not in set(exclude)
        and not (exclude_market and f.name.startswith("market_"))
    ]
    if not numeric:
        return []
    known = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in numeric]).first()
    return [c for c in numeric if known[c]]
