"""Matching of players and games between sources by name, date and teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalars import canonical_id, date_key, name_key, number
from pregame.operators.joins import require_columns, unique_match, with_missing
from pregame.operators.ordered import latest_per_key

# Source and target names of the register columns.
REGISTER_IDS = {
    "key_mlbam": "mlbam_id", "key_retro": "retrosheet_id", "key_bbref": "bbref_id",
    "key_bbref_minors": "bbref_minors_id", "key_fangraphs": "fangraphs_id", "key_wikidata": "wikidata_id",
}
REGISTER_TEXTS = ["name_first", "name_last", "name_given", "name_suffix"]
REGISTER_YEARS = ["birth_year", "birth_month", "birth_day", "mlb_played_first", "mlb_played_last"]
ANY_OF = ["mlbam_id", "retrosheet_id", "bbref_id", "fangraphs_id"]
PERSON = ["bats", "throws", "primary_position"]


def build_id_map(register: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Register rows with at least one major id, cleaned, with hands and position where known."""
    source = {"key_person": "string", "key_uuid": "string"}
    source |= {c: "string" for c in [*REGISTER_IDS, *REGISTER_TEXTS, *REGISTER_YEARS]}
    rows = with_missing(register, source)
    out = rows.select(
        F.col("key_person").alias("chadwick_key"),
        F.col("key_uuid").alias("chadwick_uuid"),
        *[canonical_id(c).alias(n) for c, n in REGISTER_IDS.items()],
        *REGISTER_TEXTS,
        *[number(F.col(c).cast("string")).cast("int").alias(c) for c in REGISTER_YEARS],
    ).filter(F.coalesce(*ANY_OF).isNotNull())
    if people is None or "player_id" not in people.columns:
        return with_missing(out, {c: "string" for c in PERSON})
    known = with_missing(people, {c: "string" for c in PERSON}).select(canonical_id("player_id").alias("mlbam_id"), *PERSON)
    known = latest_per_key(known.filter(F.col("mlbam_id").isNotNull()), ["mlbam_id"], PERSON, newest=False)
    return out.join(known, "mlbam_id", "left").select("chadwick_key", "chadwick_uuid", *REGISTER_IDS.values(),
                                                      *REGISTER_TEXTS, *REGISTER_YEARS, *PERSON)


def names_of(id_map: DataFrame, season: int | None = None) -> DataFrame:
    """(mlbam_id, matched_name, name_key): the given name and "first last" of active players."""
    rows = with_missing(
        id_map, {"name_given": "string", "name_first": "string", "name_last": "string",
                 "mlb_played_first": "int", "mlb_played_last": "int"},
    )
    if season is not None:
        first, last = F.col("mlb_played_first"), F.col("mlb_played_last")
        rows = rows.filter((first.isNull() | (first <= season)) & (last.isNull() | (last >= season)))
    spelled = F.concat_ws(" ", F.coalesce("name_first", F.lit("")), F.coalesce("name_last", F.lit("")))
    both = rows.select("mlbam_id", F.explode(F.array("name_given", spelled)).alias("matched_name"))
    keyed = both.withColumn("name_key", name_key("matched_name"))
    return keyed.filter((F.col("name_key") != "") & F.col("mlbam_id").isNotNull()).distinct()


def external_player_ids(provider: DataFrame, id_map: DataFrame, season: int | None = None) -> DataFrame:
    """Provider players whose name belongs to exactly one register id."""
    require_columns(provider, ["external_player_id", "player_name"], "provider")
    require_columns(id_map, ["mlbam_id"], "id_map")
    wanted = provider.select("external_player_id", "player_name").dropna().distinct()
    wanted = wanted.withColumn("name_key", name_key("player_name"))
    out = unique_match(wanted, names_of(id_map, season), ["name_key"], "external_player_id", "mlbam_id")
    return out.select("external_player_id", F.col("mlbam_id").alias("player_id"), "player_name", "matched_name")


def external_game_ids(provider: DataFrame, games: DataFrame) -> DataFrame:
    """Provider games which one game alone matches by UTC date and both teams."""
    require_columns(provider, ["external_game_id", "game_date", "home_team", "away_team"], "provider")
    require_columns(games, ["game_id", "game_date", "home_team", "away_team"], "games")

    def keyed(df: DataFrame, *ids: str) -> DataFrame:
        rows = df.select(*ids, "game_date", "home_team", "away_team").dropna().distinct()
        return rows.withColumns({
            "date_key": date_key("game_date"), "home_key": F.upper("home_team"), "away_key": F.upper("away_team"),
        })

    ours = keyed(games, "game_id").select("game_id", "date_key", "home_key", "away_key").distinct()
    out = unique_match(
        keyed(provider, "external_game_id"), ours, ["date_key", "home_key", "away_key"], "external_game_id", "game_id"
    )
    return out.select("external_game_id", "game_id", "game_date", "home_team", "away_team")


def unique_names(id_map: DataFrame, season: int | None = None) -> DataFrame:
    """(name_key, player_id) for names that stand for exactly one player."""
    keyed = names_of(id_map, season)
    ends = keyed.groupBy("name_key").agg(F.min("mlbam_id").alias("player_id"), F.max("mlbam_id").alias("_other"))
    return ends.filter(F.col("player_id") == F.col("_other")).drop("_other")
