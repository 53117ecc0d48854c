"""Nested JSON documents to rows, with one fixed schema per kind of document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalars import canonical_id, first_present, number

TEAM = "STRUCT<team: STRUCT<id: STRING, name: STRING, abbreviation: STRING>, score: STRING, probablePitcher: STRUCT<id: STRING, fullName: STRING>>"
SCHEDULE = f"""STRUCT<dates: ARRAY<STRUCT<date: STRING, games: ARRAY<STRUCT<gamePk: STRING, gameDate: STRING, season: STRING,
  gameType: STRING, status: STRUCT<detailedState: STRING>, teams: STRUCT<home: {TEAM}, away: {TEAM}>,
  venue: STRUCT<id: STRING, name: STRING>>>>>>"""
PEOPLE = """STRUCT<people: ARRAY<STRUCT<id: STRING, fullName: STRING, batSide: STRUCT<code: STRING>, pitchHand: STRUCT<code: STRING>,
  primaryPosition: STRUCT<abbreviation: STRING>>>>"""
VENUES = """STRUCT<venues: ARRAY<STRUCT<id: STRING, name: STRING, location: STRUCT<city: STRING, state: STRING, country: STRING,
  defaultCoordinates: STRUCT<latitude: DOUBLE, longitude: DOUBLE>>>>>"""
HOURLY = """STRUCT<hourly: STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, relative_humidity_2m: ARRAY<DOUBLE>,
  wind_speed_10m: ARRAY<DOUBLE>, wind_direction_10m: ARRAY<DOUBLE>>>"""
PROVIDER = "STRUCT<data: ARRAY<STRING>>"

# Alternative field names of the lineup provider, in order of preference.
GAME_IDS = ["game_id", "gameId", "game.id", "game", "id", "external_game_id"]
GAME_DATES = ["game_date", "date", "scheduled_at", "game.date", "game.game_date", "game.datetime", "game.scheduled_at"]
SIDE_NAMES = ["{s}_team.abbreviation", "{s}_team.name", "{s}_team", "{s}_team_abbreviation"]
GAME_SIDES = [f"game.{{s}}{t}.{n}" for t in ("_team", "") for n in ("abbreviation", "abbr", "name", "full_name")]
GAME_SIDES += ["game.{s}_team", "game.{s}"]
TEAM_NAMES = ["team_abbreviation", "team_abbrev", "team.abbreviation", "team.abbr", "team.name", "team.full_name", "team.id", "team", "team_name"]
STATUS = ["status", "lineup_status", "type"]
PLAYER_LISTS = ["players", "batters", "lineup", "starting_lineup"]
NESTED_IN = ["home", "away", "team"]
PLAYER_IDS = ["id", "player_id", "playerId", "external_player_id"]
PLAYER_NAMES = ["full_name", "name", "display_name"]
SLOTS = ["batting_order", "battingOrder", "order", "lineup_position", "slot"]
POSITIONS = ["position.abbreviation", "position.name", "position", "pos.abbreviation", "pos.name", "pos"]
BATS = ["bats", "bat_side", "batSide"]


def schedule_rows(payloads: DataFrame, json: str = "json") -> DataFrame:
    """One row per scheduled game, 19 columns."""
    days = payloads.select(F.explode(F.from_json(json, SCHEDULE)["dates"]).alias("d"))
    games = days.select(F.col("d.date").alias("day"), F.explode("d.games").alias("g"))
    side = lambda s: {
        f"{s}_team_id": F.col(f"g.teams.{s}.team.id"), f"{s}_team": F.col(f"g.teams.{s}.team.name"),
        f"{s}_team_abbrev": F.col(f"g.teams.{s}.team.abbreviation"), f"{s}_score": number(F.col(f"g.teams.{s}.score")),
        f"{s}_sp_id": F.col(f"g.teams.{s}.probablePitcher.id"), f"{s}_sp_name": F.col(f"g.teams.{s}.probablePitcher.fullName"),
    }
    return games.select(
        canonical_id("g.gamePk").alias("game_id"), F.try_to_timestamp(first_present("g.gameDate", "day")).alias("game_date"),
        number("g.season").cast("int").alias("season"), F.col("g.gameType").alias("game_type"),
        F.col("g.status.detailedState").alias("status"), *[c.alias(n) for s in ("home", "away") for n, c in side(s).items()],
        F.col("g.venue.id").alias("venue_id"), F.col("g.venue.name").alias("venue_name"),
    )


def people_rows(payloads: DataFrame, json: str = "json") -> DataFrame:
    rows = payloads.select(F.explode(F.from_json(json, PEOPLE)["people"]).alias("p"))
    return rows.select(
        canonical_id("p.id").alias("player_id"), F.col("p.fullName").alias("player_name"), F.col("p.batSide.code").alias("bats"),
        F.col("p.pitchHand.code").alias("throws"), F.col("p.primaryPosition.abbreviation").alias("primary_position"),
    )


def venue_rows(payloads: DataFrame, fallback: DataFrame | None = None, json: str = "json") -> DataFrame:
    """One row per venue; a pair of coordinates is taken from `fallback` when either is unknown."""
    rows = payloads.select(F.explode(F.from_json(json, VENUES)["venues"]).alias("v")).select(
        canonical_id("v.id").alias("venue_id"), F.col("v.name").alias("venue_name"),
        F.col("v.location.defaultCoordinates.latitude").alias("latitude"), F.col("v.location.defaultCoordinates.longitude").alias("longitude"),
        F.col("v.location.city").alias("city"), F.col("v.location.state").alias("state"), F.col("v.location.country").alias("country"),
    )
    if fallback is None:
        return rows
    spare = fallback.select(canonical_id("venue_id").alias("venue_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    joined = rows.join(spare, "venue_id", "left")
    gap = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("_lat").isNotNull()
    return joined.withColumns({
        "latitude": F.when(gap, F.col("_lat")).otherwise(F.col("latitude")),
        "longitude": F.when(gap, F.col("_lon")).otherwise(F.col("longitude")),
    }).drop("_lat", "_lon")


def hourly_weather_rows(payloads: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Parallel hourly arrays to one row per hour."""
    h = F.from_json(json, HOURLY)["hourly"]
    rows = payloads.select(*keys, F.explode(F.arrays_zip(
        h["time"].alias("time"), h["temperature_2m"].alias("t"), h["relative_humidity_2m"].alias("r"),
        h["wind_speed_10m"].alias("w"), h["wind_direction_10m"].alias("d"))).alias("z"))
    return rows.select(
        *keys, F.try_to_timestamp("z.time").alias("weather_hour"), F.col("z.t").alias("hourly_temperature"), F.col("z.r").alias("humidity"),
        F.col("z.w").alias("hourly_wind_speed"), F.col("z.d").alias("hourly_wind_direction_degrees"),
    )


OBJECT, LIST = r"^\s*\{", r"^\s*\["
FIELDS = "MAP<STRING, STRING>"


def _fields(text: Column) -> Column:
    """The fields of a JSON object, nested ones as their JSON text; NULL for any other text."""
    return F.when(text.rlike(OBJECT), F.from_json(text, FIELDS))


def _opened(texts: Column, paths: list[str]) -> Column:
    """Array of JSON texts to structs of fields: those of the object (`_`) and of each object that the paths lead through.

    To be exploded, with the values picked in there: a filter on one then stays above, and no text is parsed again for it.
    """
    inner = {p.rsplit(".", 1)[0] for p in paths if "." in p}
    inner |= {p.split(".", 1)[0] for p in inner}
    out, done = F.transform(texts, lambda t: F.struct(_fields(t).alias("_"))), ["_"]
    for depth in sorted({p.count(".") for p in inner}):
        new = sorted(p for p in inner if p.count(".") == depth)
        out = F.transform(out, lambda o: F.struct(
            *[o[n].alias(n) for n in done], *[_fields(_at(o, p)).alias(p.replace(".", "_")) for p in new]))
        done += [p.replace(".", "_") for p in new]
    return out


def _at(opened: Column, path: str) -> Column:
    above, _, last = path.rpartition(".")
    return opened[above.replace(".", "_") or "_"][last]


def _first(opened: Column, paths: list[str]) -> Column:
    """First scalar among the paths; an object or a blank does not count. Each path is looked up once."""
    values = F.array(*[_at(opened, p) for p in paths])
    return F.get(F.filter(values, lambda v: ~v.rlike(r"^\s*[\[{]") & (F.trim(v) != "")), F.lit(0))


def provider_lineups(
    payloads: DataFrame, source: str, mode: str = "projected", captured_at: str | None = None, game_ids: DataFrame | None = None,
    player_ids: DataFrame | None = None, json: str = "json", confidence: float = 0.65,
) -> DataFrame:
    """Provider lineup documents to standard lineup rows; ids are translated where a map has them.

    Every object is parsed once, level by level, however many names its fields may have.
    """
    lists = PLAYER_LISTS + [f"{n}.{p}" for n in NESTED_IN for p in PLAYER_LISTS]
    sides = {f"{s}_team": [p.format(s=s) for p in SIDE_NAMES + GAME_SIDES] for s in ("home", "away")}
    seen = ["captured_at", "updated_at"]
    read = [*lists, *GAME_IDS, *GAME_DATES, *sides["home_team"], *sides["away_team"], *TEAM_NAMES, *STATUS, *seen]
    entries = F.transform(_opened(F.from_json(json, PROVIDER)["data"], read), lambda e: F.struct(
        _first(e, GAME_IDS).alias("external_game_id"), _first(e, GAME_DATES).alias("game_date"),
        *[_first(e, paths).alias(n) for n, paths in sides.items()], _first(e, TEAM_NAMES).alias("team"),
        _first(e, STATUS).alias("provider_lineup_status"), _first(e, seen).alias("seen_at"),
        F.get(F.filter(F.array(*[_at(e, p) for p in lists]), lambda v: v.rlike(LIST)), F.lit(0)).alias("players")))
    entries = payloads.select(F.explode(entries).alias("e"))
    people = F.transform(_opened(F.from_json("e.players", "ARRAY<STRING>"), SLOTS + POSITIONS), lambda p: F.struct(
        p.alias("own"), F.struct(F.coalesce(_fields(_at(p, "player")), p["_"]).alias("_")).alias("person")))
    people = F.transform(people, lambda p: F.struct(
        _first(p["person"], PLAYER_IDS).alias("external_player_id"), _first(p["person"], PLAYER_NAMES).alias("player_name"),
        number(_first(p["own"], SLOTS)).alias("batting_order"), _first(p["own"], POSITIONS).alias("position"),
        _first(p["person"], BATS).alias("bats")))
    rows = entries.select("e.*", F.explode(people).alias("p")).select("*", "p.*").drop("players", "p")
    for map_, key, own in ((game_ids, "external_game_id", "game_id"), (player_ids, "external_player_id", "player_id")):
        if map_ is None:
            rows = rows.withColumn(own, F.col(key))
        else:
            known = map_.select(F.col(key).cast("string").alias(key), F.col(own).cast("string").alias("_own")).dropna().dropDuplicates([key])
            rows = rows.join(known, key, "left").withColumn(own, F.coalesce("_own", key)).drop("_own")
    out = rows.select(
        "game_id", "team", "player_id", "player_name", "batting_order", "position", "bats", F.lit(mode).alias("prediction_mode"),
        F.lit(source).alias("lineup_source"), F.lit(confidence).alias("lineup_confidence"), F.lit(1.0).alias("is_available"),
        F.lit(1.0).alias("is_expected_starter"), F.coalesce(F.lit(captured_at).cast("string"), "seen_at").alias("captured_at"),
        "provider_lineup_status", "external_game_id", "external_player_id", "game_date", "home_team", "away_team",
    )
    return out.dropna(subset=["game_id", "team", "player_id", "batting_order"])


def lineup_documents(lineups: DataFrame) -> DataFrame:
    """Standard lineups back to one provider document per (game, team), players in batting order."""
    player = F.struct(
        F.col("batting_order"), F.struct(F.col("player_id").alias("id"), F.col("player_name").alias("full_name"), "bats").alias("player")
    )
    grouped = lineups.groupBy("game_id", "team").agg(F.sort_array(F.collect_list(player)).alias("players"))
    entry = F.struct("game_id", F.col("team").alias("team_abbreviation"), "players")
    return grouped.select("game_id", "team", F.to_json(F.struct(F.array(entry).alias("data"))).alias("json"))
