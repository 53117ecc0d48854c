"""Cleaning, parsing, nested documents, pages and enrichment on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pregame.catalog import tables as T
from pregame.catalog.base import query, rounded, rounded_sql
from pregame.catalog.tables import read
from pregame.functions import scalars as C
from pregame.operators import joins as J
from pregame.plans import standardize as S
from pregame.session import shared_folder
from pregame.sources import pages as G
from pregame.sources import payloads as Y
from pregame.sources.tables import read_feature_tables, union_all, write_table
from pregame.streaming import landed


# -- scalars -------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'c' || o_custkey END AS text_id,
  CAST(9007199254740993 + o_orderkey AS VARCHAR) AS large_id, CAST(9007199254740993 + o_orderkey AS VARCHAR) AS large_text_id FROM orders""")
def canonical_ids(spark, folder):
    o = read(spark, folder, "orders")
    messy = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_custkey", F.lit(".0"))).otherwise(F.col("o_custkey").cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "nan").otherwise(F.concat(F.lit("c"), "o_custkey", F.lit(" ")))
    large = F.lit(9007199254740993) + F.col("o_orderkey")  # above 2^53, where doubles have gaps
    return o.select("o_orderkey", C.canonical_id(messy).alias("id"), C.canonical_id(text).alias("text_id"), C.canonical_id(large).alias("large_id"),
                    C.canonical_id(F.concat(F.lit(" "), large.cast("string"), F.lit(".0"))).alias("large_text_id"))


@query(rounded_sql("""SELECT event_id, CAST(user_id % 9 AS DOUBLE) + (event_id % 3) / 3.0 AS ip, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 9 + 2 / 3.0 END AS ip_fraction,
  CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(floor(value) AS DOUBLE) END AS stat FROM events""", ["ip", "ip_fraction"]))
def innings_and_stats(spark, folder):
    e = read(spark, folder, "events")
    u = F.col("user_id") % 9
    return rounded(e.select(
        "event_id", C.innings(F.concat(u, F.lit("."), F.col("event_id") % 3, F.lit("+"))).alias("ip"),
        C.innings_with_fraction(F.when(F.col("event_id") % 5 != 0, F.concat(u, F.lit(" &frac23;"))).otherwise(" ")).alias("ip_fraction"),
        C.stat_value(F.when(F.col("event_id") % 4 == 0, "-.--").otherwise(F.floor("value").cast("string"))).alias("stat"),
    ))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name_key FROM documents""")
def name_keys(spark, folder):
    return read(spark, folder, "documents").select("doc_id", C.name_key("text").alias("name_key"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[\\s\\x{00a0}혻]+', ' ', 'g')) AS clean FROM documents""")
def clean_texts(spark, folder):
    return read(spark, folder, "documents").select("doc_id", C.clean_text(C.strip_html("text")).alias("clean"))


@query(rounded_sql("""SELECT o_orderkey, CASE WHEN m > 0 THEN 100.0 / (m + 100.0) WHEN m < 0 THEN -m / (-m + 100.0) END AS implied
  FROM (SELECT o_orderkey, CAST(o_orderkey % 401 - 200 AS DOUBLE) AS m FROM orders)""", ["implied"]))
def implied_probabilities(spark, folder):
    odds = (F.col("o_orderkey") % 401 - 200).cast("double")
    return rounded(read(spark, folder, "orders").select("o_orderkey", C.american_implied_probability(odds).alias("implied")))


@query("""SELECT event_id, strftime(CAST(date_trunc('hour', ts + INTERVAL 30 MINUTE) AS TIMESTAMP), '%Y-%m-%d %H') AS hour, strftime(ts + INTERVAL 9 HOUR, '%m-%d %H:%M') AS east,
  CAST(CAST(ts AS DATE) - 1 AS DATE) AS day_before FROM events""")
def hours_and_zones(spark, folder):
    e = read(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.date_format(C.nearest_hour("ts"), "yyyy-MM-dd HH").alias("hour"), C.zone_time("ts", "Asia/Seoul").alias("east"),
                    C.previous_date("ts").alias("day_before"))


@query(rounded_sql("""SELECT o_orderkey, 2 * 3958.7613 * asin(sqrt(pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(d - c) / 2), 2))) AS miles
  FROM (SELECT o_orderkey, o_orderkey % 90 - 45.0 AS a, o_custkey % 90 - 45.0 AS b, o_orderkey % 180 - 90.0 AS c, o_custkey % 180 - 90.0 AS d FROM orders)""", ["miles"], 3))
def distances(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    miles = C.haversine_miles(k % 90 - 45.0, k % 180 - 90.0, c % 90 - 45.0, c % 180 - 90.0)
    return rounded(read(spark, folder, "orders").select("o_orderkey", miles.alias("miles")), 3)


@query("""SELECT o_orderkey, CAST(40 + o_orderkey % 60 AS DOUBLE) AS temperature, CAST(o_custkey % 30 AS DOUBLE) AS wind_speed,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Out To CF' END AS wind_direction, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 101 AS DOUBLE) END AS humidity,
  CAST(o_orderkey % 5 = 0 AS DOUBLE) AS is_dome, CASE WHEN o_orderkey % 5 = 0 THEN 'Roof Closed' ELSE 'Clear' END ||
  CASE WHEN o_orderkey % 3 = 0 THEN ', humidity ' || (o_custkey % 101) || '%' ELSE '' END AS weather_condition, 'boxscore' AS weather_source FROM orders""")
def weather_texts(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    humid = F.when(k % 3 == 0, F.concat(F.lit(", humidity "), c % 101, F.lit("%"))).otherwise("")
    sky = F.concat(40 + k % 60, F.lit(" degrees, "), F.when(k % 5 == 0, "Roof Closed").otherwise("Clear"), humid, F.lit("."))
    wind = F.concat(c % 30, F.lit(" mph, "), F.when(k % 2 == 0, "Out To CF").otherwise("None"), F.lit("."))
    fields = C.weather_fields(sky, wind, "boxscore")
    return read(spark, folder, "orders").select("o_orderkey", *[v.alias(n) for n, v in fields.items()])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE 'ASIA' END AS away_team, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE 'MIDDLE EAST' END AS home_team,
  CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey % 20 AS DOUBLE) END AS away_score, CASE WHEN o_orderkey % 5 < 2 THEN 3.0 END AS home_score,
  CASE o_orderkey % 5 WHEN 0 THEN 'Final' WHEN 1 THEN 'Bot 9th' WHEN 2 THEN 'Canceled' WHEN 3 THEN 'Scheduled' END AS status,
  CAST(o_orderkey % 5 = 0 AS INTEGER) AS is_final, CAST(o_orderkey % 5 = 1 AS INTEGER) AS is_live, CAST(o_orderkey % 5 = 2 AS INTEGER) AS is_canceled,
  CASE WHEN o_orderkey % 5 = 2 THEN 'Rained Out' END AS cancel_reason, CASE WHEN o_orderkey % 5 = 3 THEN '6:30pm' END AS scheduled_time,
  CASE WHEN o_orderkey % 5 = 3 THEN 'Park ' || o_custkey END AS venue_name FROM orders""")
def schedule_texts(spark, folder):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    text = (
        F.when(k == 0, F.concat(F.lit("ASIA "), c % 20, F.lit(" : 3 Final MIDDLE EAST")))
        .when(k == 1, F.concat(F.lit("ASIA "), c % 20, F.lit(" : 3 Bot 9th  MIDDLE EAST")))
        .when(k == 2, "ASIA Canceled Rained Out MIDDLE EAST")
        .when(k == 3, F.concat(F.lit("ASIA 6:30PM Park "), c, F.lit(" MIDDLE EAST")))
        .otherwise("Standings")
    )
    rows = read(spark, folder, "orders").select("o_orderkey", text.alias("text"))
    fields = S.schedule_text("text", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    return rows.select("o_orderkey", *[v.alias(n) for n, v in fields.items()])


# -- pages ---------------------------------------------------------------------------------

_HIDDEN = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"


def _decoded_sql(text: str) -> str:
    """The character references that the pages hold; `&amp;` last, as its result is not read again."""
    for name, plain in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7")):
        text = f"replace({text}, '{name}', '{plain}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


@query(f"""SELECT page_id, link_no, {_decoded_sql("text")} AS text, {_decoded_sql("href")} AS href FROM (SELECT page_id, unnest(range(1, len(e) + 1)) AS link_no,
  unnest(list_transform(e, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g')))) AS text,
  unnest(list_transform(e, lambda x: nullif(regexp_extract(x, '(?is)^<[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1), ''))) AS href
  FROM (SELECT page_id, regexp_extract_all({_HIDDEN}, '(?is)(<a\\b[^>]*>.*?</a>)', 1) AS e FROM pages)) WHERE href IS NOT NULL""")
def page_links(spark, folder):
    out = G.page_links(read(spark, folder, "pages"))
    return out.withColumn("link_no", F.col("link_no").cast("bigint"))


@query(f"""SELECT page_id, line_number, {_decoded_sql("text")} AS text FROM (SELECT page_id, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line_number, unnest(l) AS text FROM (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(
    regexp_extract({_HIDDEN}, '(?is)<body\\b[^>]*>(.*)$', 1), '<[^>]*>', chr(10), 'g'), '\\r?\\n'),
    lambda x: trim(regexp_replace(x, '[\\s\\x{{00a0}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages))""")
def page_text_lines(spark, folder):
    out = G.page_lines(read(spark, folder, "pages"))
    return out.withColumn("line_number", F.col("line_number").cast("bigint"))


@query("""SELECT l_orderkey AS page_id, 1 AS table_no, CAST(2 + (n - 1) AS INTEGER) AS row_no, 'AB' AS h2, 'AB_2' AS h3, 'column_4' AS h4,
  'p' || l_partkey AS c1, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c2, CAST(l_linenumber AS VARCHAR) AS c3 FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity) AS n FROM lineitem)""")
def page_table_rows(spark, folder):
    """Order lines written as page tables, then read back."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    line = F.struct("l_partkey", "l_linenumber", "l_quantity")
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    tr = F.transform("l", lambda x: F.concat(
        F.lit("<tr>"), cell(F.concat(F.lit("<b>p"), x["l_partkey"], F.lit("</b>"))), cell(x["l_quantity"].cast("bigint")),
        cell(x["l_linenumber"]), cell(F.lit(" ")), F.lit("</tr>")))
    head = "<table><tr><th>Team</th><th>AB</th><th>AB</th><th></th></tr>"
    pages = lines.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit(head), F.array_join(tr, ""), F.lit("<tr><td>x</td></tr></table>")).alias("html"))
    out = G.page_tables(pages)
    item = lambda a, i: F.element_at(a, i)
    return out.select("page_id", "table_no", "row_no", item("headers", 2).alias("h2"), item("headers", 3).alias("h3"), item("headers", 4).alias("h4"),
                      item("cells", 1).alias("c1"), item("cells", 2).alias("c2"), item("cells", 3).alias("c3"))


# Order lines as game pages: parts with even numbers are one team's, odd ones the other's. The pitching table of the first
# team stands there twice; its batting table comes again in reverse order, which makes it another table.
_PAGE_LINES = """WITH l AS (SELECT l_orderkey AS g, l_partkey AS part, CAST(l_quantity AS BIGINT) AS q, l_partkey % 2 AS odd,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_partkey, l_linenumber, l_quantity) AS n,
    count(*) FILTER (l_partkey % 2 = 0) OVER (PARTITION BY l_orderkey) AS evens, count(*) FILTER (l_partkey % 2 = 1) OVER (PARTITION BY l_orderkey) AS odds
    FROM lineitem),
  first AS (SELECT *, odd = 0 OR evens = 0 AS away FROM l),
  turned AS (SELECT *, FALSE AS away FROM l WHERE odds = 0 AND evens >= 2),
  games AS (SELECT o_orderkey AS g, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INTEGER) AS season, 'H' || o_custkey % 10 AS h, 'A' || o_custkey % 7 AS a
    FROM orders WHERE o_orderkey % 11 <> 0)"""
_PAGE_BASE = """CAST(g AS VARCHAR) AS game_id, game_date, season, CASE WHEN part % 5 <> 0 THEN CAST(part AS VARCHAR) END AS player_id,
  'p' || part || ' ' || n AS player_name, CASE WHEN away THEN a ELSE h END AS team"""


def _page_logs(spark, folder):
    """Pages written as HTML, then read back as tables and links."""
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity"))).alias("l"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    number = lambda c: cell(c.cast("string"))

    def who(x, n):
        name = F.concat(F.lit("p"), x["l_partkey"], F.lit(" "), n)
        link = F.concat(F.lit('<a href="/player/?PlayerID='), x["l_partkey"], F.lit('&amp;x=1">'), name, F.lit("</a>"))
        return cell(F.when(x["l_partkey"] % 5 != 0, link).otherwise(name))

    def pitching(x, i):
        q, n = x["l_quantity"].cast("bigint"), i + 1
        decision = F.when(n % 4 == 1, "S").when(n % 4 == 2, "h").otherwise("")
        innings = F.concat((q % 9).cast("string"), F.lit("."), (q % 3).cast("string"))
        return F.concat(F.lit("<tr>"), cell(decision), number(i), who(x, n), number(q * 100), number(q), cell(innings), number(q % 5), F.lit("</tr>"))

    def batting(x, i):
        q, n = x["l_quantity"].cast("bigint"), i + 1
        return F.concat(F.lit("<tr>"), cell(F.when(n < 4, n.cast("string")).otherwise("")), cell(F.lit("CF")), who(x, n), number(q % 6), number(q % 2), number(q % 4), F.lit("</tr>"))

    heads = {"p": ["", "Index", "Pitcher", "NP", "BF", "IP", "K"], "b": ["Order", "Pos", "Batter", "AB", "R", "H"]}

    def table(kind, rows):
        head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in heads[kind]) + "</tr>"
        return F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</table>"))

    even, odd = F.filter("l", lambda x: x["l_partkey"] % 2 == 0), F.filter("l", lambda x: x["l_partkey"] % 2 == 1)
    parts = [table("p", F.transform(even, pitching)), table("p", F.transform(even, pitching)), F.lit("<table><tr><th>Other</th></tr><tr><td>x</td></tr></table>"),
             table("p", F.transform(odd, pitching)), table("b", F.transform(even, batting)), table("b", F.transform(odd, batting)),
             table("b", F.reverse(F.transform(even, batting)))]
    pages = lines.select(F.col("l_orderkey").alias("game_id"), F.concat(*parts).alias("html"))
    rows = G.page_tables(pages, "game_id").withColumn("cell", F.map_from_arrays("headers", "cells"))
    links = S.player_links(G.page_links(pages, "game_id"), r"PlayerID=([^&#]+)", page="game_id")
    games = read(spark, folder, "orders").filter("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.year("o_orderdate").alias("season"),
        F.concat(F.lit("H"), F.col("o_custkey") % 10).alias("home_team"), F.concat(F.lit("A"), F.col("o_custkey") % 7).alias("away_team"))
    return S.indexed_page_logs(rows, games, links)


@query(f"""{_PAGE_LINES} SELECT {_PAGE_BASE}, CAST(NULL AS VARCHAR) AS opposing_pitcher_hand, CAST(q % 6 AS DOUBLE) AS at_bats, CAST(q % 4 AS DOUBLE) AS hits,
  CAST(0 AS DOUBLE) AS doubles, CAST(0 AS DOUBLE) AS triples, CAST(0 AS DOUBLE) AS home_runs, CAST(0 AS DOUBLE) AS walks, CAST(0 AS DOUBLE) AS hit_by_pitch,
  CAST(0 AS DOUBLE) AS sacrifice_flies, CAST(q % 4 AS DOUBLE) AS total_bases, CAST(q % 6 AS DOUBLE) AS plate_appearances
  FROM (SELECT * FROM first UNION ALL SELECT * FROM turned) LEFT JOIN games USING (g)""")
def page_batting_logs(spark, folder):
    return _page_logs(spark, folder)["batting_logs"]


@query(f"""{_PAGE_LINES} SELECT {_PAGE_BASE}, CAST(n AS DOUBLE) AS batting_order, 'CF' AS position, 'confirmed_lineup' AS prediction_mode,
  'game_page' AS lineup_source, CAST(1 AS DOUBLE) AS lineup_confidence
  FROM (SELECT * FROM first UNION ALL SELECT * FROM turned) LEFT JOIN games USING (g) WHERE n < 4""")
def page_lineups(spark, folder):
    return _page_logs(spark, folder)["lineups"]


@query(f"""{_PAGE_LINES} SELECT {_PAGE_BASE}, CAST(q * 100 AS DOUBLE) AS pitches, CAST(q AS DOUBLE) AS batters_faced, q % 9 + (q % 3) / CAST(3 AS DOUBLE) AS innings_pitched,
  CAST(q % 5 AS DOUBLE) AS strikeouts, CAST(n = 1 AS DOUBLE) AS is_start, CASE WHEN n = 1 THEN 'SP' ELSE 'RP' END AS role,
  CAST(n % 4 = 1 AS DOUBLE) AS is_closer, CAST(n % 4 IN (1, 2) AS DOUBLE) AS is_high_leverage FROM first LEFT JOIN games USING (g)""")
def page_pitcher_logs(spark, folder):
    out = _page_logs(spark, folder)["pitcher_logs"]
    # The pages made here have no such columns.
    return out.drop("hits", "home_runs", "walks", "hit_by_pitch", "runs", "earned_runs")


# -- nested documents ----------------------------------------------------------------------


def _schedule_json(spark, folder):
    g = T.games(spark, folder)
    side = lambda s: F.struct(
        F.struct(F.col(f"{s}_team").alias("name"), F.col(f"{s}_team").alias("abbreviation")).alias("team"), F.col(f"{s}_score").alias("score"),
        F.struct(F.col(f"{s}_sp_id").cast("bigint").alias("id")).alias("probablePitcher"))
    game = F.struct(
        F.col("game_id").cast("bigint").alias("gamePk"), F.date_format("game_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"), F.col("season").cast("string").alias("season"),
        F.struct(F.lit("Final").alias("detailedState")).alias("status"), F.struct(side("home").alias("home"), side("away").alias("away")).alias("teams"),
        F.struct(F.col("venue_id").alias("id")).alias("venue"))
    return g.select(F.to_json(F.struct(F.array(F.struct(F.array(game).alias("games"))).alias("dates"))).alias("json"))


@query(f"""WITH {T.GAMES_SQL} SELECT game_id, season, CAST(game_date AS DATE) AS day, home_team, away_team, home_score, away_score, home_sp_id, away_sp_id, venue_id, 'Final' AS status FROM games""")
def schedule_documents(spark, folder):
    out = Y.schedule_rows(_schedule_json(spark, folder))
    return out.select("game_id", "season", F.to_date("game_date").alias("day"), "home_team", "away_team", "home_score", "away_score",
                      "home_sp_id", "away_sp_id", "venue_id", "status")


def _boxscore_json(spark, folder):
    """One box score per game: every line's part bats for the side its number says."""
    rows = T.batting_logs.once(spark, folder).join(T.games(spark, folder).select("game_id", "home_team"), "game_id")
    stats = F.create_map(*[x for n, k in (("hits", "hits"), ("atBats", "at_bats"), ("doubles", "doubles"), ("triples", "triples"), ("homeRuns", "home_runs"))
                           for x in (F.lit(n), F.col(k).cast("bigint").cast("string"))])
    entry = F.struct(F.concat(F.lit("ID"), "player_id").alias("k"), F.struct(
        F.struct(F.col("player_id").alias("id")).alias("person"), F.struct(stats.alias("batting")).alias("stats")).alias("v"))
    at = lambda flag: F.map_from_entries(F.collect_list(F.when((F.col("team") == F.col("home_team")) == flag, entry)))
    order = lambda flag: F.sort_array(F.collect_list(F.when((F.col("team") == F.col("home_team")) == flag, F.col("player_id"))))
    both = rows.groupBy("game_id").agg(at(True).alias("h"), at(False).alias("a"), order(True).alias("ho"), order(False).alias("ao"))
    side = lambda players, order_: F.struct(F.col(order_).alias("battingOrder"), F.col(players).alias("players"))
    info = F.array(F.struct(F.lit("Weather").alias("label"), F.lit("70 degrees, Dome.").alias("value")))
    return both.select("game_id", F.to_json(F.struct(info.alias("info"), F.struct(side("h", "ho").alias("home"), side("a", "ao").alias("away")).alias("teams"))).alias("json"))


@query(f"""WITH {T.GAMES_SQL}, {T.BATTING_SQL} SELECT game_id, player_id, team, hits, at_bats, hits + doubles + 2 * triples + 3 * home_runs AS total_bases, 0.0 AS walks FROM batting_logs""")
def boxscore_batting(spark, folder):
    tables = S.boxscore_tables(T.games(spark, folder), _boxscore_json(spark, folder))
    return tables["batting_logs"].select("game_id", "player_id", "team", "hits", "at_bats", "total_bases", "walks")


@query(f"""WITH {T.GAMES_SQL}, {T.BATTING_SQL} SELECT game_id, team, player_id, CAST(row_number() OVER (PARTITION BY game_id, team ORDER BY player_id) AS DOUBLE) AS batting_order,
  'pre_lineup' AS prediction_mode, 1.0 AS is_available FROM batting_logs""")
def boxscore_lineups(spark, folder):
    tables = S.boxscore_tables(T.games(spark, folder), _boxscore_json(spark, folder), mode="pre_lineup")
    return tables["lineups"].select("game_id", "team", "player_id", "batting_order", "prediction_mode", "is_available")


@query(f"""WITH {T.GAMES_SQL}, {T.LINEUPS_SQL} SELECT game_id, team, player_id, batting_order, 'n' || player_id AS player_name, 0.65 AS lineup_confidence FROM lineups""")
def provider_lineup_documents(spark, folder):
    rows = T.lineups.once(spark, folder, T.games.once).withColumn("player_name", F.concat(F.lit("n"), "player_id"))
    out = Y.provider_lineups(Y.lineup_documents(rows), "provider")
    return out.select("game_id", "team", "player_id", "batting_order", "player_name", "lineup_confidence")


@query("""SELECT user_id, event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, floor(value) AS humidity FROM events""")
def hourly_weather_documents(spark, folder):
    e = read(spark, folder, "events").select("user_id", "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), F.floor("value").cast("double").alias("v"))
    body = F.struct(F.struct(F.array(F.date_format("h", "yyyy-MM-dd'T'HH:mm")).alias("time"), F.array("v").alias("relative_humidity_2m"),
                             F.array("v").alias("temperature_2m"), F.array("v").alias("wind_speed_10m"), F.array("v").alias("wind_direction_10m")).alias("hourly"))
    out = Y.hourly_weather_rows(e.select("user_id", "event_id", F.to_json(body).alias("json")), ["user_id", "event_id"])
    return out.select("user_id", "event_id", F.col("weather_hour").cast("timestamp_ntz").alias("h"), "humidity")


# -- enrichment ----------------------------------------------------------------------------


@query(f"""WITH {T.GAMES_SQL}, {T.PITCHING_SQL}, best AS (SELECT game_id, team, player_id FROM pitcher_logs WHERE is_start = 1
  QUALIFY row_number() OVER (PARTITION BY game_id, team ORDER BY innings_pitched DESC, pitches DESC, player_id DESC) = 1)
  SELECT g.game_id, CASE WHEN game_no % 2 = 0 THEN home_sp_id ELSE h.player_id END AS home_sp_id, a.player_id AS away_sp_id FROM games g
  LEFT JOIN best h ON g.game_id = h.game_id AND g.home_team = h.team LEFT JOIN best a ON g.game_id = a.game_id AND g.away_team = a.team""")
def games_with_starters(spark, folder):
    g = T.games(spark, folder).select(
        "game_id", "home_team", "away_team", F.when(F.col("game_id").cast("bigint") % 2 == 0, F.col("home_sp_id")).otherwise(" ").alias("home_sp_id"))
    return S.with_starters(g, T.pitcher_logs(spark, folder)).select("game_id", "home_sp_id", "away_sp_id")


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey ELSE 'vn_' || regexp_replace(lower(n_name), '[^a-z0-9]', '_', 'g') END AS venue_id,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS venue_latitude FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def games_with_named_venues(spark, folder):
    nation = read(spark, folder, "nation")
    games = read(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("venue_name"))
    venues = nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("v"), "n_nationkey").alias("venue_id"), F.col("n_name").alias("venue_name"),
                                                        F.col("n_nationkey").cast("double").alias("latitude"))
    return S.with_named_venues(games, venues, "vn_").select("c_custkey", "venue_id", "venue_latitude")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS game_id, min(CASE WHEN l_linenumber % 2 = 0 THEN q END) AS home_score, min(CASE WHEN l_linenumber % 2 = 1 THEN q END) AS away_score
  FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, sum(l_quantity) AS q FROM (SELECT l_orderkey, l_linenumber % 2 AS l_linenumber, l_quantity FROM lineitem) GROUP BY ALL)
  GROUP BY o_orderkey HAVING count(*) = 2""")
def two_row_game_results(spark, folder):
    side = F.when(F.col("l_linenumber") % 2 == 0, "Home").otherwise("Away")
    rows = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("GameID"), side.alias("Home or Away")).agg(F.sum("l_quantity").alias("Score"))
    rows = rows.withColumns({"Season": F.lit("2024"), "Date": F.lit("2024-04-01"), "Game Type": F.lit("R"), "Team": F.col("Home or Away"), "Ballpark": F.lit("Park")})
    return S.two_row_results(rows).select("game_id", "home_score", "away_score")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CASE s WHEN 0 THEN 'A' ELSE 'H' END || o_custkey AS team, CAST(b AS INTEGER) AS batting_order
  FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS s) CROSS JOIN (SELECT unnest(range(1, 10)) AS b)""")
def lineup_templates(spark, folder):
    games = read(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("game_id"), F.col("o_orderdate").alias("game_date"),
        F.concat(F.lit("H"), "o_custkey").alias("home_team"), F.concat(F.lit("A"), "o_custkey").alias("away_team"))
    return S.lineup_template(games).select("game_id", "team", "batting_order")


@query("""SELECT gid AS game_id, team, CAST(s AS DOUBLE) AS batting_order, 'p' || (gid + s) AS player_id FROM (
  SELECT o_orderkey AS gid, o_custkey AS team, unnest(range(1, 10)) AS s FROM orders WHERE o_orderpriority <> '5-LOW') WHERE (gid + s) % 4 <> 0""")
def wide_starters_to_rows(spark, folder):
    k = F.col("o_orderkey")
    starts = [F.when((k + i) % 4 == 0, " ").otherwise(F.concat(F.lit("p"), k + i)).alias(f"start_l{i}") for i in range(1, 10)]
    wide = read(spark, folder, "orders").select(k.alias("gid"), F.col("o_custkey").alias("team"), *starts,
                                                F.when(F.col("o_orderpriority") == "5-LOW", "official").otherwise("value").alias("stattype"))
    return S.retro_lineups(wide).select("game_id", "team", "batting_order", "player_id")


@query("""SELECT c_custkey AS game_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN n = 1 THEN 'id' || k END AS player_id,
  0.6 AS lineup_confidence FROM (SELECT c_custkey, c_custkey % 300 AS k FROM customer) LEFT JOIN (SELECT s_suppkey % 60 AS k, count(*) AS n FROM supplier GROUP BY 1) USING (k)""")
def manual_lineup_ids(spark, folder):
    rows = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("game_id"), F.lit("T").alias("team"), F.lit("1").alias("batting_order"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat("c_custkey", F.lit(".0"))).alias("player_id"), F.concat(F.lit("Name "), F.col("c_custkey") % 300, F.lit(" Jr.")).alias("player_name"))
    k = F.col("s_suppkey") % 60
    register = read(spark, folder, "supplier").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(k))).select(
        F.when(F.col("n") == 1, F.concat(F.lit("id"), k)).otherwise(F.concat(F.lit("x"), "s_suppkey")).alias("mlbam_id"), F.lit("name").alias("name_first"), k.cast("string").alias("name_last"))
    return S.manual_lineups(rows, register).select("game_id", "player_id", "lineup_confidence")


@query("""SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 50.0 END, h) AS DOUBLE) AS humidity,
  CASE WHEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 50.0 END, h) IS NOT NULL THEN 'hourly' END AS humidity_source
  FROM orders LEFT JOIN (SELECT DISTINCT user_id % 25 AS v, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, 40.0 AS h FROM events) e
  ON o_custkey % 25 = v AND CAST(o_orderdate AS TIMESTAMP) + INTERVAL 8766 HOUR * 3 = d + INTERVAL 18 HOUR""")
def hourly_weather_join(spark, folder):
    o = read(spark, folder, "orders")
    shifted = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 3 * 8766 * 3_600_000_000)
    games = o.select(F.col("o_orderkey").alias("game_id"), shifted.alias("game_date"), F.lit(1).alias("season"), (F.col("o_custkey") % 25).alias("venue_id"))
    weather = o.select(F.col("o_orderkey").alias("game_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(50.0)).alias("humidity"))
    venues = read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("venue_id"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"))
    hours = read(spark, folder, "events").select(
        (F.col("user_id") % 25).alias("venue_id"), F.lit(1).alias("season"), F.lit(40.0).alias("humidity"),
        F.timestamp_micros(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))) + 18 * 3_600_000_000).alias("weather_hour")).distinct()
    out = S.with_hourly_weather(games, weather, venues, hours, "hourly")
    return out.select(F.col("game_id").alias("o_orderkey"), "humidity", "humidity_source")


@query(f"""WITH {T.GAMES_SQL} SELECT game_id, venue_latitude, venue_timezone_offset FROM games""")
def venue_metadata(spark, folder):
    from pregame.plans.features import with_venues

    g = T.games(spark, folder)
    venues = g.select("venue_id", F.col("venue_latitude").alias("latitude"), F.col("venue_longitude").alias("longitude")).distinct()
    bare = g.select("game_id", "venue_id", F.when(F.col("game_id").cast("bigint") % 2 == 0, F.col("venue_latitude")).alias("venue_latitude"))
    return with_venues(bare, venues).select("game_id", "venue_latitude", "venue_timezone_offset")


# -- files and landing ---------------------------------------------------------------------


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def landed_snapshots(spark, folder):
    """Events landed as files in two batches, ingested twice, then the newest per user."""
    base = f"{shared_folder(spark)}/landing/{uuid.uuid4().hex}"
    e = read(spark, folder, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("captured_at"))
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        landed.ingest(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", e.schema, "parquet")
    landed.ingest(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", e.schema, "parquet")
    return landed.latest_snapshots(spark, f"{base}/table", ["user_id"]).select("user_id", "event_id", "value")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, CASE WHEN year(o_orderdate) < 1999 THEN o_custkey END AS o_custkey FROM orders""")
def feature_table_union(spark, folder):
    """Tables written by season, with and without a column, read back as one."""
    base = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    o = read(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), "o_custkey")
    write_table(o.filter("season < 1999"), f"{base}/old")
    write_table(o.filter("season >= 1999").drop("o_custkey"), f"{base}/new")
    return read_feature_tables(spark, [f"{base}/old", f"{base}/new"]).drop("source_file")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def combined_chunks(spark, folder):
    from pregame.operators.events import combine_pitches

    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("game_pk"), F.col("l_linenumber").alias("at_bat_number"), F.lit(1).alias("pitch_number"))
    out = combine_pitches(union_all([lines, lines.filter("at_bat_number > 2")]))
    return out.select(F.col("game_pk").alias("l_orderkey"), F.col("at_bat_number").alias("l_linenumber"))
