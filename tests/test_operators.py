import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pregame.functions import scalars as C
from pregame.operators import events as E
from pregame.operators import identity as I
from pregame.operators import joins as J
from pregame.operators import medians as M
from pregame.operators import parks, quality


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_identifiers_and_numbers(spark):
    got = {t: _one(spark, C.canonical_id(F.lit(t))) for t in ("123.0", " 45 ", "ab1", "nan", "", "None", "1.5", "1d")}
    assert got == {"123.0": "123", " 45 ": "45", "ab1": "ab1", "nan": None, "": None, "None": None, "1.5": "1.5", "1d": "1d"}
    assert _one(spark, C.number_with_commas(F.lit("1,234.5"))) == 1234.5
    assert _one(spark, C.number(F.lit("1d"))) is None
    assert _one(spark, C.percent(F.lit(1), F.lit(3))) == 33.3 and _one(spark, C.percent(F.lit(1), F.lit(0))) == 0.0


def test_innings(spark):
    for text, value in {"6.0": 6, "5.1": 5 + 1 / 3, "0.2": 2 / 3, "5.2+": 5 + 2 / 3, "": 0, "7": 7}.items():
        assert _one(spark, C.innings(F.lit(text))) == pytest.approx(value)
    assert _one(spark, C.innings_with_fraction(F.lit("5 &frac23;"))) == pytest.approx(5 + 2 / 3)
    assert _one(spark, C.innings_with_fraction(F.lit("5 1/3"))) == pytest.approx(5 + 1 / 3)
    assert _one(spark, C.innings_with_fraction(F.lit(" "))) is None


def test_weather_texts(spark):
    fields = C.weather_fields(F.lit("68 degrees, Roof Closed."), F.lit("0 mph, None."), "x")
    row = spark.range(1).select(*[c.alias(n) for n, c in fields.items()]).first()
    assert (row.temperature, row.wind_speed, row.wind_direction, row.is_dome, row.weather_condition) == (68, 0, None, 1, "Roof Closed")
    assert _one(spark, C.humidity(F.lit("Partly cloudy, humidity 57%."))) == 57
    assert _one(spark, C.humidity(F.lit("57 % humidity"))) == 57


def test_names_and_odds(spark):
    assert _one(spark, C.name_key(F.lit("Test Player Jr."))) == "test player"
    assert _one(spark, C.slug(F.lit("Big (Dome) 1"), "npb_")) == "npb_big__dome__1"
    assert _one(spark, C.american_implied_probability(F.lit(-110.0))) == pytest.approx(110 / 210)
    assert _one(spark, C.american_implied_probability(F.lit(0.0))) is None
    order, name = C.order_and_name(F.lit("1 Some Name #7"))
    assert (_one(spark, order), _one(spark, name)) == (1, "Some Name")
    rank, name = C.rank_and_name(F.lit("3 Name Here"))
    assert (_one(spark, rank), _one(spark, name)) == (3, "Name Here")


PITCHES = [
    (1, "2024-04-01", 10, 20, "HOM", "AWY", "Top", "single", "hit_into_play", 97.0, 12.0, 3.0, 0.43, 0.9),
    (1, "2024-04-01", 10, 20, "HOM", "AWY", "Top", "home_run", "hit_into_play", 101.0, 28.0, 6.0, 1.8, 2.0),
    (1, "2024-04-01", 11, 21, "HOM", "AWY", "Bot", None, "swinging_strike", None, None, None, None, None),
]
PITCH_COLUMNS = ("game_pk long, game_date string, batter long, pitcher long, home_team string, away_team string, inning_topbot string, events string, "
                 "description string, launch_speed double, launch_angle double, launch_speed_angle double, estimated_woba_using_speedangle double, woba_value double")


def test_event_sums(spark):
    df = spark.createDataFrame(PITCHES, PITCH_COLUMNS)
    batters = {r.player_id: r for r in E.event_quality(df, "batter").collect()}
    b = batters["10"]
    assert (b.team, b.statcast_pa, b.statcast_batted_balls, b.statcast_hard_hit_balls, b.statcast_barrels) == ("AWY", 2, 2, 2, 1)
    assert b.statcast_xwoba_sum == pytest.approx(2.23) and b.statcast_woba_sum == pytest.approx(2.9)
    assert batters["11"].statcast_whiffs == 1 and batters["11"].statcast_pa == 0
    p = {r.player_id: r for r in E.event_quality(df, "pitcher").collect()}["20"]
    assert (p.team, p.statcast_batters_faced, p.statcast_barrels_allowed) == ("HOM", 2, 1)
    logs = spark.createDataFrame([("1", "10", "AWY"), ("1", "99", "AWY")], "game_id string, player_id string, team string")
    merged = {r.player_id: r.statcast_pa for r in E.merge_quality(logs, E.event_quality(df, "batter")).collect()}
    assert merged == {"10": 2, "99": None}
    with pytest.raises(ValueError):
        E.event_quality(df.drop("batter"), "batter")


def test_park_factors(spark):
    games = spark.createDataFrame([("a", 2024, "10", "X", 8, 6), ("b", 2024, "10", "X", 7, 5), ("c", 2024, "20", "Y", 2, 1), ("d", 2024, "20", "Y", 3, 1)],
                                  "game_id string, season int, venue_id string, venue_name string, home_score int, away_score int")
    homers = spark.createDataFrame([("a", 4), ("b", 2), ("c", 0), ("d", 1)], "game_id string, home_runs int")
    rows = {r.venue_id: r for r in parks.park_factors(games, homers, min_games=1).collect()}
    assert rows["10"].season == 2025 and rows["10"].source_games == 2
    assert rows["10"].park_factor_run == pytest.approx(1.5757575758) and rows["20"].park_factor_run == pytest.approx(0.4242424242)
    assert rows["10"].park_factor_hr == pytest.approx(1.7142857143) and rows["20"].park_factor_hr == pytest.approx(0.2857142857)


def test_id_map(spark):
    register = spark.createDataFrame([("k1", "123.0", "456.0", "A", "B", "2024"), ("k2", None, None, "C", "D", None)],
                                     "key_person string, key_mlbam string, key_fangraphs string, name_first string, name_last string, mlb_played_last string")
    people = spark.createDataFrame([(123.0, "R", "L")], "player_id double, bats string, throws string")
    rows = I.build_id_map(register, people).collect()
    assert [(r.mlbam_id, r.fangraphs_id, r.throws, r.mlb_played_last) for r in rows] == [("123", "456", "L", 2024)]


def test_unique_player_and_game_matches(spark):
    provider = spark.createDataFrame([("p1", "Test Player Jr."), ("p2", "Ambiguous Name"), ("p3", None)], "external_player_id string, player_name string")
    register = spark.createDataFrame([("1", "Test", "Player"), ("2", "Ambiguous", "Name"), ("3", "Ambiguous", "Name")], "mlbam_id string, name_first string, name_last string")
    out = I.external_player_ids(provider, register).collect()
    assert [(r.external_player_id, r.player_id) for r in out] == [("p1", "1")]
    games = spark.createDataFrame([("778001", "2026-05-26 23:05:00", "NYY", "BOS"), ("8", "2026-05-27 17:00:00", "SEA", "LAA"), ("9", "2026-05-27 22:00:00", "SEA", "LAA")],
                                  "game_id string, game_date string, home_team string, away_team string").withColumn("game_date", F.to_timestamp("game_date"))
    wanted = games.select(F.concat(F.lit("x"), "game_id").alias("external_game_id"), "game_date", F.lower("home_team").alias("home_team"), "away_team")
    assert [(r.external_game_id, r.game_id) for r in I.external_game_ids(wanted, games).collect()] == [("x778001", "778001")]


def test_asof_in_buckets_is_strict(spark):
    left = spark.createDataFrame([("k", t, t) for t in range(0, 40, 3)], "k string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("k", t, i) for i, t in enumerate(sorted([*range(0, 40, 4), 12]))], "k string, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    history = right.select("k", "ts", "v")
    want = {t: max([r.v for r in right.collect() if r.s < t], default=None) for t in range(0, 40, 3)}
    for seconds in (1000, 10, 1):
        out = J.asof_strict(left, history, ["k"], "ts", ["v"], "v", width=seconds * 1_000_000)
        tie_free = {r.n: r.v for r in out.collect()}
        assert tie_free.keys() == want.keys()
        assert all(tie_free[t] == v for t, v in want.items())


def test_set_continuity_in_chunks(spark):
    sets = {"g1": "abc", "g2": "abd", "g3": "", "g4": "ab", "g5": "xa"}
    rows = [("T", g, i, m) for i, (g, ms) in enumerate(sets.items()) for m in (ms or [None])] + [("T", "g2", 1, "a")]
    df = spark.createDataFrame(rows, "team string, game string, day long, m string")
    for size in (1000, 2):
        out = {(r.game, r.m): (r.returned, r.previous_missing) for r in J.set_continuity(df, "team", "game", ["day"], "m", size).collect()}
        assert out["g2", "a"] == (1.0, 1.0) and out["g2", "d"] == (0.0, 1.0)
        assert out["g1", "a"] == (None, None) and out["g3", None] == (0.0, 3.0)
        assert out["g4", "a"] == (None, None) and out["g5", "x"] == (0.0, 1.0) and out["g5", "a"] == (1.0, 1.0)


def test_unique_match_drops_ambiguous_names(spark):
    """Against plain counting: names shared on either side, NULL names and ids, repeated rows."""
    draw = random.Random(9)
    left = [(i, draw.choice(["a", "b", "c", "d", None])) for i in range(30)] * 2 + [(i, "b") for i in range(5)]
    right = [(100, "a"), (100, "a"), (101, "b"), (102, "b"), (None, "c"), (103, "c"), (104, None)]
    met = {}
    for i, k in left:
        met.setdefault(i, set()).update(r for r, name in right if r is not None and k is not None and name == k)
    out = J.unique_match(spark.createDataFrame(left, "l int, k string"), spark.createDataFrame(right, "r int, k string"), ["k"], "l", "r")
    assert sorted((r.l, r.r) for r in out.select("l", "r").collect()) == sorted((i, *found) for i, found in met.items() if len(found) == 1)


def test_exact_medians_by_narrowed_histograms(spark):
    values = [5.0, 1.0, 1.0, 1.0, 8.0, 2.0, 2.0, 9.0, None]
    df = spark.createDataFrame([(v, float(i), None) for i, v in enumerate(values)], "a double, b double, empty double")
    want = {"a": statistics.median([v for v in values if v is not None]), "b": 4.0}
    for parts in (1, 5):
        assert {r["column"]: r["median"] for r in quality.exact_medians(df.repartition(parts), ["a", "b", "empty"]).collect()} == want
    assert quality.exact_medians(df.limit(0), ["a", "b"]).collect() == []


def test_middles_of_groups_and_of_all_earlier_seasons(spark):
    draw = random.Random(5)
    odd = [-0.0, 0.0, math.inf, -math.inf, 5e-324, -1e308, 1.0, 1.0 + 2**-52]
    rows = [(draw.choice([2020, 2021, 2023, None]), draw.choice(["x", None]), draw.choice([*odd, draw.gauss(0, 1e-3), draw.gauss(1e6, 1), None]))
            for _ in range(900)]
    df = spark.createDataFrame(rows, "season int, g string, v double").repartition(6)

    def want(chosen):
        known = sorted(v for v in chosen if v is not None)
        return known[(len(known) - 1) // 2], known[len(known) // 2]

    grouped = M.middles(df, ["v"], ["g"])
    assert grouped == {('{"g":"x"}', "v"): want(v for _, g, v in rows if g == "x"), ("{}", "v"): want(v for _, g, v in rows if g is None)}
    earlier = M.middles(df, ["v"], before=("season", [2020, 2021, 2022, 2024]))
    assert earlier == {(str(c), "v"): want(v for s, _, v in rows if s is not None and s < c) for c in (2021, 2022, 2024)}
    nan = spark.createDataFrame([(math.nan,), (math.nan,), (1.0,)], "v double")
    assert math.isnan(M.middles(nan, ["v"])["", "v"][0])
    assert M.distinct_values(nan.union(df.select("v")), ["v"]).count() == len({v for *_, v in rows if v is not None} | {1.0}) + 1


def test_feature_set_and_model_ready_table(spark):
    df = spark.createDataFrame(
        [("g1", 2024, 3.0, 1.0, None, math.nan, True, "x", 0.5), ("g2", 2024, 4.0, None, None, None, False, "y", None)],
        "game_id string, season int, home_score double, rest double, empty double, nan_only double, flag boolean, note string, home_statcast_x double")
    chosen = quality.feature_set(df)
    lines = [(r["column"], r.status, r.reason, r.non_null, r.null_rate) for r in chosen.collect()]
    assert lines == [
        ("empty", "excluded", "all_null", 0, 1.0), ("nan_only", "excluded", "all_null", 0, 1.0),
        ("home_score", "excluded", "identifier_or_target", 2, 0.0), ("season", "excluded", "identifier_or_target", 2, 0.0),
        ("home_statcast_x", "excluded", "mlb_only_tracking", 1, 0.5),
        ("flag", "included", "npb_public_or_proxy", 2, 0.0), ("rest", "included", "npb_public_or_proxy", 1, 0.5),
    ]
    ready = quality.model_ready(df, chosen)
    assert ready.columns == ["game_id", "season", "home_score", "flag", "rest"] and ready.count() == 2
    assert quality.model_ready(df.drop("rest"), chosen).columns == ["game_id", "season", "home_score", "flag"]
    bare = quality.feature_set(df.limit(0))
    assert {(r.status, r.null_rate) for r in bare.collect()} == {("excluded", None)}
    assert quality.feature_set(df.select("note")).collect() == []
    with pytest.raises(ValueError):
        quality.model_ready(df, chosen.drop("status"))


def test_quality_report(spark):
    df = spark.createDataFrame([("g1", 2024, "2024-04-01", 1.0, 1), ("g2", 2024, "2024-05-02", None, 0)],
                               "game_id string, season int, d string, x_last_10 double, won int").withColumn("game_date", F.to_timestamp("d"))
    tables = quality.quality_report(df, target="won")
    rates = {r["column"]: r for r in tables["null_rates"].collect()}
    assert rates["x_last_10"].null_rate == 0.5 and rates["x_last_10"].rows == 2 and rates["won"].zero_rate == 0.5
    ready = tables["rolling_readiness"].first()
    assert ready.null_rate_all == 0.5 and ready.null_rate_may_onward == 1.0
    assert tables["season_summary"].first().home_win_rate == 0.5
    status = {r["column"]: r.reason for r in quality.column_status(df, ["season"]).collect()}
    assert status["season"] == "metadata_or_target" and status["d"] == "not_numeric" and status["x_last_10"] == "usable"
    pairs = quality.rank_correlations(df.withColumn("y", F.col("won") * 2.0), ["won", "y"]).collect()
    assert [(r.left_column, r.right_column) for r in pairs] == [("won", "y")]


def test_rank_correlations_count_equal_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.integers(0, 40, 3000).astype(float)
    b = a + rng.integers(0, 30, 3000)
    c = rng.random(3000)
    rows = [(float(x) if i % 50 else None, float(y), float(z), 1.0) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double").repartition(7)
    a[::50] = np.median(np.delete(a, np.arange(0, 3000, 50)))

    def ranks(v):
        values, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    got = {(r.left_column, r.right_column): r.correlation for r in quality.rank_correlations(df, ["a", "b", "c", "same"], 0.0).collect()}
    want = {(x, y): np.corrcoef(ranks(v), ranks(w))[0, 1] for (x, v), (y, w) in ((("a", a), ("b", b)), (("a", a), ("c", c)), (("b", b), ("c", c)))}
    assert got == pytest.approx(want, abs=1e-9)
    # No sort of all rows: distinct values come in ranges, each ranked by itself.
    counted = spark.range(5000).selectExpr("cast(id % 1000 as double) AS v", "2L AS n")
    found = quality.mean_ranks(counted, ["v"], "n").collect()
    assert {r.value: r["rank"] for r in found} == {float(v): 10 * v + 5.5 for v in range(1000)}


def test_two_sided_join_makes_its_block_once(spark):
    base = spark.createDataFrame([("g1", "a", "b"), ("g2", "a", None), ("g3", "b", "a"), (None, "a", "b")], "game_id string, h string, w string")
    block = spark.createDataFrame([("g1", "a", 1.0), ("g1", "b", 2.0), ("g2", "a", 3.0), ("g2", "a", 4.0), ("g2", None, 5.0), (None, "a", 6.0)],
                                  "game_id string, player_id string, v double")
    out = J.join_two_sided(base, block.withColumn("made_here", F.rand(7) * 0 + F.col("v")), "game_id", "h", "w", "player_id")
    rows = sorted(tuple(r) for r in out.filter("game_id IS NOT NULL").select("game_id", "home_v", "away_v").fillna(-1.0).collect())
    assert rows == [("g1", 1.0, 2.0), ("g2", 3.0, -1.0), ("g2", 4.0, -1.0), ("g3", -1.0, -1.0)]  # two rows of a member give two
    assert out.filter("game_id IS NULL AND home_v IS NULL AND away_v IS NULL").count() == 1
    assert out.columns == ["game_id", "h", "w", "home_v", "home_made_here", "away_v", "away_made_here"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rand(7)") == 1
