"""The two-game fixture as Spark frames. All numbers are fixed values with known results."""

from datetime import datetime

G1, G2 = datetime(2024, 4, 1), datetime(2024, 4, 5)
DATES = {"g1": G1, "g2": G2}

GAMES = [
    ("g1", G1, 2024, "HOM", "AWY", "HSP", "ASP", 5.0, 3.0, "park", 40.0, -75.0, -4.0),
    ("g2", G2, 2024, "HOM", "AWY", "HSP", "ASP", 2.0, 4.0, "park", 34.0, -118.0, -7.0),
]
GAME_COLUMNS = (
    "game_id string, game_date timestamp, season int, home_team string, away_team string, home_sp_id string, "
    "away_sp_id string, home_score double, away_score double, venue_id string, venue_latitude double, "
    "venue_longitude double, venue_timezone_offset double"
)

# player, team, hand, ab, h, hr, bb, tb, pa, batted, hard, barrel, xwoba, woba, n, speed
BATTING = {
    "g1": [
        ("H1", "HOM", "R", 4, 2, 1, 1, 5, 5, 4, 2, 1, 2.5, 2.0, 5, 360),
        ("H2", "HOM", "R", 4, 2, 0, 1, 2, 5, 4, 2, 0, 2.5, 2.0, 5, 360),
        ("H3", "HOM", "R", 4, 2, 0, 1, 2, 5, 4, 2, 0, 2.5, 2.0, 5, 360),
    ],
    "g2": [(p, "HOM", "R", 4, 0, 0, 1, 0, 5, 4, 2, 0, 1.5, 1.0, 5, 360) for p in ("H1", "H2", "H3")],
}
AWAY_BATTING = [(p, "AWY", "L", 4, 1, 0, 0, 1, 4, 4, 1, 0, 1.2, 1.0, 4, 330) for p in ("A1", "A2", "A3")]
BATTING_COLUMNS = (
    "game_id string, game_date timestamp, season int, player_id string, team string, opposing_pitcher_hand string, "
    "at_bats double, hits double, home_runs double, walks double, total_bases double, plate_appearances double, "
    "statcast_batted_balls double, statcast_hard_hit_balls double, statcast_barrels double, "
    "statcast_xwoba_sum double, statcast_woba_sum double, statcast_xwoba_count double, statcast_launch_speed_sum double, "
    "statcast_woba_count double"
)

# game, player, team, start, ip, h, hr, bb, k, bf, pitches, closer, leverage, sv, hld, gf, svo
PITCHING = [
    ("g1", "HSP", "HOM", 1, 6, 4, 1, 1, 7, 24, 92, None, None, None, None, None, None),
    ("g1", "ASP", "AWY", 1, 5, 6, 2, 3, 4, 23, 101, None, None, None, None, None, None),
    ("g1", "HRP", "HOM", 0, 2, 1, 0, 0, 2, 7, 22, 1, 1, 1, 0, 1, 1),
    ("g1", "ARP", "AWY", 0, 3, 2, 0, 1, 3, 12, 45, 0, 1, 0, 1, 0, 0),
    ("g2", "HSP", "HOM", 1, 5, 8, 3, 2, 2, 25, 88, None, None, None, None, None, None),
    ("g2", "ASP", "AWY", 1, 7, 3, 0, 1, 8, 26, 95, None, None, None, None, None, None),
]
TRACKED = {
    ("g1", "HSP"): dict(
        statcast_pitches=92, statcast_whiffs=12, statcast_xwoba_allowed_sum=7.2, statcast_xwoba_allowed_count=24,
        statcast_fastball_release_speed_sum=65 * 96, statcast_fastball_release_speed_count=65,
        statcast_pitch_ff=50, statcast_pitch_si=10, statcast_pitch_fc=5,
    ),
    ("g1", "ASP"): dict(
        statcast_pitches=101, statcast_whiffs=8, statcast_xwoba_allowed_sum=9.2, statcast_xwoba_allowed_count=23,
        statcast_fastball_release_speed_sum=55 * 94, statcast_fastball_release_speed_count=55,
        statcast_pitch_ff=45, statcast_pitch_si=5, statcast_pitch_fc=5,
    ),
}
TRACKED_COLUMNS = list(TRACKED[("g1", "HSP")])
PITCHING_COLUMNS = [
    "is_start", "innings_pitched", "hits", "home_runs", "walks", "strikeouts", "batters_faced", "pitches",
    "is_closer", "is_high_leverage", "saves", "holds", "games_finished", "save_opportunities",
]
LINEUP_COLUMNS = (
    "game_id string, team string, player_id string, batting_order double, bats string, prediction_mode string, "
    "lineup_confidence double, is_available double, is_expected_starter double, rest_signal double, injury_status string"
)


def tables(spark, games=GAMES, pitching=PITCHING):
    batting = []
    for game in ("g1", "g2"):
        for p, team, hand, *stats in BATTING[game] + AWAY_BATTING:
            ab, h, hr, bb, tb, pa, batted, hard, barrel, xw, w, n, speed = map(float, stats)
            batting.append((game, DATES[game], 2024, p, team, hand, ab, h, hr, bb, tb, pa, batted, hard, barrel, xw, w, n, speed, n))
    pitch_rows = []
    for game, player, team, *stats in pitching:
        tracked = TRACKED.get((game, player), {})
        values = [None if v is None else float(v) for v in stats + [tracked.get(c) for c in TRACKED_COLUMNS]]
        pitch_rows.append((game, DATES[game], 2024, player, team, *values))
    numbers = ", ".join(f"{c} double" for c in PITCHING_COLUMNS + TRACKED_COLUMNS)
    lineups = []
    for game in ("g1", "g2"):
        for team, confidence in (("HOM", 0.95), ("AWY", 0.90)):
            for slot in (1, 2, 3):
                out = game == "g2" and team == "AWY" and slot == 3
                bats = "L" if team == "HOM" and slot == 1 else "R"
                lineups.append((game, team, f"{team[0]}{slot}", float(slot), bats, "confirmed_lineup",
                                confidence, 1.0, 1.0, float(out), "out" if out else ""))
    return {
        "games": spark.createDataFrame(games, GAME_COLUMNS),
        "batting_logs": spark.createDataFrame(batting, BATTING_COLUMNS),
        "pitcher_logs": spark.createDataFrame(
            pitch_rows, f"game_id string, game_date timestamp, season int, player_id string, team string, {numbers}"
        ),
        "lineups": spark.createDataFrame(lineups, LINEUP_COLUMNS),
        "weather": spark.createDataFrame(
            [("g1", 70.0, 5.0, "out", 50.0, 0.0), ("g2", 72.0, 8.0, "in", 55.0, 0.0)],
            "game_id string, temperature double, wind_speed double, wind_direction string, humidity double, is_dome double",
        ),
        "park_factors": spark.createDataFrame(
            [("park", 2024, 1.02, 1.10)], "venue_id string, season int, park_factor_run double, park_factor_hr double"
        ),
    }
