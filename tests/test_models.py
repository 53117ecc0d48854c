import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pregame.plans import models as M
from pregame.plans import predictions as P


@pytest.fixture(scope="module")
def sheet(spark):
    """Three seasons of games whose winner follows the sign of `a` most of the time."""
    rows = []
    for i in range(360):
        a = math.sin(i * 1.7)
        won = int(a + 0.4 * math.sin(i * 5.3) > 0)
        rows.append((f"g{i:03d}", 2022 + i // 120, i, f"T{i % 6}", f"T{(i + 1 + i % 4) % 6}", 4.0 + 2 * a, 4.0 - 2 * a + 0.1 * (i % 3), won, a, None if i % 7 == 0 else float(i % 5)))
    df = spark.createDataFrame(rows, "game_id string, season int, day int, home_team string, away_team string, home_score double, away_score double, home_team_win int, a double, b double")
    return df.withColumn("game_date", F.timestamp_seconds(F.col("day") * 86400 + 1640995200)).drop("day").cache()


def test_elo_known_values_and_stream_of_leagues(spark):
    rows = [("L", "1", 1, "A", "B", 1), ("L", "2", 2, "B", "C", 0), ("L", "3", 3, "A", "C", 1), ("M", "4", 1, "A", "B", None), ("M", "5", 2, "A", "B", None)]
    df = spark.createDataFrame(rows, "lg string, game_id string, d int, home_team string, away_team string, home_team_win int")
    df = df.withColumn("game_date", F.timestamp_seconds(F.col("d") * 86400))
    out = {r.game_id: r.home_win_probability for r in M.elo(df, ["lg"]).collect()}
    assert out["1"] == pytest.approx(0.5784967523) and out["2"] == pytest.approx(0.5666210195) and out["3"] == pytest.approx(0.5744176184)
    assert out["4"] == out["5"] == out["1"]


def test_splits(sheet):
    train, test = M.holdout(sheet)
    assert train.count() == 240 and test.count() == 120
    old, new = M.temporal_split(sheet)
    assert (old.count(), new.count()) == (288, 72)
    assert old.agg(F.max("game_date")).first()[0] < new.agg(F.min("game_date")).first()[0]
    assert M.temporal_split(sheet, last_rows=10)[1].count() == 10
    one = sheet.filter("season = 2022")
    assert M.holdout(one)[1].count() == 24


@pytest.mark.parametrize("name", ["logistic", "logistic_l1", "calibrated_logistic"])
def test_presets_give_probabilities(sheet, name):
    train, test = M.holdout(sheet)
    scored = M.fit_classifier(name, train, ["a", "b"]).score(test)
    r = scored.agg(F.min(M.PROBABILITY).alias("lo"), F.max(M.PROBABILITY).alias("hi"), F.count("*").alias("n")).first()
    assert 0 <= r.lo <= r.hi <= 1 and r.n == 120
    assert set(scored.columns) == set(test.columns) | {M.PROBABILITY}


def test_ensembles_and_trees(sheet, monkeypatch):
    for table in (M.FORESTS, M.BOOSTED):
        for name, args in table.items():
            small = {**args, **({"numTrees": 5, "maxDepth": 3} if "numTrees" in args else {"maxIter": 3})}
            monkeypatch.setitem(table, name, small)
    train, test = M.holdout(sheet)
    for name in ("soft_voting", "hybrid_stacking"):
        scored = M.fit_classifier(name, train, ["a", "b"]).score(test)
        assert scored.filter(F.col(M.PROBABILITY).between(0, 1)).count() == 120
    forest = M.fit_classifier("random_forest", train, ["a", "b"])
    shares = {r.feature: r.share for r in M.importances(forest).collect()}
    assert shares["a"] > shares["b"] and sum(shares.values()) == pytest.approx(1)
    with pytest.raises(M.ModelUnavailable):
        M.fit_classifier("nothing", train, ["a"])


def test_oof_report_and_picks(sheet):
    report = M.holdout_report(sheet.withColumnRenamed("b", "unused_text").withColumn("unused_text", F.lit("x")), ["elo", "logistic", "not_there"], [2023, 2024])
    metrics = {(r.holdout_season, r.model_name): r for r in report["metrics"].collect()}
    assert len(metrics) == 4 and metrics[2024, "logistic"].accuracy > 0.8
    assert metrics[2024, "logistic"].log_loss < metrics[2024, "elo"].log_loss
    assert {r.model_name for r in report["best"].collect()} == {"logistic"}
    picks = M.selective_picks(report["predictions"], "logistic", ["elo"])
    assert {r.rule for r in picks["agreement"].collect()} == {"pass", "lean", "strong", "actionable"}


def test_expected_runs_use_earlier_seasons_only(sheet):
    features = ["a", "b"]
    out = M.with_expected_runs(sheet, [2024], "ridge", features)
    assert out.filter("season < 2024 and expected_total_runs is not null").count() == 0
    assert out.filter("season = 2024 and abs(expected_home_runs - home_score) > 0.2").count() == 0
    changed = sheet.withColumn("home_score", F.when(F.col("season") == 2024, 99.0).otherwise(F.col("home_score")))
    other = M.with_expected_runs(changed, [2024], "ridge", features)
    key = lambda df: {r.game_id: r.expected_home_runs for r in df.filter("season = 2024").select("game_id", "expected_home_runs").collect()}
    assert key(out) == key(other)
    result = M.expected_runs(sheet, ["ridge"], 2024, features)
    assert result["metrics"].first().n_games == 120 and result["totals"].count() == 5


def _plain_ridge(x, y, at):
    """Medians, population deviations and normal equations, written out."""
    fill = np.nanmedian(x, axis=0)
    full = np.where(np.isnan(x), fill, x)
    mean, sd = full.mean(0), full.std(0)
    sd[sd == 0] = 1.0
    z = (full - mean) / sd
    w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + ((np.where(np.isnan(at), fill, at) - mean) / sd) @ w


def test_ridge_of_all_seasons_from_one_pass(spark):
    draw = np.random.default_rng(4)
    n = 400
    season = draw.choice([2019, 2020, 2022, 2023], n)
    x = np.column_stack([draw.normal(1e6, 2, n), draw.normal(0, 1e-3, n), np.full(n, 7.0), draw.integers(0, 3, n).astype(float)])
    x[draw.random((n, 4)) < 0.2] = np.nan
    x[season < 2022, 3] = np.nan  # nothing is known before 2022: no coefficient for the fits of 2020 and 2022
    y = np.column_stack([x[:, 1] * 0 + draw.normal(4, 1, n), draw.normal(5, 2, n)])
    y[:, 0] = np.where(np.isnan(y[:, 0]), 4.0, y[:, 0] + np.nan_to_num(x[:, 1]) * 500)
    y[draw.random(n) < 0.1, 1] = np.nan
    rows = [(f"g{i}", int(season[i]), *[None if np.isnan(v) else float(v) for v in (*x[i], *y[i])]) for i in range(n)]
    rows.append(("none", None, 1e6, 0.0, 7.0, 1.0, 9.0, 900.0))
    df = spark.createDataFrame(rows, "game_id string, season int, a double, b double, c double, d double, home_score double, away_score double").repartition(5)
    out = {r.game_id: r for r in M.with_expected_runs(df, None, "ridge", ["a", "b", "c", "d"]).collect()}
    assert len(out) == n + 1 and out["none"].expected_home_runs is None
    for i in range(n):
        before = season < season[i]
        got = (out[f"g{i}"].expected_home_runs, out[f"g{i}"].expected_away_runs)
        if season[i] == 2019:
            assert got == (None, None)
            continue
        use = [0, 1, 2] if season[i] <= 2022 else [0, 1, 2, 3]
        for t in (0, 1):
            learn = before & ~np.isnan(y[:, t])
            want = max(0.0, _plain_ridge(x[learn][:, use], y[learn, t], x[i, use]))
            assert got[t] == pytest.approx(want, abs=1e-7)
    assert M.with_expected_runs(df.limit(0), None, "ridge", ["a"]).count() == 0
    few = M.with_expected_runs(df, [2020, 2031], "ridge", ["a", "b"]).filter("expected_total_runs is not null")
    assert {r.season for r in few.select("season").distinct().collect()} == {2020}


def _newton_logistic(a, y, copies, deviation):
    """Penalty 1 on the scaled coefficient, every row `copies` times."""
    x, b = np.column_stack([(a - a.mean()) / deviation, np.ones_like(a)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        slope = copies * x.T @ (p - y) + np.array([b[0], 0.0])
        b -= np.linalg.solve(copies * (x.T * (p * (1 - p))) @ x + np.diag([1.0, 0.0]), slope)
    return 1 / (1 + np.exp(-x @ b))


def test_weights_count_as_repeated_rows(sheet):
    """Both equal the plain fit; they differ by the scaler alone, whose deviation divides by rows less one."""
    rows = sheet.orderBy("game_id").select("a", "home_team_win").collect()
    a, y = np.array([r.a for r in rows]), np.array([float(r.home_team_win) for r in rows])
    score = lambda fitted: np.array([r[0] for r in fitted.score(sheet).orderBy("game_id").select(M.PROBABILITY).collect()])
    weighted = score(M.fit_classifier("logistic", sheet.withColumn("w", F.lit(2.0)), ["a"], weight="w"))
    repeated = score(M.fit_classifier("logistic", sheet.union(sheet), ["a"]))
    assert np.abs(weighted - _newton_logistic(a, y, 2, a.std(ddof=1))).max() < 1e-6
    assert np.abs(repeated - _newton_logistic(a, y, 2, np.r_[a, a].std(ddof=1))).max() < 1e-6
    assert np.abs(weighted - _newton_logistic(a, y, 1, a.std(ddof=1))).max() > 1e-2


def test_saved_model_scores_frames_without_some_columns(sheet, tmp_path):
    fitted = M.fit_classifier("logistic", sheet, ["a", "b"])
    M.save(fitted, str(tmp_path / "m"))
    loaded = M.load(sheet.sparkSession, str(tmp_path / "m"))
    assert loaded.features == ("a", "b")
    assert loaded.score(sheet.drop("b")).filter(F.col(M.PROBABILITY).isNull()).count() == 0


def test_predict_games_and_readable(sheet):
    win, runs = P.final_win_model(sheet, "logistic", ["a"]), P.final_runs_models(sheet, "ridge", ["a"])
    over = P.final_over_model(sheet, "logistic", ["a"], constant=8.05)
    out = P.predict_games(sheet, win, runs, over, total_line=8.0)
    row = out.filter("game_id = 'g001'").first()
    assert row.total_line == 8.0 and row.win_pick == row.home_team and row.win_correct
    assert row.runs_ou_confidence in ("pass", "lean", "strong") and row.direct_ou_pick in ("over", "under")
    text = P.readable(out).filter("game_id = 'g001'").first()
    assert text.matchup == f"{row.away_team} @ {row.home_team}" and text.score_prediction.startswith(row.home_team)
    summary = P.review(out, sheet.select("game_id", "home_score", "away_score"))["summary"].first()
    assert summary.games == 360 and summary.win_accuracy > 0.8


def test_variants_and_recency(sheet):
    grid = M.variant_grid(sheet, {"all": ["a", "b"], "no_b": M.without_groups(["a", "b"], ["b"])}, ["logistic"], [2024], seeds=(1, 2))
    assert grid.count() == 4
    out = M.recency_challengers(sheet, "logistic", 2024, ["a"], recent=1)
    assert {r.variant for r in out.select("variant").distinct().collect()} == {"all_seasons", "recent_seasons", "recency_weighted"}


def test_gaps_are_filled_with_the_lower_middle_value(spark):
    from pyspark.ml.feature import Imputer

    rows = [(4.0, None), (1.0, 2.0), (float("nan"), 7.0), (3.0, 5.0), (None, float("nan")), (2.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, `b c` double")
    inputs = M._inputs(["a", "b c"], False, M._medians(df, ["a", "b c"]))
    got = inputs[0].transform(df).select("_f0", "_f1").collect()
    want = Imputer(strategy="median", relativeError=0.0, inputCols=["a", "b c"], outputCols=["_f0", "_f1"]).fit(df).transform(df)
    assert got == want.select("_f0", "_f1").collect()
    with pytest.raises(ValueError, match="median"):
        M._inputs(["a"], False, {})


@pytest.mark.parametrize("overlap", [False, True])
def test_one_elo_chain_serves_all_seasons(spark, overlap):
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = [(str(i), dt.datetime(2020 + i // 30, 5, 1) + dt.timedelta(hours=i % 30, days=400 if overlap and i % 7 == 0 else 0), 2020 + i // 30,
             *rng.sample("ABCD", 2), rng.choice([0, 1, 1, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "game_id string, game_date timestamp, season int, home_team string, away_team string, home_team_win int")
    common = M._shared(df, ["elo"], [2021, 2022, 2023], [])
    assert (common.rated is None) == overlap and set(common.fills) == {2021, 2022, 2023}
    got = {(r.holdout_season, r.game_id): r.home_win_probability for r in M.oof_predictions(df, ["elo"], None, []).collect()}
    want = {}
    for season in (2021, 2022, 2023):
        want |= {(season, r.game_id): r.home_win_probability for r in M._score_season(df, "elo", season, [], 42).collect()}
    assert got == pytest.approx(want) and len(got) > 60


def test_medians_of_all_seasons_come_from_one_search(spark):
    rows = [(2020 + i % 4, float(i * 37 % 101) if i % 5 else None, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "season int, x double, home_team_win int")
    fills = M._shared(df, ["logistic"], [2021, 2022, 2023], ["x"]).fills
    assert fills == {s: M._medians(df.filter(f"season < {s}"), ["x"]) for s in (2021, 2022, 2023)}
