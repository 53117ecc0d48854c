import pytest
from pyspark.sql import functions as F

from pregame.operators import forecasts as X


def test_metrics_known_values(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.3), (1, 0.55), (0, 0.45)], "y int, p double")
    row = X.probability_metrics(df, "y", "p").first()
    assert row.log_loss == pytest.approx(0.4438731242)
    assert row.brier_score == pytest.approx(0.13375)
    assert row.accuracy == 1 and row.coverage_conf_55 == 1
    sure = X.probability_metrics(df.filter("p between 0.44 and 0.56"), "y", "p").first()
    assert sure.accuracy_conf_60 is None and sure.coverage_conf_60 == 0


def test_calibration_keeps_empty_bins_and_closes_right(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.1000001), (1, 1.0)], "y int, p double")
    rows = {r.bin: r for r in X.calibration(df, "y", "p").collect()}
    assert len(rows) == 10
    assert rows[1].n_games == 2 and rows[2].n_games == 1 and rows[10].n_games == 1 and rows[5].n_games == 0
    assert rows[5].calibration_error is None


def test_selection_rules(spark):
    df = spark.createDataFrame(
        [(2024, "logistic", 0.70, 0.25, 0.70, 0.2), (2024, "random_forest", 0.68, 0.24, 0.65, 0.3), (2024, "rare", 0.69, 0.24, 0.9, 0.05)],
        "holdout_season int, model_name string, log_loss double, brier_score double, accuracy_conf_60 double, coverage_conf_60 double")
    rules = {r.rule_name: r.selected_model for r in X.selection_rules(df).collect()}
    assert rules == {"overall_log_loss": "random_forest", "confidence_60": "logistic"}
    with pytest.raises(ValueError):
        X.selection_rules(df.drop("log_loss"))


def _games(spark, rows):
    return spark.createDataFrame(rows, "home_win_probability double, home_team string, away_team string, actual_winner string")


def test_win_picks(spark):
    rows = X.win_picks(_games(spark, [(0.51, "A", "B", "A"), (0.56, "B", "C", "B"), (0.62, "C", "D", "C")])).orderBy("home_win_probability").collect()
    assert [r.win_pick_rule for r in rows] == ["pass", "lean", "strong"]
    assert [r.rule_win_pick for r in rows] == ["", "B", "C"]
    assert [r.rule_win_correct for r in rows] == [None, True, True]


def test_unscored_picks_and_bad_thresholds(spark):
    df = _games(spark, [(0.61, "A", "B", ""), (0.39, "A", "B", None)])
    rows = X.win_picks(df).collect()
    assert all(r.win_pick_rule == "strong" and r.rule_win_correct is None for r in rows)
    with pytest.raises(ValueError):
        X.win_picks(df, lean=0.4)
    with pytest.raises(ValueError):
        X.win_picks(df, lean=0.6, strong=0.55)


def test_summary(spark):
    df = X.win_picks(_games(spark, [(0.51, "A", "B", "A"), (0.56, "A", "B", "A"), (0.62, "A", "B", "A"), (0.42, "A", "B", "A")]))
    rows = {r.rule: r for r in X.summarize_picks(df).collect()}
    assert rows["actionable"].picks == 3 and rows["actionable"].hits == 2
    assert rows["pass"].games == 1 and rows["pass"].picks == 0 and rows["pass"].accuracy is None
    assert rows["strong"].coverage == 0.25


def test_agreement(spark):
    rows = [(2024, g, m, p, "A", "B", "A") for g, ps in {"g1": (0.65, 0.6, 0.7), "g2": (0.65, 0.4, 0.7)}.items()
            for m, p in zip(("main", "x/1", "y"), ps)]
    df = spark.createDataFrame(rows, "holdout_season int, game_id string, model_name string, home_win_probability double, home_team string, away_team string, actual_winner string")
    out = {r.game_id: r for r in X.agreement_picks(df, "main", ["x/1", "y", "gone"]).collect()}
    assert out["g1"].win_pick_rule == "strong" and out["g2"].win_pick_rule == "pass"
    assert out["g1"].agreement_required == 2 and out["g2"].agreement_models == 1
    with pytest.raises(ValueError):
        X.agreement_picks(df, "gone", [])


def test_totals_and_scores(spark):
    df = spark.createDataFrame([(9.2, 9.0, 10.0), (9.6, 9.0, 9.0), (12.0, 9.0, 10.0), (9.0, None, 5.0)],
                               "expected_total_runs double, total_line double, actual_total double")
    rows = X.total_picks(df).collect()
    assert [r.ou_pick_rule for r in rows] == ["pass", "lean", "strong", "pass"]
    assert [r.rule_ou_correct for r in rows] == [None, False, True, None]
    scores = spark.createDataFrame([(2.5, 3.5, 0.6), (3.5, 2.5, 0.4), (5.0, 1.0, 0.7)], "h double, a double, p double")
    out = [(r.predicted_home_score, r.predicted_away_score) for r in X.consistent_score(scores, "h", "a", "p").collect()]
    assert out == [(5, 4), (4, 5), (5, 1)]
