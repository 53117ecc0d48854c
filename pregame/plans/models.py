"""Training and scoring on Spark ML: presets, ensembles, holdouts, expected runs, Elo."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pregame.functions.rates import recency_weight
from pregame.operators import forecasts as X
from pregame.operators.medians import middles
from pregame.operators.ridge import fit_before, score_cuts
from pregame.schemas import TARGET, feature_columns
from pregame.session import settle

# Penalties, tree settings and folds of the named presets.
LOGISTIC = {
    "logistic": (1.0, 0.0), "logistic_l2_c03": (0.3, 0.0), "logistic_l2_c3": (3.0, 0.0), "logistic_l1": (0.5, 1.0),
}
FORESTS = {
    "random_forest": dict(numTrees=400, minInstancesPerNode=8, maxDepth=20),
    "random_forest_shallow": dict(numTrees=350, minInstancesPerNode=16, maxDepth=7),
    "random_forest_deep": dict(numTrees=500, minInstancesPerNode=4, maxDepth=25),
}
BOOSTED = {
    "gbt": dict(maxIter=100, stepSize=0.04, maxDepth=4, subsamplingRate=0.9),
    "gbt_shallow": dict(maxIter=80, stepSize=0.05, maxDepth=3, subsamplingRate=0.8),
    "gbt_slow": dict(maxIter=200, stepSize=0.02, maxDepth=4, subsamplingRate=0.9),
}
CALIBRATED = {"calibrated_logistic": ("logistic_l2_c03", "isotonic"), "calibrated_random_forest": ("random_forest_shallow", "sigmoid")}
VOTING = {
    "soft_voting": ["logistic_l2_c03", "random_forest_shallow", "gbt"],
    "booster_voting": ["gbt", "gbt_shallow", "gbt_slow"],
}
STACKING = {
    "hybrid_stacking": ["logistic_l2_c03", "random_forest_shallow", "gbt"],
    "booster_stacking": ["gbt", "gbt_shallow", "gbt_slow"],
}
CALIBRATION_FOLDS, STACKING_FOLDS = 3, 5
ELO = dict(start=1500.0, k=20.0, home=55.0, scale=400.0)
RUNS_COLUMNS = ["expected_home_runs", "expected_away_runs", "expected_total_runs", "expected_run_diff"]

PROBABILITY = "home_win_probability"
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Fitted:
    """A trained model: `score` adds its output column and keeps the rest."""

    name: str
    features: tuple[str, ...]
    score: Scorer
    model: PipelineModel | None = None


class ModelUnavailable(ValueError):
    """The named model cannot be built here."""


def fold_of(key: str, folds: int) -> Column:
    """Repeatable fold number of a row, by a hash of its id."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds)).cast("int")


Fill = dict[str, float]


def _medians(rows: DataFrame, features: Sequence[str]) -> Fill:
    """The lower middle value of each feature, exact, from histograms: nothing of a column comes to the driver."""
    return {c: low for (_, c), (low, _) in middles(_not_nan(rows, features), features).items()}


def _not_nan(rows: DataFrame, features: Sequence[str], *others: str) -> DataFrame:
    return _doubles(rows, features).select(*others, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in features])


def _inputs(features: Sequence[str], scaled: bool, fill: Fill) -> list:
    empty = [c for c in features if c not in fill]
    if empty:
        raise ValueError(f"no values to take a median of in {', '.join(empty)}")
    filled = [f"_f{i}" for i in range(len(features))]
    name = lambda c: "`" + c.replace("`", "``") + "`"
    each = [f"CASE WHEN {name(c)} IS NULL OR isnan({name(c)}) THEN CAST('{fill[c]!r}' AS DOUBLE) ELSE {name(c)} END AS {f}" for c, f in zip(features, filled)]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(each)} FROM __THIS__"),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scaled else "_x"),
    ]
    if scaled:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_x"))
    return stages


def _doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({
        c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in features
    })


def _drop_working(df: DataFrame) -> DataFrame:
    working = [c for c in df.columns if c.startswith("_f") and c[2:].isdigit()]
    return df.drop(*working, "_raw", "_x", "_raw_prediction", "_probability", "_prediction")


def _classifier(name: str, total_weight: float, n_features: int, seed: int, weight: str | None):
    shared = dict(featuresCol="_x", labelCol="_y", predictionCol="_prediction", probabilityCol="_probability",
                  rawPredictionCol="_raw_prediction")
    weighted = dict(weightCol=weight) if weight else {}
    if name in LOGISTIC:
        strength, mix = LOGISTIC[name]
        return True, LogisticRegression(
            regParam=1.0 / (strength * total_weight), elasticNetParam=mix, standardization=False, maxIter=300, **shared, **weighted
        )
    if name in FORESTS:
        return False, RandomForestClassifier(featureSubsetStrategy="sqrt", seed=seed, **FORESTS[name], **shared, **weighted)
    if name in BOOSTED:
        columns = {c: shared[c] for c in ("featuresCol", "labelCol", "predictionCol")}
        trees = GBTClassifier(seed=seed, **BOOSTED[name], **columns, **weighted)
        return False, trees.setProbabilityCol("_probability").setRawPredictionCol("_raw_prediction")
    if name == "mlp":
        if weight:
            raise ModelUnavailable("mlp takes no weights")
        return True, MultilayerPerceptronClassifier(layers=[n_features, 96, 48, 2], maxIter=200, seed=seed, **shared)
    raise ModelUnavailable(f"unknown model name: {name}")


def model_names() -> list[str]:
    return ["elo", *LOGISTIC, *FORESTS, *BOOSTED, "mlp", *CALIBRATED, *VOTING, *STACKING]


def _fit_one(
    name: str, train: DataFrame, features: Sequence[str], seed: int, weight: str | None, out: str, fill: Fill | None = None
) -> Fitted:
    rows = _doubles(train, features)
    # Spark divides the loss by the sum of weights, so the penalty must be divided by it too.
    total = train.count() if weight is None else train.agg(F.sum(weight)).first()[0] or 1.0
    scaled, estimator = _classifier(name, float(total), len(features), seed, weight)
    inputs = _inputs(features, scaled, _medians(rows, features) if fill is None else fill)
    model = Pipeline(stages=[*inputs, estimator]).fit(rows)
    return Fitted(name, tuple(features), _scorer(model, features, out), model)


def _scorer(model: PipelineModel, features: Sequence[str], out: str) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in features]
        scored = model.transform(_doubles(df, features))
        value = vector_to_array("_probability")[1] if "_probability" in scored.columns else F.col("_prediction")
        return _drop_working(scored.withColumn(out, value)).select(*kept, *[c for c in features if c in df.columns], out)

    return score


def fit_classifier(
    name: str, train: DataFrame, features: Sequence[str], target: str = TARGET, key: str = "game_id",
    seed: int = 42, weight: str | None = None, out: str = PROBABILITY, fill: Fill | None = None,
) -> Fitted:
    """Fit a preset or ensemble by name on the scored rows of `train`. `fill`: their medians, where they are known."""
    rows = train.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    if weight and (name in CALIBRATED or name in STACKING):
        raise ModelUnavailable(f"{name} takes no weights")
    if name in CALIBRATED:
        return _fit_calibrated(name, rows, features, key, seed, out)
    if name in VOTING:
        members = [_fit_one(m, rows, features, seed, weight, f"_m{i}", fill) for i, m in enumerate(VOTING[name])]
        return Fitted(name, tuple(features), _averaged(members, out))
    if name in STACKING:
        return _fit_stacking(name, rows, features, key, seed, out)
    return _fit_one(name, rows, features, seed, weight, out, fill)


def _averaged(members: Sequence[Fitted], out: str) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        for member in members:
            df = member.score(df)
        columns = [f"_m{i}" for i in range(len(members))]
        mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
        return df.withColumn(out, mean).drop(*columns)

    return score


def _fit_calibrated(name: str, rows: DataFrame, features: Sequence[str], key: str, seed: int, out: str) -> Fitted:
    """Per fold: fit on the other folds, calibrate on this one; the forecasts are averaged."""
    base, method = CALIBRATED[name]
    folded = rows.withColumn("_fold", fold_of(key, CALIBRATION_FOLDS))
    members = []
    for fold in range(CALIBRATION_FOLDS):
        inner = _fit_one(base, folded.filter(F.col("_fold") != fold), features, seed, None, "_p")
        held = inner.score(folded.filter(F.col("_fold") == fold))
        if method == "isotonic":
            curve = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="_c").fit(held)
        else:
            log_odds = VectorAssembler(inputCols=["_p"], outputCol="_v")
            curve = Pipeline(stages=[log_odds, LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_pc",
                                                                    predictionCol="_pp", rawPredictionCol="_pr")]).fit(held)
        members.append(Fitted(base, tuple(features), _calibrated_scorer(inner, curve, f"_m{fold}")))
    return Fitted(name, tuple(features), _averaged(members, out))


def _calibrated_scorer(inner: Fitted, curve, out: str) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        scored = curve.transform(inner.score(df))
        value = F.col("_c") if "_c" in scored.columns else vector_to_array("_pc")[1]
        return scored.withColumn(out, value).drop("_p", "_c", "_v", "_pc", "_pp", "_pr")

    return score


def _fit_stacking(name: str, rows: DataFrame, features: Sequence[str], key: str, seed: int, out: str) -> Fitted:
    """Out-of-fold member forecasts feed a logistic model; members are then fitted on all rows."""
    names = STACKING[name]
    folded = rows.withColumn("_fold", fold_of(key, STACKING_FOLDS))
    parts = None
    for fold in range(STACKING_FOLDS):
        held, rest = folded.filter(F.col("_fold") == fold), folded.filter(F.col("_fold") != fold)
        for i, m in enumerate(names):
            held = _fit_one(m, rest, features, seed, None, f"_m{i}").score(held)
        part = held.select("_y", *[f"_m{i}" for i in range(len(names))])
        parts = part if parts is None else parts.unionByName(part)
    columns = [f"_m{i}" for i in range(len(names))]
    top = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_probability", predictionCol="_prediction",
                           rawPredictionCol="_raw_prediction"),
    ]).fit(settle(parts))
    members = [_fit_one(m, rows, features, seed, None, f"_m{i}") for i, m in enumerate(names)]

    def score(df: DataFrame) -> DataFrame:
        for member in members:
            df = member.score(df)
        scored = top.transform(df).withColumn(out, vector_to_array("_probability")[1])
        return _drop_working(scored).drop(*columns)

    return Fitted(name, tuple(features), score)


def fit_regressor(
    name: str, train: DataFrame, features: Sequence[str], target: str, seed: int = 42, out: str = "prediction"
) -> Fitted:
    """`ridge` (penalty 1) or `random_forest_regressor` (300 trees, leaf 8)."""
    rows = _doubles(train.filter(F.col(target).isNotNull()), features).withColumn("_y", F.col(target).cast("double"))
    if name == "ridge":
        # Spark divides the penalty by the spread of the label, so it is multiplied back in.
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("sd")).first()
        estimator = LinearRegression(
            featuresCol="_x", labelCol="_y", predictionCol="_prediction", elasticNetParam=0.0, standardization=False,
            regParam=(stats["sd"] or 0.0) / max(stats["n"], 1),
        )
    elif name == "random_forest_regressor":
        estimator = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_prediction", numTrees=300,
                                          minInstancesPerNode=8, maxDepth=20, featureSubsetStrategy="all", seed=seed)
    else:
        raise ModelUnavailable(f"unknown regressor name: {name}")
    model = Pipeline(stages=[*_inputs(features, name == "ridge", _medians(rows, features)), estimator]).fit(rows)
    return Fitted(name, tuple(features), _scorer(model, features, out), model)


# -- saving --------------------------------------------------------------------------------


def save(fitted: Fitted, path: str) -> None:
    """Pipeline model plus a one-line JSON manifest with name and feature list."""
    if fitted.model is None:
        raise ValueError("only single models are saved as one pipeline")
    fitted.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    manifest = json.dumps({"name": fitted.name, "features": list(fitted.features)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark, path: str, out: str = PROBABILITY) -> Fitted:
    """Loaded models score frames that lack some training columns; those are read as NULL."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    model = PipelineModel.load(f"{path}/model")
    return Fitted(manifest["name"], tuple(manifest["features"]), _scorer(model, manifest["features"], out), model)


def importances(fitted: Fitted) -> DataFrame:
    """(feature, importance, share), for tree models."""
    last = fitted.model.stages[-1]
    values = last.featureImportances.toArray()
    spark = SparkSession.active()
    total = float(sum(values)) or 1.0
    rows = [(f, float(v), float(v) / total) for f, v in zip(fitted.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double, share double")


# -- splits --------------------------------------------------------------------------------


def temporal_split(
    df: DataFrame, fraction: float = 0.2, last_rows: int | None = None, date: str = "game_date", key: str = "game_id",
    target: str = TARGET,
) -> tuple[DataFrame, DataFrame]:
    """Oldest rows for training, the newest `fraction` (or `last_rows`) for testing."""
    rows = df.filter(F.col(target).isNotNull())
    order = [F.col(date), F.col(key).try_cast("bigint"), F.col(key)]
    # Rows per date decide where the cut falls; only that date's keys are put in order.
    days = rows.groupBy(F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    counted = days.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = rows.count()
    cut = max(1, int(n * (1 - fraction))) if last_rows is None else max(1, n - last_rows)
    at = counted.filter((F.col("_before") < cut) & (F.col("_before") + F.col("_n") >= cut)).first()
    if at is None:
        return rows, rows.limit(0)
    on_day = rows.filter(F.col(date).eqNullSafe(F.lit(at["_d"]))).select(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    last = on_day.orderBy(*[F.asc(f"_o{i}") for i in range(3)]).limit(cut - at["_before"]).agg(F.max(F.struct(F.col("_o1").isNotNull(), "_o1", "_o2"))).first()[0]
    here = F.struct(F.col(key).try_cast("bigint").isNotNull(), F.col(key).try_cast("bigint"), F.col(key).cast("string"))
    bound = F.struct(F.lit(last[0]), F.lit(last[1]).cast("bigint"), F.lit(last[2]).cast("string"))
    day = F.lit(at["_d"])
    old = F.when(F.col(date).isNull(), day.isNull() & (here <= bound)).when(F.col(date) < day, True).otherwise((F.col(date) == day) & (here <= bound))
    old = F.coalesce(old, F.lit(False))
    return rows.filter(old), rows.filter(~old)


def holdout(
    df: DataFrame, season: int | None = None, target: str = TARGET
) -> tuple[DataFrame, DataFrame]:
    """Seasons before the held-out one against it; without either side, the newest fifth is held out."""
    rows = df.filter(F.col(target).isNotNull())
    if season is None:
        season = rows.agg(F.max("season")).first()[0]
    train, test = rows.filter(F.col("season") < season), rows.filter(F.col("season") == season)
    if train.isEmpty() or test.isEmpty():
        return temporal_split(rows, target=target)
    return train, test


# -- Elo -----------------------------------------------------------------------------------


def elo(
    games: DataFrame, by: Sequence[str] = (), k: float = ELO["k"], home: float = ELO["home"],
    scale: float = ELO["scale"], start: float = ELO["start"], target: str = TARGET, carry: Sequence[str] = (),
) -> DataFrame:
    """Home-win probability before each game, from ratings updated game by game.

    Each rating depends on all earlier games of its league, so a league (`by`) is one chain. Rows
    stream through in date order and only the ratings are held, whatever the league's length;
    leagues, folds and parameter sets run side by side.
    """
    league = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    rows = games.select(
        league.alias("league"), F.col("game_id").cast("string").alias("game_id"), F.col("game_date").cast("timestamp").alias("t"),
        "home_team", "away_team", F.col(target).cast("double").alias("won"), *carry,
    )
    order = ["league", "t", F.col("game_id").try_cast("bigint"), "game_id"]
    ordered = rows.repartition("league").sortWithinPartitions(*order)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ratings = None, {}
        for batch in batches:
            chance = []
            for name, host, guest, won in zip(batch.league, batch.home_team, batch.away_team, batch.won):
                if name != current:
                    current, ratings = name, {}
                gap = ratings.get(guest, start) - ratings.get(host, start) - home
                p = 1.0 / (1.0 + 10.0 ** (gap / scale))
                chance.append(p)
                if won == won and won is not None:
                    ratings[host] = ratings.get(host, start) + k * (won - p)
                    ratings[guest] = ratings.get(guest, start) - k * (won - p)
            yield batch[["league", "game_id", *carry]].assign(**{PROBABILITY: chance})

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("league", "game_id", *carry))
    return ordered.mapInPandas(rate, f"{kept}, {PROBABILITY} double")


# -- experiments ---------------------------------------------------------------------------

IDENTITY = ["game_id", "game_date", "season", "home_team", "away_team", "home_score", "away_score", TARGET]


@dataclass(frozen=True)
class Shared:
    """What the held-out seasons of a table have in common, made once for all of them."""

    fills: dict[int, Fill]
    rated: DataFrame | None = None


def _shared(df: DataFrame, models: Sequence[str], seasons: Sequence[int], features: Sequence[str] | None) -> Shared:
    """Medians of the earlier games of every season from one search, and one chain of Elo ratings.

    Seasons without scored games before and in them are left out: they are held out by time. A rating needs only the games
    before it, so one chain serves all seasons where one ends before the next begins; otherwise each has its own.
    """
    scored = df.filter(F.col(TARGET).isNotNull() & F.col("season").isNotNull())
    t = F.col("game_date").cast("timestamp") if "game_date" in df.columns else F.lit(None).cast("timestamp")
    # One line per season.
    spans = sorted(scored.groupBy("season").agg(F.min(t), F.max(t), F.count_if(t.isNull())).collect())
    known = [s[0] for s in spans]
    usual = [s for s in seasons if s in known[1:]]
    columns = list(features) if features is not None else feature_columns(df)
    fills: dict[int, Fill] = {s: {} for s in usual}
    if usual and columns and any(name != "elo" for name in models):
        rows = _not_nan(scored, columns, "season")
        for (cut, c), (low, _) in middles(rows, columns, before=("season", usual)).items():
            fills[int(cut)][c] = low
    apart = all(not s[3] for s in spans) and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    rated = None
    if usual and apart and "elo" in models:
        rated = settle(elo(scored.filter(F.col("season") <= max(usual)), carry=["season"]).drop("league"))
    return Shared(fills, rated)


def _score_season(
    df: DataFrame, name: str, season: int | None, features: Sequence[str] | None, seed: int, common: Shared = Shared({})
) -> DataFrame:
    if name == "elo" and common.rated is not None and season in common.fills:
        test = df.filter(F.col(TARGET).isNotNull() & (F.col("season") == season))
        rated = common.rated.filter(F.col("season") <= season).select(F.col("game_id").alias("_rated"), PROBABILITY)
        return test.join(rated, F.col("game_id").cast("string") == F.col("_rated")).drop("_rated")
    train, test = holdout(df, season)
    if name == "elo":
        keys = [c for c in IDENTITY if c in df.columns]
        rated = elo(train.select(*keys).unionByName(test.select(*keys))).drop("league")
        return test.join(rated, test["game_id"].cast("string") == rated["game_id"]).drop(rated["game_id"])
    columns = list(features) if features is not None else feature_columns(train)
    if not columns:
        raise ValueError("no numeric feature columns found")
    return fit_classifier(name, train, columns, seed=seed, fill=common.fills.get(season)).score(test)


def later_seasons(df: DataFrame) -> list[int]:
    """The seasons of a table but the first; as many numbers as there are seasons."""
    return sorted(r[0] for r in df.select("season").filter(F.col("season").isNotNull()).distinct().collect())[1:]


def oof_predictions(
    df: DataFrame, models: Sequence[str], seasons: Sequence[int] | None = None, features: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Long table of held-out forecasts per (season, model); unavailable models are skipped.

    Without `seasons`, every season that has an earlier one is held out.
    """
    df = settle(df)  # read by every fit
    out = None
    seasons = later_seasons(df) if seasons is None else seasons
    common = _shared(df, models, seasons, features)
    for season in seasons:
        for name in models:
            try:
                scored = _score_season(df, name, season, features, seed, common)
            except ModelUnavailable:
                continue
            p, truth = F.col(PROBABILITY), F.col(TARGET)
            part = scored.select(
                F.lit(season).alias("holdout_season"), F.lit(name).alias("model_name"), *[c for c in IDENTITY if c in df.columns],
                p.alias(PROBABILITY), (1 - p).alias("away_win_probability"),
                F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team")).alias("raw_win_pick"),
                F.greatest(p, 1 - p).alias("win_confidence"),
                F.when(truth == 1, F.col("home_team")).when(truth == 0, F.col("away_team")).alias("actual_winner"),
            )
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no model could be fitted")
    return out


def holdout_report(df: DataFrame, models: Sequence[str], seasons: Sequence[int], seed: int = 42) -> dict[str, DataFrame]:
    """Metrics, calibration, best model and selection rules, all from one table of forecasts."""
    oof = settle(oof_predictions(df, models, seasons, seed=seed))
    by = ["holdout_season", "model_name"]
    metrics = X.probability_metrics(oof, TARGET, PROBABILITY, by)
    return {
        "predictions": oof,
        "metrics": metrics,
        "calibration": X.calibration(oof, TARGET, PROBABILITY, by),
        "best": X.best_per(metrics, ["holdout_season"], ["log_loss", "brier_score", "model_name"]),
        "rules": X.selection_rules(metrics),
    }


def selective_picks(oof: DataFrame, primary: str, challengers: Sequence[str], lean: float = 0.55, strong: float = 0.60) -> dict[str, DataFrame]:
    """Pick summaries per model, and for the primary model with agreeing challengers."""
    agreed = X.agreement_picks(oof, primary, challengers, lean, strong)
    return {
        "per_model": X.summarize_picks(X.win_picks(oof, lean=lean, strong=strong), ["model_name"]),
        "agreement": X.summarize_picks(agreed),
        "agreement_by_season": X.summarize_picks(agreed, ["holdout_season"]),
    }


def _run_columns(df: DataFrame) -> DataFrame:
    """Both sides' forecasts cut at 0, their sum and difference; NULL stays NULL."""
    cut = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    home, away = RUNS_COLUMNS[:2]
    out = df.withColumns({c: cut(c) for c in (home, away)})
    return out.withColumns({"expected_total_runs": F.col(home) + F.col(away), "expected_run_diff": F.col(home) - F.col(away)})


def _runs(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], seed: int) -> DataFrame:
    out = test
    for side, column in (("home", "expected_home_runs"), ("away", "expected_away_runs")):
        out = fit_regressor(name, train, features, f"{side}_score", seed + (side == "away"), column).score(out)
    return _run_columns(out)


def expected_runs(
    df: DataFrame, models: Sequence[str] = ("ridge", "random_forest_regressor"), season: int | None = None,
    features: Sequence[str] | None = None, seed: int = 42, lines: Sequence[float] = X.TOTAL_LINES,
) -> dict[str, DataFrame]:
    """Held-out run predictions, their errors, and over/under metrics against fixed totals."""
    train, test = holdout(df, season)
    columns = list(features) if features is not None else feature_columns(train)
    out = None
    for name in models:
        part = _runs(train, test, name, columns, seed).withColumn("model_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return {
        "predictions": out,
        "metrics": X.runs_metrics(out, ["model_name"]),
        "totals": X.total_line_metrics(out, ["model_name"], lines),
    }


def with_expected_runs(
    df: DataFrame, seasons: Sequence[int] | None = None, name: str = "ridge", features: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Add run predictions to the given seasons (all but the first), each from models of earlier seasons only.

    `ridge` fits all seasons and both sides from one pass of sums (`operators.ridge`); other models are fitted one
    by one, and each fit reads `df`. Give a written table where its plan is long.
    """
    seasons = later_seasons(df) if seasons is None else list(seasons)
    if name == "ridge":
        columns = list(features) if features is not None else feature_columns(df, RUNS_COLUMNS)
        fits = fit_before(df, columns, ["home_score", "away_score"], seasons)
        out = score_cuts(df, fits, columns, {"home_score": RUNS_COLUMNS[0], "away_score": RUNS_COLUMNS[1]}, seasons)
        return _run_columns(out)
    scored = None
    for season in seasons:
        train, test = df.filter(F.col("season") < season), df.filter(F.col("season") == season)
        if train.isEmpty() or test.isEmpty():
            continue
        columns = list(features) if features is not None else feature_columns(train, RUNS_COLUMNS)
        part = _runs(train, test, name, columns, seed).select("game_id", *RUNS_COLUMNS)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in RUNS_COLUMNS})
    return df.join(scored, "game_id", "left")


def without_groups(columns: Sequence[str], markers: Sequence[str]) -> list[str]:
    """Feature list without the columns whose name holds one of the markers."""
    return [c for c in columns if not any(m in c for m in markers)]


def variant_grid(
    df: DataFrame, variants: dict[str, Sequence[str]], models: Sequence[str], seasons: Sequence[int], seeds: Sequence[int] = (42,)
) -> DataFrame:
    """Metrics for every (variant, model, seed, season); ablations and seed studies are grids of this."""
    out = None
    for variant, columns in variants.items():
        for seed in seeds:
            oof = oof_predictions(df, models, seasons, columns, seed)
            part = X.probability_metrics(oof, TARGET, PROBABILITY, ["holdout_season", "model_name"]).withColumns(
                {"variant": F.lit(variant), "seed": F.lit(seed)}
            )
            out = part if out is None else out.unionByName(part)
    return out


def recency_challengers(
    df: DataFrame, name: str, season: int, features: Sequence[str], recent: int = 2, half_life: float = 2.0, seed: int = 42
) -> DataFrame:
    """Forecasts for one season by models of all, of recent, and of recency-weighted seasons."""
    train, test = holdout(df, season)
    latest = train.agg(F.max("season")).first()[0]
    weighted = train.withColumn("_weight", recency_weight(F.col("season"), F.lit(latest), half_life))
    ways = {
        "all_seasons": (train, None),
        "recent_seasons": (train.filter(F.col("season") > latest - recent), None),
        "recency_weighted": (weighted, "_weight"),
    }
    out = None
    for label, (rows, weight) in ways.items():
        part = fit_classifier(name, rows, features, seed=seed, weight=weight).score(test).withColumn("variant", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out
