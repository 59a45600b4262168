"""A cross-sectional ranker on Spark ML boosted trees: fit, predict, refit, save.

Trees see the encoded features (missing as 0 plus a flag), because MLlib trees take no NaN.
The loss is squared error on the relevance label; ranking quality is judged by the rank IC,
which also chooses the number of trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from panelwright.operators.cross_section import rank_ic_daily, rank_ic_of_scores, rank_ic_summary, ranking_rows
from panelwright.operators.screening import align_features, feature_profile, kept_features
from panelwright.operators.staging import stage
from panelwright.operators.views import encode_features


@dataclass(frozen=True)
class RankerParams:
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    subsampling_rate: float = 0.7
    min_instances: int = 20
    relevance_bins: int = 10
    min_group_size: int = 30
    clip_y_abs: float = 0.0
    missing_drop_thresh: float = 0.98
    exclude: str | None = None
    seed: int = 42


def model_rows(view: DataFrame, params: RankerParams) -> DataFrame:
    """Ranking rows with the encoded feature vector."""
    rows = ranking_rows(view, params.min_group_size, params.relevance_bins, params.clip_y_abs)
    return rows.withColumn("x", array_to_vector(encode_features(F.col("features"), F.col("usable"))))


def _trees(params: RankerParams, max_iter: int) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="x",
        labelCol="relevance",
        predictionCol="pred",
        maxIter=max_iter,
        maxDepth=params.max_depth,
        stepSize=params.step_size,
        subsamplingRate=params.subsampling_rate,
        minInstancesPerNode=params.min_instances,
        seed=params.seed,
    )


def fit(rows: DataFrame, params: RankerParams, n_trees: int | None = None) -> GBTRegressionModel:
    """Fit on `relevance`, with as many trees as the parameters or the caller say."""
    return _trees(params, n_trees or params.max_iter).fit(rows)


def rank_ic_by_trees(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """The rank IC summary of the first 1, 2, ... trees of a model (n_trees), each row scored by every tree once."""
    scored, running = rows.select("date", "sid", "y_raw", "x"), []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        scored = tree.setFeaturesCol("x").setPredictionCol(f"_tree{i}").transform(scored)
        term = F.col(f"_tree{i}") * F.lit(float(weight))
        running.append(running[-1] + term if running else term)
    return rank_ic_summary(rank_ic_of_scores(scored, "n_trees", F.array(*running)), ["n_trees"])


def best_tree_count(model: GBTRegressionModel, valid: DataFrame) -> int:
    """The number of trees with the greatest mean rank IC, the fewest if several; all where no day can be judged."""
    best = rank_ic_by_trees(model, valid).where("rank_ic_mean is not null").orderBy(F.desc("rank_ic_mean"), "n_trees").first()
    return best["n_trees"] if best else model.getNumTrees


def predict(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("date", "sid", "y_raw", "pred")


@dataclass(frozen=True)
class RankerRun:
    """`features` the model was fitted on, in order; `predictions` tagged by split;
    `metrics` (split, rank_ic_mean, rank_ic_std, rank_ic_n_days, rank_ic_ir)."""

    model: GBTRegressionModel
    features: list[str]
    predictions: DataFrame
    metrics: DataFrame


def run(view: DataFrame, names: Sequence[str], params: RankerParams, refit_before_test: bool = False) -> RankerRun:
    """Screen features on train, choose the number of trees on valid, optionally refit on both, predict all splits.

    `view` is a tabular view with a `split` column, `names` its features in order. Every split sees the features kept on train, in their order.
    """
    features = kept_features(feature_profile(view.where("split = 'train'"), names, params.missing_drop_thresh, params.exclude))
    if not features:
        raise ValueError("screening leaves no feature to train on")
    # Boosting reads its input many times, so the training table is written once.
    rows = stage(model_rows(align_features(view, names, features), params))
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    model = fit(train, params)
    best = best_tree_count(model, valid)
    if refit_before_test:
        model = fit(train.unionByName(valid), params, best)
    elif best < model.getNumTrees:
        model = fit(train, params, best)
    predictions = stage(model.transform(rows).select("date", "sid", "split", "y_raw", "pred"))
    return RankerRun(model, features, predictions, rank_ic_summary(rank_ic_daily(predictions, by=["split", "date"]), ["split"]))


def save(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)
