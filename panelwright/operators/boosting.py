"""Boosted trees for ranking: pairwise gradients, Newton leaves, rounds that can be stopped, resumed and stored.

A pair of rows of a day counts if one of them stands in the day's top k by the present score, since no other swap changes NDCG@k. So each
row meets the k top rows of its day (an array of one broadcast row per day), and what a top row gets from the whole day is a sum of k columns: work is
rows * k, and no pair is ever a row.

Feature vectors are written once, bucketed by the row's key. The state of a round is a narrow table in the same buckets: label, margin
before the round and leaf reached in it. A round joins the two without an exchange, fits one tree, scores only that tree and
writes the next state, so its cost doesn't depend on how many rounds went before. Executors may be lost: both tables are files in shared storage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.operators.cross_section import DAY, per_day, rank_ic_daily, rank_ic_summary
from panelwright.operators.losses import PAIR_EPS, discount, ideal_dcg
from panelwright.operators.ranks import top_k
from panelwright.operators.staging import stage
from panelwright.operators.views import encode_features
from panelwright.sources.tables import bucketed

# Fixed value: what a pair's score difference is raised by when its weight is divided by it.
NORM_EPS = 0.01


@dataclass(frozen=True)
class BoostParams:
    """`gains[r]` is the gain of relevance r; None is r itself. `k` is the truncation level of the objective and of the NDCG metric."""

    rounds: int = 5000
    patience: int = 400
    learning_rate: float = 0.02
    max_depth: int = 8
    min_instances: int = 2000
    min_gain: float = 0.0
    feature_fraction: float = 0.7
    row_fraction: float = 0.7
    l2: float = 10.0
    k: int = 50
    sigma: float = 1.0
    normalise: bool = True
    gains: tuple[float, ...] | None = None
    max_bins: int = 32
    seed: int = 42


def _gain(params: BoostParams) -> Callable[[Column], Column]:
    if params.gains is None:
        return lambda r: r.cast("double")
    return lambda r: F.get(F.array(*[F.lit(float(g)) for g in params.gains]), r.cast("int"))


# --- gradients -----------------------------------------------------------------------------


def rank_gradients(df: DataFrame, score: str, relevance: str, params: BoostParams, by: Sequence[str] = DAY, tie: str = "sid") -> DataFrame:
    """df with `grad` and `hess`: first and second derivative by the row's score of the day's pairwise logistic loss, each pair weighted
    by the change of NDCG@k that swapping it would bring. Equal scores stand in md5 order of `tie`; rows without a score or relevance get zeros.

    With `normalise`, a pair's weight is divided by its score difference (unless the day has one score only), and the day's derivatives are scaled by
    log2(1 + s) / s, s being twice the sum of its pairs' gradients. `tie` names a row within its group once. df is read several times: pass a stored table.

    A row is laid beside its day's k top rows, and the terms are summed by row and by top row in compiled code. Where df lies in buckets of some of its
    columns, the sums by row move nothing and leave it there.
    """
    gain, by = _gain(params), list(by)
    known = F.coalesce(F.col(score).isNotNull() & ~F.isnan(score) & F.col(relevance).isNotNull(), F.lit(False))
    live = df.where(known)
    top = top_k(live, by, [F.col(score).desc(), F.md5(F.col(tie)).asc(), F.col(tie).asc()], params.k, spread=tie)
    item = F.struct(F.col("top_pos").alias("_p"), F.col(tie).alias("_key"), F.col(score).cast("double").alias("_ts"), F.col(relevance).alias("_tr"))
    tops = top.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_top"))
    ends = live.groupBy(*by).agg((F.min(score) < F.max(score)).alias("_spread"))
    ideal = ideal_dcg(live, relevance, params.k, by, gain)
    context = per_day(tops.join(ideal, by).join(ends, by).select(*by, "_top", F.col("_top._key").alias("_keys"), "_spread", "idcg"))

    # The row's own place among the top, -1 outside; beyond the top the discount is zero.
    faced = df.join(context, by, "left")
    faced = faced.withColumn("_place", F.array_position("_keys", F.col(tie)).cast("int") - 1)
    faced = faced.withColumn("_own", F.when(F.col("_place") >= 0, discount(F.col("_place"))).otherwise(0.0))
    pairs = faced.select(*df.columns, "_place", "_own", "_spread", "idcg", F.inline_outer(F.when(known, F.col("_top")))).drop("_key")

    # What the pair of the row and the top row adds to the top row: gradient and curvature.
    s, r, ts, tr = F.col(score).cast("double"), F.col(relevance), F.col("_ts"), F.col("_tr")
    better = tr > r
    gap = F.when(better, ts - s).otherwise(s - ts)
    weight = F.abs(gain(tr) - gain(r)) * F.abs(discount(F.col("_p")) - F.col("_own")) / (F.col("idcg") + PAIR_EPS)
    if params.normalise:
        weight = F.when(F.col("_spread"), weight / (NORM_EPS + F.abs(gap))).otherwise(weight)
    pairs = pairs.withColumns({"_better": better, "_counts": tr != r, "_weight": weight, "_share": 1 / (1 + F.exp(params.sigma * gap))})
    weight, p = F.col("_weight"), F.col("_share")
    g = F.when(F.col("_better"), -params.sigma * weight * p).otherwise(params.sigma * weight * p)
    pairs = pairs.select(*df.columns, "_place", "_p", F.when(F.col("_counts"), g).otherwise(0.0).alias("_g"),
                         F.when(F.col("_counts"), params.sigma**2 * weight * p * (1 - p)).otherwise(0.0).alias("_h"))

    each = pairs.groupBy(*df.columns).agg(F.first("_place").alias("_place"), F.sum("_g").alias("_row_g"), F.sum("_h").alias("_row_h"))
    # Pairs within the top are met from both sides, the others once.
    once = F.when(F.col("_place") >= 0, 0.5).otherwise(1.0)
    # Every place is met at least by its own row, so the sorted places are 0, 1, ...
    sums = pairs.where("_p is not null").groupBy(*by, "_p").agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"), F.sum(once * F.abs("_g")).alias("_s"))
    sums = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", "_g", "_h"))).alias("_tops"), (2 * F.sum("_s")).alias("_s"))
    at, mine = F.col("_place") >= 0, F.get("_tops", F.col("_place"))
    scale = F.when(F.col("_s") > 0, F.log2(1 + F.col("_s")) / F.col("_s")).otherwise(1.0) if params.normalise else F.lit(1.0)
    grad = scale * F.when(at, mine["_g"]).otherwise(-F.col("_row_g"))
    hess = scale * F.when(at, mine["_h"]).otherwise(F.col("_row_h"))
    return each.join(per_day(sums), by, "left").select(
        *df.columns, F.when(known, grad).otherwise(0.0).alias("grad"), F.when(known, hess).otherwise(0.0).alias("hess"))


def ndcg_daily(df: DataFrame, score: str, relevance: str, params: BoostParams, by: Sequence[str] = DAY, tie: str = "sid") -> DataFrame:
    """(by, ndcg) at k with the parameters' gains; days whose ideal is zero are left out."""
    by = list(by)
    top = top_k(df, by, [F.col(score).desc(), F.md5(F.col(tie)).asc(), F.col(tie).asc()], params.k, spread=tie)
    dcg = top.groupBy(*by).agg(F.sum(_gain(params)(F.col(relevance)) * discount(F.col("top_pos"))).alias("dcg"))
    ideal = ideal_dcg(df, relevance, params.k, by, _gain(params)).where("idcg > 0")
    return dcg.join(ideal, by).select(*by, (F.col("dcg") / F.col("idcg")).alias("ndcg"))


# --- metrics: a table of scored rows in, one number out ----------------------------------------

Metric = Callable[[DataFrame], DataFrame]


def mean_rank_ic(scored: DataFrame) -> DataFrame:
    return rank_ic_summary(rank_ic_daily(scored)).select(F.col("rank_ic_mean").alias("value"))


def mean_ndcg(params: BoostParams) -> Metric:
    return lambda scored: ndcg_daily(scored, "pred", "relevance", params).agg(F.avg("ndcg").alias("value"))


# --- rounds --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosted:
    """Trees with the value of each leaf, shrunk by the learning rate, and the features they were fitted on."""

    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def first(self, n: int) -> Boosted:
        return Boosted(self.trees[:n], self.leaves[:n], self.features)


@dataclass(frozen=True)
class BoostState:
    """Where boosting stands: the model so far, the value of the metric after each round, and the state tables: of the start, then of every round."""

    model: Boosted
    values: list[float]
    tables: list[str]
    vectors: str
    keys: list[str]
    buckets: int

    @property
    def table(self) -> str:
        return self.tables[-1]

    def after(self, rounds: int) -> BoostState:
        """Where boosting stood after that many rounds; the tables of rounds are kept, so nothing is computed again."""
        return replace(self, model=self.model.first(rounds), values=self.values[:rounds], tables=self.tables[: rounds + 1])

    @property
    def best_round(self) -> int:
        """Rounds up to the first greatest value; all if no round could be judged."""
        known = [v for v in self.values if not math.isnan(v)]
        return self.values.index(max(known)) + 1 if known else len(self.values)

    @property
    def best(self) -> Boosted:
        return self.model.first(self.best_round)


def _leaf_value(leaves: list[float], leaf: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in leaves]), leaf.cast("int"))


def start(rows: DataFrame, features: Sequence[str], buckets: int) -> BoostState:
    """rows: split, date, sid (unique together), y_raw, relevance and the vector x. Vectors are stored apart from what changes."""
    keys = ["split", "date", "sid"]
    vectors = bucketed(rows.select(*keys, "x"), keys, buckets)
    state = bucketed(rows.select(*keys, "y_raw", "relevance", F.lit(0.0).alias("margin"), F.lit(-1).alias("leaf")), keys, buckets)
    return BoostState(Boosted(features=list(features)), [], [state], vectors, keys, buckets)


def margins(spark: SparkSession, state: BoostState) -> DataFrame:
    """split, date, sid, y_raw, relevance and margin after the state's last round."""
    table = spark.read.table(state.table)
    after = F.col("margin") + _leaf_value(state.model.leaves[-1], F.col("leaf")) if state.model.leaves else F.col("margin")
    return table.select(*state.keys, "y_raw", "relevance", after.alias("margin"))


def boost_round(spark: SparkSession, state: BoostState, params: BoostParams, train: str = "train") -> BoostState:
    """One more tree. The values of the metric are left to the caller."""
    number = len(state.model.trees)
    now = margins(spark, state)
    vectors = spark.read.table(state.vectors)
    own = now.where(F.col("split") == train)
    # Fitting reads its sample several times and the leaves read the gradients again, so both are written once.
    graded = rank_gradients(own, "margin", "relevance", params)
    graded = spark.read.table(bucketed(graded.where("hess > 0").select(*state.keys, "grad", "hess"), state.keys, state.buckets))
    faced = vectors.join(graded, state.keys)
    drawn = F.pmod(F.xxhash64(F.lit(params.seed), F.lit(number), *state.keys), F.lit(1 << 20)) < int(params.row_fraction * (1 << 20))
    fraction = "all" if params.feature_fraction >= 1 else str(params.feature_fraction)
    forest = RandomForestRegressor(featuresCol="x", labelCol="_step", weightCol="hess", numTrees=1, bootstrap=False, featureSubsetStrategy=fraction, maxDepth=params.max_depth,
                                   minInstancesPerNode=params.min_instances, minInfoGain=params.min_gain, maxBins=params.max_bins, seed=params.seed + number)
    # A weighted mean of -grad / hess with weights hess is the Newton step of a leaf, and its variance is what a split lowers.
    sample = stage(faced.where(drawn).select("x", "hess", (-F.col("grad") / F.col("hess")).alias("_step")))
    tree = forest.fit(sample).trees[0].setFeaturesCol("x").setPredictionCol("_tree").setLeafCol("_leaf")
    placed = tree.transform(vectors).select(*state.keys, F.col("_leaf").cast("int").alias("leaf"))
    table = bucketed(now.join(placed, state.keys).select(*state.keys, "y_raw", "relevance", "margin", "leaf"), state.keys, state.buckets)
    # One row per leaf, 2 ** max_depth at most.
    sums = {r["leaf"]: (r["g"], r["h"]) for r in graded.join(spark.read.table(table).select(*state.keys, "leaf"), state.keys)
            .groupBy("leaf").agg(F.sum("grad").alias("g"), F.sum("hess").alias("h")).collect()}
    values = [-params.learning_rate * sums[i][0] / (sums[i][1] + params.l2) if i in sums else 0.0 for i in range((tree.numNodes + 1) // 2)]
    model = Boosted([*state.model.trees, tree], [*state.model.leaves, values], state.model.features)
    return replace(state, model=model, tables=[*state.tables, table])


def boost(spark: SparkSession, state: BoostState, params: BoostParams, metric: Metric = mean_rank_ic, judge: str = "valid", rounds: int | None = None) -> BoostState:
    """Adds up to `rounds` trees (params.rounds in all, if not given) and stops when `patience` rounds in a row did not raise the metric on split `judge`.

    A state may be boosted again: the result is that of boosting at once."""
    most = params.rounds if rounds is None else len(state.values) + rounds
    while len(state.values) < most and (not state.values or len(state.values) - state.best_round < params.patience):
        state = boost_round(spark, state, params)
        scored = margins(spark, state).where(F.col("split") == judge).withColumnRenamed("margin", "pred")
        found = metric(scored.select("date", "sid", "y_raw", "relevance", "pred")).first()
        value = float("nan") if found is None or found["value"] is None else float(found["value"])
        state = replace(state, values=[*state.values, value])
    return state


# --- scoring -------------------------------------------------------------------------------


def scoring_pipeline(model: Boosted) -> PipelineModel:
    """A stored form of the model: encodes a view's features (missing as 0 plus a flag), runs the trees and adds up their leaves as `pred`."""
    stages: list = []
    for i, (tree, leaves) in enumerate(zip(model.trees, model.leaves)):
        one = tree.copy().setFeaturesCol("x").setPredictionCol(f"_tree{i}").setLeafCol(f"_leaf{i}")
        stages.append(one)
        before = "0D" if i == 0 else "_margin"
        values = ", ".join(f"{v!r}D" for v in leaves)
        kept = "" if i == 0 else ", _margin"
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT (_tree{i}, _leaf{i}{kept}), {before} + get(array({values}), CAST(_leaf{i} AS INT)) AS _margin FROM __THIS__"))
    stages.append(SQLTransformer(statement="SELECT * EXCEPT (_margin, x), _margin AS pred FROM __THIS__" if model.trees else "SELECT * EXCEPT (x), 0D AS pred FROM __THIS__"))
    return PipelineModel(stages)


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    """The scoring pipeline, and beside it the features it expects, in order."""
    scoring_pipeline(model).write().overwrite().save(f"{path}/pipeline")
    rows = [(i, n) for i, n in enumerate(model.features)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


@dataclass(frozen=True)
class Scorer:
    pipeline: PipelineModel
    features: list[str]

    def score(self, view: DataFrame, names: Sequence[str]) -> DataFrame:
        """A tabular view with `pred`. The view's features must be the stored ones in the stored order."""
        if list(names) != self.features:
            raise ValueError(f"the model expects the features {self.features}, the view has {list(names)}")
        return self.pipeline.transform(view.withColumn("x", array_to_vector(encode_features(F.col("features"), F.col("usable")))))


def load(spark: SparkSession, path: str) -> Scorer:
    features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    return Scorer(PipelineModel.load(f"{path}/pipeline"), features)
