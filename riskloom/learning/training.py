"""Model definitions, fitting and tuning. Default parameters are the published ones."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.buckets import BUCKETS, sha_bucket
from riskloom.learning.dataset import LABEL, assembler
from riskloom.schemas import MODEL_FEATURES
from riskloom.sources.staging import stage

# The published model parameters and search grids.
SEED = 42
GBT = {"max_iter": 50, "max_depth": 6, "step_size": 0.1}
SCALED_GBT = {"max_iter": 100, "max_depth": 4, "step_size": 0.1}
FOREST = {"num_trees": 100, "max_depth": 8}
GBT_GRID = {"max_iters": (30,), "max_depths": (4, 6), "step_sizes": (0.1,)}
VALIDATION_SHARE = 0.2
FOREST_GRID = {"num_trees": (30, 50), "max_depths": (6, 10), "subsets": ("auto",)}


def gbt_stages(
    features: Sequence[str] = MODEL_FEATURES,
    max_iter: int = GBT["max_iter"],
    max_depth: int = GBT["max_depth"],
    step_size: float = GBT["step_size"],
    seed: int = SEED,
    scaled: bool = False,
) -> tuple[Pipeline, GBTClassifier]:
    """Gradient-boosted trees, one model per tier against the rest; the models fit side by side."""
    vector = "scaled_features" if scaled else "features"
    gbt = GBTClassifier(
        labelCol=LABEL, featuresCol=vector, maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed
    )
    stages = [assembler(features)]
    if scaled:
        stages.append(StandardScaler(inputCol="features", outputCol=vector, withMean=True, withStd=True))
    stages.append(OneVsRest(classifier=gbt, labelCol=LABEL, featuresCol=vector, parallelism=3))
    return Pipeline(stages=stages), gbt


def forest_stages(
    features: Sequence[str] = MODEL_FEATURES,
    num_trees: int = FOREST["num_trees"],
    max_depth: int = FOREST["max_depth"],
    seed: int = SEED,
) -> tuple[Pipeline, RandomForestClassifier]:
    forest = RandomForestClassifier(
        labelCol=LABEL, featuresCol="features", numTrees=num_trees, maxDepth=max_depth, seed=seed
    )
    return Pipeline(stages=[assembler(features), forest]), forest


def require_two_classes(train: DataFrame) -> None:
    low, high = train.agg(F.min(LABEL), F.max(LABEL)).first()
    if low == high:
        raise ValueError(f"training needs at least two classes, found only {low}")


def train_gbt(train: DataFrame, features: Sequence[str] = MODEL_FEATURES, **params) -> PipelineModel:
    return gbt_stages(features, **params)[0].fit(train)


def train_forest(train: DataFrame, features: Sequence[str] = MODEL_FEATURES, **params) -> PipelineModel:
    return forest_stages(features, **params)[0].fit(train)


def train_gbt_scaled(train: DataFrame, features: Sequence[str] = MODEL_FEATURES, **params) -> PipelineModel:
    """Boosted trees on standardised features, fitted on every training row."""
    require_two_classes(train)
    return train_gbt(train, features, scaled=True, **(SCALED_GBT | params))


@dataclass
class Search:
    """What a parameter search found: every grid point with its F1, and the best one fitted on all rows."""

    points: list[dict]
    validationMetrics: list[float]
    bestModel: PipelineModel


# Keeps the search's sides apart from the holdout, which is divided by the same key.
VALIDATION_SALT = "validation:"


def mark_validation(df: DataFrame, key: str = "prescriber_id", share: float = 0.2) -> DataFrame:
    """Add ``is_validation``, decided by the key alone: all copies of a prescriber are on one side."""
    salted = F.concat(F.lit(VALIDATION_SALT), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.withColumn("is_validation", sha_bucket(salted) < int(share * BUCKETS))


def _judge() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction", metricName="f1")


def _search(pipeline: Pipeline, grid: ParamGridBuilder, train: DataFrame, key: str, share: float, parallelism: int) -> Search:
    """Fit each grid point on one side of the keys and judge it on the other; the first of equal ones wins."""
    marked = stage(mark_validation(train, key, share), "search")
    fitting, judging = marked.filter("not is_validation"), marked.filter("is_validation")
    if fitting.isEmpty() or judging.isEmpty():
        raise ValueError("one side of the validation split is empty: change share or check the key")
    points, judge = grid.build(), _judge()
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        scores = list(pool.map(lambda point: judge.evaluate(pipeline.fit(fitting, point).transform(judging)), points))
    best = max(range(len(points)), key=lambda i: (scores[i], -i))
    told = [{param.name: value for param, value in point.items()} for point in points]
    return Search(told, scores, pipeline.fit(marked.drop("is_validation"), points[best]))


def _cross_validate(pipeline: Pipeline, grid: ParamGridBuilder, train: DataFrame, key: str, folds: int, parallelism: int) -> Search:
    """The same with every key in one of ``folds`` parts, each of which is the judge once."""
    salted = F.concat(F.lit(VALIDATION_SALT), F.coalesce(F.col(key).cast("string"), F.lit("")))
    parts = stage(train.withColumn("fold", (sha_bucket(salted) % folds).cast("int")), "folds")
    points = grid.build()
    search = CrossValidator(
        estimator=pipeline, estimatorParamMaps=points, evaluator=_judge(), numFolds=folds, foldCol="fold", parallelism=parallelism
    )
    fitted = search.fit(parts)
    told = [{param.name: value for param, value in point.items()} for point in points]
    return Search(told, list(fitted.avgMetrics), fitted.bestModel)


def _tuned(pipeline, grid, train, key, share, folds, parallelism) -> Search:
    if folds:
        return _cross_validate(pipeline, grid, train, key, folds, parallelism)
    return _search(pipeline, grid, train, key, share, parallelism)


def tune_gbt(
    train: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    max_iters: Sequence[int] = GBT_GRID["max_iters"],
    max_depths: Sequence[int] = GBT_GRID["max_depths"],
    step_sizes: Sequence[float] = GBT_GRID["step_sizes"],
    seed: int = SEED,
    parallelism: int = 2,
    key: str = "prescriber_id",
    share: float = VALIDATION_SHARE,
    folds: int = 0,
) -> Search:
    """``share`` of the keys judge the grid points; with ``folds``, all of them do in turn."""
    pipeline, gbt = gbt_stages(features, seed=seed)
    grid = (
        ParamGridBuilder()
        .addGrid(gbt.maxIter, list(max_iters))
        .addGrid(gbt.maxDepth, list(max_depths))
        .addGrid(gbt.stepSize, list(step_sizes))
    )
    return _tuned(pipeline, grid, train, key, share, folds, parallelism)


def tune_forest(
    train: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    num_trees: Sequence[int] = FOREST_GRID["num_trees"],
    max_depths: Sequence[int] = FOREST_GRID["max_depths"],
    subsets: Sequence[str] = FOREST_GRID["subsets"],
    seed: int = SEED,
    parallelism: int = 2,
    key: str = "prescriber_id",
    share: float = VALIDATION_SHARE,
    folds: int = 0,
) -> Search:
    """``share`` of the keys judge the grid points; with ``folds``, all of them do in turn."""
    pipeline, forest = forest_stages(features, seed=seed)
    grid = (
        ParamGridBuilder()
        .addGrid(forest.numTrees, list(num_trees))
        .addGrid(forest.maxDepth, list(max_depths))
        .addGrid(forest.featureSubsetStrategy, list(subsets))
    )
    return _tuned(pipeline, grid, train, key, share, folds, parallelism)


def tuning_report(search: Search) -> list[dict]:
    """Parameters and validation F1 of every grid point, best first."""
    points = [point | {"f1": metric} for point, metric in zip(search.points, search.validationMetrics)]
    return sorted(points, key=lambda p: -p["f1"])


def tuning_table(spark: SparkSession, search: Search) -> DataFrame:
    """The report as rows: rank, the grid point's parameters as text, F1."""
    rows = [
        (rank, ", ".join(f"{k}={v}" for k, v in sorted(point.items()) if k != "f1"), float(point["f1"]))
        for rank, point in enumerate(tuning_report(search), start=1)
    ]
    return spark.createDataFrame(rows, "rank int, parameters string, f1 double")
