"""Applying fitted models to whole tables, and explaining what they use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.labels import decode_tier, softmax
from riskloom.learning.dataset import TIER
from riskloom.operators.projecting import ensure_features, select_present
from riskloom.schemas import MODEL_FEATURES

# The columns kept next to a prediction.
PREDICTION_COLUMNS = [
    "prescriber_id",
    "provider_type",
    "state",
    "total_claims",
    "total_payment_amount",
    "payment_to_drug_cost_ratio",
    "peer_deviation_score",
    TIER,
    "predicted_category",
]

PROBABILITY_COLUMNS = ["p_low", "p_medium", "p_high"]


def score_holdout(model: PipelineModel, holdout: DataFrame) -> DataFrame:
    return model.transform(holdout)


def class_probabilities(df: DataFrame) -> dict[str, Column]:
    """Probability per tier: the model's own, or the softmax of its raw scores.

    One-against-rest models give raw scores only. A tier the training rows never
    showed has no score and gets 0.
    """
    if "probability" in df.columns:
        values = vector_to_array("probability")
    else:
        values = softmax(vector_to_array("rawPrediction"))
    return {name: F.coalesce(F.get(values, i), F.lit(0.0)) for i, name in enumerate(PROBABILITY_COLUMNS)}


def with_prediction(model: PipelineModel, df: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Add the predicted code, its tier name and the three probabilities."""
    predicted = model.transform(ensure_features(df, features))
    added = predicted.withColumns(
        {"predicted_category": decode_tier(F.col("prediction")), **class_probabilities(predicted)}
    )
    return added.select(*df.columns, "prediction", "predicted_category", *PROBABILITY_COLUMNS)


def batch_score(model: PipelineModel, uploads: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Uploaded records, each with its prediction; features the upload lacks count as 0."""
    return with_prediction(model, uploads, features)


def predictions_table(predictions: DataFrame, with_peer_score: bool = True) -> DataFrame:
    """Identifying columns, true and predicted tier. Sort when writing, with ``write_table``."""
    named = predictions.withColumn("predicted_category", decode_tier(F.col("prediction")))
    kept = [c for c in PREDICTION_COLUMNS if with_peer_score or c != "peer_deviation_score"]
    return select_present(named, kept)


def probability_table(model: PipelineModel, df: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Identifier as text, code, tier and probabilities for every row."""
    return with_prediction(model, df, features).select(
        F.col("prescriber_id").cast("string").alias("prescriber_id"),
        F.col("prediction").cast("int").alias("prediction"),
        "predicted_category",
        *PROBABILITY_COLUMNS,
    )


def importances(model: PipelineModel, features: Sequence[str] = MODEL_FEATURES) -> dict[str, float]:
    """Importance per feature; the mean over the models of a one-against-rest stage."""
    fitted = model.stages[-1]
    members = getattr(fitted, "models", [fitted])
    vectors = [m.featureImportances.toArray() for m in members]
    return {f: float(sum(v[i] for v in vectors) / len(vectors)) for i, f in enumerate(features)}


def feature_importance(
    spark: SparkSession, model: PipelineModel, features: Sequence[str] = MODEL_FEATURES
) -> DataFrame:
    rows = list(importances(model, features).items())
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(
    df: DataFrame, importance: Mapping[str, float], n: int = 5, key: str = "prescriber_id"
) -> DataFrame:
    """The ``n`` most important features with each record's own value.

    The ranking is the same for all records, so it is settled once and each
    record is turned into its ``n`` rows in place, without a window or a join.
    """
    ranked = sorted(importance.items(), key=lambda item: (-item[1], item[0]))[:n]
    cells = [
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(feature).alias("feature"),
            (F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) if feature in df.columns else F.lit(0.0)).alias(
                "your_value"
            ),
            F.round(F.lit(weight), 4).alias("model_importance"),
        )
        for rank, (feature, weight) in enumerate(ranked, start=1)
    ]
    return df.select(key, F.inline(F.array(*cells)))


