"""Training frames: labels, leak-free features, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import encode_tier
from riskloom.operators.projecting import ensure_features
from riskloom.operators.sampling import mark_holdout, split_marked
from riskloom.schemas import MODEL_FEATURES, RULE_INPUTS
from riskloom.sources.readers import require_columns
from riskloom.sources.staging import stage

LABEL = "fraud_label"
TIER = "fraud_risk_category"


class LeakyFeature(ValueError):
    """A model feature is also an input of the rules that made the label."""


def require_safe_features(features: Sequence[str]) -> list[str]:
    leaks = [f for f in features if f in RULE_INPUTS]
    if leaks:
        raise LeakyFeature(f"rule inputs cannot be model features: {', '.join(leaks)}")
    return list(features)


def labelled(df: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Rows with a tier, its code as the label, and complete numeric features.

    Rows without a tier are left out; a tier that is not one of the three stops
    the job, where a silent default would teach the model a wrong class.
    """
    require_safe_features(features)
    require_columns(df, [TIER], "training")
    unknown = F.raise_error(F.concat(F.lit("unknown tier: "), F.col(TIER))).cast("int")
    tagged = df.filter(F.col(TIER).isNotNull()).withColumn(LABEL, F.coalesce(encode_tier(F.col(TIER)), unknown))
    return ensure_features(tagged, features)


def assembler(features: Sequence[str] = MODEL_FEATURES, output: str = "features") -> VectorAssembler:
    """Vectors in the order of ``features``; values must be complete, as ``labelled`` leaves them."""
    return VectorAssembler(inputCols=require_safe_features(features), outputCol=output, handleInvalid="error")


def staged_marked(
    scored: DataFrame, features: Sequence[str] = MODEL_FEATURES, test_size: float = 0.2
) -> DataFrame:
    """Labelled rows with ``is_holdout``, decided by prescriber, read from a stage table.

    Fitting passes over the training rows many times; from the stage table each
    pass reads files instead of repeating the joins before it.
    """
    return stage(mark_holdout(labelled(scored, features), "prescriber_id", test_size), "training")


def staged_split(
    scored: DataFrame, features: Sequence[str] = MODEL_FEATURES, test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) of ``staged_marked``; neither may be empty."""
    train, holdout = split_marked(staged_marked(scored, features, test_size))
    if train.isEmpty() or holdout.isEmpty():
        raise ValueError("one side of the split is empty: change test_size or check prescriber_id")
    return train, holdout
