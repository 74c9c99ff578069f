"""Saved model pipelines, and bundles of a model with what it expects."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.functions.labels import TIERS
from riskloom.sources.readers import MissingColumns, MissingInput
from riskloom.sources.sinks import delete_path, write_table

#: Changes when a bundle's layout does.
LAYOUT = 1


class WrongModel(ValueError):
    """A saved model does not fit its signature, or this code."""


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass(frozen=True)
class Signature:
    """Features in the order of the vector, classes in the order of their codes, and facts about the training."""

    features: list[str]
    classes: list[str] = field(default_factory=lambda: list(TIERS))
    facts: dict[str, str] = field(default_factory=dict)
    layout: int = LAYOUT

    def check_inputs(self, df: DataFrame) -> DataFrame:
        """``df``, if it has every feature as a number or as text."""
        readable = (T.NumericType, T.StringType, T.BooleanType)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        wrong = [f for f in self.features if not isinstance(kinds.get(f), readable)]
        if wrong:
            raise MissingColumns(f"the model needs these features as numbers: {', '.join(wrong)}")
        return df


def assembled_features(model: PipelineModel) -> list[str]:
    """The columns that a pipeline's vector is made of."""
    found = [list(s.getInputCols()) for s in model.stages if isinstance(s, VectorAssembler)]
    if len(found) != 1:
        raise WrongModel(f"a model has one vector assembler, this one has {len(found)}")
    return found[0]


def _check(model: PipelineModel, signature: Signature) -> None:
    if signature.layout != LAYOUT:
        raise WrongModel(f"the bundle has layout {signature.layout}, this code reads {LAYOUT}")
    if assembled_features(model) != signature.features:
        raise WrongModel(f"the vector holds {assembled_features(model)}, the signature says {signature.features}")
    if signature.classes != list(TIERS):
        raise WrongModel(f"the model's classes are {signature.classes}, this code decodes {list(TIERS)}")


def save_bundle(
    model: PipelineModel, path: str, features: Sequence[str], facts: Mapping[str, object] | None = None
) -> str:
    """Write the model with its signature. The signature goes first and comes back last, so half a bundle has none."""
    spark = SparkSession.getActiveSession()
    signature = Signature(list(features), facts={k: str(v) for k, v in (facts or {}).items()})
    _check(model, signature)
    delete_path(spark, f"{path}/signature")
    save_model(model, f"{path}/model")
    told = spark.createDataFrame([(json.dumps(asdict(signature)),)], "value string").coalesce(1)
    write_table(told, f"{path}/signature", fmt="text")
    return path


def load_signature(spark: SparkSession, path: str) -> Signature:
    try:
        lines = spark.read.text(f"{path}/signature").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"no complete model bundle at {path}") from error
        raise
    return Signature(**json.loads("".join(r[0] for r in lines)))


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, Signature]:
    """The model and its signature, once both are found to agree with each other and with this code."""
    signature = load_signature(spark, path)
    model = load_model(f"{path}/model")
    _check(model, signature)
    return model, signature
