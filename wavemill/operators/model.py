"""Window classifiers on Spark MLlib, in place of a neural network: the same contract
(fit on training windows, score windows), other scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_windows(train: DataFrame, features: Sequence[str] | str, kind: str = "logistic", weight: str | None = None, sampled: bool = False, seed: int = 42, iterations: int = 50) -> PipelineModel:
    """Fit on ``binary_label`` and feature columns, or one array column.  A class weight
    and dynamic sampling exclude each other."""
    if weight and sampled:
        raise ValueError("a class weight and dynamic sampling exclude each other")
    rows = train.where(F.col("binary_label").isNotNull()).withColumn("label", F.col("binary_label").cast("double"))
    stages: list = []
    if isinstance(features, str):
        rows = rows.withColumn("raw", array_to_vector(F.col(features)))
    else:
        stages.append(VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    extra = {"weightCol": weight} if weight else {}
    stages.append(LogisticRegression(maxIter=iterations, regParam=1e-4, **extra) if kind == "logistic" else GBTClassifier(maxIter=iterations, seed=seed, **extra))
    return Pipeline(stages=stages).fit(rows)


def score_windows(model: PipelineModel, windows: DataFrame, features: Sequence[str] | str, keys: Sequence[str]) -> DataFrame:
    """(keys, score): the probability of the positive class."""
    rows = windows.withColumn("raw", array_to_vector(F.col(features))) if isinstance(features, str) else windows
    return model.transform(rows).select(*keys, vector_to_array("probability")[1].alias("score"))


def train_history(model: PipelineModel) -> list[float]:
    """The objective after each iteration, where the classifier keeps it."""
    last = model.stages[-1]
    return list(last.summary.objectiveHistory) if getattr(last, "hasSummary", False) else []


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
