"""Nod classifier over window features: a kernel machine, trained on some recordings and scored on others."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.permute import drawn
from .features import finite_columns, finite_rows
from .scoring import classification_report

WIDTH = 256  # random features


@dataclass
class NodModel:
    """Selected and standardised features, their random features, and the linear machine on those."""

    used: list[str]
    prepared: PipelineModel | None
    weights: np.ndarray
    shift: np.ndarray
    machine: LinearSVCModel | None = None
    constant: int | None = None  # the only label there was to learn


def random_features(vector: Column, weights: np.ndarray, shift: np.ndarray) -> Column:
    """Random Fourier features: their products are about the Gaussian kernel of the vectors (Rahimi and Recht)."""

    @F.pandas_udf("array<double>")
    def lifted(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        z = np.sqrt(2 / len(shift)) * np.cos(np.vstack(batch.to_numpy()) @ weights + shift)
        return pd.Series(list(z))

    return array_to_vector(lifted(vector_to_array(vector)))


def split_by_recording(windows: DataFrame, recording: str, fold: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation windows: about one recording in ``fold`` is kept unseen, always the whole of it."""
    number = F.crc32(F.coalesce(F.col(recording).cast("string"), F.lit("")))
    unseen = drawn(number, fold, seed) == 0
    return windows.filter(~unseen), windows.filter(unseen)


def train_nods(train: DataFrame, features: list[str], label: str = "label", keep: int = 12, seed: int = 0, width: int = WIDTH,
               rounds: int = 50) -> NodModel:
    """Fit the classifier: drop features with gaps, standardise, keep the telling ones, lift them, train.

    The Gaussian kernel's width is one over the number of kept features, which are standardised; the machine is linear in
    ``width`` random features, so it trains in passes over the windows whatever their number. Rare labels weigh more. From
    windows of one label a model learns to say that label, and without windows it says 0.
    """
    whole = finite_columns(train, features)
    shares = {row[label]: row["n"] for row in whole.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two labels
    used = [f for f in features if f in whole.columns]
    if len(shares) < 2:
        return NodModel(used, None, np.zeros((0, 0)), np.zeros(0), constant=int(next(iter(shares), 0)))
    kept = min(keep, len(used))
    selector = (UnivariateFeatureSelector(featuresCol="scaled", outputCol="kept", labelCol=label, selectionMode="numTopFeatures")
                .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(kept))
    steps = [VectorAssembler(inputCols=used, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), selector]
    prepared = Pipeline(stages=steps).fit(whole)
    r = np.random.default_rng(seed)
    model = NodModel(used, prepared, r.normal(scale=np.sqrt(2 / kept), size=(kept, width)), r.uniform(0, 2 * np.pi, width))
    lifted = _lifted(model, whole)
    total, weight = sum(shares.values()), F.lit(None).cast("double")
    for value, n in shares.items():
        weight = F.when(F.col(label) == value, total / (2.0 * n)).otherwise(weight)
    machine = LinearSVC(featuresCol="lifted", labelCol=label, weightCol="_weight", regParam=1e-3, maxIter=rounds)
    model.machine = machine.fit(lifted.withColumn("_weight", weight))
    return model


def _lifted(model: NodModel, windows: DataFrame) -> DataFrame:
    return model.prepared.transform(windows).withColumn("lifted", random_features(F.col("kept"), model.weights, model.shift))


def predict_nods(model: NodModel, windows: DataFrame) -> DataFrame:
    """Predicted 0/1 per window; windows with a gap in a used feature are left out."""
    whole = finite_rows(windows, model.used)
    if model.constant is not None:
        return whole.withColumn("pred", F.lit(model.constant).cast("long"))
    found = model.machine.transform(_lifted(model, whole))
    return found.withColumn("pred", F.col("prediction").cast("long")).drop("raw", "scaled", "kept", "lifted", "rawPrediction", "prediction")


def validated(windows: DataFrame, features: list[str], recording: str, label: str = "label", **settings) -> tuple[NodModel, DataFrame]:
    """A model trained on some recordings, and its report on the others."""
    seen, unseen = split_by_recording(windows, recording)
    model = train_nods(seen, features, label, **settings)
    return model, classification_report(predict_nods(model, unseen), label, "pred")
