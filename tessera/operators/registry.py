"""Models by name, loaded once a worker, and a store of the features they give."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import match
from tessera.functions.shared import materialise
from tessera.sources import snapshots


@dataclass(frozen=True)
class Model:
    """``loader(path)`` gives a function from n x ``dim`` numbers (or, for a store, a list of contents) to n results."""

    key: str
    loader: Callable[[str], Callable]
    path: str
    dim: int


class Registry:
    """Models by key; keys are used once."""

    def __init__(self, models: Sequence[Model] = ()):
        self._models: dict[str, Model] = {}
        for model in models:
            self.register(model)

    def register(self, model: Model) -> None:
        if model.key in self._models:
            raise ValueError(f"there is a model {model.key} already")
        if model.dim < 1:
            raise ValueError(f"{model.key} needs a dimension")
        self._models[model.key] = model

    def __getitem__(self, key: str) -> Model:
        if key not in self._models:
            raise KeyError(f"no model {key}; there are {', '.join(sorted(self._models)) or 'none'}")
        return self._models[key]

    def __iter__(self) -> Iterator[Model]:
        return iter(self._models.values())


def _predictor(model: Model):
    def make():
        predict = model.loader(model.path)  # once a Python worker

        def run(x: np.ndarray) -> np.ndarray:
            out = np.asarray(predict(x), dtype=float)
            if out.shape != (len(x),):
                raise ValueError(f"{model.key} gave {out.shape} for {len(x)} rows")
            return out

        return run

    return make


def _checked(features: Column, model: Model) -> Column:
    """The features as doubles, zeros for null; raises where a row has another dimension."""
    wrong = F.raise_error(F.concat(F.lit(f"{model.key} takes {model.dim} features, a row has "), F.size(features).cast("string")))
    zeros = F.array_repeat(F.lit(0.0), model.dim)
    return F.when(features.isNull(), zeros).when(F.size(features) == model.dim, features.cast("array<double>")).otherwise(wrong.cast("array<double>"))


def score_models(df: DataFrame, models: Sequence[Model], features: str, batch: int = 1024) -> DataFrame:
    """``df`` with prob_<key> of each model, in one pass over the rows; null features give null.

    A row with another number of features than a model takes is an error, as in a model's own input check. Nulls within features
    are for the model to take; they reach it as NaN.
    """
    out = df
    for model in models:
        score = predict_batch_udf(_predictor(model), return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[model.dim]])
        values = F.transform(_checked(F.col(features), model), lambda v: F.coalesce(v, F.lit(float("nan"))))
        out = out.withColumn(f"prob_{model.key}", F.when(F.col(features).isNotNull(), score(values)))
    return out


STORED = "model string, address string, features array<float>"


def _compute(contents: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = None
        for batch in batches:
            if not len(batch):
                continue
            features = features or model.loader(model.path)
            found = np.asarray(features(batch["content"].tolist()), dtype=np.float32)
            if found.shape != (len(batch), model.dim):
                raise ValueError(f"{model.key} gave {found.shape}, not {(len(batch), model.dim)}")
            yield pd.DataFrame({"model": model.key, "address": batch["address"], "features": list(found)})

    return contents.select("address", "content").mapInPandas(run, STORED)


def stored_features(df: DataFrame, model: Model, folder: str, content: str) -> DataFrame:
    """``df`` with address (SHA-256 of the content) and features, computed only for contents that the store ``folder`` lacks.

    The store is a versioned table keyed by model and address, so equal contents are computed once, several runs may write
    to it, and a failed run leaves nothing. Null contents have null features. Features of the model that have another
    dimension than it says raise ValueError.
    """
    spark = df.sparkSession
    rows = df.withColumn("address", F.sha2(F.col(content).cast("binary"), 256))
    wanted = rows.filter("address IS NOT NULL").select("address", F.col(content).alias("content"))
    known = _of_model(spark, folder, model)
    if known is not None:
        wrong = known.filter(F.size("features") != model.dim).select(F.size("features").alias("n")).first()
        if wrong:
            raise ValueError(f"{folder} holds features of {model.key} with dimension {wrong['n']}, not {model.dim}")
        wanted = wanted.join(known.select("address"), "address", "left_anti")
    wanted = wanted.dropDuplicates(["address"])
    if not wanted.isEmpty():
        snapshots.commit(materialise(_compute(wanted, model)), folder, ["model", "address"], partition_by=["model"])
    known = _of_model(spark, folder, model)
    known = spark.createDataFrame([], STORED) if known is None else known
    return rows.join(known.select("address", "features"), "address", "left")


def _of_model(spark: SparkSession, folder: str, model: Model) -> DataFrame | None:
    if snapshots.version(spark, folder) is None:
        return None
    return snapshots.read(spark, folder).filter(F.col("model") == model.key)


def aligned_features(features: DataFrame, manifest: DataFrame, key: Sequence[str], dim: int, column: str = "features") -> DataFrame:
    """``manifest`` with the features of its keys; ValueError unless each key has exactly one row of ``dim`` features, and no other has.

    Rows are brought together by key, never by position.
    """
    kind = features.schema[column].dataType if column in features.columns else None
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{column} is not an array of floats")
    key = list(key)
    sides = features.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.size(column) != dim, F.lit(True))).alias("_odd")).withColumn("_own", F.lit(0))
    asked = manifest.select(*key).distinct().select(*key, F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_odd"), F.lit(1).alias("_own"))
    each = sides.unionByName(asked).groupBy(*key).agg(F.sum("_n").alias("n"), F.sum("_odd").alias("odd"), F.max("_own").alias("own"))
    found = each.agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("own") == 0).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("odd") > 0).alias("odd")).first()
    if any(found):
        raise ValueError(f"keys without features {found['missing']}, features without key {found['unknown']}, repeated {found['repeated']}, of another dimension {found['odd']}")
    return match(manifest, features.select(*key, column), key)
