"""Models: a linear one that is a plain column expression, Spark ML pipelines, and any Python object."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, ModelError
from ..schema import col, finite, require_columns


def encoded(df: DataFrame, features: list[str], levels: dict[str, list[str]]) -> dict[str, Column]:
    """Numbers for all features: strings by the place of their level, else 0 for what is missing."""
    out = {}
    for f in features:
        if f in levels:
            m = F.create_map(*[F.lit(x) for i, v in enumerate(levels[f]) for x in (v, float(i))])
            out[f] = F.coalesce(F.try_element_at(m, col(f).cast("string")), F.lit(0.0)) if levels[f] else F.lit(0.0)
        else:
            out[f] = F.coalesce(finite(f), F.lit(0.0))
    return out


@dataclass
class LinearModel:
    """Intercept and slopes; predictions stay inside code generation."""

    intercept: float
    slopes: dict[str, float]
    levels: dict[str, list[str]] = field(default_factory=dict)
    backend: str = "linear"

    @property
    def features(self) -> list[str]:
        return list(self.slopes)

    def column(self, df: DataFrame) -> Column:
        e = encoded(df, self.features, self.levels)
        out = F.lit(float(self.intercept))
        for f, b in self.slopes.items():
            out = out + e[f] * float(b)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, *self.features)
        return df.withColumn("prediction", self.column(df))

    def importances(self) -> dict[str, float]:
        return {f: abs(b) for f, b in self.slopes.items()}


@dataclass
class MLModel:
    """A fitted Spark ML regressor over an assembled vector."""

    stage: object
    features: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    backend: str = "gbt"

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        require_columns(df, *self.features)
        e = encoded(df, self.features, self.levels)
        names = [f"__f{i}" for i in range(len(self.features))]
        x = df.withColumns(dict(zip(names, e.values(), strict=True)))
        v = VectorAssembler(inputCols=names, outputCol="__features").transform(x)
        out = self.stage.transform(v) if "prediction" not in df.columns else self.stage.transform(v.drop("prediction"))
        return out.drop("__features", *names)

    def importances(self) -> dict[str, float]:
        s = self.stage
        raw = s.featureImportances.toArray() if hasattr(s, "featureImportances") else np.abs(s.coefficients.toArray())
        return dict(zip(self.features, map(float, raw), strict=True))


@dataclass
class PythonModel:
    """Any object with ``predict(matrix)``, run on Arrow batches."""

    model: object
    features: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    backend: str = "python"

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, *self.features)
        e = encoded(df, self.features, self.levels)
        plain, names, model = df.columns, [f"__f{i}" for i in range(len(self.features))], self.model

        def run(batches):
            for pdf in batches:
                yield pdf[plain].assign(prediction=np.asarray(model.predict(pdf[names].to_numpy(float)), float))

        x = df.withColumns(dict(zip(names, e.values(), strict=True)))
        return x.mapInPandas(run, df.withColumn("prediction", F.lit(0.0)).schema)

    def importances(self) -> dict[str, float]:
        raw = getattr(self.model, "feature_importances_", None)
        return dict.fromkeys(self.features, 0.0) if raw is None else dict(zip(self.features, map(float, raw), strict=True))


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``."""
    if not hasattr(model, "transform"):
        raise ModelError(f"{type(model).__name__} isn't a model")
    return model.transform(df)


def detect_backend(model) -> str:
    if not hasattr(model, "backend"):
        raise ModelError("the model names no backend")
    return model.backend


def extract_features(model, by_importance: bool = False, ascending: bool = False) -> list[str]:
    if not by_importance:
        return list(model.features)
    imp = model.importances()
    return sorted(model.features, key=lambda f: (imp[f] if ascending else -imp[f], f))


def feature_importance(spark: SparkSession, model) -> DataFrame:
    """(variable, scaled_importance, percentage), the largest first."""
    imp = model.importances()
    top, total = max(imp.values(), default=0.0) or 1.0, sum(imp.values()) or 1.0
    rows = sorted(((f, v / top, v / total) for f, v in imp.items()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "variable string, scaled_importance double, percentage double")


def describe(model) -> dict:
    out = {"backend": model.backend, "features": model.features, "levels": model.levels}
    if isinstance(model, LinearModel):
        out |= {"intercept": model.intercept, "slopes": model.slopes}
    elif isinstance(model, MLModel):
        s = model.stage
        out["fit"] = s.toDebugString if hasattr(s, "toDebugString") else [float(s.intercept), *map(float, s.coefficients)]
    else:
        out["fit"] = repr(model.model)
    return out


def model_hash(model) -> str:
    return hashlib.sha1(json.dumps(describe(model), sort_keys=True).encode()).hexdigest()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def save_model(model, path: str, name: str = "model") -> str:
    """Write to any store Spark reaches; the metadata as JSON, an ML stage in its own format."""
    spark = SparkSession.active()
    at = os.path.join(path, name)
    meta = {"backend": model.backend, "features": model.features, "levels": model.levels, "class": type(model).__name__}
    if isinstance(model, LinearModel):
        meta |= {"intercept": model.intercept, "slopes": model.slopes}
    elif isinstance(model, MLModel):
        meta["stage"] = f"{type(model.stage).__module__}:{type(model.stage).__name__}"
        model.stage.write().overwrite().save(f"{at}/stage")
    else:
        raise ModelError("this backend's models can't be saved")
    _write_text(spark, f"{at}/meta", json.dumps(meta))
    return at


def load_model(path: str, name: str = "model"):
    import importlib

    spark = SparkSession.active()
    at = os.path.join(path, name)
    meta = json.loads(_read_text(spark, f"{at}/meta"))
    if meta["class"] == "LinearModel":
        return LinearModel(meta["intercept"], meta["slopes"], meta["levels"], meta["backend"])
    module, cls = meta["stage"].split(":")
    if not module.startswith("pyspark.ml."):
        raise ConfigError(f"unknown stage {module}")
    stage = getattr(importlib.import_module(module), cls).load(f"{at}/stage")
    return MLModel(stage, meta["features"], meta["levels"], meta["backend"])
