"""Training: linear by moments, boosted trees by random search, a race of several algorithms."""

from __future__ import annotations

import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError, ModelError, get_logger
from ..operators.prepare import prepare_data
from ..schema import TIME_VARS, col, finite, require_columns
from .base import LinearModel, MLModel, encoded

BACKENDS = ("linear", "gbt", "automl")


def training_rows(df: DataFrame, fit_on_all: bool = False) -> DataFrame:
    """Rows of the training set; a model never sees testing rows unless asked to."""
    return df.where(F.col("set") == "training") if "set" in df.columns and not fit_on_all else df


def levels_of(df: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """Sorted levels of the string features, in one pass."""
    texts = [f.name for f in df.schema.fields if f.name in features and isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    r = df.agg(*(F.array_sort(F.collect_set(col(t))).alias(f"l{i}") for i, t in enumerate(texts))).first()
    return {t: list(r[i]) for i, t in enumerate(texts)}


def fit_linear(df: DataFrame, target: str, features: list[str], ridge: float = 0.0) -> LinearModel:
    """Least squares from one aggregate of moments about the means; constant features get slope 0."""
    levels = levels_of(df, features)
    x = df.select(finite(target).alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(encoded(df, features, levels).values()))).where("y is not null")
    names = ["y", *(f"x{i}" for i in range(len(features)))]
    m = x.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names)).first()
    if not m.n:
        raise DataError("no rows to fit")
    dev = {c: F.col(c) - m[c] for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    s = x.agg(*(F.sum(dev[a] * dev[b]).alias(f"{a}_{b}") for a, b in pairs)).first()
    get = lambda a, b: s[f"{a}_{b}"] if (a, b) in set(pairs) else s[f"{b}_{a}"]
    xs = names[1:]
    scale = np.array([math.sqrt(max(get(a, a), 0.0)) for a in xs])
    ok = scale > 1e-12 * max(1.0, scale.max(initial=0.0))
    beta = np.zeros(len(xs))
    if ok.any():
        k = np.flatnonzero(ok)
        a = np.array([[get(xs[i], xs[j]) / scale[i] / scale[j] for j in k] for i in k]) + ridge * np.eye(len(k))
        b = np.array([get("y", xs[i]) / scale[i] for i in k])
        beta[k] = np.linalg.lstsq(a, b, rcond=1e-12)[0] / scale[k]
    slopes = dict(zip(features, map(float, beta), strict=True))
    return LinearModel(float(m.y - sum(beta[i] * m[c] for i, c in enumerate(xs))), slopes, levels)


def fold_column(df: DataFrame, folds: int) -> DataFrame:
    """Contiguous blocks by time: a quantile of ``date_unix``, found in one aggregate, not a sort."""
    if "date_unix" not in df.columns:
        return df.withColumn("__fold", F.pmod(F.xxhash64(*map(col, df.columns)), F.lit(folds)).cast("int"))
    cuts = df.agg(F.percentile_approx("date_unix", [i / folds for i in range(1, folds)], 10_000)).first()[0]
    fold = F.lit(0)
    for c in cuts or []:
        fold = fold + F.when(F.col("date_unix") > c, 1).otherwise(0)
    return df.withColumn("__fold", fold.cast("int"))


def _assembled(df: DataFrame, target: str, features: list[str], levels: dict[str, list[str]]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    names = [f"__f{i}" for i in range(len(features))]
    x = df.select(finite(target).alias("__y"), *(c.alias(n) for n, c in zip(names, encoded(df, features, levels).values(), strict=True)), *([F.col("__fold")] if "__fold" in df.columns else []))
    return VectorAssembler(inputCols=names, outputCol="__features").transform(x.where("__y is not null")).drop(*names)


def gbt_trials(n: int, n_features: int, n_trials: int, seed: int, max_iter: int) -> list[dict]:
    """Random settings; the range of leaves follows the number of rows, and depth the leaves."""
    rng = random.Random(seed)
    low, high = max(8, min(127, n // 20)), min(127, max(16, n // 3))
    out = []
    for _ in range(n_trials):
        leaves = rng.randint(min(low, high), max(low, high))
        out.append({"maxDepth": min(8, max(2, math.ceil(math.log2(leaves)))), "stepSize": rng.uniform(0.03, 0.3), "minInstancesPerNode": rng.choice([5, 10, 20, 30]), "subsamplingRate": rng.uniform(0.6, 1.0), "featureSubsetStrategy": str(round(rng.uniform(0.6, 1.0), 3)), "maxIter": max_iter})
    return out


def _cv_rmse(estimator, data: DataFrame, folds: int) -> float:
    from pyspark.ml.evaluation import RegressionEvaluator

    ev = RegressionEvaluator(labelCol="__y", metricName="rmse")
    scores = []
    for f in range(folds):
        train, test = data.where(F.col("__fold") != f), data.where(F.col("__fold") == f)
        if not test.isEmpty() and not train.isEmpty():
            scores.append(ev.evaluate(estimator.fit(train).transform(test)))
    return float(np.mean(scores)) if scores else math.inf


def fit_gbt(df: DataFrame, target: str, features: list[str], n_trials: int = 3, folds: int = 3, max_iter: int = 20, seed: int = 1, parallelism: int = 2) -> MLModel:
    """Boosted trees: random search by time-blocked cross-validation, then a fit on all training rows."""
    from pyspark.ml.regression import GBTRegressor

    levels = levels_of(df, features)
    data = _assembled(fold_column(df, folds), target, features, levels).persist()
    try:
        trials = gbt_trials(data.count(), len(features), n_trials, seed, max_iter)
        make = lambda p: GBTRegressor(featuresCol="__features", labelCol="__y", seed=seed, **p)
        if len(trials) == 1:
            best = trials[0]
        else:
            with ThreadPoolExecutor(parallelism) as pool:
                scores = list(pool.map(lambda p: _cv_rmse(make(p), data, folds), trials))
            best = trials[int(np.argmin(scores))]
        return MLModel(make(best).fit(data), list(features), levels, "gbt")
    finally:
        data.unpersist()


def race(df: DataFrame, target: str, features: list[str], include: tuple[str, ...] = ("gbt", "forest", "linear", "glm"), max_runtime_secs: float = 60, max_models: int = 4, folds: int = 3, seed: int = 1) -> tuple[MLModel | None, list[tuple[str, float]]]:
    """Algorithms by cross-validated RMSE within a budget; the leader is fitted on all rows."""
    from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor

    known = {
        "gbt": lambda: GBTRegressor(featuresCol="__features", labelCol="__y", maxIter=15, maxDepth=4, seed=seed),
        "forest": lambda: RandomForestRegressor(featuresCol="__features", labelCol="__y", numTrees=20, maxDepth=6, seed=seed),
        "linear": lambda: LinearRegression(featuresCol="__features", labelCol="__y", solver="normal"),
        "glm": lambda: GeneralizedLinearRegression(featuresCol="__features", labelCol="__y", regParam=0.1),
    }
    if set(include) - known.keys():
        raise ConfigError(f"unknown algorithms {sorted(set(include) - known.keys())}; known: {sorted(known)}")
    levels = levels_of(df, features)
    data = _assembled(fold_column(df, folds), target, features, levels).persist()
    try:
        n, spread = data.agg(F.count("*"), F.stddev_samp("__y")).first()
        if n < 5 or not spread:
            raise DataError("too few rows, or the target doesn't vary")
        board, began = [], time.time()
        for name in include[:max_models]:
            if board and time.time() - began > max_runtime_secs:
                get_logger("models").info("budget spent before %s", name)
                break
            try:
                board.append((name, _cv_rmse(known[name](), data, folds)))
            except Exception as e:  # a failed candidate leaves the race
                get_logger("models").warning("%s failed: %s", name, e)
        if not board:
            raise ModelError("no algorithm could be fitted")
        board.sort(key=lambda r: r[1])
        return MLModel(known[board[0][0]]().fit(data), list(features), levels, "automl"), board
    finally:
        data.unpersist()


def automl_leaderboard(df: DataFrame, target: str, features: list[str], **kw) -> DataFrame:
    """(model, rmse), the best first."""
    return df.sparkSession.createDataFrame(race(training_rows(df), target, features, **kw)[1], "model string, rmse double")


def train_model(df: DataFrame, target: str = "value", features: list[str] = (), backend: str = "linear", config: dict | None = None, seed: int = 1, fit_on_all: bool = False, cache=None):
    """A fitted model of one of BACKENDS; ``cache`` (see persistence.Cache) remembers it by the hash of its inputs."""
    features = list(features)
    if not features:
        raise ModelError("no features")
    require_columns(df, target, *features)
    if backend not in BACKENDS:
        raise ConfigError(f"unknown backend {backend}; known: {', '.join(BACKENDS)}")
    rows = training_rows(df, fit_on_all)
    key = None
    if cache is not None:
        from ..sources.persistence import config_hash, data_hash

        key = config_hash({"backend": backend, "target": target, "features": sorted(features), "config": config or {}, "seed": seed, "data": data_hash(rows.select(*map(col, [target, *features])))})
        if (hit := cache.load_model(key)) is not None:
            return hit
    config = dict(config or {})
    if backend == "linear":
        model = fit_linear(rows, target, features, **config)
    elif backend == "gbt":
        model = fit_gbt(rows, target, features, seed=seed, **config)
    else:
        model = race(rows, target, features, seed=seed, **config)[0]
    if cache is not None:
        cache.save_model(key, model)
    return model


def build_model(df: DataFrame, target: str, covariates: list[str], backend: str = "linear", split_method: str = "random", train_fraction: float = 0.75, config: dict | None = None, seed: int = 1, dropna: bool = True, **kw):
    """(prepared data, model); calendar covariates are made here, others must exist."""
    external = [c for c in covariates if c not in TIME_VARS]
    require_columns(df, *external)
    prepared = prepare_data(df, target, external, dropna, split_method, train_fraction, seed)
    return prepared, train_model(prepared, "value", list(covariates), backend, config, seed, **kw)
