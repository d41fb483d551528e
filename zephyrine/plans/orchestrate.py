"""Pipelines: one model, an ensemble, many sites, workflows by name."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, get_logger
from ..models import build_model
from ..operators.metrics import ensemble, mod_stats
from ..schema import col
from .decompose import decompose
from .normalise import normalise, normalise_rolling


def do_all(df: DataFrame, target: str, covariates: list[str], backend: str = "linear", resample_vars: list[str] | None = None, n_samples: int = 300, seed: int = 1, pool: DataFrame | None = None, split_method: str = "random", train_fraction: float = 0.75, config: dict | None = None, **kw) -> dict:
    """{result, model, prepared}: prepare, train, normalise."""
    prepared, model = build_model(df, target, covariates, backend, split_method, train_fraction, config, seed)
    return {"result": normalise(prepared, model, resample_vars, n_samples, seed, pool, **kw), "model": model, "prepared": prepared}


def do_all_unc(df: DataFrame, target: str, covariates: list[str], n_models: int = 5, confidence: float = 0.95, weighted: str = "r2", seed: int = 1, parallelism: int = 2, **kw) -> dict:
    """An ensemble of models by seed: {result, mod_stats, runs}; the long form keeps every model's date.

    Weights come from each model's scores on testing rows: max(R2, 0), or 1 / RMSE; equal if all are 0.
    """
    if weighted not in ("r2", "rmse"):
        raise ConfigError("weighted is r2 or rmse")
    seeds = [seed + 1000 * i for i in range(n_models)]
    with ThreadPoolExecutor(parallelism) as pool:
        runs = list(pool.map(lambda s: do_all(df, target, covariates, seed=s, **kw), seeds))
    scores = reduce(DataFrame.unionByName, [mod_stats(r["prepared"], r["model"]).withColumn("seed", F.lit(s)) for s, r in zip(seeds, runs, strict=True)])
    raw = {r.seed: (max(r.R2 or 0.0, 0.0) if weighted == "r2" else 1 / ((r.RMSE or 0.0) + 1e-9)) for r in scores.where("set = 'testing'").collect()}  # a row a model
    total = sum(raw.values())
    share = {s: (raw.get(s, 0.0) / total if total > 0 else 1 / n_models) for s in seeds}
    long = reduce(DataFrame.unionByName, [r["result"].select("date", "observed", "normalised", F.lit(s).alias("seed"), F.lit(share[s]).alias("weight")) for s, r in zip(seeds, runs, strict=True)])
    obs = long.groupBy("date").agg(F.avg("observed").alias("observed"))
    table = df.sparkSession.createDataFrame(list(share.items()), "seed int, weight double")
    return {"result": obs.join(ensemble(long, "normalised", weight="weight", confidence=confidence), "date"), "mod_stats": scores.join(F.broadcast(table), "seed"), "runs": dict(zip(seeds, runs, strict=True))}


def multisite(df: DataFrame, site: str, func: Callable[[DataFrame], DataFrame | dict], parallelism: int = 2) -> tuple[DataFrame, dict]:
    """``func`` for every site, its results united with the site's name; failures and empty results are dropped.

    Returns the table and the registry of what every site's call returned. For functions on pandas
    tables use ``multisite_pandas``, which is one grouped map.
    """
    sites = sorted(r[0] for r in df.select(col(site)).distinct().collect() if r[0] is not None)

    def one(s):
        try:
            out = func(df.where(col(site) == s))
            return s, out
        except Exception as e:
            get_logger("multisite").warning("%s: %s", s, e)
            return s, None

    with ThreadPoolExecutor(parallelism) as pool:
        done = dict(pool.map(one, sites))
    tables = [(out["result"] if isinstance(out, dict) else out).withColumn(site, F.lit(s)) for s, out in done.items() if out is not None]
    if not tables:
        raise DataError("every site failed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), done


def multisite_pandas(df: DataFrame, site: str, func, schema: str) -> DataFrame:
    """``func(pandas) -> pandas`` by site, in one grouped map."""
    return df.groupBy(col(site)).applyInPandas(func, schema)


def do_all_multisite(df: DataFrame, site: str, **kw) -> tuple[DataFrame, dict]:
    out, done = multisite(df, site, lambda d: do_all(d, **kw))
    return out, {s: r["model"] for s, r in done.items() if r}


def decompose_multisite(df: DataFrame, site: str, target: str, covariates: list[str], method: str = "emission", backend: str = "linear", seed: int = 1, **kw) -> DataFrame:
    def one(d: DataFrame) -> DataFrame:
        prepared, model = build_model(d, target, covariates, backend, seed=seed)
        return decompose(prepared, model, method, seed=seed, **kw)

    return multisite(df, site, one)[0]


@dataclass
class SingleConfig:
    target: str
    covariates: list[str]
    backend: str = "linear"
    n_samples: int = 300
    seed: int = 1
    split_method: str = "random"
    train_fraction: float = 0.75
    resample_vars: list[str] | None = None
    config: dict = field(default_factory=dict)


@dataclass
class UncConfig(SingleConfig):
    n_models: int = 5
    confidence: float = 0.95
    weighted: str = "r2"


@dataclass
class RollingConfig(SingleConfig):
    window_days: int = 14
    every: int = 7


def _rolling(df: DataFrame, c: RollingConfig) -> dict:
    prepared, model = build_model(df, c.target, c.covariates, c.backend, c.split_method, c.train_fraction, c.config, c.seed)
    return {"result": normalise_rolling(prepared, model, c.resample_vars, None, c.n_samples, c.window_days, c.every, c.seed), "model": model, "prepared": prepared}


WORKFLOWS = {"single": lambda df, c: do_all(df, **asdict(c)), "unc": lambda df, c: do_all_unc(df, **asdict(c)), "rolling": _rolling}


def run_workflow(df: DataFrame, mode: str, config) -> dict:
    if mode not in WORKFLOWS:
        raise ConfigError(f"unknown workflow {mode}; known: {', '.join(WORKFLOWS)}")
    return WORKFLOWS[mode](df, config)
