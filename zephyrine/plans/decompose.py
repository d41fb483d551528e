"""Decomposition: several normalisations that freeze one more variable each, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..models import extract_features
from ..schema import TIME_VARS, col
from .normalise import base_rows, indexed_pool, sampled, with_time_vars


def _states(df: DataFrame, model, frozen: dict[str, list[str]], pool: DataFrame | None, n_samples: int, seed: int, index: str) -> DataFrame:
    """date, observed, and the mean prediction of every state; all states share their draws."""
    df = with_time_vars(df, model.features)
    names = [f for f in model.features if any(f not in keep for keep in frozen.values())]
    p, m = indexed_pool(with_time_vars(df if pool is None else pool, names), names)
    x = sampled(base_rows(df, model), p, m, names, n_samples, seed, index, frozen)
    y = model.transform(x).groupBy("date").pivot("state", list(frozen)).agg(F.avg("prediction"))
    obs = df.groupBy("date").agg(F.avg("value").alias("observed"))
    return y.join(obs, "date")


def decompose_emission(df: DataFrame, model, pool: DataFrame | None = None, n_samples: int = 300, seed: int = 7_654_321, index: str = "portable") -> DataFrame:
    """(date, observed, time variables of the model..., emi_total, emi_base, emi_noise).

    Each state freezes one more time variable; a component is its state less the state before, so
    emi_total = emi_base + emi_noise + the components, exactly.
    """
    times = [t for t in TIME_VARS if t in model.features]
    frozen = {"base": []} | {t: times[: i + 1] for i, t in enumerate(times)}
    y = _states(df, model, frozen, pool, n_samples, seed, index)
    states = list(frozen)
    mean = y.agg(F.avg("base").alias("emi_base"))
    comps = [(F.col(b) - F.col(a)).alias(b) for a, b in zip(states, states[1:], strict=False)]
    out = y.crossJoin(F.broadcast(mean))  # one row
    return out.select("date", "observed", *comps, F.coalesce(F.col(states[-1]), F.col("observed")).alias("emi_total"), "emi_base", (F.col("base") - F.col("emi_base")).alias("emi_noise"))


def decompose_meteorology(df: DataFrame, model, pool: DataFrame | None = None, n_samples: int = 300, seed: int = 7_654_321, ascending: bool = False, variable_order: list[str] | None = None, index: str = "portable") -> DataFrame:
    """(date, observed, emi_total, drivers..., met_total, met_base, met_noise).

    observed = emi_total + met_base + the drivers' components + met_noise, exactly.
    """
    mets = [f for f in extract_features(model, True, ascending) if f not in TIME_VARS]
    if variable_order is not None:
        if sorted(variable_order) != sorted(mets):
            raise ConfigError("variable_order must be a permutation of the drivers")
        mets = list(variable_order)
    times = [t for t in TIME_VARS if t in model.features]
    frozen = {"emi_total": times} | {f"with_{v}": times + mets[: i + 1] for i, v in enumerate(mets)}
    y = _states(df, model, frozen, pool, n_samples, seed, index)
    states = list(frozen)
    comps = {v: F.col(b) - F.col(a) for v, a, b in zip(mets, states, states[1:], strict=False)}
    y = y.select("date", "observed", "emi_total", *(c.alias(v) for v, c in comps.items()), (F.col("observed") - F.col("emi_total")).alias("met_total"))
    out = y.crossJoin(F.broadcast(y.agg(F.avg("met_total").alias("met_base"))))  # one row
    total = F.col("met_base")
    for v in mets:
        total = total + col(v)
    return out.withColumn("met_noise", F.col("met_total") - total)


def decompose(df: DataFrame, model, method: str = "emission", **kw) -> DataFrame:
    if method == "emission":
        return decompose_emission(df, model, **kw)
    if method == "meteorology":
        return decompose_meteorology(df, model, **kw)
    raise ConfigError(f"unknown method {method}")


def contribution(a: DataFrame, b: DataFrame, name: str = "transport") -> DataFrame:
    """Difference of two normalised series, by date."""
    return a.select("date", F.col("normalised").alias("__a")).join(b.select("date", F.col("normalised").alias("__b")), "date").select("date", (F.col("__a") - F.col("__b")).alias(name))
