"""Model scores, one pass over the rows for any grouping, and other summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..functions.features import floor_date
from ..schema import col, finite, numeric_columns, ratio, season

STATISTICS = ("n", "FAC2", "MB", "MGE", "NMB", "NMGE", "RMSE", "r", "p_level", "COE", "IOA", "R2")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_cdf((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def p_stars(p: float | None) -> str | None:
    return None if p is None else "" if p >= 0.1 else "+" if p >= 0.05 else "*" if p >= 0.01 else "**" if p >= 0.001 else "***"


@F.udf(T.StringType())
def _p_level(r, n):  # on aggregated rows only
    return p_stars(correlation_p(r, n or 0))


def score_columns(mod: Column, obs: Column, mean: Column) -> dict[str, Column]:
    """Aggregates of all scores; ``mean`` is the group's mean observation, on every row."""
    ok = mod.isNotNull() & obs.isNotNull()
    m, o = F.when(ok, mod), F.when(ok, obs)
    d = m - o
    n = F.count(o)
    total, spread, miss = F.sum(o), F.sum(F.abs(o - mean)), F.sum(F.abs(d))
    q = m / F.when(o + 1e-9 != 0, o + 1e-9)
    r = F.when((n > 1) & (F.stddev_samp(m) > 0) & (F.stddev_samp(o) > 0), F.corr(m, o))
    rhs = 2 * spread
    return {
        "n": n,
        "FAC2": F.avg(F.when(q.isNotNull(), F.when(q.between(0.5, 2), 1.0).otherwise(0.0))),
        "MB": F.avg(d),
        "MGE": F.avg(F.abs(d)),
        "NMB": ratio(F.sum(d), total),
        "NMGE": ratio(miss, total),
        "RMSE": F.sqrt(F.avg(d * d)),
        "r": r,
        "COE": 1 - ratio(miss, spread),
        "IOA": F.when((rhs == 0) & (miss == 0), 1.0).when(miss <= rhs, 1 - ratio(miss, rhs)).otherwise(ratio(rhs, miss) - 1),
        "R2": r * r,
    }


def token_column(name: str, date: str = "date") -> Column:
    """A calendar token or a plain column."""
    d = col(date)
    tokens = {"season": lambda: season(F.month(d)), "month": lambda: F.month(d), "hour": lambda: F.hour(d), "weekday": lambda: F.weekday(d), "year": lambda: F.year(d), "day_of_year": lambda: F.dayofyear(d)}
    return tokens[name]() if name in tokens else col(name)


def stats(df: DataFrame, mod: str, obs: str, by: list[str] = (), statistic: list[str] = STATISTICS, include_all: bool = False, date: str = "date") -> DataFrame:
    """Scores of ``mod`` against ``obs``, for every group of ``by`` (columns or calendar tokens).

    ``include_all`` adds a row over everything, labelled "all". Groups come first, as strings. Two
    groupings are two aggregates of one narrow projection; the mean observation that some scores
    need is a first aggregate, joined on the group.
    """
    unknown = set(statistic) - set(STATISTICS)
    if unknown:
        raise DataError(f"unknown statistics {sorted(unknown)}")
    base = df.select(finite(mod).alias("__m"), finite(obs).alias("__o"), *(token_column(c, date).cast("string").alias(c) for c in by))

    def one(keys: list[str]) -> DataFrame:
        both = F.when(F.col("__m").isNotNull(), F.col("__o"))
        mean = base.groupBy(*map(col, keys)).agg(F.avg(both).alias("__mean"))
        if keys:
            joined = base.join(mean.withColumnsRenamed({c: f"__k_{c}" for c in keys}), [base[c].eqNullSafe(F.col(f"__k_{c}")) for c in keys])
        else:
            joined = base.crossJoin(F.broadcast(mean))  # one row
        a = score_columns(F.col("__m"), F.col("__o"), F.col("__mean"))
        return joined.groupBy(*map(col, keys)).agg(*(v.alias(k) for k, v in a.items()))

    out = one(list(by))
    if include_all and by:
        every = one([]).select(*(F.lit("all").alias(c) for c in by), "*")
        out = out.unionByName(every)
    if "p_level" in statistic:
        out = out.withColumn("p_level", _p_level("r", "n"))
    return out.select(*map(col, by), *statistic)


def mod_stats(df: DataFrame, model, subset: str | None = None, statistic: list[str] = STATISTICS) -> DataFrame:
    """Scores of a model's predictions, for every ``set`` and all rows, or one subset."""
    src = df.where(F.col("set") == subset) if subset else df
    return stats(model.transform(src), "prediction", "value", ["set"], statistic, include_all=subset is None)


def mod_stats_grouped(df: DataFrame, model=None, by: list[str] = ("season",), subset: str | None = None, predictor=None, statistic: list[str] = STATISTICS, include_all: bool = True) -> DataFrame:
    """Scores by calendar tokens or columns; ``predictor(model, df)`` may replace the model's own transform."""
    src = df.where(F.col("set") == subset) if subset else df
    scored = predictor(model, src) if predictor else model.transform(src)
    return stats(scored, "prediction", "value", list(by), statistic, include_all)


def resample_mean(df: DataFrame, unit: str, date: str = "date") -> DataFrame:
    """Means of all numeric columns by period, ignoring missing values, in time order."""
    numbers = [c for c in numeric_columns(df) if c != date]
    return df.groupBy(floor_date(col(date), unit).alias(date)).agg(*(F.avg(finite(c)).alias(c) for c in numbers)).orderBy(date)


POLAR = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "max": F.max, "min": F.min, "sd": F.stddev_samp, "sum": F.sum, "count": F.count}


def polar_bins(df: DataFrame, value: str, speed: str, direction: str, statistic: str = "mean", n_speed: int = 8, n_direction: int = 36) -> DataFrame:
    """A statistic by wind sector and speed class up to its 99th percentile; right-closed, lowest included."""
    x = df.select(finite(value).alias("x"), finite(speed).alias("ws"), F.pmod(finite(direction), F.lit(360.0)).alias("wd")).dropna()
    top = x.agg(F.percentile("ws", 0.99).alias("top"))
    agg = POLAR.get(statistic) or (lambda c: F.percentile(c, int(statistic[1:]) / 100) if statistic[:1] == "p" and statistic[1:].isdigit() else None)
    if agg(F.col("x")) is None:
        raise DataError(f"unknown statistic {statistic}")
    step = F.col("top") / n_speed
    wide = 360.0 / n_direction
    b = x.crossJoin(F.broadcast(top)).where("ws <= top").select("x", "top", F.greatest(F.ceil(F.col("ws") / step), F.lit(1)).cast("int").alias("i"), F.greatest(F.ceil(F.col("wd") / wide), F.lit(1)).cast("int").alias("k"))
    return b.groupBy("i", "k").agg(agg(F.col("x")).alias("statistic"), F.count("*").alias("n"), F.first("top").alias("top")).select(((F.col("k") - 0.5) * wide).alias("theta"), ((F.col("i") - 0.5) * F.col("top") / n_speed).alias("r"), "statistic", "n")


def ensemble(long: DataFrame, value: str, by: str = "date", weight: str | None = None, confidence: float = 0.95) -> DataFrame:
    """Row statistics across models, from the long form (date, model, value[, weight])."""
    a = (1 - confidence) / 2
    x = finite(value)
    out = {"mean": F.avg(x), "std": F.stddev_samp(x), "median": F.percentile(x, 0.5), "lower_bound": F.percentile(x, a), "upper_bound": F.percentile(x, 1 - a)}
    if weight:
        out["weighted"] = ratio(F.sum(x * col(weight)), F.sum(F.when(x.isNotNull(), col(weight))))
    return long.groupBy(col(by)).agg(*(c.alias(n) for n, c in out.items()))


def time_series_cv(df: DataFrame, n_splits: int = 5, gap: int = 0, test_size: int | None = None, max_train_size: int | None = None, date: str = "date") -> DataFrame:
    """Walk-forward folds: every row once for each fold and role (train, test) it has."""
    from .index import with_index

    n = df.count()
    size = test_size or max(1, n // (n_splits + 1))
    if n_splits * size + gap * n_splits >= n:
        raise DataError("too few rows for these folds")
    folds = []
    for f in range(1, n_splits + 1):
        end = n - (n_splits - f) * size
        start = end - size
        train_end = start - gap
        if train_end > 0:
            folds += [(f, "train", max(0, train_end - max_train_size) if max_train_size else 0, train_end), (f, "test", start, end)]
    table = df.sparkSession.createDataFrame(folds, "fold int, role string, lo long, hi long")
    i = with_index(df, [date], "__i", rows=n)
    return i.join(F.broadcast(table), (F.col("__i") >= F.col("lo")) & (F.col("__i") < F.col("hi"))).drop("__i", "lo", "hi")
