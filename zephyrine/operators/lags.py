"""Autocorrelation, partial autocorrelation and cross-correlation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..schema import col, finite
from .index import with_index


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def acf(df: DataFrame, value: str, max_lag: int, date: str = "date") -> DataFrame:
    """(lag, acf): biased, missing pairs left out; one equi-join on the shifted row number."""
    x = with_index(df.select(col(date).alias("date"), finite(value).alias("x")), ["date"], "i")
    m = x.agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    c = x.crossJoin(F.broadcast(m)).select("i", (F.col("x") - F.col("m")).alias("x"), "n")  # one row
    pairs = c.select(F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "i", "x", "n").withColumn("j", F.col("i") - F.col("lag"))
    s = pairs.join(c.select(F.col("i").alias("j"), F.col("x").alias("y")), "j").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.first("n")).alias("s"))
    zero = s.where("lag = 0").select(F.col("s").alias("z"))
    return s.crossJoin(F.broadcast(zero)).select("lag", F.when(F.col("z") != 0, F.col("s") / F.col("z")).alias("acf")).orderBy("lag")  # one row


def ccf(df: DataFrame, driver: str, target: str, max_lag: int, date: str = "date") -> DataFrame:
    """(lag, ccf, n) at -L..L: correlation of the driver ``lag`` rows earlier with the target, from three pairs on."""
    x = with_index(df.select(col(date).alias("date"), finite(driver).alias("d"), finite(target).alias("t")), ["date"], "i")
    a = x.select(F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "i", "t").withColumn("j", F.col("i") - F.col("lag"))
    both = a.join(x.select(F.col("i").alias("j"), "d"), "j").where("d is not null and t is not null")
    ok = (F.count("*") >= 3) & (F.stddev_samp("d") > 0) & (F.stddev_samp("t") > 0)
    return both.groupBy("lag").agg(F.when(ok, F.corr("d", "t")).alias("ccf"), F.count("*").alias("n")).orderBy("lag")


def durbin_levinson(rho: list[float]) -> tuple[list[float], list[list[float]], list[float]]:
    """PACF, AR coefficients and innovation variance ratios of orders 1.. from the ACF (lag 0 first)."""
    pacf, coefs, var = [], [], [1.0]
    phi: list[float] = []
    for k in range(1, len(rho)):
        den = 1 - sum(p * rho[j + 1] for j, p in enumerate(phi))
        a = (rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(phi))) / den if abs(den) > 1e-12 else 0.0
        phi = [p - a * phi[len(phi) - 1 - j] for j, p in enumerate(phi)] + [a]
        pacf.append(a)
        coefs.append(list(phi))
        var.append(var[-1] * (1 - a * a))
    return pacf, coefs, var


def ar_order(rho: list[float], n: int) -> list[float]:
    """Yule-Walker coefficients of the order with the least AIC."""
    _, coefs, var = durbin_levinson(rho)
    best = min(range(len(var)), key=lambda p: n * math.log(max(var[p], 1e-300)) + 2 * p)
    return coefs[best - 1] if best else []


@dataclass
class LagDiagnostics:
    acf: DataFrame
    pacf: list[tuple[int, float]]
    ccf: DataFrame | None
    band: float
    target_ar_lags: list[int] = field(default_factory=list)
    driver_lags: list[int] = field(default_factory=list)
    peak_lag: int | None = None

    def summary(self) -> str:
        return f"target AR lags: {self.target_ar_lags}\ndriver lags: {self.driver_lags}\npeak lag: {self.peak_lag}\nband: {self.band:.4g}"


def analyze_lag(df: DataFrame, target: str, driver: str | None = None, max_lag: int = 24, date: str = "date", prewhiten: bool = True, max_ar: int = 10, alpha: float = 0.05) -> LagDiagnostics:
    """Which lags of target and driver matter; only correlations by lag reach the driver program."""
    if max_lag < 1:
        raise DataError("max_lag must be positive")
    n = df.where(finite(target).isNotNull()).count()
    nlags = min(max_lag, max(1, n - 2))
    a = acf(df, target, nlags, date)
    rho = [r.acf or 0.0 for r in a.collect()]
    pacf = list(enumerate(durbin_levinson(rho)[0], 1))
    band = normal_quantile(1 - alpha / 2) / math.sqrt(max(n, 1))
    out = LagDiagnostics(a, pacf, None, band, [k for k, v in pacf if abs(v) > band])
    if driver:
        src = df.select(col(date).alias("date"), finite(driver).alias("d"), finite(target).alias("t"))
        if prewhiten:
            drho = [r.acf or 0.0 for r in acf(src, "d", min(max_ar, nlags), "date").collect()]
            phi = ar_order(drho, n)
            if phi:
                i = with_index(src, ["date"], "i")
                mean = i.agg(F.avg("d").alias("md"), F.avg("t").alias("mt"))
                c = i.crossJoin(F.broadcast(mean)).select("i", "date", (F.col("d") - F.col("md")).alias("d"), (F.col("t") - F.col("mt")).alias("t"))  # one row
                terms = c.select(F.posexplode(F.array(*map(F.lit, [1.0, *(-p for p in phi)]))).alias("k", "w"), "i", "d", "t").select((F.col("i") + F.col("k")).alias("i"), (F.col("w") * F.col("d")).alias("d"), (F.col("w") * F.col("t")).alias("t"))
                f = terms.groupBy("i").agg(F.count("*").alias("m"), F.count("d").alias("md"), F.count("t").alias("mt"), F.sum("d").alias("d"), F.sum("t").alias("t")).where(F.col("m") == len(phi) + 1)
                whole = len(phi) + 1
                src = f.select(F.col("i").alias("date"), F.when(F.col("md") == whole, F.col("d")).alias("d"), F.when(F.col("mt") == whole, F.col("t")).alias("t"))
        out.ccf = ccf(src, "d", "t", nlags, "date")
        rows = [(r.lag, r.ccf) for r in out.ccf.collect() if r.lag >= 0 and r.ccf is not None]
        out.driver_lags = [k for k, v in rows if abs(v) > band]
        out.peak_lag = max(rows, key=lambda r: abs(r[1]))[0] if rows else None
    return out
