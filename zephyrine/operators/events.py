"""Anomaly scores, and events as runs of scores above a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..schema import col, finite


def iqr_scores(df: DataFrame, value: str) -> DataFrame:
    """``score`` = abs(x - median) / IQR; all 0 if the IQR is not positive."""
    q = df.agg(F.percentile(finite(value), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("__q"))
    iqr = F.col("__q")[2] - F.col("__q")[0]
    s = F.when(iqr > 0, F.abs(finite(value) - F.col("__q")[1]) / iqr).otherwise(F.when(finite(value).isNotNull(), 0.0))
    return df.crossJoin(F.broadcast(q)).withColumn("score", s).drop("__q")  # one row


def _latest(c, w):
    """The last known value up to a row. Frames that look ahead are read anew for each row, so the next value is the latest one of the reverse order."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def lagged_features(df: DataFrame, value: str, date: str = "date", lags: tuple[int, ...] = (1, 2, 3, 6, 12)) -> DataFrame:
    """x and its lags, filled forwards, then backwards, then with 0."""
    w = Window.partitionBy().orderBy(col(date))
    x = finite(value)
    out = df.withColumns({"x0": x, **{f"x{k}": F.lag(x, k).over(w) for k in lags}})
    back = Window.partitionBy().orderBy(F.desc(date))
    fill = lambda c: F.coalesce(_latest(c, w), _latest(c, back), F.lit(0.0))
    return out.withColumns({f"x{k}": fill(F.col(f"x{k}")) for k in (0, *lags)})


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_depths(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """Path lengths of ``rows`` in one isolation tree grown on ``sample``."""
    depth = np.zeros(len(rows))
    todo = [(sample, np.arange(len(rows)), 0)]
    while todo:
        s, r, d = todo.pop()
        if not len(r):
            continue
        lo, hi = (s.min(axis=0), s.max(axis=0)) if len(s) else (None, None)
        open_ = np.flatnonzero(hi > lo) if len(s) else []
        if len(s) <= 1 or d >= limit or not len(open_):
            depth[r] = d + _average_path(len(s))
            continue
        f = rng.choice(open_)
        cut = rng.uniform(lo[f], hi[f])
        left = rows[r, f] < cut
        todo += [(s[s[:, f] < cut], r[left], d + 1), (s[s[:, f] >= cut], r[~left], d + 1)]
    return depth


def isolation_scores(df: DataFrame, value: str, date: str = "date", trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """Isolation-forest score less 0.5: the forest is grown on a bounded sample and scores every row by batches."""
    feats = lagged_features(df, value, date)
    names = [c for c in feats.columns if c.startswith("x") and c[1:].isdigit()]
    grown = feats.orderBy(F.xxhash64(col(date), F.lit(seed))).limit(sample * 16).select(*names).toPandas().to_numpy(float)
    limit = int(np.ceil(np.log2(max(sample, 2))))
    norm = float(_average_path(min(sample, max(len(grown), 2)))) or 1.0
    plain = df.columns

    def run(batches):
        for pdf in batches:
            x, rng = pdf[names].to_numpy(float), np.random.default_rng(seed)
            total = np.zeros(len(x))
            for _ in range(trees):
                pick = grown[rng.choice(len(grown), min(sample, len(grown)), replace=False)]
                total += isolation_depths(pick, x, np.random.default_rng(rng.integers(2**31)), limit)
            yield pdf[plain].assign(score=2.0 ** (-total / trees / norm) - 0.5)

    return feats.select(*map(col, plain), *names).mapInPandas(run, df.withColumn("score", F.lit(0.0)).schema)


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, q: int, weight: np.ndarray) -> np.ndarray:
    """Local linear regression with tricube weights over the q nearest points."""
    out = np.empty(len(at))
    n = len(x)
    k = min(q, n)
    for i, t in enumerate(at):
        d = np.abs(x - t)
        near = np.argpartition(d, k - 1)[:k]
        h = max(d[near].max() * (1.0 if q <= n else q / n), 1e-12)
        w = weight[near] * (1 - np.minimum(d[near] / h, 1) ** 3) ** 3
        sw = w.sum()
        if sw <= 0:
            out[i] = y[near].mean()
            continue
        mx, my = (w * x[near]).sum() / sw, (w * y[near]).sum() / sw
        sxx = (w * (x[near] - mx) ** 2).sum()
        slope = (w * (x[near] - mx) * (y[near] - my)).sum() / sxx if sxx > 1e-12 else 0.0
        out[i] = my + slope * (t - mx)
    return out


def stl(y: np.ndarray, period: int, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal (periodic), trend and remainder; robust weights are the bisquare of the remainder."""
    n = len(y)
    x = np.arange(n, dtype=float)
    trend, weight = np.zeros(n), np.ones(n)
    span = int(1.5 * period) | 1
    for _ in range(6 if robust else 1):
        for _ in range(2):
            free = y - trend
            phase = np.arange(n) % period
            seasonal = np.array([np.average(free[phase == p], weights=np.maximum(weight[phase == p], 1e-6)) for p in range(min(period, n))])
            seasonal = (seasonal - seasonal.mean())[phase]
            step = max(1, n // 400)
            knots = np.unique(np.append(x[::step], x[-1]))
            trend = np.interp(x, knots, loess(x, y - seasonal, knots, span, weight))
        rest = y - seasonal - trend
        h = 6 * np.median(np.abs(rest))
        weight = (1 - np.minimum(np.abs(rest) / max(h, 1e-12), 1) ** 2) ** 2
    return seasonal, trend, rest


def stl_scores(df: DataFrame, value: str, date: str = "date", period: int = 24, group: str | None = None) -> DataFrame:
    """Residual of a robust periodic STL, over its IQR; one series, or one of each group, in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        y = pdf[value].to_numpy(float)
        ok = np.isfinite(y)
        score = np.full(len(y), np.nan)
        if ok.sum() >= 2 * period:
            r = stl(y[ok], period)[2]
            q1, q2, q3 = np.quantile(r, [0.25, 0.5, 0.75])
            score[ok] = np.abs(r - q2) / max(q3 - q1, 1e-12)
        return pdf.assign(score=score)

    keys = [col(group)] if group else [F.lit("all")]
    return df.groupBy(*keys).applyInPandas(one, df.withColumn("score", F.lit(0.0)).schema)


def anomaly_scores(df: DataFrame, value: str, method: str = "iqr", date: str = "date", **kw) -> DataFrame:
    if method == "iqr":
        return iqr_scores(df, value)
    if method == "isolation":
        return isolation_scores(df, value, date, **kw)
    if method == "stl_residual":
        return stl_scores(df, value, date, **kw)
    raise DataError(f"unknown method {method}")


def detect_events(df: DataFrame, value: str, method: str = "iqr", k: float | None = None, min_length: int = 1, date: str = "date", **kw) -> DataFrame:
    """Maximal runs of scores above k (3; isolation: 0): start, end, n, max_score, mean_score, strongest first."""
    limit = k if k is not None else 0.0 if method == "isolation" else 3.0
    w = Window.partitionBy().orderBy(col(date))
    s = anomaly_scores(df, value, method, date, **kw).select(col(date).alias("date"), "score").withColumn("__on", F.coalesce(F.col("score") > limit, F.lit(False)))
    runs = s.withColumn("__i", F.row_number().over(w)).withColumn("__k", F.col("__i") - F.row_number().over(Window.partitionBy("__on").orderBy("date"))).where("__on")
    out = runs.groupBy("__k").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
    return out.where(F.col("n") >= min_length).drop("__k").orderBy(F.desc("max_score"), "start")


def detect_cutoff(df: DataFrame, value: str, pick: str = "max", **kw):
    """Start of the strongest (or with pick="first" the earliest) event, or None."""
    r = detect_events(df, value, **kw).orderBy(*([F.desc("max_score"), "start"] if pick == "max" else ["start"])).limit(1).collect()
    return r[0]["start"] if r else None


def interpolate(df: DataFrame, value: str, group: str, date: str = "date") -> DataFrame:
    """Linear by position between known values, the ends carried outwards."""
    w = Window.partitionBy(col(group)).orderBy(col(date))
    x = finite(value)
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(x.isNotNull(), F.struct(F.col("__i").alias("i"), x.alias("v"))))
    df = df.withColumns({"__p": _latest("__v", w), "__n": _latest("__v", Window.partitionBy(col(group)).orderBy(F.desc("__i")))})
    p, n = F.col("__p"), F.col("__n")
    line = p.v + (n.v - p.v) * (F.col("__i") - p.i) / F.when(n.i != p.i, n.i - p.i)
    return df.withColumn(value, F.coalesce(x, line, p.v, n.v)).drop("__i", "__v", "__p", "__n")


def locf(df: DataFrame, value: str, date: str = "date", group: str | None = None) -> DataFrame:
    """The last known value carried forwards, then the first one backwards."""
    w = Window.partitionBy(col(group)) if group else Window.partitionBy()
    x = finite(value)
    return df.withColumn(value, F.coalesce(_latest(x, w.orderBy(col(date))), _latest(x, w.orderBy(F.desc(date)))))
