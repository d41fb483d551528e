"""Partial dependence, cross-validated scores, fit verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import STATISTICS, stats, time_series_cv
from ..operators.prepare import add_date_variables, process_date
from ..schema import TIME_VARS, col, finite
from .train import train_model, training_rows


def pdp(df: DataFrame, model, variables: list[str] | None = None, training_only: bool = True, grid_points: int = 50, quantiles: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """(variable, value, pdp_mean, pdp_std): all variables and grid points in one job.

    Grids lie between two quantiles of each variable (one aggregate); a flat variable has none. Each
    row meets the small table of grid points, is predicted with the variable set, and averaged.
    """
    rows = training_rows(df, not training_only)
    names = [v for v in (variables or model.features) if v in model.features and v not in model.levels]
    r = rows.agg(*(F.percentile(finite(v), [*quantiles]).alias(f"q{i}") for i, v in enumerate(names))).first()
    grid = []
    for i, v in enumerate(names):
        lo, hi = r[i] or (None, None)
        if lo is not None and hi > lo:
            grid += [(v, lo + (hi - lo) * k / (grid_points - 1)) for k in range(grid_points)]
    table = F.broadcast(df.sparkSession.createDataFrame(grid, "variable string, value double"))  # grid_points rows a variable
    x = rows.select(*map(col, model.features)).crossJoin(table)
    for v in names:
        x = x.withColumn(v, F.when(F.col("variable") == v, F.col("value")).otherwise(col(v)))
    return model.transform(x).groupBy("variable", "value").agg(F.avg("prediction").alias("pdp_mean"), F.stddev_samp("prediction").alias("pdp_std"))


#: Names of days and months in time order, as labels write them, whole or by three letters.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def axis_rank(c: Column) -> Column:
    """Order of PDP labels: numbers by value, then weekday and month names in time order, then text."""
    low = F.lower(c.cast("string"))
    ranks = {name: i for names in (WEEKDAYS, MONTHS) for i, n in enumerate(names) for name in (n, n[:3])}
    place = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    number = c.cast("string").try_cast("double")
    rank = F.try_element_at(place, low)
    return F.struct(F.when(number.isNotNull(), 0).when(rank.isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce(number, rank.cast("double"), F.lit(0.0)).alias("rank"), c.cast("string").alias("label"))


def cv_score(df: DataFrame, target: str, covariates: list[str], backend: str = "linear", n_splits: int = 5, gap: int = 0, test_size: int | None = None, max_train_size: int | None = None, config: dict | None = None, seed: int = 1) -> DataFrame:
    """Walk-forward scores of one fit a fold, with the folds' dates and sizes."""
    src = process_date(df)
    if set(covariates) & set(TIME_VARS):
        src = add_date_variables(src)
    folds = time_series_cv(src.select("date", *map(col, dict.fromkeys([target, *covariates]))), n_splits, gap, test_size, max_train_size).persist()
    try:
        meta = folds.groupBy("fold").agg(*(f.alias(n) for n, f in {"train_start": F.min(F.when(F.col("role") == "train", F.col("date"))), "train_end": F.max(F.when(F.col("role") == "train", F.col("date"))), "test_start": F.min(F.when(F.col("role") == "test", F.col("date"))), "test_end": F.max(F.when(F.col("role") == "test", F.col("date"))), "n_train": F.count_if(F.col("role") == "train"), "n_test": F.count_if(F.col("role") == "test")}.items()))
        scored = None
        for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):  # n_splits fits
            part = folds.where(F.col("fold") == f)
            model = train_model(part.where("role = 'train'"), target, covariates, backend, config, seed)
            one = model.transform(part.where("role = 'test'")).select("fold", "prediction", col(target).alias("value"))
            scored = one if scored is None else scored.unionByName(one)
        s = stats(scored, "prediction", "value", ["fold"], list(STATISTICS))
        return meta.join(s.withColumn("fold", F.col("fold").cast("int")), "fold").orderBy("fold")
    finally:
        folds.unpersist()


def verdict(c: Column, ok: float, warn: float) -> Column:
    """ok, warn or error by two limits of R2."""
    return F.when(c >= ok, "ok").when(c >= warn, "warn").otherwise("error")
