"""Long panels: calendar, coverage, interpolation; difference in differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError, get_logger
from ..functions.features import floor_date
from ..schema import col, finite, ratio
from .events import interpolate

STEPS = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year", "H": "1 hour"}


@dataclass
class Panel:
    data: DataFrame
    coverage: DataFrame
    n_donors: int
    n_pre: int
    donor_ratio: float


def panel_means(df: DataFrame, date: str, unit: str, outcome: str, freq: str = "D") -> DataFrame:
    """(date, unit, outcome): mean by period and unit."""
    return df.groupBy(floor_date(col(date).cast("timestamp"), freq).cast("date").alias("date"), col(unit).alias("unit")).agg(F.avg(finite(outcome)).alias("outcome"))


def dense_grid(panel: DataFrame, freq: str = "D") -> DataFrame:
    """Every period for every unit, missing ones with NULL."""
    span = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {STEPS[freq]}"))).alias("date"))
    grid = panel.select("unit").distinct().crossJoin(F.broadcast(days))  # the calendar: bounded by the span of dates
    return grid.join(panel, ["date", "unit"], "left").select("date", "unit", "outcome")


def coverage(grid: DataFrame, cutoff) -> DataFrame:
    """(unit, pre, post): share of periods with a value."""
    have = F.when(F.col("outcome").isNotNull(), 1.0).otherwise(0.0)
    pre = F.col("date") < F.lit(cutoff).cast("date")
    return grid.groupBy("unit").agg(F.avg(F.when(pre, have)).alias("pre"), F.avg(F.when(~pre, have)).alias("post"))


def prepare_panel(df: DataFrame, date: str, unit: str, outcome: str, cutoff, treated, min_coverage: float = 0.65, date_from=None, date_to=None, freq: str = "D", max_donor_ratio: float = 0.3) -> Panel:
    """A complete panel of the treated unit and all donors with enough coverage before and after."""
    src = df
    if date_from is not None:
        src = src.where(col(date) >= F.lit(date_from))
    if date_to is not None:
        src = src.where(col(date) <= F.lit(date_to))
    # Small next to its source, and read by the checks, the calendar and the result: computed once.
    grid = dense_grid(panel_means(src, date, unit, outcome, freq).persist(), freq)
    cov = coverage(grid, cutoff)
    keep = cov.where(((F.col("pre") >= min_coverage) & (F.col("post") >= min_coverage)) | (F.col("unit") == F.lit(treated))).select("unit")
    full = interpolate(grid.join(keep, "unit", "left_semi"), "outcome", "unit").persist()
    bad = full.where("outcome is null").select("unit").distinct()
    if not bad.where(F.col("unit") == F.lit(treated)).isEmpty():
        raise DataError("the treated unit has no data")
    out = full.join(bad, "unit", "left_anti").select("date", "unit", "outcome")
    r = out.agg(F.count_distinct("unit").alias("u"), F.count_distinct(F.when(F.col("date") < F.lit(cutoff).cast("date"), F.col("date"))).alias("p")).first()
    donors = max(r.u - 1, 0)
    rate = donors / r.p if r.p else float("inf")
    if rate > max_donor_ratio:
        get_logger("panel").warning("%d donors for %d periods before the cutoff", donors, r.p)
    return Panel(out, cov, donors, r.p, rate)


def to_wide(panel: DataFrame, units: list[str], agg: str = "last") -> DataFrame:
    """One column a unit (named explicitly); a repeated cell takes its mean or last value."""
    f = F.avg("outcome") if agg == "mean" else F.last("outcome")
    return panel.groupBy("date").pivot("unit", units).agg(f)


def to_long(wide: DataFrame, units: list[str]) -> DataFrame:
    return wide.unpivot("date", units, "unit", "outcome")


def task_units(tasks: DataFrame) -> DataFrame:
    """(task, __tr, cutoff, unit): a row for each task's treated unit and donors, so that the panel meets its tasks in an equi-join."""
    units = F.array_distinct(F.concat(F.array("treated"), "donors"))
    return tasks.select("task", F.col("treated").alias("__tr"), "cutoff", F.explode(units).alias("unit"))


def pre_period_means(df: DataFrame, unit: str, covariates: list[str], cutoff, date: str = "date") -> DataFrame:
    """(unit, covariates): means by unit before the cutoff."""
    return df.where(col(date) < F.lit(cutoff).cast("date")).groupBy(col(unit).alias("unit")).agg(*(F.avg(finite(c)).alias(c) for c in covariates))


def panel_balance(df: DataFrame, date: str, unit: str, outcome: str, cutoff, max_missing: float = 10.0, min_pre: int = 10) -> DataFrame:
    """One row: units, dates, percentage of cells without a value, dates before the cutoff, and "ok" or "warn"."""
    cells = df.groupBy(col(date).cast("date").alias("date"), col(unit).alias("unit")).agg(F.avg(finite(outcome)).alias("x"))
    n = cells.agg(F.count_distinct("unit").alias("n_units"), F.count_distinct("date").alias("n_dates"), F.count("x").alias("have"), F.count_distinct(F.when(F.col("date") < F.lit(cutoff).cast("date"), F.col("date"))).alias("n_pre"))
    missing = F.lit(100.0) * (1 - ratio(F.col("have"), F.col("n_units") * F.col("n_dates")))
    return n.select("n_units", "n_dates", missing.alias("missing_percent"), "n_pre", F.when((missing > max_missing) | (F.col("n_pre") < min_pre), "warn").otherwise("ok").alias("verdict"))


def did_effects(panel: DataFrame, tasks: DataFrame) -> DataFrame:
    """Difference-in-differences path of every task: (task, treated, cutoff, donors array) -> (task, date, observed, synthetic, effect).

    Plain relational algebra: donors' mean by date, its and the treated unit's mean before the cutoff.
    """
    t = task_units(tasks).withColumn("__cut", F.col("cutoff").cast("date"))
    x = panel.join(t, "unit")
    mine = F.col("unit") == F.col("__tr")
    day = x.groupBy("task", "date", "__cut").agg(F.avg(F.when(mine, F.col("outcome"))).alias("observed"), F.avg(F.when(~mine, F.col("outcome"))).alias("d"))
    pre = day.where("date < __cut").groupBy("task").agg(F.avg("observed").alias("mt"), F.avg("d").alias("md"))
    s = F.col("mt") + F.col("d") - F.col("md")
    return day.join(pre, "task").select("task", "date", "observed", s.alias("synthetic"), (F.col("observed") - s).alias("effect"))
