"""Joins of time series: nearest in time, rounded time, outer merges, nearest place, interval overlap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import in_region
from ..schema import col, finite


def rounded_time(c: Column, seconds: int) -> Column:
    """Time rounded to a multiple of ``seconds``, halves to even; in whole microseconds, so that a fraction past the half counts."""
    t, step = F.unix_micros(c.cast("timestamp")), F.lit(seconds * 1_000_000)
    over = F.pmod(t, step)
    low = t - over
    up = (over * 2 > step) | ((over * 2 == step) & (F.pmod(low, step * 2) != 0))
    return F.timestamp_micros(F.when(up, low + step).otherwise(low))


def rounded_time_join(left: DataFrame, right: DataFrame, seconds: int, date: str = "date", by: list[str] | None = None) -> DataFrame:
    """Rows of two tables that agree in the rounded time (and ``by``): the key as ``date``, then the other columns of both."""
    slot = lambda df: df.withColumn(date, rounded_time(col(date), seconds))
    return slot(left).join(slot(right), [date, *(by or [])])


def asof_nearest(left: DataFrame, right: DataFrame, date: str = "date", by: str | None = None, columns: list[str] | None = None, tolerance: str | None = None) -> DataFrame:
    """Every left row with the right row nearest in time, the earlier one on a tie.

    One union, sorted by time: two windows carry the last and the next right row. The rows are
    shuffled once by ``by`` (without it the series is one by definition), and no pairs are made.
    Left rows of a group without right rows keep NULLs.
    """
    columns = columns or [c for c in right.columns if c not in (date, by)]
    keys = [by] if by else []
    l = left.withColumn("__side", F.lit(1)).withColumn("__t", col(date)).withColumn("__r", F.lit(None).cast(right.select(F.struct(col(date).alias("__d"), *map(col, columns))).schema[0].dataType))
    r = right.select(*map(col, keys), F.lit(0).alias("__side"), col(date).alias("__t"), F.struct(col(date).alias("__d"), *map(col, columns)).alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*map(col, keys)).orderBy("__t", "__side")
    prev = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards in time the next row is the last one seen; a frame that looks ahead would be read anew for each row.
    back = Window.partitionBy(*map(col, keys)).orderBy(F.desc("__t"), F.desc("__side"))
    nxt = F.last("__r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    m = both.withColumns({"__p": prev, "__n": nxt}).where("__side = 1")
    gap = lambda c: F.abs(F.col("__t").cast("double") - F.col(f"{c}.__d").cast("double"))
    pick = F.when(F.col("__n").isNull() | (gap("__p") <= gap("__n")), F.col("__p")).otherwise(F.col("__n"))
    m = m.withColumn("__x", pick)
    if tolerance:
        m = m.withColumn("__x", F.when(F.abs(F.col("__t").cast("double") - F.col("__x.__d").cast("double")) <= F.expr(f"unix_timestamp(timestamp '1970-01-01 00:00:00' + interval {tolerance})"), F.col("__x")))
    return m.select(*map(col, left.columns), *(F.col("__x").getField(c).alias(c) for c in columns))


def merge_outer(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of several tables."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def fetch_merge(measurements: DataFrame, meteorology: DataFrame, site: str | None = None, floor: float = -50.0, pollutants: list[str] | None = None) -> DataFrame:
    """Long measurements without sentinels, means by date, one column a pollutant, meteorology joined left."""
    ok = measurements.where(F.col("value") > floor)
    names = pollutants or sorted(r[0] for r in ok.select("pollutant").distinct().collect())
    wide = ok.groupBy("date").pivot("pollutant", names).agg(F.avg("value"))
    out = wide.join(meteorology, "date", "left")
    return (out.withColumn("site", F.lit(site)) if site else out).orderBy("date")


def match_or_nearest(left: DataFrame, right: DataFrame, name: str, lat: str = "lat", lon: str = "lon", code: str = "code", within: float = 0.02) -> DataFrame:
    """A code by trimmed lower-case name, else by the nearest place closer than ``within`` degrees.

    Distances count to nine digits, the smallest code wins a tie. Rows at the same coordinates are one place, on either side.
    """
    key = lambda c: F.lower(F.trim(col(c)))
    named = right.select(key(name).alias("__k"), col(code).alias("__c1")).groupBy("__k").agg(F.min("__c1").alias("__c1"))
    l = left.withColumns({"__k": key(name), "__la": finite(lat), "__lo": finite(lon)}).join(named, "__k", "left")
    probe = l.where("__c1 is null and __la is not null and __lo is not null").select(F.col("__la").alias("la"), F.col("__lo").alias("lo")).distinct()
    spot = right.select(finite(lat).alias("x"), finite(lon).alias("y"), col(code).alias("c")).where("x is not null and y is not null").groupBy("x", "y").agg(F.min("c").alias("c"))
    best = nearest_place(probe, spot, within).withColumnsRenamed({"la": "__la", "lo": "__lo", "c": "__c2"})
    return l.join(best, ["__la", "__lo"], "left").select(*map(col, left.columns), F.coalesce("__c1", "__c2").alias(code))


def nearest_place(probe: DataFrame, spot: DataFrame, within: float, fill: int = 64) -> DataFrame:
    """For distinct ``la, lo`` the ``c`` of the nearest of distinct ``x, y``, where one is closer than ``within``.

    Spots are dealt to cells of that width; only neighbouring cells meet. While a cell holds more than ``fill`` spots
    (counted), all are halved, and a probe follows only the halves that may hold its nearest spot, so that the pairs grow
    with the probes, not with the spots around them.
    """
    width, slack = within * (1 + 1e-9), 2e-9
    cell = lambda c, k: F.floor(F.col(c) / (width / 2**k))
    dealt = lambda k: spot.withColumns({"a": cell("x", k), "b": cell("y", k)})
    k = 0
    while k < 20 and (n := dealt(k).groupBy("a", "b").count().agg(F.max("count")).first()[0] or 0) > fill:
        k += math.ceil(math.log(n / fill, 4))
    near = F.array(*(F.struct((cell("la", 0) + i).alias("a"), (cell("lo", 0) + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    open_ = probe.select("la", "lo", F.inline(near))
    for i in range(1, k + 1):
        w = width / 2**i
        half = dealt(i).select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b"), F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        short = lambda p, q: F.greatest(F.col(q) * w - F.col(p), F.col(p) - (F.col(q) + 1) * w, F.lit(0.0))  # noqa: B023, E731
        far = lambda p, q: F.greatest(F.col(p) - F.col(q) * w, (F.col(q) + 1) * w - F.col(p))  # noqa: B023, E731
        open_ = open_.join(half, ["a", "b"]).withColumns({"low": F.hypot(short("la", "u"), short("lo", "v")), "high": F.hypot(far("la", "u"), far("lo", "v"))}).where(F.col("low") < within + slack)
        open_ = open_.withColumn("bound", F.min("high").over(Window.partitionBy("la", "lo"))).where(F.col("low") <= F.col("bound") + slack).select("la", "lo", F.col("u").alias("a"), F.col("v").alias("b"))
    d = F.sqrt(F.pow(F.col("la") - F.col("x"), 2) + F.pow(F.col("lo") - F.col("y"), 2))
    pairs = open_.join(dealt(k), ["a", "b"]).withColumn("d", d).where(F.col("d") < within)
    return pairs.groupBy("la", "lo").agg(F.min_by("c", F.struct(F.round("d", 9), "c")).alias("c"))


def points_in_regions(points: DataFrame, regions: dict[str, object], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """A boolean column for each region."""
    return points.withColumns({f"in_{n}": in_region(col(lon), col(lat), r) for n, r in regions.items()})


def overlapping(left: DataFrame, start: str, end: str, lo, hi) -> DataFrame:
    """Rows whose interval [start, end] meets [lo, hi]."""
    return left.where((col(start) <= F.lit(hi)) & (col(end) >= F.lit(lo)))


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row for each key: the first or last in ``order``; an aggregate, not a sort."""
    s = F.struct(*map(col, order), *(col(c) for c in df.columns if c not in order))
    pick = (F.max if keep == "last" else F.min)(s).alias("__s")
    return df.groupBy(*(col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(pick).select(*(F.col("__s").getField(c).alias(c) for c in df.columns))


def union_fill(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
