"""Preparation: date discovery, checks, imputation, calendar columns, train/test split."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..schema import TIME_VARS, col, require_columns
from .index import with_index

DATE_LIKE = r"^\d{4}[-/]\d{2}[-/]\d{2}"
DATE_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def to_time(c: Column) -> Column:
    """A timestamp from the usual spellings, NULL if it is none."""
    s = F.regexp_replace(c.cast("string"), "/", "-")
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def process_date(df: DataFrame, prefer: str | None = None) -> DataFrame:
    """``df`` with a timestamp column ``date``, found by name, type, or (one aggregate) by content."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(kinds.get("date"), DATE_TYPES):
        return df.withColumn("date", F.col("date").cast("timestamp"))
    typed = [n for n, t in kinds.items() if isinstance(t, DATE_TYPES)]
    pick = prefer if prefer in typed else typed[0] if typed else None
    if pick:
        return df.withColumn("date", col(pick).cast("timestamp"))
    texts = [n for n, t in kinds.items() if isinstance(t, T.StringType)]
    if texts:
        marks = []
        for i, n in enumerate(texts):
            marks += [F.first(col(n), ignorenulls=True).alias(f"f{i}"), F.avg(F.when(to_time(col(n)).isNull(), 1.0).otherwise(0.0)).alias(f"m{i}")]
        r = df.agg(*marks).first()
        for i, n in enumerate(texts):
            if r[f"f{i}"] is not None and re.search(DATE_LIKE, r[f"f{i}"]) and r[f"m{i}"] < 0.5:
                return df.withColumn("date", to_time(col(n)))
    raise DataError("no date column was found")


def check_data(df: DataFrame, target: str, covariates: list[str]) -> DataFrame:
    """Date, target (as ``value``) and covariates; no date may be missing."""
    keep = list(dict.fromkeys(["date", target, *covariates]))
    require_columns(df, *keep)
    out = df.select(*(col(c).alias("value" if c == target else c) for c in keep))
    if out.where("date is null").limit(1).count():
        raise DataError("a date is missing")
    return out


def mode_of(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row: the most frequent value, the earliest in ``order`` if several are; NULL if all are."""
    seen = df.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count("*").alias("n"), F.min(F.struct(*map(col, order))).alias("first"))
    return seen.orderBy(F.desc("n"), F.asc("first")).limit(1).select("v")


def impute(df: DataFrame, dropna: bool = False, order: list[str] | None = None) -> DataFrame:
    """Rows with missing values go, or numbers take the median and strings the mode."""
    if dropna:
        return df.dropna()
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    side = df.agg(*(F.percentile(F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")), 0.5).alias(f"__{c}") for c in numbers), F.count("*").alias("__n"))
    out = df.crossJoin(F.broadcast(side))  # one row
    for c in texts:
        m = mode_of(df, c, order or (["date"] if "date" in df.columns else [c]))
        out = out.crossJoin(F.broadcast(m.agg(F.first("v").alias(f"__{c}"))))
    for c in numbers:
        out = out.withColumn(c, F.coalesce(F.when(~F.isnan(col(c).cast("double")), col(c)), col(f"__{c}")))
    for c in texts:
        out = out.withColumn(c, F.coalesce(col(c), col(f"__{c}")))
    return out.select(*map(col, df.columns))


def add_date_variables(df: DataFrame) -> DataFrame:
    """Seconds since the epoch, day of year, weekday (0 = Monday) and hour, in UTC."""
    return df.withColumns({"date_unix": F.unix_timestamp("date").cast("double"), "day_julian": F.dayofyear("date"), "weekday": F.weekday("date"), "hour": F.hour("date")})


def portable_hash(a: Column, b: Column | int, seed: int) -> Column:
    """Three congruential rounds modulo 2**31 with shifts: the same in any SQL with 64-bit integers."""
    m = F.lit(2**31).cast("long")
    h = F.pmod(a.cast("long") * 1103515245 + (b if isinstance(b, Column) else F.lit(b)).cast("long") * 2654435761 + F.lit(seed * 69069 + 12345).cast("long"), m)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = F.pmod(h * 1103515245 + 12345, m)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = F.pmod(h * 1597334677 + 1013904223, m)
    return h.bitwiseXOR(F.shiftright(h, 16))


def portable_sql(a: str, b: str, seed: int) -> str:
    """The same in DuckDB."""
    h = f"(({a})*1103515245 + ({b})*2654435761 + {seed * 69069 + 12345}) % 2147483648"
    h = f"(select xor(y, y >> 16) from (select (xor(x, x >> 13)*1597334677 + 1013904223) % 2147483648 as y from (select (xor(h, h >> 15)*1103515245 + 12345) % 2147483648 as x from (select cast({h} as bigint) as h))))"
    return h


def split_sets(df: DataFrame, method: str = "random", train_fraction: float = 0.75, seed: int = 1) -> DataFrame:
    """``df`` with ``set``: training or testing.

    random: the rows with the smallest hash; ts: the first by date; month_ts and season_ts: in every
    month (meteorological season) one contiguous block of rows at a hashed place is for testing.
    """
    if method not in ("random", "ts", "month_ts", "season_ts"):
        raise DataError(f"unknown split method {method}")
    label = lambda train: F.when(train, "training").otherwise("testing")
    if method in ("random", "ts"):
        n = df.count()
        cut = int(train_fraction * n)
        i = with_index(df, ["date"], "__i", rows=n)
        if method == "ts":
            return i.withColumn("set", label(F.col("__i") < cut)).drop("__i")
        h = with_index(i.withColumn("__h", portable_hash(F.col("__i"), 0, seed)), ["__h", "__i"], "__k", rows=n)
        return h.withColumn("set", label(F.col("__k") < cut)).drop("__i", "__h", "__k")
    year, month = F.year("date"), F.month("date")
    if method == "month_ts":
        group = year * 100 + month
    else:  # December counts to the next year's winter
        group = (year + F.when(month == 12, 1).otherwise(0)) * 100 + F.floor(F.pmod(month, F.lit(12)) / 3)
    w = Window.partitionBy("__g")
    out = df.withColumn("__g", group.cast("long")).withColumn("__r", F.row_number().over(w.orderBy("date")) - 1).withColumn("__n", F.count("*").over(w))
    cut = F.floor(F.col("__n") * train_fraction)
    start = F.pmod(portable_hash(F.col("__g"), 1, seed), cut + 1)
    test = (F.col("__r") >= start) & (F.col("__r") < start + F.col("__n") - cut)
    return out.withColumn("set", label(~test)).drop("__g", "__r", "__n")


def prepare_data(df: DataFrame, target: str, covariates: list[str], dropna: bool = False, split_method: str = "random", train_fraction: float = 0.75, seed: int = 1) -> DataFrame:
    """Date, checks, imputation, calendar columns and split in one lazy plan."""
    out = check_data(process_date(df), target, [c for c in covariates if c not in TIME_VARS])
    return split_sets(add_date_variables(impute(out.where(F.col("value").isNotNull()) if dropna else out, dropna)), split_method, train_fraction, seed)


def conditional_filter(pool: DataFrame, conditions: dict[str, object | Callable[[Column], Column]]) -> DataFrame:
    """Rows of the pool that meet every condition: a callable on the column, a list (any of) or a value."""
    for name, want in conditions.items():
        require_columns(pool, name)
        c = col(name)
        pool = pool.where(want(c) if callable(want) else c.isin(list(want)) if isinstance(want, list | tuple | set) else c == want)
    if pool.isEmpty():
        raise DataError("no row meets the conditions")
    return pool


def sanitise_categories(df: DataFrame) -> DataFrame:
    """Missing strings become the category "Missing"."""
    return df.withColumns({f.name: F.coalesce(col(f.name), F.lit("Missing")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
