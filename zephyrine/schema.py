"""Column conventions, the one treatment of missing numbers, and data checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataError

TIME_VARS = ("date_unix", "day_julian", "weekday", "hour")
SEASONS = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column | str) -> Column:
    """The number, or NULL if it is NULL, NaN or infinite."""
    c = (col(c) if isinstance(c, str) else c).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.when(b != 0, b)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")


def require_not_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise DataError("no rows")


def require_no_missing(df: DataFrame, *names: str) -> None:
    """No NULL or NaN in the named columns; one pass for all."""
    require_columns(df, *names)
    kinds = dict(df.dtypes)
    bad = {n: F.count_if(col(n).isNull() | (F.isnan(col(n)) if kinds[n] in ("double", "float") else F.lit(False))) for n in names}
    r = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(bad.values()))).first()
    hit = [n for i, n in enumerate(bad) if r[i]]
    if hit:
        raise DataError(f"missing values in {', '.join(hit)}")


def require_no_duplicates(df: DataFrame, *names: str) -> None:
    require_columns(df, *names)
    if not df.groupBy(*map(col, names)).count().where("count > 1").isEmpty():
        raise DataError(f"duplicate rows for {', '.join(names)}")


def safe_name(name: str, taken: set[str] | None = None) -> str:
    """A name of letters, digits and underscores, not starting with a digit, unique among ``taken``."""
    out = re.sub("_+", "_", re.sub("[^A-Za-z0-9_]", "_", name)).strip("_") or "var"
    out = f"v_{out}" if out[0].isdigit() else out
    if taken is not None:
        base, k = out, 1
        while out in taken:
            out, k = f"{base}_{k}", k + 1
        taken.add(out)
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def quantile_name(q: float) -> str:
    if not 0 <= q <= 1:
        raise DataError(f"{q} isn't a probability")
    return f"q{round(q * 1000):03d}"


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def percent(x: str | float) -> float:
    """0.03 from "3%", or the number itself."""
    return float(x[:-1]) / 100 if isinstance(x, str) and x.endswith("%") else float(x)
