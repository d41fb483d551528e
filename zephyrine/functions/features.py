"""Feature columns: cyclical, wind, lags, rolling windows, units, geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..schema import col, finite

EARTH_KM = 6371.0


def cyclical_encode(df: DataFrame, column: str, period: float, drop: bool = False, prefix: str | None = None) -> DataFrame:
    """``<base>_sin`` and ``<base>_cos`` of 2 pi x / period."""
    if period <= 0:
        raise DataError("the period must be positive")
    angle, base = col(column) * (2 * math.pi / period), prefix or column
    out = df.withColumns({f"{base}_sin": F.sin(angle), f"{base}_cos": F.cos(angle)})
    return out.drop(column) if drop else out


def wind_to_uv(df: DataFrame, speed: str, direction: str, convention: str = "meteorological", u: str = "u", v: str = "v") -> DataFrame:
    """Wind components; the meteorological direction is where the wind comes from."""
    if convention not in ("meteorological", "oceanographic"):
        raise DataError(f"unknown convention {convention}")
    sign = -1.0 if convention == "meteorological" else 1.0
    rad = F.radians(col(direction))
    return df.withColumns({u: col(speed) * F.sin(rad) * sign, v: col(speed) * F.cos(rad) * sign})


def _window(group: str | None, date: str):
    """Rows in time order, in a group; without one the series is a single one by definition."""
    w = Window.partitionBy(col(group)) if group else Window.partitionBy()
    return w.orderBy(col(date))


def add_lags(df: DataFrame, columns: list[str], lags: list[int], group: str | None = None, date: str = "date", suffix: str = "lag") -> DataFrame:
    """``<col>_lag<k>``: the value k rows earlier; NULL where there is none."""
    if any(k <= 0 for k in lags):
        raise DataError("lags must be positive")
    w = _window(group, date)
    return df.withColumns({f"{c}_{suffix}{k}": F.lag(col(c), k).over(w) for c in columns for k in lags})


def shift(df: DataFrame, column: str, k: int, name: str, group: str | None = None, date: str = "date") -> DataFrame:
    """The value k rows earlier, or with negative k later."""
    w = _window(group, date)
    return df.withColumn(name, F.lag(col(column), k).over(w) if k >= 0 else F.lead(col(column), -k).over(w))


ROLLING = {
    "mean": F.avg,
    "sd": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, 0.5),
}


def add_rolling(df: DataFrame, columns: list[str], windows: list[int], aggs: list[str] = ("mean",), min_periods: int | None = None, group: str | None = None, date: str = "date", suffix: str = "roll", causal: bool = True) -> DataFrame:
    """``<col>_roll<w>_<agg>`` over w rows up to each row, or centred; NULL below ``min_periods`` finite values."""
    unknown = set(aggs) - ROLLING.keys()
    if unknown:
        raise DataError(f"unknown aggregates {sorted(unknown)}")
    new = {}
    for w in windows:
        lo, hi = (-(w - 1), 0) if causal else (-(w // 2), w - w // 2 - 1)
        over = _window(group, date).rowsBetween(lo, hi)
        for c in columns:
            x = finite(c)
            for a in aggs:
                new[f"{c}_{suffix}{w}_{a}"] = F.when(F.count(x).over(over) >= (min_periods or w), ROLLING[a](x).over(over))
    return df.withColumns(new)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * EARTH_KM)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def convert_units(c: Column, how: str) -> Column:
    """Fixed conversions of meteorological units."""
    rules = {"c_to_k": lambda x: x + 273.15, "hpa_to_pa": lambda x: x * 100.0, "percent_to_fraction": lambda x: x / 100.0, "mm_to_m": lambda x: x / 1000.0, "w_to_j": lambda x: x * 3600.0}
    if how not in rules:
        raise DataError(f"unknown conversion {how}")
    return rules[how](c)


def floor_date(c: Column, unit: str) -> Column:
    """Start of the day, week (Sunday), month, quarter, year or hour."""
    units = {"D": "day", "W": "week", "M": "month", "MS": "month", "Q": "quarter", "QS": "quarter", "Y": "year", "A": "year", "YS": "year", "H": "hour"}
    u = units.get(unit.upper(), unit.lower())
    if u == "week":
        return F.date_trunc("week", c + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    if u not in set(units.values()):
        raise DataError(f"unknown unit {unit}")
    return F.date_trunc(u, c)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule; the ring is a short constant, so this is plain arithmetic."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            over = ((lat < y1) & (lat >= y2)) | ((lat >= y1) & (lat < y2))
            at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(over & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def in_rings(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings of a region: further parts add to it, holes are cut out."""
    inside = F.lit(False)
    for ring in rings:
        inside = inside != in_polygon(lon, lat, [tuple(p) for p in ring])
    return inside


def in_region(lon: Column, lat: Column, region) -> Column:
    """A box (lon_min, lat_min, lon_max, lat_max), edges included, a polygon's ring, or several rings."""
    if len(region) == 4 and not isinstance(region[0], list | tuple):
        return lon.between(region[0], region[2]) & lat.between(region[1], region[3])
    if isinstance(region[0][0], list | tuple):
        return in_rings(lon, lat, region)
    return in_polygon(lon, lat, [tuple(p) for p in region])
