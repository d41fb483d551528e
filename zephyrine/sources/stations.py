"""Measurement and meteorology services, as parsers of their JSON and CSV answers.

Fetching is a driver-side matter (``fetch`` takes any function from URL to text, so that tests and closed
clusters can supply files); what comes back is parsed by Spark, in parallel over answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, get_logger
from ..operators.joins import union_fill
from ..schema import col

#: Codes of the services.
AURN_POLLUTANTS = {"NO2": 8, "NO": 38, "NOX": 9, "O3": 7, "SO2": 1, "CO": 10, "PM10": 5, "PM2.5": 6001, "C6H6": 20}
EEA_POLLUTANTS = {"SO2": 1, "PM10": 5, "O3": 7, "NO2": 8, "CO": 10, "PM2.5": 6001}
ERA5_VARIABLES = ("10m_u_component_of_wind", "10m_v_component_of_wind", "2m_dewpoint_temperature", "2m_temperature", "boundary_layer_height", "surface_pressure", "surface_solar_radiation_downwards", "total_cloud_cover", "total_precipitation")
OPENMETEO_NAMES = {"temperature_2m": "t2m", "dew_point_2m": "d2m", "relative_humidity_2m": "rh2m", "surface_pressure": "sp", "precipitation": "tp", "cloud_cover": "tcc", "shortwave_radiation": "ssrd", "boundary_layer_height": "blh", "wind_speed_10m": "ws", "wind_direction_10m": "wd"}
EEA_NAMES = {"DatetimeBegin": "date", "Concentration": "value", "AirPollutant": "pollutant", "AirQualityStation": "site", "UnitOfMeasurement": "unit", "Countrycode": "country", "Latitude": "lat", "Longitude": "lon"}


def resolve_code(name: str | int, table: dict[str, int]) -> int:
    """A code by name in any case, or a number as it is."""
    if isinstance(name, int) or str(name).isdigit():
        return int(name)
    hit = {k.lower(): v for k, v in table.items()}.get(str(name).lower())
    if hit is None:
        raise ConfigError(f"unknown pollutant {name}; known: {', '.join(table)}")
    return hit


def with_retries(fetch: Callable[[str], str], url: str, tries: int = 3, wait: float = 1.0, exponential: bool = False) -> str:
    for k in range(tries):
        try:
            return fetch(url)
        except Exception as e:
            if k == tries - 1:
                raise DataError(f"{url}: {e}") from e
            time.sleep(wait * (2**k if exponential else k + 1))
    raise DataError(url)


def _answers(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "body string")


def parse_stations(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, label, lat, lon) of a station list; coordinates come as latitude, longitude."""
    s = answers.select(F.explode(F.from_json("body", "array<struct<properties:struct<id:string,label:string>,geometry:struct<coordinates:array<double>>>>")).alias("s"))
    out = s.select(F.col("s.properties.id").alias("id"), F.col("s.properties.label").alias("label"), F.col("s.geometry.coordinates")[0].alias("lat"), F.col("s.geometry.coordinates")[1].alias("lon"))
    return out.limit(limit) if limit else out


def parse_series(answers: DataFrame) -> DataFrame:
    """(date, site, station_id, pollutant, value, unit, lat, lon) of {meta..., values: [{timestamp, value}]} answers, milliseconds."""
    shape = "site string, station_id string, pollutant string, unit string, lat double, lon double, values array<struct<timestamp:long,value:double>>"
    x = answers.select(F.from_json("body", shape).alias("b")).select("b.*", F.explode("b.values").alias("v"))
    return x.select(F.timestamp_millis("v.timestamp").alias("date"), "site", "station_id", "pollutant", F.col("v.value").alias("value"), "unit", "lat", "lon").orderBy("site", "date")


def fetch_measurements(spark: SparkSession, urls: list[str], fetch: Callable[[str], str]) -> DataFrame:
    """All series that can be fetched; a failed one is skipped with a warning."""
    texts = []
    for u in urls:
        try:
            texts.append(with_retries(fetch, u))
        except DataError as e:
            get_logger("stations").warning("%s", e)
    if not texts:
        raise DataError("no series could be fetched")
    return parse_series(_answers(spark, texts))


def eea_table(files: list[DataFrame], keep: list[str] = ("date", "site", "pollutant", "value", "unit", "country", "lat", "lon")) -> DataFrame:
    """Yearly files united by name, renamed, times parsed, default columns that exist, by site and date."""
    x = union_fill(files).withColumnsRenamed(EEA_NAMES)
    x = x.withColumn("date", F.try_to_timestamp(F.substring(F.regexp_replace(col("date").cast("string"), "T", " "), 1, 19)))
    return x.select(*(col(c) for c in keep if c in x.columns)).orderBy(*(c for c in ("site", "date") if c in x.columns))


LOCATION = "results array<struct<id:long,name:string,country:struct<code:string>,coordinates:struct<latitude:double,longitude:double>,sensors:array<struct<id:long,name:string,parameter:struct<id:long,name:string,units:string>>>>>"


def parse_locations(answers: DataFrame) -> DataFrame:
    """(id, name, country, lat, lon, sensors) with sensors as an array of structs."""
    r = answers.select(F.explode(F.from_json("body", LOCATION).getField("results")).alias("r"))
    sensors = F.transform("r.sensors", lambda s: F.struct(s.id.alias("id"), s.name.alias("name"), s.parameter.id.alias("parameter_id"), s.parameter.name.alias("parameter"), s.parameter.units.alias("units")))
    return r.select("r.id", "r.name", F.col("r.country.code").alias("country"), F.col("r.coordinates.latitude").alias("lat"), F.col("r.coordinates.longitude").alias("lon"), sensors.alias("sensors"))


def sensors_of(locations: DataFrame) -> DataFrame:
    """One row a sensor."""
    return locations.select(F.col("id").alias("location_id"), F.explode("sensors").alias("s")).select("location_id", F.col("s.id").alias("sensor_id"), F.col("s.name").alias("name"), "s.parameter", "s.parameter_id", "s.units")


def fetch_pages(fetch: Callable[[str], str], url: str, size: int = 1000, most: int = 10_000) -> list[str]:
    """Pages until a short one."""
    import json

    out = []
    for page in range(1, most + 1):
        text = with_retries(fetch, f"{url}&limit={size}&page={page}", exponential=True)
        out.append(text)
        if len(json.loads(text).get("results", [])) < size:
            break
    return out


def parse_openaq(answers: DataFrame, site: str | None = None) -> DataFrame:
    """(date, site, parameter, value, unit, lat, lon) of measurement pages."""
    shape = "results array<struct<value:double,parameter:struct<name:string,units:string>,period:struct<datetimeFrom:struct<utc:string>>,coordinates:struct<latitude:double,longitude:double>>>"
    r = answers.select(F.explode(F.from_json("body", shape).getField("results")).alias("r"))
    return r.select(F.try_to_timestamp(F.col("r.period.datetimeFrom.utc")).alias("date"), F.lit(site).alias("site"), F.col("r.parameter.name").alias("parameter"), "r.value", F.col("r.parameter.units").alias("unit"), F.col("r.coordinates.latitude").alias("lat"), F.col("r.coordinates.longitude").alias("lon")).orderBy("site", "date")


def coerce_sites(sites) -> list[tuple[str, float, float]]:
    """(site, lat, lon) from a mapping name -> (lat, lon), or rows with those three fields."""
    if isinstance(sites, dict):
        return [(str(k), float(v[0]), float(v[1])) for k, v in sites.items()]
    rows = sites.collect() if isinstance(sites, DataFrame) else list(sites)
    try:
        return list({str(r["site"]): (str(r["site"]), float(r["lat"]), float(r["lon"])) for r in reversed(rows)}.values())[::-1]
    except (KeyError, ValueError, TypeError) as e:
        raise DataError("sites need site, lat and lon") from e


def era5_table(frames: dict[str, DataFrame]) -> DataFrame:
    """Per-site series united by name: lower-case names, date and place renamed, place columns first, by site and date."""
    out = []
    for site, df in frames.items():
        x = df.toDF(*[c.lower() for c in df.columns])
        x = x.withColumnsRenamed({"valid_time": "date", "time": "date", "timestamp": "date", "latitude": "lat", "longitude": "lon"})
        out.append(x.withColumn("date", F.to_timestamp("date")).withColumn("site", F.lit(site)))
    x = union_fill(out)
    first = [c for c in ("date", "site", "lat", "lon") if c in x.columns]
    return x.select(*first, *(col(c) for c in x.columns if c not in first)).orderBy("site", "date")


def parse_openmeteo(answers: DataFrame, variables: list[str]) -> DataFrame:
    """(date, site, lat, lon, variables) of {site, lat, lon, hourly: {time: [...], ...}} answers, in SI units.

    Arrays are zipped and exploded; the first answer of a site wins.
    """
    shape = "site string, latitude double, longitude double, hourly struct<time:array<string>," + ",".join(f"`{v}`:array<double>" for v in variables) + ">"
    b = answers.withColumn("n", F.monotonically_increasing_id()).select("n", F.from_json("body", shape).alias("b"))
    first = b.groupBy("b.site").agg(F.min_by("b", "n").alias("b"))
    z = first.select("b.site", F.col("b.latitude").alias("lat"), F.col("b.longitude").alias("lon"), F.explode(F.arrays_zip("b.hourly.time", *(F.col(f"b.hourly.{v}") for v in variables))).alias("h"))
    x = z.select(F.try_to_timestamp(F.col("h.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("date"), "site", "lat", "lon", *(F.col("h").getField(v).alias(OPENMETEO_NAMES.get(v, v)) for v in variables))
    rules = {"t2m": lambda c: c + 273.15, "d2m": lambda c: c + 273.15, "sp": lambda c: c * 100, "tcc": lambda c: c / 100, "rh2m": lambda c: c, "tp": lambda c: c / 1000, "ssrd": lambda c: c * 3600}
    x = x.withColumns({c: rules[c](col(c)) for c in x.columns if c in rules})
    if {"ws", "wd"} <= set(x.columns):
        x = x.withColumns({"u10": -F.col("ws") * F.sin(F.radians("wd")), "v10": -F.col("ws") * F.cos(F.radians("wd"))})
    return x.orderBy("site", "date")


def read_session_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """A CSV (or gzipped CSV) with a header; the date becomes a UTC timestamp."""
    x = spark.read.csv(path, header=True, inferSchema=True)
    return x.withColumn(date, F.try_to_timestamp(col(date).cast("string"))) if date in x.columns else x


def station_rollup(df: DataFrame, site: str = "site", pollutant: str = "pollutant", order: list[str] = ()) -> DataFrame:
    """(site, pollutants, n): pollutants in the order asked for, the most complete sites first."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("p")) if order else F.lit(0)
    x = df.select(col(site).alias("site"), col(pollutant).alias("p")).distinct().withColumn("r", F.when(rank == 0, 10**6).otherwise(rank))
    g = x.groupBy("site").agg(F.array_sort(F.collect_set(F.struct("r", "p"))).alias("s"))
    return g.select("site", F.array_join(F.transform("s", lambda s: s.p), ",").alias("pollutants"), F.size("s").alias("n")).orderBy(F.desc("n"), "site")


def example_hourly(spark: SparkSession, hours: int = 8760, seed: int = 42) -> DataFrame:
    """Seeded synthetic hourly data: meteorology and a pollutant that depends on it."""
    t = F.col("id") / 24.0
    x = spark.range(hours).select(F.timestamp_seconds(F.col("id") * 3600 + 1_704_067_200).alias("date"), (15 + 8 * F.sin(t * 0.0172) + 4 * F.sin(t * 6.2832) + F.randn(seed)).alias("t2m"), (4 + F.abs(F.randn(seed + 1)) * 2).alias("ws"), F.pmod(F.randn(seed + 2) * 90 + 200, F.lit(360.0)).alias("wd"), (600 + 300 * F.sin(t * 6.2832) + 50 * F.randn(seed + 3)).alias("blh"))
    return x.withColumn("NO2", F.greatest(40 - 3 * F.col("ws") - 0.02 * F.col("blh") + 5 * F.randn(seed + 4), F.lit(0.5)))


def example_panel(spark: SparkSession, units: int = 31, weeks: int = 80, seed: int = 42, treated: str = "u00", from_week: int = 42, factor: float = 0.65) -> DataFrame:
    """A seeded weekly panel whose treated unit steps down."""
    x = spark.range(units * weeks).select(F.format_string("u%02d", F.col("id") % units).alias("ID"), F.floor(F.col("id") / units).cast("int").alias("w"))
    y = 20 + 5 * F.sin(F.col("w") / 8) + F.randn(seed)
    step = F.when((F.col("ID") == treated) & (F.col("w") >= from_week), factor).otherwise(1.0)
    return x.select(F.expr("date_add(date'2015-01-05', w * 7)").alias("date"), "ID", (y * step).alias("SO2"))
