"""Back-trajectory text files and their transport features; run files for the trajectory model."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, get_logger
from ..functions.features import bearing_deg, haversine_km, in_region
from ..schema import col

RENAMES = {"mixdepth": "blh", "relhumid": "rh", "air_temp": "temp"}
FIELDS = ("traj", "grid", "yy", "mm", "dd", "hh", "mi", "fcast", "age", "lat", "lon", "height")
ARL_GDAS1_BASE_URL = "https://www.ready.noaa.gov/data/archives/gdas1/"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def read_tdump(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, traj, datetime, age_h, lat, lon, height, vars map) of all endpoint rows.

    A file is one row; its header's line counts and variable names are found by expressions, so files of
    different layouts are read in one scan. Rows with too few fields are dropped.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.col("value"), r"\r?\n").alias("line"))
    words = lambda c: F.split(F.trim(c), r"\s+")
    number = lambda c: c.try_cast("int")
    x = raw.withColumn("g", number(words(F.col("line")[0])[0]))
    x = x.withColumn("n", number(words(F.try_element_at("line", F.col("g") + 2))[0]))
    x = x.withColumn("head", F.col("g") + F.col("n") + 3).withColumn("names", words(F.try_element_at("line", F.col("head"))))
    x = x.withColumn("names", F.transform(F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda v: F.lower(v)))
    x = x.where(F.col("names").isNotNull() & F.col("head").isNotNull())
    e = x.select("file", "names", F.posexplode("line").alias("at", "text"), "head").where(F.col("at") >= F.col("head")).select("file", "at", "names", words(F.col("text")).alias("w"))
    e = e.where(F.size("w") >= F.size("names") + len(FIELDS))
    f = {n: F.col("w")[i] for i, n in enumerate(FIELDS)}
    yy = f["yy"].cast("int")
    year = F.when(yy < 50, yy + 2000).otherwise(yy + 1900)
    tail = F.transform(F.slice("w", len(FIELDS) + 1, F.size("names")), lambda v: v.try_cast("double"))
    return e.select("file", "at", f["traj"].cast("int").alias("traj"), F.make_timestamp(year, f["mm"].cast("int"), f["dd"].cast("int"), f["hh"].cast("int"), f["mi"].cast("int"), F.lit(0)).alias("datetime"), f["age"].cast("double").alias("age_h"), f["lat"].cast("double").alias("lat"), f["lon"].cast("double").alias("lon"), f["height"].cast("double").alias("height"), F.map_from_arrays("names", tail).alias("vars"))


def trajectory_features(points: DataFrame, keys: list[str], regions: dict[str, object] | None = None, prefix: str = "traj", variables: dict[str, str] | None = None) -> DataFrame:
    """One row a trajectory: distance, path length, speed, inflow sector, heights, residence shares, means.

    ``points`` has keys, age_h, lat, lon, height, and optionally the columns that ``variables`` maps to
    an aggregate (sum or mean).
    """
    w = Window.partitionBy(*map(col, keys)).orderBy(F.desc("age_h"))
    lat2, lon2 = F.lead("lat").over(w), F.lead("lon").over(w)
    x = points.withColumn("__step", haversine_km(F.col("lat"), F.col("lon"), lat2, lon2))
    first = F.max_by(F.struct("lat", "lon"), "age_h")
    last = F.min_by(F.struct("lat", "lon"), "age_h")
    aggs = [first.alias("a"), last.alias("z"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path"), (F.max("age_h") - F.min("age_h")).alias("span"), F.avg("height").alias("hm"), F.min("height").alias("hl")]
    aggs += [F.avg(F.when(in_region(F.col("lon"), F.col("lat"), r), 1.0).otherwise(0.0)).alias(f"r_{n}") for n, r in (regions or {}).items()]
    aggs += [(F.sum if how == "sum" else F.avg)(col(v)).alias(f"v_{v}") for v, how in (variables or {}).items()]
    y = x.groupBy(*map(col, keys)).agg(*aggs)
    p = prefix
    out = [haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")).alias(f"{p}_dist_km"), F.col("path").alias(f"{p}_pathlen_km"), (F.col("path") / F.when(F.col("span") != 0, F.abs("span"))).alias(f"{p}_speed_kmh"), bearing_deg(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")).alias(f"{p}_inflow_deg"), F.col("hm").alias(f"{p}_height_mean"), F.col("hl").alias(f"{p}_height_min")]
    out += [F.col(f"r_{n}").alias(f"{p}_resid_{n}") for n in (regions or {})]
    out += [F.col(f"v_{v}").alias(f"{p}_{RENAMES.get(v, v)}_{how}") for v, how in (variables or {}).items()]
    return y.select(*map(col, keys), *out)


DIAGNOSTICS = {"rainfall": "sum", "mixdepth": "mean", "relhumid": "mean", "pressure": "mean", "air_temp": "mean"}


def build_trajectory_features(spark: SparkSession, paths: str | list[str], regions: dict[str, object] | None = None, prefix: str = "traj", date_col: str = "date") -> DataFrame:
    """Features of every trajectory by its arrival time; of several for one time the last file and number wins."""
    x = read_tdump(spark, paths)
    present = {r[0] for r in x.select(F.explode(F.map_keys("vars"))).distinct().collect()}  # variable names
    use = {v: how for v, how in DIAGNOSTICS.items() if v in present}
    x = x.withColumns({v: F.try_element_at("vars", F.lit(v)) for v in use})
    feats = trajectory_features(x, ["file", "traj"], regions, prefix, use)
    when = x.groupBy("file", "traj").agg(F.min_by("datetime", F.abs("age_h")).alias(date_col))
    both = feats.join(when, ["file", "traj"])
    names = [c for c in both.columns if c not in ("file", "traj", date_col)]
    one = both.groupBy(date_col).agg(F.max(F.struct("file", "traj", *map(col, names))).alias("s"))
    return one.select(date_col, *(F.col("s").getField(c).alias(c) for c in names)).orderBy(date_col)


def load_regions(spark: SparkSession, path: str) -> dict[str, list]:
    """Named regions of a GeoJSON feature collection (a handful, returned to the caller): a ring, or all rings of a region with parts or holes."""
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    import json

    out = {}
    for i, f in enumerate(spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*").collect()):
        props = f.properties or {}
        parts = [json.loads(f.geometry.coordinates)]
        while isinstance(parts[0][0][0], list):
            parts = [p for part in parts for p in part]
        rings = [[(float(x), float(y)) for x, y, *_ in ring] for ring in parts]
        out[props.get("name") or props.get("id") or props.get("NAME") or f"region_{i}"] = rings[0] if len(rings) == 1 else rings
    return out


def gdas1_filenames(date_from: date, date_to: date) -> list[str]:
    """Weekly archive names that cover the dates, in order."""
    a, b = sorted((date_from, date_to))
    days = ((a + timedelta(i)) for i in range((b - a).days + 1))
    return list(dict.fromkeys(f"gdas1.{MONTHS[d.month - 1]}{d.year % 100:02d}.w{min((d.day - 1) // 7 + 1, 5)}" for d in days))


def gdas1_filenames_df(days: DataFrame, column: str = "date") -> DataFrame:
    """The same for a table of days, as a Spark plan: (file, first_day)."""
    d = col(column).cast("date")
    week = F.least(F.floor((F.dayofmonth(d) - 1) / 7) + 1, F.lit(5))
    name = F.concat(F.lit("gdas1."), F.lower(F.date_format(d, "MMM")), F.date_format(d, "yy"), F.lit(".w"), week.cast("string"))
    return days.groupBy(name.alias("file")).agg(F.min(d).alias("first_day"))


def gdas1_range(name: str) -> tuple[datetime, datetime] | None:
    """The time span of an archive file, from its name."""
    m = re.fullmatch(r"gdas1\.([a-z]{3})(\d\d)\.w([1-5])", name)
    if not m:
        return None
    first = datetime(2000 + int(m[2]), MONTHS.index(m[1]) + 1, 1)
    start = first + timedelta(7 * (int(m[3]) - 1))
    after = datetime(first.year + first.month // 12, first.month % 12 + 1, 1)
    return start, min(start + timedelta(7), after) - timedelta(hours=3)


def met_files_for(names: list[str], lo: datetime, hi: datetime) -> list[str]:
    """Archive files whose span meets [lo, hi]; unknown names stay."""
    return [n for n in names if (r := gdas1_range(n.rsplit("/", 1)[-1])) is None or (r[0] <= hi and r[1] >= lo)]


def control_text(start: datetime, lat: float, lon: float, height: float, hours: int, met: list[tuple[str, str]], out_dir: str, out_name: str, top: float = 10000.0, vertical: int = 0) -> str:
    """The trajectory model's control file."""
    lines = [start.strftime("%y %m %d %H"), "1", f"{lat:.4f} {lon:.4f} {height:.1f}", str(hours), str(vertical), f"{top:.1f}", str(len(met))]
    for folder, name in met:
        lines += [folder.rstrip("/") + "/", name]
    return "\n".join([*lines, out_dir.rstrip("/") + "/", out_name]) + "\n"


def setup_text(**settings) -> str:
    """The trajectory model's namelist."""
    base = {"tm_pres": 1, "tm_rain": 1, "tm_mixd": 1, "tm_relh": 1, "tm_tamb": 1} | settings
    return "&SETUP\n" + "".join(f"{k} = {v},\n" for k, v in base.items()) + "/\n"


def run_back_trajectories(*_, **__):
    raise DataError("running the external trajectory model is out of scope; write control_text and setup_text, run it, and read its files with build_trajectory_features")


def fetch_gdas1(date_from: date, date_to: date, folder: str, base: str, on_missing: str = "error") -> list[str]:
    """Paths of the weekly archives that cover the dates, in order; those not in ``folder`` yet are fetched from ``base``.

    A file is written as ``.part`` and renamed when whole. ``on_missing``: "error", "warn" (leave it out and say so) or "skip".
    """
    import os
    import shutil
    import urllib.error
    import urllib.request

    if on_missing not in ("error", "warn", "skip"):
        raise ConfigError("on_missing is error, warn or skip")
    os.makedirs(folder, exist_ok=True)
    out = []
    for name in gdas1_filenames(date_from, date_to):
        path = os.path.join(folder, name)
        if not (os.path.exists(path) and os.path.getsize(path)):
            part = f"{path}.part"
            try:
                with urllib.request.urlopen(f"{base.rstrip('/')}/{name}") as src, open(part, "wb") as dst:
                    shutil.copyfileobj(src, dst)
                os.replace(part, path)
            except (urllib.error.URLError, OSError) as e:
                if os.path.exists(part):
                    os.remove(part)
                if on_missing == "error":
                    raise DataError(f"{name} can't be fetched: {e}") from e
                if on_missing == "warn":
                    get_logger("trajectory").warning("%s can't be fetched: %s", name, e)
                continue
        out.append(path)
    return out
