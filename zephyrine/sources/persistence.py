"""Hashes, the result cache, runs with provenance, and CSV output."""

from __future__ import annotations

import functools
import getpass
import hashlib
import json
import platform
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..models import load_model, save_model
from ..models.base import _read_text, _write_text
from ..schema import col


def data_hash(df: DataFrame, columns: list[str] | None = None) -> str:
    """SHA-1 of schema, row count and the sum of row hashes: one aggregate, whatever the order of rows."""
    x = df.select(*map(col, columns)) if columns else df
    s = x.agg(F.count("*"), F.sum(F.xxhash64(*map(col, x.columns)).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *map(col, x.columns)).cast("decimal(38,0)"))).first()
    return hashlib.sha1(f"{x.schema.simpleString()}|{s[0]}|{s[1]}|{s[2]}".encode()).hexdigest()


def config_hash(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Cache:
    """Results by key in any store Spark reaches; a miss is None."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def load(self, key: str) -> DataFrame | None:
        path = f"{self.location}/{key}.parquet"
        return self.spark.read.parquet(path) if _exists(self.spark, f"{path}/_SUCCESS") else None

    def save(self, key: str, df: DataFrame) -> DataFrame:
        path = f"{self.location}/{key}.parquet"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def load_model(self, key: str):
        return load_model(self.location, key) if _exists(self.spark, f"{self.location}/{key}/meta") else None

    def save_model(self, key: str, model) -> None:
        save_model(model, self.location, key)

    def memoise(self, f):
        """A function to DataFrame, remembered by its arguments; tables are hashed by content."""

        @functools.wraps(f)
        def run(*a, **kw):
            mark = lambda x: data_hash(x) if isinstance(x, DataFrame) else repr(x)
            key = config_hash({"f": f.__qualname__, "a": [mark(x) for x in a], "k": {k: mark(v) for k, v in kw.items()}})
            return hit if (hit := self.load(key)) is not None else self.save(key, f(*a, **kw))

        return run


@dataclass
class Run:
    """A result with its model, prepared data and where it came from."""

    result: DataFrame
    kind: str
    metadata: dict = field(default_factory=dict)
    model: object | None = None
    prepared: DataFrame | None = None

    def __str__(self) -> str:
        return f"{self.kind} run of {self.metadata.get('time')}: {', '.join(self.result.columns)}"


def make_run(result: DataFrame, kind: str, config: dict | None = None, df: DataFrame | None = None, prepared: DataFrame | None = None, model=None, seed: int | None = None, extra: dict | None = None) -> Run:
    spark = result.sparkSession
    meta = {"kind": kind, "time": datetime.now(UTC).isoformat(), "python": platform.python_version(), "spark": spark.version, "host": platform.node(), "user": getpass.getuser(), "seed": seed, "config": config or {}, "config_hash": config_hash(config or {})}
    if df is not None:
        meta |= {"data_hash": data_hash(df), "columns": df.columns, "rows": df.count()}
    if model is not None:
        from ..models import model_hash

        meta["model_hash"] = model_hash(model)
    return Run(result, kind, meta | (extra or {}), model, prepared)


def save_run(run: Run, path: str) -> str:
    run.result.write.mode("overwrite").parquet(f"{path}/result")
    if run.model is not None:
        save_model(run.model, path, "model")
    _write_text(run.result.sparkSession, f"{path}/run.meta.json", json.dumps(run.metadata | {"format": "run"}, default=str))
    return path


def load_run(spark: SparkSession, path: str) -> Run:
    if not _exists(spark, f"{path}/run.meta.json"):
        raise DataError(f"{path} holds no run")
    meta = json.loads(_read_text(spark, f"{path}/run.meta.json"))
    if meta.get("format") != "run":
        raise DataError(f"{path} isn't a run")
    model = load_model(path, "model") if _exists(spark, f"{path}/model/meta") else None
    return Run(spark.read.parquet(f"{path}/result"), meta["kind"], meta, model)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header and one fixed time format."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path
