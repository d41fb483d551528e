"""Tables that cut lineage: written to the shared folder the cluster names, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/zephyrine"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read from there."""
    path = folder(df.sparkSession)
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` has made and that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        fs = p.getFileSystem(conf)
        if "llm-" in f and fs.exists(p):
            fs.delete(p, True)
