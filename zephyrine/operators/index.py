"""Dense row numbers, in an order, that don't need all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import col

ONE_TASK_ROWS = 2_000_000


def with_index(df: DataFrame, order: list[str], name: str = "i", rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ascending order of the columns ``order``.

    Up to ONE_TASK_ROWS rows (counted, unless ``rows`` says) one sorted window does; beyond, rows are
    range-partitioned, numbered inside each range, and shifted by the ranges' sizes. The ranges are
    written once (a checkpoint), so that both passes see the same ones.
    """
    n = df.count() if rows is None else rows
    keys = [col(c) for c in order]
    if n <= ONE_TASK_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    ranged = df.repartitionByRange(max(8, n // ONE_TASK_ROWS * 4), *keys).withColumn("__p", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("__p").count().orderBy("__p").collect()  # a row for each range
    shifts, total = [], 0
    for r in sizes:
        shifts.append((r["__p"], total))
        total += r["count"]
    shift = df.sparkSession.createDataFrame(shifts, "__p int, __s long")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return ranged.withColumn("__r", inside).join(F.broadcast(shift), "__p").withColumn(name, (F.col("__r") + F.col("__s")).cast("long")).drop("__p", "__r", "__s")
