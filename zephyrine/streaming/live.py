"""Structured Streaming forms of batch operators: sliding means, sessions of events, normalising new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.normalise import normalise
from ..schema import col, finite


def sliding_means(stream: DataFrame, value: str, date: str = "date", width: str = "14 days", every: str = "7 days", late: str = "1 day", group: str | None = None) -> DataFrame:
    """(start, end[, group], mean, n) of sliding windows; state is bounded by the watermark."""
    keys = [F.window(col(date), width, every).alias("w"), *([col(group)] if group else [])]
    g = stream.withWatermark(date, late).groupBy(*keys).agg(F.avg(finite(value)).alias("mean"), F.count(finite(value)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([col(group)] if group else []), "mean", "n")


def event_sessions(stream: DataFrame, score: str, limit: float, gap: str = "1 hour", date: str = "date", late: str = "1 day", group: str | None = None) -> DataFrame:
    """([group], start, end, n, max_score, mean_score) of sessions of scores above the limit."""
    # Session windows in a stream need a key, and one that isn't folded away.
    key = col(group) if group else F.when(col(date).isNull(), "none").otherwise("all")
    g = stream.where(finite(score) > limit).withWatermark(date, late).groupBy(key.alias("__g"), F.session_window(col(date), gap).alias("w"))
    x = g.agg(F.count("*").alias("n"), F.max(col(score)).alias("max_score"), F.avg(col(score)).alias("mean_score"))
    return x.select(*([F.col("__g").alias(group)] if group else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_score", "mean_score")


def normalise_stream(stream: DataFrame, model, pool: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, n_samples: int = 300, seed: int = 1):
    """Start a query that normalises each batch of new rows against a fixed pool and hands it to ``sink``."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(normalise(batch, model, None, n_samples, seed, pool), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
