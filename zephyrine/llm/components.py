"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import stored
from .textops import frugal


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges: equal marks, equal sets."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(h * h % 1_000_003)).first())


#: Up to so many links (16 MB) one task finds the components; beyond, rounds over all executors do.
ONE_TASK_LINKS = 1_000_000


def union(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component), by minima along links and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    @frugal
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, label = union(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

    return edges.coalesce(1).mapInArrow(run, "node long, label long")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, label) for every node of the links; the label is the component's smallest node.

    Few links, by a count, are settled in one task. Otherwise every step is a grouping by node with partial aggregation and a join; the edges are written
    to the shared folder between rounds, so that lineage stays short, and the rounds end when they
    stay the same: then every edge leads to its component's smallest node. The neighbours of a hub are
    never gathered: a minimum is aggregated and joined back.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    if edges.count() <= one_task:
        return _in_one_task(edges)
    edges = stored(edges.distinct())
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
