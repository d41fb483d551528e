"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1-grams and 2-grams, of word shapes and of 3-byte runs with a sign
in them, hashed to ``2**bits`` columns, with bands of a few counts (length, share of distinct words and of
symbols) as further indicators. Every indicator is scaled by its log-count ratio between the two
classes, smoothed by ``alpha``; the counts are taken in Spark over **all** labelled training rows.
A linear model with the hinge loss is then fitted to the scaled, length-normalised features by
dual coordinate descent, on at most ``max_train`` training rows (the documented bound on the fit;
the rows with the smallest hash), in one task. Columns of features seen in fewer than ``min_count`` training rows have no weight. The model is a vector of ``2**bits`` numbers,
whose size is fixed, and it is broadcast for scoring. Scores are a logistic curve of the margin.

Null and empty texts get the score of the bias and the length bands alone. Rows with a null label
are not trained on; with one class or no training rows at all the model is the constant prior. An
id labelled twice counts twice. Ties at 0.5 are predicted 1. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import BITS, bitmap, held_in
from .spill import stored
from .textops import columns, combine, distinct, frugal, mix, slices, smallest, words

U = np.uint64
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
KINDS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
KINDS[[ord(c) for c in "0123456789"]] = 3
KINDS[0x80:] = 1
KINDS[[ord(c) for c in ".,"]] = 4
for _i, _c in enumerate("!?#*$%&|<>@_=+/\\:;'\"()[]{}~^`-"):
    KINDS[ord(_c)] = 5 + _i


def _mean(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n = np.diff(edges)
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[edges]) / np.maximum(n, 1)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and feature column of every distinct feature, sorted."""
    n = len(offsets) - 1
    lo = int(offsets[0])
    edges = np.asarray(offsets) - lo
    part = data[lo : int(offsets[-1])]
    doc, st, en, h = words(data, offsets, lower=True)
    docs, keys = [doc], [h]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        docs.append(doc[1:][same])
        keys.append(combine(h[:-1], h[1:])[same])
    kinds = KINDS[part].astype(np.uint64)
    if len(h):
        # A word's shape: the kinds of its first and last two characters.
        last, back = kinds[en - 1], kinds[np.maximum(en - 2, st)]
        docs.append(doc)
        keys.append(mix(kinds[st] << U(12) | back << U(6) | last | U(1 << 40)))
    if len(part) > 2:
        owner = np.repeat(np.arange(n), np.diff(edges))
        fold = part.astype(np.uint64)
        inside = owner[2:] == owner[:-2]
        odd = inside & ((kinds[1:-1] > 4) | (kinds[:-2] > 4) | (kinds[2:] > 4))
        docs.append(owner[2:][odd])
        keys.append(mix((fold[:-2] << U(16) | fold[1:-1] << U(8) | fold[2:] | U(1 << 41))[odd]))
    n_words = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    n_distinct = np.bincount(doc[order][fresh], minlength=n)
    bands = [np.log2(n_words + 1).astype(int), (10 * n_distinct / np.maximum(n_words, 1)).astype(int), (20 * _mean(kinds > 4, edges)).astype(int), (10 * _mean(kinds == 2, edges)).astype(int), (20 * _mean(part == 10, edges)).astype(int)]
    for k, band in enumerate(bands):
        docs.append(np.arange(n))
        keys.append(mix(band.astype(np.uint64) | U((k + 2) << 42)))
    d = np.concatenate(docs).astype(np.uint64)
    column = np.concatenate(keys) >> U(64 - bits)
    both = distinct(d << U(bits) | column)
    return (both >> U(bits)).astype(np.int64), (both & U((1 << bits) - 1)).astype(np.int64)


def fit_hinge(indptr: np.ndarray, cols: np.ndarray, y: np.ndarray, values: np.ndarray, c: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; row i has unit norm, bias included.

    ``values`` scales columns; classes weigh inversely to their frequency.
    """
    w, bias = np.zeros(len(values)), 0.0
    n = len(y)
    alpha = np.zeros(n)
    share = {k: n / (2.0 * max(1, int((y == k).sum()))) for k in (-1, 1)}
    rows = []
    for i in range(n):
        x = values[cols[indptr[i] : indptr[i + 1]]]
        norm = math.sqrt(float(x @ x)) or 1.0
        rows.append((cols[indptr[i] : indptr[i + 1]], x / norm))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            at, x = rows[i]
            g = y[i] * (float(w[at] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / 2.0, 0.0), c * share[int(y[i])])  # |x|^2 + bias^2 = 2
            d = new - alpha[i]
            if d:
                alpha[i] = new
                w[at] += d * y[i] * x
                bias += d * y[i]
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w, bias


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "key", bits: int = 18, alpha: float = 1.0, c: float = 1.0, max_train: int = 6000, epochs: int = 20, min_count: int = 3) -> dict:
    """Fit on rows (key, text, label 0/1). Returns the model: its column weights and the bias."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))
    size = 1 << bits

    @frugal
    def count(batches):
        counts, seen = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for b in batches:
            _, data, off = columns(b, "key", "text")
            y = b.column(2).to_numpy()
            seen += np.bincount(y, minlength=2)
            for i, j in slices(off):
                d, f = features(data, off[i : j + 1], bits)
                for k in (0, 1):
                    counts[k] += np.bincount(f[y[i:j][d] == k], minlength=size)
        if seen.any():  # in blocks, so that many tasks' tables add up in many tasks
            step = size // 64
            for k in (0, 1):
                for i in range(64):
                    yield pa.RecordBatch.from_arrays([pa.array([k * 64 + i], pa.int32()), pa.array([int(seen[k])], pa.int64()), pa.array([counts[k, i * step : (i + 1) * step].tobytes()], pa.binary())], ["block", "seen", "counts"])

    @frugal
    def add(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for block, seen, counts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                s, v = sums.get(block, (0, 0))
                sums[block] = (s + seen, v + np.frombuffer(counts, np.int64))
        for block, (s, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([s], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["block", "seen", "counts"])

    shape = "block int, seen long, counts binary"
    parts = rows.mapInArrow(count, shape).repartition(16, "block").mapInArrow(add, shape).toArrow().to_pylist()
    counts, seen = np.zeros((2, size)), np.zeros(2)
    for p in parts:
        k, i = divmod(p["block"], 64)
        seen[k] = p["seen"]
        counts[k, i * (size // 64) : (i + 1) * (size // 64)] = np.frombuffer(p["counts"], np.int64)
    prior = (seen[1] + 1) / (seen.sum() + 2)
    model = {"bits": bits, "w": np.zeros(size, np.float32), "bias": math.log(prior / (1 - prior)), "scale": 1.0}
    if not seen.all():
        return model
    share = (counts + alpha) / (counts + alpha).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    values = np.where(counts.sum(axis=0) >= min_count, ratio, 0.0).astype(np.float32)
    sample = smallest(rows, max_train, 11)

    @frugal
    def fit(batches):
        ds, fs, ys, n = [], [], [], 0
        for b in batches:
            _, data, off = columns(b, "key", "text")
            ys.append(b.column(2).to_numpy().astype(np.int64) * 2 - 1)
            for i, j in slices(off):
                d, f = features(data, off[i : j + 1], bits)
                used = values[f] != 0
                ds.append(d[used] + n + i)
                fs.append(f[used].astype(np.int32))
            n += b.num_rows
        y = np.concatenate(ys) if ys else np.zeros(0, np.int64)
        indptr = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(ds), minlength=n)))) if n else np.zeros(1, np.int64)
        cols = np.concatenate(fs) if fs else np.zeros(0, np.int32)
        w, bias = fit_hinge(indptr, cols, y, values.astype(np.float64), c, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([(w * values).astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["w", "bias"])

    (fitted,) = sample.repartition(1).sortWithinPartitions("key").mapInArrow(fit, "w binary, bias double").collect()
    return model | {"w": np.frombuffer(fitted.w, np.float32), "values": values, "bias": fitted.bias, "scale": 3.0}


def score(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and ``score`` in (0, 1)."""
    spark = df.sparkSession
    weights = spark.sparkContext.broadcast((model["w"], model.get("values", np.ones(1 << model["bits"], np.float32))))
    bits, bias, scale = model["bits"], model["bias"], model["scale"]

    @frugal
    def run(batches):
        w, values = weights.value
        for b in batches:
            _, data, off = columns(b, "key", "text")
            out = []
            for i, j in slices(off):
                d, f = features(data, off[i : j + 1], bits)
                top = np.bincount(d, weights=w[f], minlength=j - i)
                norm = np.sqrt(np.bincount(d, weights=values[f].astype(np.float64) ** 2, minlength=j - i))
                margin = top / np.where(norm > 0, norm, 1.0) + bias
                out.append(1.0 / (1.0 + np.exp(-np.clip(scale * margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["key", "score"])

    src = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    return src.mapInArrow(run, "key long, score double").withColumnRenamed("key", key)


def fold(key: Column, parts: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % parts


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, text, label) of the labelled documents, stored.

    Documents pass a bitmap of the labelled ids (2 MB, whatever their number) where they are read, so
    that only labelled texts are shuffled; the join behind it is exact.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(1 << BITS)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(labels.where("key is not null").select(place.alias("x"))))

    @frugal
    def marked(batches):
        for b in batches:
            yield b.select(["key", "text"]).filter(pa.array(held_in(shared.value, b.column(2).to_numpy() - 1)))

    src = docs.where("key is not null").select("key", "text", place.alias("x")).mapInArrow(marked, "key long, text string")
    return stored(src.join(labels.hint("merge"), "key"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    labelled = with_labels(docs.withColumnRenamed("doc_id", "key"), labels.where(fold(F.col("key"), 3) != 1))
    out = score(docs, train(labelled))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
