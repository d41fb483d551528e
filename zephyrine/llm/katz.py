"""Language-model scoring: a Katz backoff model of any order with Good-Turing discounts.

Tokens are words and one end per text; starts stand before the first. Counts of the n-grams of every length up to
``order`` come from the training texts. A count r up to ``k`` is discounted by Good-Turing's factor d_r, from the counts of counts
of its length; beyond k the absolute discount of k goes on, so that every context keeps mass to back off
with. The unigram level gives its discounted mass to one event for unknown words. Backoff weights
are normalised exactly: alpha(c) = (1 - sum of discounted shares after c) / (1 - sum of the next lower order's
probabilities of the words seen after c); those are direct shares too, for what is seen after c is seen after its
shorter context. A token is scored recursively: its longest seen n-gram's share, times the alphas of all longer contexts
that are known; an unknown context backs off with weight 1.

All texts' pieces ask for their distinct n-grams (see pieces.py), with their own training
counts; the tables, dealt by hash into as many partitions as the input needs, add up the counts. They are
stored, and each answer is the total of every key asked. Each piece then scores what its texts
have seen, and sends on, dealt by context: its part of the sums behind alpha (each
distinct n-gram is counted by one owner), and the tokens that backed off. Everything
grows with the corpus; nothing is broadcast but the counts of counts (k + 3 numbers a length).

Null and empty texts are one end token. A null id is never held out. Repeated rows count again.
With no training texts every token is the unknown event, of probability 1. An empty table gives an empty one. Other columns are not
read. Every text is scored whole; a long one is a piece of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces as P
from .spill import stored
from .textops import combine, distinct, slices, words

U = np.uint64
START, END = U(0x5F7374617274), U(0x5F656E64)
SUMS, TOTALS = 9, 8


def held_out(ids: np.ndarray, null: np.ndarray, parts: int, out: int) -> np.ndarray:
    return ~null & np.array([zlib.crc32(str(i).encode()) % parts == out for i in ids.tolist()], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every token, the end of each text among them."""
    docs, hs = [], []
    for i, j in slices(offsets):
        d, _, _, h = words(data, offsets[i : j + 1])
        docs.append(d + i), hs.append(h)
    doc = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    h = np.concatenate([*hs, np.zeros(0, U)]).astype(U)
    n = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(n), "right")
    doc, h = np.insert(doc, at, np.arange(n)), np.insert(h, at, END)
    return doc, h


def grams(doc: np.ndarray, h: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By length, the hash of the n-gram that ends at every token, and of its context (from length 2 on)."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]
    keys, contexts, start = [h], [], START
    for _ in range(1, order):
        context = np.concatenate((h[:0], [start], keys[-1][:-1]))[: len(h)]
        context[first] = start
        contexts.append(context)
        keys.append(combine(context, h))
        start = combine(np.array([start]), np.array([START]))[0]
    return keys, contexts


def discounts(of: np.ndarray, k: int) -> np.ndarray:
    """d_1..d_k, and at index 0 the absolute discount for larger counts; ``of[r]``: keys counted r times."""
    d = np.ones(k + 1)
    last = (k + 1) * of[k + 1] / of[1] if of[1] else 0.0
    for r in range(1, k + 1):
        g = (r + 1) * of[r + 1] / (r * of[r]) if of[r] else 0.0
        x = (g - last) / (1 - last) if last < 1 else 0.0
        d[r] = x if 0.05 < x < 1 else (r - 0.5) / r
    d[0] = max(k * (1 - d[k]), 0.05)
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    k = len(d) - 1
    c = count.astype(np.float64)
    return np.where(count <= k, d[np.minimum(count, k)] * c, c - d[0]) * (count > 0)


class Model:
    """The few numbers that all pieces need: counts of counts, discounts, totals."""

    def __init__(self, totals: np.ndarray, k: int):
        uni = totals[0]
        self.n, self.v = int(uni[-2]), int(uni[-1])
        self.d = [discounts(of, k) for of in totals]
        self.du = self.d[0]
        self.kept = 0.0  # discounted unigram mass of known words
        for r in range(1, k + 1):
            self.kept += uni[r] * self.du[r] * r
        beyond = self.v - uni[1 : k + 1].sum()
        self.kept += self.n - (np.arange(1, k + 1) * uni[1 : k + 1]).sum() - self.du[0] * beyond
        self.unknown = (self.n - self.kept) / self.n if self.n else 1.0

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.du) / max(self.n, 1), self.unknown)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 7, out: int = 2, k: int = 5, order: int = 2, store: bool = True) -> DataFrame:
    """One row per text: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is the longest n-gram's length, from 1 to 7. ``store=False`` is for plain reads of files (see ``pieces.cut``).
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be from 1 to 7")
    same = P.same_splits(df.sparkSession)
    pieces = P.cut(df, key, text, store=store)
    n_pieces = P.count_of(df, text)
    buckets = P.buckets_for(df.sparkSession, n_pieces)
    asked = P.ask(pieces, lambda piece, body: _questions(piece, body, buckets, parts, out, order))
    with same():
        tables = stored(P.answer(asked, buckets, lambda bucket, held: _add(bucket, held, k, order)), "kind").select(*P.NAMES)
    P.release(df)
    totals = np.zeros((order, k + 4), np.int64)
    for o, body in tables.where(F.col("kind") == TOTALS).groupBy("piece").agg(F.collect_list("body").alias("body")).select((-F.col("piece") - 1).alias("o"), "body").collect():
        totals[o] = np.sum([np.frombuffer(x, np.int64) for x in body], axis=0)
    model = Model(totals, k)
    half = P.meet(pieces.frame, tables.where(F.col("kind") < order), 4 * n_pieces, lambda piece, body, held: _seen(piece, body, held, model, buckets, parts, out), P.ROW)
    with same():
        seen = stored(half, "kind").select(*P.NAMES)
    P.release(df)
    rest = P.answer(seen.where(F.col("kind") == SUMS), buckets, _back_off)
    schema = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    done = P.meet(seen.where(F.col("kind") == TOTALS), rest, 4 * n_pieces, _total, schema)
    return done.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _questions(piece: int, body: bytes, buckets: int, parts: int, out: int, order: int) -> Iterator:
    ids, null, data, off = P.texts_of(body)
    doc, h = tokens(data, off)
    learn = ~held_out(ids, null, parts, out)[doc]
    for o, keys in enumerate(grams(doc, h, order)[0]):
        u, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse[learn], minlength=len(u)).astype(np.uint32)
        at = P.bounds(u, buckets)
        for b in range(buckets):
            if at[b] < at[b + 1]:
                yield piece, b, -o - 2, P.join(P.pack_sorted(u[at[b] : at[b + 1]]), P.pack(n[at[b] : at[b + 1]]))


def _add(bucket: int, held: list, k: int, order: int) -> Iterator:
    """The table's part: totals of all keys, and for each block its totals and which keys it owns."""
    for o in range(order):
        blocks = [(piece, *P.split(body)) for piece, _, kind, body in held if kind == -o - 2]
        if not blocks:
            continue
        keys = [P.unpack_sorted(a) for _, a, _ in blocks]
        flat, n = np.concatenate(keys), np.concatenate([P.unpack(c, np.uint32) for _, _, c in blocks]).astype(np.int64)
        u, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64)
        owner = np.zeros(len(flat), np.int64)
        owner[first] = 1
        figures = np.zeros(k + 4, np.int64)
        figures[: k + 2] = np.bincount(np.minimum(total, k + 2), minlength=k + 3)[: k + 2]
        figures[-2:] = total.sum(), (total > 0).sum()
        yield -o - 1, bucket, TOTALS, figures.tobytes()
        answer = (total[inverse] * 2 + owner).astype(np.uint64 if len(total) and total.max() >= 2**31 else np.uint32)
        at = 0
        for (piece, _, _), own in zip(blocks, keys, strict=True):
            yield piece, bucket, o, P.join(P.digest(own), bytes([answer.itemsize]), P.pack(answer[at : at + len(own)]))
            at += len(own)


def _seen(piece: int, body: bytes, held: list, model: Model, buckets: int, parts: int, out: int) -> Iterator[pa.RecordBatch]:
    ids, null, data, off = P.texts_of(body)
    doc, h = tokens(data, off)
    n, order = len(ids), len(model.d)
    all_keys, contexts = grams(doc, h, order)
    inside = np.concatenate(([False], doc[1:] == doc[:-1]))[: len(doc)]
    p = own = count = known = None
    v_, seen_, mass_, back_, back_doc = [], [], [], [], []
    for o in range(order):
        u, at, of = np.unique(all_keys[o], return_index=True, return_inverse=True)
        answers = [P.split(b) for _, _, kind, b in held if kind == o]
        P.check([d for d, _, _ in answers], u)
        got = np.concatenate([P.unpack(b, np.uint64 if size[0] == 8 else np.uint32).astype(np.int64) for _, size, b in answers]) if answers else np.zeros(0, np.int64)
        total, owner = got >> 1, (got & 1) == 1
        before, count = count, total[of]
        if o == 0:
            words_count = count
            # The count of the start as a context is the number of training texts: count of the end.
            starts = int(total[np.searchsorted(u, END)]) if n else 0
            p = own = model.unigram(count)
            log_own = np.log10(own)
            continue
        context = np.full(len(h), starts, np.int64)
        context[1:][inside[1:]] = before[:-1][inside[1:]]
        known = count > 0
        lower = p
        p = np.zeros(len(h))
        p[known] = discounted(count[known], model.d[o]) / context[known]
        log_own[known] = np.log10(p[known])
        # Each distinct n-gram's share in the sums behind alpha, once over all pieces.
        mine = at[owner & (total > 0)]
        v, where = np.unique(contexts[o - 1][mine], return_inverse=True)
        v_.append(v)
        seen_.append(np.bincount(where, weights=p[mine], minlength=len(v)))
        mass_.append(np.bincount(where, weights=lower[mine], minlength=len(v)))
        # Tokens that back off from a known context.
        back = np.flatnonzero(~known & (context > 0))
        back_.append(contexts[o - 1][back])
        back_doc.append(doc[back])
    base = np.log10((words_count + 1) / (model.n + model.v + 1))
    total_of = lambda x: np.bincount(doc, weights=x, minlength=n)
    own_rows = [ids, null.astype(np.uint8), held_out(ids, null, parts, out).astype(np.uint8), np.bincount(doc, minlength=n), np.bincount(doc[words_count > 0], minlength=n), total_of(base), total_of(log_own)]
    out_rows = [(piece, -1, TOTALS, P.join(*(P.pack(x) for x in own_rows)))]
    if order > 1:
        v, seen, mass, back, of_doc = (np.concatenate(x) for x in (v_, seen_, mass_, back_, back_doc))
        first = np.argsort(v, kind="stable")
        v, seen, mass = v[first], seen[first], mass[first]
        first = np.lexsort((of_doc, back))
        back, of_doc = back[first], of_doc[first]
        at_v, at_b = P.bounds(v, buckets), P.bounds(back, buckets)
        for b in range(buckets):
            i, j, x, y = at_v[b], at_v[b + 1], at_b[b], at_b[b + 1]
            if i < j or x < y:
                out_rows.append((piece, b, SUMS, P.join(P.pack_sorted(v[i:j]), P.pack(seen[i:j]), P.pack(mass[i:j]), P.pack_sorted(back[x:y]), P.pack(of_doc[x:y].astype(np.uint32)))))
    yield P.rows(out_rows)


def alphas(seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Exactly normalised backoff weights."""
    return np.maximum(1 - seen, 1e-12) / np.maximum(1 - mass, 1e-12)


def _back_off(bucket: int, held: list) -> Iterator:
    """log10 alpha of every backed-off token of this bucket's contexts, summed by text."""
    blocks = [(piece, P.split(body)) for piece, _, _, body in held]
    v = np.concatenate([P.unpack_sorted(x[0]) for _, x in blocks])
    u, where = np.unique(v, return_inverse=True)
    seen = np.bincount(where, weights=np.concatenate([P.unpack(x[1], np.float64) for _, x in blocks]), minlength=len(u))
    mass = np.bincount(where, weights=np.concatenate([P.unpack(x[2], np.float64) for _, x in blocks]), minlength=len(u))
    log_alpha = np.log10(alphas(seen, mass))
    for piece, x in blocks:
        doc = P.unpack(x[4], np.uint32).astype(np.int64)
        if len(doc):
            sums = np.bincount(doc, weights=log_alpha[np.searchsorted(u, P.unpack_sorted(x[3]))])
            docs = distinct(doc)
            yield piece, bucket, SUMS, P.join(P.pack(docs.astype(np.uint32)), P.pack(sums[docs]))


def _total(_: int, body: bytes, held: list) -> Iterator[pa.RecordBatch]:
    ids, null, out, n, known, base, own = (P.unpack(x, t) for x, t in zip(P.split(body), (np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64, np.float64), strict=True))
    own = own.copy()
    for _, _, _, b in held:
        docs, sums = P.split(b)
        own[P.unpack(docs, np.uint32).astype(np.int64)] += P.unpack(sums, np.float64)
    cols = [pa.array(ids, mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(own)]
    yield pa.RecordBatch.from_arrays(cols, ["key", "held_out", "n_tokens", "n_known", "base_score", "score"])


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), store=False)
