"""Quality rules: base counts, and repetition inside a text by suffix arrays.

Per text a suffix array over its words is built by prefix doubling, with the ranks of every level
kept; from them come the longest common prefixes of neighbouring suffixes, vectorised. The
maximal repeated substrings are the intervals of that array; every suffix is covered up to its
longest common prefix with a neighbour, so the union of these spans, of ``min_repeat`` words or
more, is the union of all maximal repeats' spans. A text is rejected if that union covers more
than ``max_covered`` of its words, or the longest repeat is longer than ``max_repeat`` words. Only
texts in which some ``min_repeat``-gram occurs twice need a suffix array: others have no repeat
of that length. Texts are handled whole and one by one: nothing is shuffled, and memory is bounded
by the longest text.

Null and empty texts have no words, so they fail the base rules. Repeated rows give repeated
results; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import columns, combine, covered, frugal, mix, repeated, slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False  # continuation bytes of UTF-8
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "covered_words": "long", "longest_repeat": "long"}


def lcp_neighbours(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every suffix, the words it shares with its nearest neighbour in its owner's suffix array.

    ``tokens`` are any 64-bit symbols, ``owner`` the text each stands in (texts in order). The
    suffix array of all texts is one array whose first symbol is the owner, so neighbours of other
    texts share nothing.
    """
    n = len(tokens)
    last = np.searchsorted(owner, owner, "right")  # where the text ends
    _, rank = np.unique(np.stack([owner.astype(np.uint64), tokens]), axis=1, return_inverse=True) if n else (None, np.zeros(0, np.int64))
    rank = rank.reshape(-1).astype(np.int64) + 1
    levels, step, at = [rank], 1, np.arange(n)
    while n and rank.max() < n and step < (last - at).max():
        ahead = np.zeros(n, np.int64)
        ok = at + step < last
        ahead[ok] = rank[at[ok] + step]
        _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, r = 1 << k, levels[k]
        ok = (a + size <= last[order[:-1]]) & (b + size <= last[order[1:]])
        ok[ok] = r[a[ok]] == r[b[ok]]
        shared[ok] += size
        a[ok] += size
        b[ok] += size
    best = np.zeros(n, np.int64)
    if n > 1:
        best[order[:-1]] = shared
        best[order[1:]] = np.maximum(best[order[1:]], shared)
    return best


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def figures(data: np.ndarray, offsets: np.ndarray, min_repeat: int, max_covered: float, max_repeat: int) -> list[np.ndarray]:
    """The columns of COLUMNS for one slice of texts."""
    n = len(offsets) - 1
    doc, _, _, h = words(data, offsets, lower=False)
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    edges = np.asarray(offsets) - lo
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[edges])
    n_words = np.bincount(doc, minlength=n)
    chars, symbols = total(LEAD[part] & ~BLANK[part]), total(SYMBOLS[part])
    dup_lines = np.array([duplicate_lines(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(n)], np.int64)

    def gram_hits(width: int) -> np.ndarray:
        """Where a window of ``width`` words starts that occurs twice or more in its text."""
        m = len(h) - width + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key = h[:m]
        for j in range(1, width):
            key = combine(key, h[j : j + m])
        inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
        _, twice = repeated(key[inside] + mix(doc[inside].astype(np.uint64)))
        return inside[twice]

    repeat_words = np.bincount(doc[covered(gram_hits(3), 3, len(h))], minlength=n)
    covered_words, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hit = np.zeros(n, bool)
    hit[doc[gram_hits(min_repeat)]] = True
    if hit.any():
        sel = np.flatnonzero(hit[doc])
        best = lcp_neighbours(h[sel], doc[sel])
        long = best >= min_repeat
        np.maximum.at(longest, doc[sel], np.where(long, best, 0))
        covered_words = np.bincount(doc[sel][covered(np.flatnonzero(long), best[long], len(sel))], minlength=n)
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & (covered_words <= max_covered * n_words) & (longest <= max_repeat)
    return [n_words, chars, symbols, dup_lines, repeat_words, failed, kept, covered_words, longest]


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = 8, max_covered: float = 0.35, max_repeat: int = 64) -> DataFrame:
    """One row per input row: the key and COLUMNS."""

    @frugal
    def run(batches):
        for b in batches:
            _, data, off = columns(b, "key", "text")
            parts = [figures(data, off[i : j + 1], min_repeat, max_covered, max_repeat) for i, j in slices(off)]
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                kinds = [pa.bool_() if t == "boolean" else pa.int64() for t in COLUMNS.values()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key", *COLUMNS])

    src = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    return src.mapInArrow(run, "key long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())).withColumnRenamed("key", key)


def keep_good(df: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = 8, max_covered: float = 0.35, max_repeat: int = 64) -> DataFrame:
    """The input's rows, all columns, without those that the rules reject; one pass, no join."""
    fields, schema = df.columns, df.schema

    @frugal
    def run(batches):
        for b in batches:
            _, data, off = columns(b, key, text)
            parts = [figures(data, off[i : j + 1], min_repeat, max_covered, max_repeat)[6] for i, j in slices(off)]
            if parts:
                yield b.select(fields).filter(pa.array(np.concatenate(parts)))

    return df.mapInArrow(run, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
