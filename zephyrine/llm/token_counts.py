"""Token counts by the whole-token shortcut.

Offline, ``whole_tokens`` proves for every string of the vocabulary, by encoding it alone, whether
it is exactly one token. Counting then splits a text at ASCII white space (no pre-token of the
tokenizer crosses it), and a word at the tokenizer's own pre-token pattern: a pre-token in the
proved set is one token without any merge; only the rest is merged by the library. Word counts are
memoised in a table of bounded size, so that memory does not grow with the number of distinct
words. Words in which a special token's string occurs, and words with characters that the
tokenizer's normaliser may change, go to the library as a whole.

Null and empty texts have 0 tokens and 0 bytes. Rows are independent: repeated rows give repeated
results, null ids stay null, an empty table gives an empty one, ties don't arise, and other columns are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .textops import frugal, slices

PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
#: Characters beyond Latin, or at which str.split() splits too: such texts take the general path.
UNUSUAL = regex.compile(r"[^\x00-\u017f]|[\x1c-\x1f\x85\xa0]")
END = "</w>"
MEMO_WORDS = 700_000


@lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def ends_word(path: str) -> np.ndarray:
    """By token id, whether the token ends a pre-token."""
    vocab = load(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for v, i in vocab.items() if v.endswith(END)]] = True
    return out


@lru_cache(4)
def whole_tokens(path: str) -> frozenset[str]:
    """Plain lower-case strings of the vocabulary that the library encodes, alone, as one token."""
    t = load(path)
    cand = sorted({w for v in t.get_vocab() if v.endswith(END) and (w := v[: -len(END)]).isascii() and PRE_TOKENS.fullmatch(w) and w == w.lower()})
    return frozenset(w for w, e in zip(cand, t.encode_batch(cand, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def words_of(text: str) -> list[str]:
    """Words between ASCII white space; lower-cased if every character is plain Latin, but for words in which a special string may stand."""
    if UNUSUAL.search(text):
        return WORDS.findall(text)
    return [w if "<|" in w else w.lower() for w in text.split()] if "<|" in text else text.lower().split()


def encode_pre_tokens(path: str, pre: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of plain pre-tokens in one array, and where each one's tokens end in it."""
    t, ids = load(path), []
    for i in range(0, len(pre), 1000):
        ids.append(np.array(t.encode_batch_fast([" ".join(pre[i : i + 1000])], add_special_tokens=False)[0].ids, np.int32))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    stops = np.flatnonzero(ends_word(path)[flat]) + 1
    if len(stops) != len(pre):
        raise ValueError("a pre-token wasn't encoded alone")
    return flat, stops


class Counter:
    """Token counts of words, each found once while it is remembered."""

    def __init__(self, path: str):
        self.path, self.whole = path, whole_tokens(path)
        self.memo: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        plain, rest, odd = [], [], set()
        for w in words:
            if UNUSUAL.search(w) or "<|" in w or w != w.lower():
                rest.append(w)
            else:
                pre = PRE_TOKENS.findall(w)
                plain.append((w, pre))
                odd.update(p for p in pre if p not in self.whole and p not in self.merged)
        if len(self.merged) + len(odd) > MEMO_WORDS:
            odd = {p for _, pre in plain for p in pre if p not in self.whole}
            self.merged.clear()
        todo = sorted(odd)
        _, stops = encode_pre_tokens(self.path, todo)
        self.merged.update(zip(todo, np.diff(stops, prepend=0).tolist(), strict=True))
        for w, pre in plain:
            self.memo[w] = sum(1 if p in self.whole else self.merged[p] for p in pre)
        if rest:
            found = load(self.path).encode_batch_fast(rest, add_special_tokens=False)
            self.memo.update((w, len(e.ids)) for w, e in zip(rest, found, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [words_of(t) for t in texts]
        fresh = set().union(*split) - self.memo.keys()
        if len(fresh) + len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            fresh = set().union(*split)
        self.learn(fresh)
        get = self.memo.__getitem__
        return [sum(map(get, ws)) for ws in split]


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, ``n_bytes`` of the UTF-8 text, and ``n_tokens``."""

    @frugal
    def run(batches):
        c = counter(tokenizer)  # stays with a reused Python worker from task to task
        for b in batches:
            col = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            sizes = pc.binary_length(col).cast(pa.int64())
            at = np.concatenate(([0], np.cumsum(sizes.to_numpy())))
            n = pa.array([x for i, j in slices(at) for x in c.count(col[i:j].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, n], ["key", "n_bytes", "n_tokens"])

    src = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    return src.mapInArrow(run, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", out.n_tokens > 2048)
