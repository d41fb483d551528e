"""BPE encoding and decoding by a distinct-word table.

Spark splits the texts into words at ASCII white space, which no pre-token of the tokenizer crosses.
All pieces of the corpus ask for their distinct words; the word table, dealt by hash, encodes
every distinct word **once**; the ids go back to the pieces, where they are joined by position.
Decoding joins ids to the vocabulary's pieces (a table whose size the vocabulary fixes) and puts
them together as the tokenizer's decoder does: this vocabulary has none, so pieces are joined by
one space.

Null and empty texts encode to no ids and decode to an empty text. Special tokens' strings inside a
text become their ids, as the library does by default. A repeated row gives a repeated result, null ids
stay null, an empty table gives an empty one; ties don't arise. Only key and text are read. A long text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import pieces as P
from .textops import sha256, slices, words
from .token_counts import PRE_TOKENS, UNUSUAL, encode_pre_tokens, load


SLICE = 1 << 20
PIECE = 5 << 20


def zip_lines(lines: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress("\n".join(lines).encode())


def unzip_lines(b: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(b).decode().split("\n")


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: sorted distinct word hashes, start and end of one occurrence. Only a slice's words are held at a time."""
    hs, sts, ens = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in slices(offsets, SLICE):
        _, st, en, h = words(data, offsets[i : j + 1], lower=False)
        keys, first = np.unique(h.astype(np.uint64), return_index=True)
        hs.append(keys), sts.append(st[first] + offsets[i]), ens.append(en[first] + offsets[i])
    keys, first = np.unique(np.concatenate(hs), return_index=True)
    return keys, np.concatenate(sts)[first], np.concatenate(ens)[first]


def positions(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distinct words stands at every place of a piece, and where each text's words begin."""
    at, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i, j in slices(offsets, SLICE):
        doc, _, _, h = words(data, offsets[i : j + 1], lower=False)
        at.append(np.searchsorted(keys, h.astype(np.uint64)).astype(np.int32))
        counts.append(np.bincount(doc.astype(np.int64), minlength=j - i))
    return np.concatenate(at), np.cumsum(np.concatenate(counts))


@lru_cache(2)
def vocabulary(path: str) -> list[str]:
    """The id-to-piece table."""
    vocab = load(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def encode_words(path: str, todo: list[str]) -> list[str]:
    """Decimal ids, joined by one space, of each word."""
    out = [""] * len(todo)
    plain, pre, n = [], [], []
    rest = []
    for i, w in enumerate(todo):
        if UNUSUAL.search(w) or "<|" in w:
            rest.append(i)
        else:
            p = PRE_TOKENS.findall(w.lower())
            plain.append(i)
            pre.extend(p)
            n.append(len(p))
    ids, stops = encode_pre_tokens(path, pre)
    text = list(map(str, ids.tolist()))
    stops = np.concatenate(([0], stops))
    at = 0
    for i, k in zip(plain, n, strict=True):
        out[i] = " ".join(text[stops[at] : stops[at + k]])
        at += k
    if rest:
        for i, e in zip(rest, load(path).encode_batch_fast([todo[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = " ".join(map(str, e.ids))
    return out


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the
    ids (array of int) and the decoded text.

    The pieces are dealt once, by name; from there they ask, and there the answers come back to them (Spark reuses the exchange).
    """
    n_pieces = P.count_of(df, text, PIECE)
    buckets = P.buckets_for(df.sparkSession, n_pieces // 8)
    n = 4 * n_pieces
    dealt = P.cut(df, key, text, store=False, most=PIECE).frame.repartition(n, "piece")

    def questions(piece: int, body: bytes) -> Iterator:
        _, _, data, off = P.texts_of(body)
        keys, st, en = distinct_words(data, off)
        at = P.bounds(keys, buckets)
        raw = data.tobytes()
        for k in range(buckets):
            if at[k] < at[k + 1]:
                spell = [raw[s:e].decode("utf-8", "replace") for s, e in zip(st[at[k] : at[k + 1]].tolist(), en[at[k] : at[k + 1]].tolist(), strict=True)]
                yield piece, k, 0, P.join(P.digest(keys[at[k] : at[k + 1]]), zip_lines(spell))

    def decide(_: int, held: list) -> Iterator:
        asked = [(piece, bucket, *P.split(body)) for piece, bucket, _, body in held]
        todo = sorted(set().union(*(unzip_lines(w) for *_, w in asked)))
        ids = dict(zip(todo, encode_words(tokenizer, todo), strict=True))
        for piece, bucket, digest, w in asked:
            yield piece, bucket, 1, P.join(digest, zip_lines([ids[x] for x in unzip_lines(w)]))

    def finish(_: int, body: bytes, answers: list) -> Iterator[pa.RecordBatch]:
        key_of, null, data, off = P.texts_of(body)
        words_, _, _ = distinct_words(data, off)
        parts = [P.split(b) for *_, b in answers]
        P.check([d for d, _ in parts], words_)
        ids = [x for _, b in parts for x in unzip_lines(b)]
        pieces_of = vocabulary(tokenizer)
        decoded = [" ".join([pieces_of[int(i)] for i in x.split()]) for x in ids]
        sizes = np.array([x.count(" ") + 1 if x else 0 for x in ids] or [0], np.int64)
        inverse, edges = positions(data, off, words_)
        cols: list[list] = [[], [], [], [], []]
        for i in range(len(key_of)):
            own = inverse[edges[i] : edges[i + 1]]
            at = own.tolist()
            a, t = " ".join([ids[k] for k in at if ids[k]]), " ".join([decoded[k] for k in at if ids[k]])
            for c, x in zip(cols, (int(sizes[own].sum()), sha256(a.encode()), sha256(t.encode()), list(map(int, a.split())) if keep_ids else None, t if keep_ids else None), strict=True):
                c.append(x)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if keep_ids else 3]
        yield pa.RecordBatch.from_arrays([pa.array(key_of, mask=null), *(pa.array(c, k) for c, k, _ in zip(cols, kinds, names))], ["key", *names])

    answers = P.answer(P.ask(P.Pieces(dealt, None, None), questions), buckets, decide)
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return P.reunite(dealt, answers, n, finish, schema).withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
