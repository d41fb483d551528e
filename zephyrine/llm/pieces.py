"""Question-and-answer exchange between pieces of a corpus and tables dealt by hash.

Some operators need, for every word or n-gram of every text, a figure that all texts together
decide, and then need the texts in order again. Joining one row per position would shuffle
hundreds of millions of rows. Here texts are packed into *pieces* of a bounded size, written once.
Each piece asks for its **distinct** keys, as sorted blocks, one for each range of the hash
(``bucket``); a bucket gathers the blocks of all pieces, decides, and answers every block in the
block's own order. The answers meet their piece again, sorted behind its texts, and are read as a
stream. Keys are spread by hash, so no key is hot: a frequent word is one entry in each piece.

Rows of the exchange: piece long, bucket int, kind int, body binary. Blocks are byte-shuffled and
zstd-compressed. All is deterministic, so lost tasks can be run again.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .spill import stored
from .textops import absent, columns, frugal, give_back, mix

ROW = "piece long, bucket int, kind int, body binary"
NAMES = ["piece", "bucket", "kind", "body"]
TEXTS = -1
PIECE_BYTES = 8 << 20


def pack(a: np.ndarray) -> bytes:
    """An array of integers or floats as compressed bytes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")


def unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted ``keys`` begins, and the end."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def rows(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], NAMES)


class Pieces(NamedTuple):
    """The pieces' rows; unless they are stored, also what they are cut from and how."""

    frame: DataFrame
    source: DataFrame | None
    cutter: Callable | None


def cut(df: DataFrame, key: str, text: str, store: bool = True, most: int = PIECE_BYTES) -> Pieces:
    """Texts as pieces of about ``most`` bytes (a longer text is a piece of its own).

    Stored, the pieces can come from any plan. Without, they are cut anew each time they are read,
    which saves their space and is for plain reads of files: ``same_splits`` keeps the files' splits, and so
    the cut, the same from read to read, whatever executors come and go; and every answer carries the digest of the keys it
    answers, so that answers to another cut could never pass for this one's.
    """

    @frugal
    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        texts: list[bytes] = []
        held = 0

        def emit():
            nonlocal n, held
            if not ids:
                return None
            body = join(pack(np.concatenate(ids)), pack(np.concatenate(nulls)), pack(np.concatenate(sizes)), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
            row = rows([(base + n, TEXTS, TEXTS, body)])
            n += 1
            held = 0
            ids.clear(), nulls.clear(), sizes.clear(), texts.clear()
            return row

        for b in batches:
            key_of, data, off = columns(b, "key", "text")
            null = absent(b, "key").astype(np.uint8)
            a = 0
            while a < len(key_of):
                e = int(np.searchsorted(off, off[a] + max(0, most - held), "right")) - 1
                e = min(max(e, a + (not held)), len(key_of))
                if e > a:
                    ids.append(key_of[a:e])
                    nulls.append(null[a:e])
                    sizes.append(np.diff(off[a : e + 1]))
                    texts.append(data[off[a] : off[e]].tobytes())
                    held += int(off[e] - off[a])
                if (e < len(key_of) or held >= most) and (row := emit()) is not None:
                    yield row
                a = e
        if (row := emit()) is not None:
            yield row

    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    out = source.mapInArrow(run, ROW)
    return Pieces(stored(out), None, None) if store else Pieces(out, source, run)


def count_of(df: DataFrame, text: str, most: int = PIECE_BYTES) -> int:
    """About how many pieces the texts make."""
    return int(df.agg(F.sum(F.octet_length(df[text].cast("string")))).first()[0] or 0) // most + 1


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same_splits(spark: SparkSession) -> Callable[[], contextlib.AbstractContextManager]:
    """Contexts in which files are split as they would be now.

    Splits follow three settings and the number of cores, which changes when executors come and go.
    """
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    now = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")} | {"spark.sql.files.minPartitionNum": cores}
    return lambda: _set(spark, now)


def digest(keys: np.ndarray) -> bytes:
    """Of a set of 64-bit keys; digests of parts add up."""
    return int(np.add.reduce(mix(keys))).to_bytes(8, "little")


def check(digests: list[bytes], keys: np.ndarray) -> None:
    """Answers' digests must add up to that of the keys that were asked."""
    if sum(int.from_bytes(d, "little") for d in digests) % 2**64 != int.from_bytes(digest(keys), "little"):
        raise ValueError("the answers are to another cut of the texts")


def texts_of(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, bytes and offsets of a piece's texts."""
    ids, nulls, sizes, texts = split(body)
    offsets = np.concatenate(([0], np.cumsum(unpack(sizes, np.int64))))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(offsets[-1])), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return unpack(ids, np.int64), unpack(nulls, np.uint8).astype(bool), data, offsets


def groups(batches, field: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows of a partition sorted by ``field``, gathered by its value."""
    at, held, k = None, [], NAMES.index(field)
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[k] != at and held:
                yield at, held
                held = []
            at = r[k]
            held.append(r)
    if held:
        yield at, held


def ask(pieces: Pieces, questions: Callable[[int, bytes], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """The questions of all pieces."""

    @frugal
    def run(batches):
        for b in batches:
            for piece, body in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                out = list(questions(piece, body.as_py()))
                if out:
                    yield rows(out)

    if pieces.source is not None:  # cut and ask in one Python worker
        cutter = pieces.cutter
        return pieces.source.mapInArrow(lambda batches: run(cutter(batches)), ROW)
    return pieces.frame.mapInArrow(run, ROW)


def answer(asked: DataFrame, buckets: int, decide: Callable[[int, list], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """``decide`` sees all blocks of one bucket."""

    @frugal
    def run(batches):
        for bucket, held in groups(batches, "bucket"):
            out = list(decide(bucket, held))
            if out:
                yield rows(out)

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "piece").mapInArrow(run, ROW)


def meet(frame: DataFrame, answers: DataFrame, n: int, finish: Callable[[int, bytes, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``finish`` sees a piece's texts and all answers to it."""

    @frugal
    def run(batches):
        for piece, held in groups(batches, "piece"):
            yield from finish(piece, held[0][3], held[1:])

    return frame.unionByName(answers).repartition(n, "piece").sortWithinPartitions("piece", "kind", "bucket").mapInArrow(run, schema)


def reunite(frame: DataFrame, answers: DataFrame, n: int, finish: Callable[[int, bytes, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Like ``meet``, for pieces that are dealt to ``n`` partitions by name already, and stay there: only answers travel."""
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)])

    def run(piece, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        held = sorted(theirs.select(NAMES).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        out = [b for body in mine.column("body").to_pylist() for b in finish(piece[0].as_py(), body, [tuple(r.values()) for r in held])]
        give_back()
        return pa.Table.from_batches(out).cast(kinds) if out else kinds.empty_table()

    dealt = answers.repartition(n, "piece")
    return frame.groupBy("piece").cogroup(dealt.groupBy("piece")).applyInArrow(run, schema)


def buckets_for(spark: SparkSession, n_pieces: int) -> int:
    """Buckets follow the input, and are at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_pieces, 1)


def release(df: DataFrame) -> None:
    """Let Spark's cleaner drop shuffle files that no plan refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
