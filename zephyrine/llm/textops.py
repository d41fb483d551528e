"""Vectorised text primitives shared by the operators of this subpackage.

Texts travel as Arrow batches (``mapInArrow``) and are handled as byte buffers with NumPy, in
slices of a bounded number of bytes, so that a Python worker's memory does not depend on how
many rows a batch holds. White space is ``[\\x20\\x09-\\x0D]``: ASCII only, so that byte
offsets of words in UTF-8 are exact.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SEGMENT = 1 << 19
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(1)
def _libc():
    """The C library, if it is one that can give freed memory back."""
    try:
        lib = ctypes.CDLL("libc.so.6")
        return lib if lib.malloc_trim else None
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if (lib := _libc()) is not None:
        lib.malloc_trim(0)


def frugal(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function for ``mapInArrow`` that gives the memory it used back to the system at its end.

    Python workers are reused from task to task and idle between stages; what one keeps is missing to the others.
    """

    @functools.wraps(run)
    def inner(batches, *args, **kw):
        try:
            yield from run(batches, *args, **kw)
        finally:
            give_back()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hash of two hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xA0761D6478BD642F) + _U(1))


def columns(batch: pa.RecordBatch, key: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the bytes of all texts and their offsets; a null text is empty. A null id reads -1 here: ``absent`` tells which are."""
    ids = pc.fill_null(batch.column(key).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    col = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return ids, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def absent(batch: pa.RecordBatch, key: str) -> np.ndarray:
    """Which ids are null."""
    return batch.column(key).is_null().to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of at most ``most`` bytes; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start, end and 64-bit hash of every word, in order.

    The hash is a polynomial in random byte values modulo 2**64, from prefix sums, and mixed;
    with ``lower`` the letters A-Z count as a-z. Work goes in segments that end at a boundary of
    words, so that a very long text needs no more scratch memory than a short one.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    data = data[base:end]
    offsets = offsets - base
    space = IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    starts, ends, hashes, a = [], [], [], 0
    while a < len(data):
        b = min(a + SEGMENT, len(data))
        while b < len(data):
            stop = (space[b : b + 4096] | first[b : b + 4096]).argmax()
            if space[b + stop] or first[b + stop]:
                b += int(stop)
                break
            b = min(b + 4096, len(data))
        s = space[a:b]
        before = np.concatenate(([True], s[:-1])) | first[a:b]
        after = np.concatenate((s[1:] | first[a + 1 : b], [True]))
        st, en = np.flatnonzero(~s & before), np.flatnonzero(~s & after) + 1
        if len(st):
            power = np.full(b - a, _BASE)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((_LOWER if lower else _TABLE)[data[a:b]] * power, out=sums[1:])
            inverse = np.full(b - a, _INVERSE)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            hashes.append(mix((sums[en] - sums[st]) * inverse[st]))
            starts.append(st + a)
            ends.append(en + a)
        a = b
    if not starts:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    st = np.concatenate(starts)
    doc = np.searchsorted(offsets, st, "right") - 1
    return doc, st, np.concatenate(ends), np.concatenate(hashes)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by a plain sort, which is many times faster here than ``np.unique``'s hash table."""
    y = np.sort(x)
    return y[np.concatenate(([True], y[1:] != y[:-1]))] if len(y) else y


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of ``keys``, and for each element whether its key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return order, twice


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a span [start, start + length)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:n]) > 0


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().decode("utf-8", "replace")


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def smallest(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of all their columns: rows of equal hash are equal, so it doesn't matter which of them are in.

    Only hashes are sorted to find the limit; then at most ``n`` rows are gathered.
    """
    h = F.xxhash64(*df.columns, F.lit(seed))
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(cut)).orderBy(h).limit(n) if cut is not None else df.limit(0)
