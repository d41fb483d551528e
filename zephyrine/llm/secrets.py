"""Secret scans: fixed patterns, and guess-cost segmentation of values in a credential context.

``scan`` finds, per text, three kinds of base spans (assign, access, hex) and the method's own
kind, ``guess``: a value that stands after a credential word and that no cheap segmentation
explains. The cost of a value is the minimum over all its segmentations, by dynamic programming,
of the sum of log10 guesses of its pieces: listed words, dates and years, repeats, keyboard
walks, and brute-force spans. Values costing ``min_log10_guesses`` or more are reported. A value is
taken to its end, however long; places that no segmentation under that cost reaches are not searched.

Null or empty texts have no spans. Ties between segmentations do not matter: only the cost is
used. Repeated rows give repeated results; other columns of the input are not read. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import frugal, sha256

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words before a value that make it a credential.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "auth_key", "credential", "credentials", "bearer")
CONTEXT = re.compile(r"""(?ai:(?<![a-z])(?:%s))["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+)["'`]?([^\x09-\x0D\x20"'`,;<>|]{6,})""" % "|".join(map(re.escape, sorted(CONTEXT_WORDS, key=len, reverse=True))))
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "bearer")
#: Words that people choose, the likeliest first.
COMMON_WORDS = ("password", "admin", "welcome", "login", "letmein", "master", "secret", "dragon", "monkey", "football", "baseball", "shadow", "sunshine", "princess", "iloveyou", "trustno", "hello", "freedom", "whatever", "starwars", "computer", "internet", "test", "user", "root", "guest", "default", "change", "changeme", "example", "sample", "demo", "temp", "public", "private", "server", "system", "manager", "summer", "winter", "spring", "autumn", "love", "money", "token", "pass", "word", "key", "my", "the", "your", "new", "old", "none", "null", "true", "false", "value", "string", "here", "insert", "replace", "foo", "bar", "baz", "dummy", "placeholder")
RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
#: Rows of keys that lie side by side.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0987654321", "poiuytrewq", "lkjhgfdsa", "mnbvcxz")
LEET = str.maketrans("@431!05$7", "aaeiiosst")
NEXT = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
_YEAR, _MONTH, _DAY, _SEP = "(?:19|20)\\d\\d", "(?:1[0-2]|0?[1-9])", "(?:[12]\\d|3[01]|0?[1-9])", "[-/._]?"
DATES = [re.compile(x) for x in (_YEAR + _SEP + _MONTH + _SEP + _DAY, _DAY + _SEP + _MONTH + _SEP + _YEAR, _YEAR)]
LONGEST_WORD = max(map(len, COMMON_WORDS))
#: Repeats and walks of more code points than this start and end only so near to their ends.
EDGE = 128


def _size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _ends(i: int, first: int, end: int, step: int, least: int) -> Iterable[int]:
    """Ends of pieces from i, every ``step`` from ``least`` steps on, in a repeat or walk found at ``first`` that goes to ``end``.

    Two such pieces of one repeat or walk cost more than one over both, so of a long one only places near its two ends matter.
    """
    if i - first >= EDGE:
        return ()
    most = (end - i) // step
    near = EDGE // step
    if most <= 2 * near:
        return range(i + least * step, i + most * step + 1, step)
    return chain(range(i + least * step, i + near * step + 1, step), range(i + (most - near) * step, i + most * step + 1, step))


def guess_cost(value: str, limit: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value`` (0 for an empty one); infinite if not under ``limit``.

    Every piece after the first adds log10(2) for the choice of where it ends, which keeps a
    value from being cut into many tiny pieces at no price.
    """
    return _guess_cost(value, limit) if len(value) <= EDGE else _guess_cost.__wrapped__(value, limit)


@lru_cache(1 << 14)
def _guess_cost(value: str, limit: float) -> float:
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    far = 0
    runs: dict[int, tuple[int, int]] = {}  # by width (0: walks): the repeat that was found last, its first place and its end

    def run(i: int, width: int) -> tuple[int, int]:
        first, end = runs.get(width, (0, 0))
        if i + max(width, 1) >= end:
            first, end = i, i + max(width, 1)
            while end < n and (value[end] == value[end - width] if width else low[end - 1] + low[end] in NEXT):
                end += 1
            runs[width] = first, end
        return first, end

    for i in range(n):
        if i > far:
            return math.inf
        start = best[i] + (math.log10(2) if i else 0.0)
        if start >= limit or best[i] == math.inf:
            continue
        pieces: list[tuple[int, float]] = []
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            r = RANK.get(low[i:j])
            leet = r is None
            r = r or RANK.get(plain[i:j])
            if r:
                case = 0.0 if value[i:j] == low[i:j] else 0.31 if value[i:j] in (low[i:j].upper(), low[i:j].capitalize()) else 0.31 * (j - i)
                pieces.append((j, math.log10(r + 1) + case + 0.61 * leet))
        first, end = run(i, 1)
        pieces.extend((k, math.log10(_size(value[i]) * (k - i))) for k in _ends(i, first, end, 1, 3))
        unit = math.log10(_size(value[i]))
        for width in range(2, (n - i) // 2 + 1):
            unit += math.log10(_size(value[i + width - 1]))
            if start + unit >= limit:
                break
            first, end = run(i, width)
            pieces.extend((k, unit + math.log10((k - i) // width)) for k in _ends(i, first, end, width, 2))
        first, end = run(i, 0)
        pieces.extend((k, math.log10(47 * (k - i))) for k in _ends(i, first, end, 1, 3))
        for form in DATES:
            if m := form.match(value, i):
                pieces.append((m.end(), math.log10(119 if m.end() - i == 4 else 365 * 119)))
        for j, cost in pieces:
            if start + cost < min(best[j], limit):
                best[j] = start + cost
                far = max(far, j)
        cost = 0.0
        for j in range(i + 1, n + 1):  # a brute-force span of any length
            cost += math.log10(_size(value[j - 1]))
            if start + cost >= limit:
                break
            if start + cost < best[j]:
                best[j] = start + cost
                far = max(far, j)
            elif j > i + 1 and start + cost >= best[j] + math.log10(2):
                break  # a span from there on is no dearer
    return best[n]


def spans_of(text: str, min_log10_guesses: float = 10.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of one text, by start and then kind as listed."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    if any(h in low for h in HINTS):
        assign = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        out += [("assign", a, b) for a, b in assign]
        near = 0  # spans of both patterns come in order and don't overlap their own kind
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            while b - a > 6 and text[b - 1] in ".!?)]}":
                b -= 1
            while near < len(assign) and assign[near][1] < b:
                near += 1
            if not (near < len(assign) and assign[near][0] <= a) and guess_cost(text[a:b], min_log10_guesses) >= min_log10_guesses:
                out.append(("guess", a, b))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", min_log10_guesses: float = 10.0) -> DataFrame:
    """One row per input row: the key, and ``found``: array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @frugal
    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py(), min_log10_guesses)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["key", "found"])

    src = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))
    return src.mapInArrow(run, "key long, found array<struct<kind:string,start:long,end:long>>").withColumnRenamed("key", key)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``scan`` over all whole texts of documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ("assign", "access", "hex")

    @frugal
    def digest(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for x in b.column(1).to_pylist():
                marks = [f"{s['kind']}:{s['start']}:{s['end']}" for s in x]
                kinds = [s["kind"] for s in x]
                for i, k in enumerate(base):
                    cols[i].append(kinds.count(k))
                cols[3].append(sha256(",".join(m for m, k in zip(marks, kinds, strict=True) if k in base).encode()))
                cols[4].append(",".join(marks))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
