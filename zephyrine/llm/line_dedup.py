"""Line dedup by a segment-partition edit join.

Lines are the parts of a text between ``\\n``, trimmed of ASCII white space. Equal lines of at least
``exact_chars`` code points (``min_chars`` if that is not given; 1 takes every line that is not blank) are one
line; lines of at least ``min_chars`` are held against near ones as well. Lines within ``edits`` insertions, deletions or substitutions of
each other are linked; of every connected group of lines the earliest one, by id and line number, stays
and all its other occurrences go.

Equal lines are found by hash. For the rest, a line of length n is split into edits + 1 segments:
if two lines are within ``edits``, the longer one holds a segment of the shorter at a place that the two
lengths and the segment's number bound (the multi-match-aware positions). All lines put their segments
into an index, keyed by (length, segment number, content), and probe it with their substrings for every
length from theirs down to edits less; keys are 64-bit hashes, dealt by hash as sorted blocks, and only keys
that an index entry and a probe of different lines share come out. Such keys are the nodes of the same
pair join as near-dedup's (near_dup.py), where a histogram of the characters screens pairs and a
banded bit-parallel edit distance confirms them; small nodes give forests of links, a node of many lines is joined by a star first and
dealt to pairs of blocks only if its lines then lie in several groups.

Null texts and null ids pass unchanged. Ids are taken to be unique; a repeated row (same id, same
text) is treated as its first. Rows whose every line is a later copy come out
without words: empty, or with their blank lines alone. Columns other than key and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import BITS, PairJoin, bitmap, by_hot, held_in
from .pieces import bounds, join, pack, pack_sorted, split, unpack, unpack_sorted
from .spill import stored
from .textops import columns, combine, fresh, frugal, mix, slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
HISTOGRAM = 32
BLANK = b" \t\n\x0b\x0c\r"


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, line number, start and end byte of every line, trimmed."""
    doc, no, st, en = [], [], [], []
    for i in range(len(offsets) - 1):
        at = int(offsets[i])
        raw = data[at : int(offsets[i + 1])].tobytes()
        for k, line in enumerate(raw.split(b"\n")):
            left = len(line) - len(line.lstrip(BLANK))
            core = len(line.strip(BLANK))
            doc.append(i), no.append(k), st.append(at + left), en.append(at + left + core)
            at += len(line) + 1
    return (np.array(x, np.int64) for x in (doc, no, st, en))


def sums_of(values: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which every substring's hash follows; made in steps, so that no scratch memory grows with the text."""
    n = len(values)
    sums, inverse = np.zeros(n + 1, U), np.empty(n + 1, U)
    power, back = np.ones(1, U), np.ones(1, U)
    for a in range(0, n + 1, step):
        part = np.full(min(step, n + 1 - a), INVERSE)
        part[:1] = back
        np.multiply.accumulate(part, out=inverse[a : a + len(part)])
        back = inverse[a + len(part) - 1 : a + len(part)] * INVERSE
        now = values[a : a + step]
        if len(now):
            powers = np.full(len(now), BASE)
            powers[:1] = power
            np.multiply.accumulate(powers, out=powers)
            power = powers[-1:] * BASE
            np.cumsum(mix(now.astype(U) + U(77)) * powers, out=sums[a + 1 : a + 1 + len(now)])
            sums[a + 1 : a + 1 + len(now)] += sums[a]
    return sums, inverse


def substring(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))


class Lines:
    """Distinct lines of a slice of texts, as code points, with their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int, first_doc: int = 0, first_no: int = 0):
        doc, no, st, en = lines_of(data, offsets)
        no = no + first_no
        lead = np.concatenate(([0], np.cumsum((data[int(offsets[0]) : int(offsets[-1])] & 0xC0) != 0x80)))
        lo = int(offsets[0])
        a, b = lead[st - lo], lead[en - lo]
        ok = b - a >= min_chars
        doc = doc + first_doc
        self.doc, self.no, self.st, self.en, self.a, self.b = (x[ok] for x in (doc, no, st, en, a, b))
        text = data[lo : int(offsets[-1])].tobytes().decode("utf-8", "replace")
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.sums, self.inverse = sums_of(self.points)
        self.hash = substring(self.sums, self.inverse, self.a, self.b)


def lines_in(data: np.ndarray, offsets: np.ndarray, min_chars: int, most: int = 2 << 20) -> Iterator[Lines]:
    """The lines of all texts, in slices of about ``most`` bytes; a longer text is cut between lines."""
    for i, j in slices(offsets, most):
        a, end, no = int(offsets[i]), int(offsets[j]), 0
        if end - a <= most:
            yield Lines(data, offsets[i : j + 1], min_chars, i)
            continue
        while a <= end:
            stop = end
            at = a + most
            while at < end:
                ends = np.flatnonzero(data[at : min(at + most, end)] == 10)
                if len(ends):
                    stop = at + int(ends[0])
                    break
                at += most
            yield Lines(data, np.array([a, stop]), min_chars, i, no)
            no += int((data[a:stop] == 10).sum()) + 1
            a = stop + 1


def segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of length n: the last ones are longer by one."""
    size, longer = n // parts, n % parts
    first = parts - longer
    extra = np.maximum(i - first, 0)
    return i * size + extra, size + (i >= first)


def keys_of(lines: Lines, pick: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, which line each is of, and whether it is an index entry (else a probe)."""
    a, n = lines.a[pick], (lines.b - lines.a)[pick]
    parts = edits + 1
    ks, of, entry = [], [], []

    def add(length, i, start, size, where, is_entry):
        content = substring(lines.sums, lines.inverse, start, start + size)
        ks.append(combine(content, length.astype(U) * U(64) + U(i)))
        of.append(where)
        entry.append(np.full(len(where), is_entry))

    every = np.arange(len(pick))
    for i in range(parts):
        at, size = segment(n, i, parts)
        add(n, i, a + at, size, every, True)
        for less in range(edits + 1):
            short = n - less
            at, size = segment(short, i, parts)
            # Multi-match-aware: i edits at most before the segment, edits - i behind it.
            low = np.maximum(at - i, at + less - (edits - i))
            high = np.minimum(at + i, at + less + (edits - i))
            for d in range(2 * edits + 1):
                pos = low + d
                ok = (short >= parts) & (pos >= 0) & (pos <= high) & (pos + size <= n)
                if ok.any():
                    add(short[ok], i, (a + pos)[ok], size[ok], every[ok], False)
    return np.concatenate(ks), np.concatenate(of), np.concatenate(entry)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a bit-parallel automaton of a diagonal band."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    lo, hi, n = 0, 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= most
    # state[k]: bit i set if a[:i] can be made from what is read of b with k edits.
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    state = [(2 << k) - 1 for k in range(most + 1)]
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        band = ((1 << (2 * most + 2)) - 1) << max(0, j - most)
        old = 0
        for k in range(most + 1):
            was = state[k]
            new = (was & eq) << 1
            if k:
                new |= old | (old << 1) | (state[k - 1] << 1)
            old = was
            state[k] = new & band
        if not state[most]:
            return False
    return bool(state[most] >> len(a) & 1)


def closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """10,000 less the difference of two histograms; an edit changes it by two at most."""
    return 10_000 - np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)


def histogram(points: np.ndarray) -> bytes:
    return np.minimum(np.bincount(points % HISTOGRAM, minlength=HISTOGRAM), 255).astype(np.uint8).tobytes()


class LineJoin(PairJoin):
    agree_of = staticmethod(closeness)

    def __init__(self, src: DataFrame, edits: int, min_chars: int):
        self.spark, self.src, self.edits, self.min_chars = src.sparkSession, src, edits, min_chars
        self.least = 10_000 - 2 * edits

    def matches(self, buckets: int) -> DataFrame:
        """(path, g): keys that index entries and probes of different lines share, with those lines."""
        edits, min_chars = self.edits, self.min_chars

        @frugal
        def ask(batches):
            for b in batches:
                _, data, off = columns(b, "key", "text")
                for lines in lines_in(data, off, min_chars):
                    h, pick = np.unique(lines.hash, return_index=True)
                    if not len(h):
                        continue
                    key, of, entry = keys_of(lines, pick, edits)
                    order = np.argsort(key)
                    key, of, entry = key[order], of[order], entry[order]
                    at = bounds(key, buckets)
                    rows = [(k, join(pack_sorted(key[s:e]), pack(h[of[s:e]]), np.packbits(entry[s:e]).tobytes())) for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if s < e]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])

        @frugal
        def meet(batches):
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            now = None

            def emit():
                key, h, entry = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((h, key))
                key, h, entry = key[order], h[order], entry[order]
                new = np.concatenate(([True], key[1:] != key[:-1]))
                group = np.cumsum(new) - 1
                n = group[-1] + 1
                first = h[new][group]
                several = np.bincount(group, weights=h != first, minlength=n) > 0
                both = (np.bincount(group, weights=entry, minlength=n) > 0) & (np.bincount(group, weights=~entry, minlength=n) > 0)
                ok = (several & both)[group]
                ok[1:] &= (key[1:] != key[:-1]) | (h[1:] != h[:-1])  # a line once
                return pa.RecordBatch.from_arrays([pa.array(key[ok].view(np.int64)), pa.array(h[ok].view(np.int64))], ["path", "g"])

            for b in batches:
                for bucket, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if bucket != now and held:
                        yield emit()
                        held.clear()
                    now = bucket
                    k, h, e = split(body.as_py())
                    key = unpack_sorted(k)
                    held.append((key, unpack(h, U), np.unpackbits(np.frombuffer(e, np.uint8), count=len(key)).astype(bool)))
            if held:
                yield emit()

        asked = self.src.mapInArrow(ask, "bucket int, body binary")
        return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "path long, g long")

    def fetch(self, need: DataFrame) -> DataFrame:
        """(g, line, small) of the lines named by g, read again where they stand (through a bitmap of fixed size)."""
        shared = self.spark.sparkContext.broadcast(bitmap(need.select((F.pmod(F.col("g"), F.lit(1 << BITS)) + 1).alias("x"))))
        min_chars = self.min_chars

        @frugal
        def run(batches):
            for b in batches:
                _, data, off = columns(b, "key", "text")
                for lines in lines_in(data, off, min_chars):
                    h, pick = np.unique(lines.hash, return_index=True)
                    ok = held_in(shared.value, (h & U((1 << BITS) - 1)).astype(np.int64))
                    h, pick = h[ok], pick[ok]
                    text = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(lines.st[pick].tolist(), lines.en[pick].tolist(), strict=True)]
                    small = [histogram(lines.points[a:c]) for a, c in zip(lines.a[pick].tolist(), lines.b[pick].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(text, pa.string()), pa.array(small, pa.binary())], ["g", "line", "small"])

        return self.src.mapInArrow(run, "g long, line string, small binary").groupBy("g").agg(F.first("line").alias("line"), F.first("small").alias("small")).join(need, "g", "left_semi")

    def bodies(self, need: DataFrame) -> DataFrame:
        return self.texts.select("g", F.col("line").alias("body"))

    def judge(self):
        edits = self.edits
        return lambda lines: lambda x, others: np.array([within(lines[x], lines[y], edits) for y in others.tolist()], bool)

    def run(self, buckets: int) -> DataFrame | None:
        """Components of near lines: (node, label); None if no two lines are near."""
        nodes = stored(self.matches(buckets))
        self.texts = stored(self.fetch(nodes.select("g").distinct()))
        members = nodes.join(self.texts.select("g", "small"), "g").select("path", "g", F.col("g").alias("label"), F.lit(0).cast("long").alias("key"), "small")
        found = self.find(members, nodes.groupBy("path").agg(F.count("*").alias("n")), nodes.count())
        again = self.absorb(found)
        units = self.units(self.unresolved(found))
        self.settle(units if again is None else units.unionByName(again))
        return self.labels


def removed_lines(src: DataFrame, edits: int, min_chars: int, exact_chars: int) -> DataFrame:
    """(key, exact, near): for every text with a line to remove, the numbers of those lines by reason."""

    @frugal
    def run(batches):
        for b in batches:
            ids, data, off = columns(b, "key", "text")
            for lines in lines_in(data, off, exact_chars):
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash.view(np.int64)), pa.array(ids[lines.doc]), pa.array(lines.no.astype(np.int32))], ["g", "key", "no"])

    spark = src.sparkSession
    seen = stored(src.mapInArrow(run, "g long, key long, no int"))
    first = stored(seen.groupBy("g").agg(F.min(F.struct("key", "no")).alias("first"), F.count("*").alias("n")))
    total = seen.count()
    job = LineJoin(src, edits, min_chars)
    labels = job.run(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000))  # buckets follow the input
    whole = first.withColumn("lead", F.col("first"))
    if labels is not None:
        linked = stored(first.join(labels.withColumnRenamed("node", "g"), "g").select("g", "first", "label"))
        groups = stored(linked.groupBy("label").agg(F.min("first").alias("lead"), F.count("*").alias("n")))
        leads = by_hot(linked, groups.select("label", "lead"), "label", groups.select("label", "n"), labels.count()).select("g", "lead")
        whole = first.join(leads, "g", "left").withColumn("lead", F.coalesce("lead", "first"))
    # Only lines that occur again, or that are near an earlier one, are joined to their occurrences;
    # the most frequent ones, fewer than 1000, by a broadcast.
    part = stored(whole.where((F.col("n") > 1) | (F.col("first") != F.col("lead"))).select("g", "first", "lead", "n"))
    hot_size = max(total // 1000, 1)
    hot = F.broadcast(part.where(F.col("n") > hot_size).drop("n"))
    rest = seen.join(F.broadcast(part.where(F.col("n") > hot_size).select("g")), "g", "left_anti")
    hits = seen.join(hot, "g").unionByName(rest.join(part.where(F.col("n") <= hot_size).drop("n"), "g"))
    place = F.struct("key", "no")
    gone = hits.where((place != F.col("first")) | (F.col("first") != F.col("lead")))
    near = F.col("first") != F.col("lead")
    return gone.groupBy("key").agg(F.collect_set(F.when(~near, F.col("no"))).alias("exact"), F.collect_set(F.when(near, F.col("no"))).alias("near"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 24, exact_chars: int | None = None, exact: str = "lines_exact", near: str = "lines_near") -> DataFrame:
    """``docs`` with its lines deduplicated, and two more columns, ``exact`` and ``near``: the numbers of the lines removed (null: none).

    Columns of ``docs`` that have these names already are replaced.
    """
    docs = docs.drop(exact, near)
    src = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).where("key is not null and text is not null")
    least = min_chars if exact_chars is None else min(max(exact_chars, 1), min_chars)  # blank lines stay
    k = fresh(docs, "__k")
    gone = stored(removed_lines(src, edits, min_chars, least)).select(F.col("key").alias(k), F.col("exact").alias(exact), F.col("near").alias(near))
    both = docs.join(gone.hint("merge"), docs[key].cast("long") == gone[k], "left").drop(k)
    drop = F.array_union(F.col(exact), F.col(near))
    kept = F.concat_ws("\n", F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(drop, i.cast("int"))))
    return both.withColumn(text, F.when(F.size(drop) > 0, kept).otherwise(F.col(text)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, exact_chars=1)
    count = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long")
    return out.select("doc_id", count("lines_exact").alias("n_exact"), count("lines_near").alias("n_near"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))
