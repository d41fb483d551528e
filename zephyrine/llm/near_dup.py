"""MinHash near-dedup by chosen paths.

A text's set is its distinct w-word shingles. Texts with equal sets are one *class*, named by a
64-bit hash of the set, so that copies cost nothing more. Classes are joined by chosen paths: in each of
``trees`` independent trees a class follows, from every node, ``branch`` coordinates that the node
picks by its own hash, to the child named by its minwise token there; so each class knows its
nodes without seeing others, and a pair of similarity s meets in a child with probability s for
each coordinate. A first pass counts the nodes at depth ``first``; classes alone in a node don't travel.

Nodes of at most ``small`` classes are compared exhaustively by their sketches, inside one
task; of the pairs that may be similar only a spanning forest comes out, the likeliest pairs first, so
a node never gives more rows than it has members. A larger node links all its classes to its smallest one (a star).
These links are confirmed on the full sets. What is left is settled inside tasks, on full sets: small nodes
of which a link was refuted, and large nodes whose classes then lie in several components:
their members go to blocks of ``block``, those outside the node's largest component to all of them. There every
pair that may be similar and lies between components is found by the sketches; the members of such pairs, once for all
nodes that hold the same ones, then travel with their full sets, pairs are verified, and only true links come out, again as a forest.
Large nodes for which that would take more than three times their members are branched again instead, down to depth ``last``.

Chance of missing a pair: at similarity 0.8 a tree with branch 2 misses it with 0.06, four trees
with 1.3e-5; above that less. A sketch hides a true link with less than 2e-6.

Nodes, classes and components with more than a thousandth of all rows, of which there are fewer than a
thousand, are split off by a broadcast of that bounded size; all others are spread by hash. No pairs are
emitted for a group, and components, links and sets stay in Spark.

Null texts, texts without words and null ids are linked with nothing. Repeated rows are members of
the same class. Ties in likeliness go by name. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .pieces import pack_sorted, unpack_sorted
from .spill import stored
from .textops import columns, combine, distinct, frugal, mix, slices, words

U = np.uint64
SKETCH = 64
_RNG = np.random.default_rng(77)
MULTIPLY = _RNG.integers(1, 2**63, SKETCH, dtype=U) * U(2) + U(1)
ADD = _RNG.integers(0, 2**63, SKETCH, dtype=U)
AGREE = 35  # of 64; a pair of similarity 0.8 has fewer with probability under 2e-6
BITS = 24


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For every text, its sorted distinct shingle hashes."""
    n = len(offsets) - 1
    doc, _, _, h = words(data, offsets)
    edges = np.searchsorted(doc, np.arange(n + 1))
    key = h
    for j in range(1, width):
        key = combine(key[:-1], h[j:]) if len(key) > 1 else key[:0]
    out = []
    for i in range(n):
        a, b = int(edges[i]), int(edges[i + 1])
        if b - a >= width:
            out.append(distinct(key[a : b - width + 1]))
        elif b > a:  # the whole sequence is one shingle
            whole = h[a : a + 1]
            for j in range(a + 1, b):
                whole = combine(whole, h[j : j + 1])
            out.append(mix(whole + U(b - a)))
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> int:
    return int(np.add.reduce(mix(s + U(len(s)))).view(np.int64))


def sketches(all_sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values, one row of SKETCH 32-bit numbers for each non-empty set."""
    flat = np.concatenate(all_sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in all_sets])[:-1]))
    out = np.empty((len(all_sets), SKETCH), np.uint32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat((flat * MULTIPLY[k] + ADD[k]) >> U(32), at)
    return out


def _measure(width: int):
    kinds = [pa.int64(), pa.int64(), pa.binary()]

    @frugal
    def run(batches):
        for b in batches:
            _, data, off = columns(b, "key", "text")
            for i, j in slices(off, 2 << 20):
                ss = sets(data, off[i : j + 1], width)
                full = [s for s in ss if len(s)]
                rows = iter(sketches(full)) if full else iter(())
                cols = zip(*((len(s), signature(s), next(rows).tobytes()) if len(s) else (0, None, None) for s in ss), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key", "n_shingles", "g", "sketch"])

    return run


def step(path: np.ndarray, sketch: np.ndarray, branch: int) -> np.ndarray:
    """Children of each (path, sketch) row: ``branch`` columns."""
    out = np.empty((len(path), branch), U)
    for j in range(branch):
        at = (mix(path + U(j + 1)) % U(SKETCH)).astype(np.int64)
        value = sketch[np.arange(len(path)), at].astype(U)
        out[:, j] = mix(path * U(0x9E3779B97F4A7C15) + (value << U(8)) + at.astype(U) + U(j << 48))
    return out


def _sketch_rows(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _small(sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What is compared: one byte of each minwise value, then the set's size in four."""
    return np.hstack(((sketch & np.uint32(255)).astype(np.uint8), n.astype("<u4").view(np.uint8).reshape(-1, 4)))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of two blocks of sketches; none where the sizes alone rule the pair out."""
    equal = (x[:, :SKETCH] == y[:, :SKETCH]).sum(axis=1)
    a, b = (np.ascontiguousarray(z[:, SKETCH:]).view("<u4").reshape(-1).astype(np.int64) for z in (x, y))
    return np.where(5 * np.minimum(a, b) >= 4 * np.maximum(a, b), equal, 0)


#: A class in a node: who else knows its key is the operator's matter.
MEMBER = "path long, g long, label long, key long, small binary"
MEMBERS = ["path", "g", "label", "key", "small"]


def _member_rows(path: np.ndarray, g: np.ndarray, label: np.ndarray, key: np.ndarray, small: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (path, g, label, key)] + [_binary(small)], MEMBERS)


def _binary(rows: np.ndarray) -> pa.Array:
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes_of(col, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)


def _walk(trees: int, depth: int, branch: int, g: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of all nodes of one depth."""
    at = np.repeat(np.arange(len(g)), trees)
    path = np.tile(mix(np.arange(1, trees + 1, dtype=U)), len(g))
    for _ in range(depth):
        path = step(path, sk[at], branch).reshape(-1)
        at = np.repeat(at, branch)
    return at, path


def _places(path: np.ndarray) -> np.ndarray:
    return (path & U((1 << BITS) - 1)).astype(np.int64)


def _paths(trees: int, depth: int, branch: int):
    """(g, key, n, sketch) -> path of every node."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                _, path = _walk(trees, depth, branch, part.column(0).to_numpy(), _sketch_rows(part.column(3)))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64))], ["path"])

    return run


def _entries(trees: int, depth: int, branch: int, shared):
    """(g, key, n, sketch) -> members of the nodes whose place the bitmap holds."""

    @frugal
    def run(batches):
        bits = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                g, key, n, sk = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), _sketch_rows(part.column(3))
                at, path = _walk(trees, depth, branch, g, sk)
                ok = held_in(bits, _places(path))
                at, path = at[ok], path[ok]
                yield _member_rows(path, g[at], g[at], key[at], _small(sk, n)[at])

    return run


def _deeper(branch: int):
    """(path, g, label, key, n, sketch) -> members of the children."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 20000):
                part = b.slice(i, 20000)
                path, g, label, key, n = (part.column(k).to_numpy() for k in range(5))
                sk = _sketch_rows(part.column(5))
                children = step(path.view(U), sk, branch).reshape(-1)
                at = np.repeat(np.arange(len(sk)), branch)
                yield _member_rows(children, g[at], label[at], key[at], _small(sk, n)[at])

    return run


def bitmap(marks: DataFrame) -> np.ndarray:
    """Which of 2**BITS places the column x (from 1) holds: 2 MB of packed bits, whatever its rows."""
    parts = marks.groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).collect()
    size = 1 << 12
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in parts:
        out[(r.k - 1) * size : r.k * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def held_in(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the packed bits hold each place (from 0)."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _candidates(rows: list[np.ndarray], agree_of, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one node's rows in two components that may be similar: nodes in order, the likeliest pair first."""
    path, _, label, _, small = rows
    new = np.concatenate(([True], path[1:] != path[:-1]))
    node = np.cumsum(new) - 1
    longest = int(np.bincount(node).max()) if len(node) else 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for shift in range(1, longest):
        x = np.flatnonzero((node[shift:] == node[:-shift]) & (label[shift:] != label[:-shift]))
        for k in range(0, len(x), 50_000):
            i = x[k : k + 50_000]
            agree = agree_of(small[i], small[i + shift])
            ok = agree >= least
            found.append((i[ok], i[ok] + shift, agree[ok]))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e
    i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i, -agree, node[i]))
    return i[order], j[order]


def _forest(i: np.ndarray, j: np.ndarray, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs, in order, link two components of their node that weren't linked yet."""
    keep, now, up = np.zeros(len(i), bool), -1, {}
    for k, (n, x, y) in enumerate(zip(node[i].tolist(), label[i].tolist(), label[j].tolist(), strict=True)):
        if n != now:
            now, up = n, {}
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        while up.setdefault(y, y) != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


EDGE, SMALL_MEMBER, LARGE_MEMBER = 0, 1, 2
FOUND = "kind int, path long, a long, b long, ka long, kb long, label long, small binary"
NAMES = ["kind", "path", "a", "b", "ka", "kb", "label", "small"]


def _found(kind: int, path, a, b=None, ka=None, kb=None, label=None, small=None) -> pa.RecordBatch:
    n = len(path)
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (path, a, b, ka, kb, label)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *longs, pa.nulls(n, pa.binary()) if small is None else _binary(small)], NAMES)


def _take(b: pa.RecordBatch) -> list[np.ndarray]:
    return [*(b.column(k).to_numpy() for k in range(4)), _bytes_of(b.column(4), b.num_rows)]


def _star(pivot: list, rows: list[np.ndarray], agree_of, least: int) -> Iterator[pa.RecordBatch]:
    """Links of a large node's rows with its pivot, and the rows."""
    path, g, label, key, small = rows
    if len(path):
        ok = (agree_of(small, np.broadcast_to(pivot[4], small.shape)) >= least) & (label != pivot[2])
        if ok.any():
            one = lambda k: np.full(int(ok.sum()), pivot[k])
            yield _found(EDGE, path[ok], one(1), g[ok], one(3), key[ok])
        yield _found(LARGE_MEMBER, path, g, ka=key, label=label, small=small)


def _compare(agree_of, least: int, most: int):
    """Members sorted by path and name -> FOUND rows; a large node is read as a stream."""

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        path = rows[0]
        edges = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
        size = np.repeat(np.diff(edges), np.diff(edges))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e - s > most:
                part = [c[s:e] for c in rows]
                yield from _star([c[0] for c in part], part, agree_of, least)
        few = np.flatnonzero((size > 1) & (size <= most))
        if not len(few):
            return
        rows = [c[few] for c in rows]
        path, g, label, key, small = rows
        node = np.cumsum(np.concatenate(([True], path[1:] != path[:-1]))) - 1
        i, j = _candidates(rows, agree_of, least)
        if not len(i):
            return
        involved = distinct(np.concatenate((i, j)))
        keep = _forest(i, j, node, label)
        i, j = i[keep], j[keep]
        yield _found(EDGE, path[i], g[i], g[j], key[i], key[j])
        yield _found(SMALL_MEMBER, path[involved], g[involved], ka=key[involved], label=label[involved], small=small[involved])

    @frugal
    def run(batches):
        held: list[np.ndarray] | None = None  # rows of the last node, which may go on
        pivot: list | None = None  # or its first row, once it is known to be large
        for b in batches:
            rows = _take(b)
            if not len(rows[0]):
                continue
            if pivot is not None:
                other = rows[0] != pivot[0]
                k = int(other.argmax()) if other.any() else len(other)
                yield from _star(pivot, [c[:k] for c in rows], agree_of, least)
                if k == len(other):
                    continue
                rows, pivot = [c[k:] for c in rows], None
            if held is not None:
                rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
            s = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - s > most:
                pivot = [c[s] for c in rows]
                yield from _star(pivot, [c[s:] for c in rows], agree_of, least)
            else:
                held = [c[s:] for c in rows]
            if s:
                yield from whole([c[:s] for c in rows])
        if held is not None:
            yield from whole(held)

    return run


def _near(agree_of, least: int):
    """A function of sketches, a row and others: which of them may be similar to it."""
    return lambda small, x, others: others[agree_of(small[others], np.broadcast_to(small[x], (len(others), small.shape[1]))) >= least] if len(others) else others


def _unitwise(settled):
    """A function for ``mapInArrow`` that gives the batches of every unit (sorted by path) with several components to ``settled``."""

    @frugal
    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            path = b.column(0).to_numpy()
            at = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True]))) if len(path) else []
            for s, e in zip(at[:-1], at[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != path[s]:
                    yield from unit(held)
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield from unit(held)

    def unit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(x) for x in zip(*(_take(b) for b in held), strict=True)]
        if (rows[2] != rows[2][0]).any():
            yield from settled(rows, held)

    return run


def _open(agree_of, least: int):
    """Units (path, g, label, key, small), sorted by path and name -> the members of pairs that may be similar and lie between components.

    Members that such pairs connect are a unit of their own, named by its members: so one that several nodes hold is one.
    """
    near = _near(agree_of, least)

    def whole(rows: list[np.ndarray], _) -> Iterator[pa.RecordBatch]:
        # Rows are held against the others one by one, so memory grows with the rows, not the pairs. Of any two components, one isn't the largest.
        _, g, label, _, small = rows
        names, size = np.unique(label, return_counts=True)
        rest, part = label != names[size.argmax()], np.arange(len(g))
        alone, every = np.ones(len(g), bool), np.arange(len(g))
        for x in np.flatnonzero(rest).tolist():
            others = near(small, x, np.flatnonzero((label != label[x]) & (~rest | (every > x))))
            if len(others):
                alone[x] = alone[others] = False
                one = np.zeros(len(g), bool)
                one[part[x]] = one[part[others]] = True
                part[one[part]] = part[x]
        pick = np.flatnonzero(~alone)
        if len(pick):
            name = np.zeros(len(g), U)
            np.add.at(name, part[pick], mix(g[pick].view(U)))
            yield _member_rows(mix(name[part[pick]]), *(c[pick] for c in rows[1:]))

    return _unitwise(whole)


def _settle(agree_of, least: int, judge):
    """Units (path, g, label, key, small, body), sorted by path and name -> true links between components, as a forest.

    ``judge(bodies)`` gives a function of a row and others: which of them are truly similar to it.
    """
    near = _near(agree_of, least)

    def whole(rows: list[np.ndarray], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Again one by one. The first pass counts open pairs; the second verifies, rows with the most pairs first.
        bodies = [x for b in held for x in b.column(5).to_pylist()]
        _, g, label, _, small = rows
        names, size = np.unique(label, return_counts=True)
        rest, degree = label != names[size.argmax()], np.zeros(len(g), np.int64)
        every = np.arange(len(g))
        for x in np.flatnonzero(rest).tolist():
            others = near(small, x, np.flatnonzero((label != label[x]) & (~rest | (every > x))))
            degree[x] += len(others)
            degree[others] += 1
        true_of = judge(bodies)
        open_ = np.ones(len(g), bool)
        a, b = [], []
        for x in np.argsort(-degree, kind="stable").tolist():
            open_[x] = False
            others = near(small, x, np.flatnonzero(open_ & (label != label[x])))
            if not len(others):
                continue
            for y in others[true_of(x, others)].tolist():
                if label[x] != label[y]:
                    a.append(g[x]), b.append(g[y])
                    label[label == label[y]] = label[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _unitwise(whole)


class PairJoin:
    """Links between classes that share a node, found without listing the pairs of a group."""

    agree_of = staticmethod(agreement)
    least = AGREE
    small = 128
    block = 1024  # members of a block when a node is dealt to blocks
    body = "binary"
    spark: SparkSession
    labels: DataFrame | None = None  # (node, label) of classes that have links

    def bodies(self, need: DataFrame) -> DataFrame:
        """(g, body) for the classes (g, key), and maybe more."""
        raise NotImplementedError

    def judge(self):
        """A function of bodies, see ``_settle``."""
        raise NotImplementedError

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The true links of (a, b, ka, kb)."""
        full = self.bodies(pairs.select(F.col("a").alias("g"), F.col("ka").alias("key")).unionByName(pairs.select(F.col("b").alias("g"), F.col("kb").alias("key"))).distinct())
        judge = self.judge()

        @frugal
        def run(batches):
            one = np.array([1])
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    keep = [bool(judge([x, y])(0, one)[0]) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = pairs.select("a", "b").join(full.withColumnsRenamed({"g": "a", "body": "x"}), "a")
        both = left.join(full.withColumnsRenamed({"g": "b", "body": "y"}), "b").select("a", "b", "x", "y")
        return both.mapInArrow(run, "a long, b long")

    def find(self, members: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
        """FOUND rows of members (MEMBER); ``sizes`` has (path, n) of their nodes of two or more."""
        hot_size = max(self.small, total // 1000)
        hot = stored(sizes.where(F.col("n") > hot_size).select("path"))  # fewer than 1000
        compare = _compare(self.agree_of, self.least, self.small)
        if not hot.limit(1).count():
            return stored(members.repartition("path").sortWithinPartitions("path", "g").mapInArrow(compare, FOUND))
        members = stored(members)
        rest = members.join(F.broadcast(hot), "path", "left_anti").select(*MEMBERS)
        out = rest.repartition("path").sortWithinPartitions("path", "g").mapInArrow(compare, FOUND)
        mine = members.join(F.broadcast(hot), "path", "left_semi").select(*MEMBERS)
        pivots = stored(mine.groupBy("path").agg(F.min(F.struct("g", "label", "key", "small")).alias("pivot")))
        agree_of, least = self.agree_of, self.least

        @frugal
        def stars(batches):
            for b in batches:
                if b.num_rows:
                    rows, pivot = _take(b), b.column(5)
                    ok = (agree_of(rows[4], _bytes_of(pivot.field("small"), b.num_rows)) >= least) & (rows[2] != pivot.field("label").to_numpy())
                    if ok.any():
                        yield _found(EDGE, rows[0][ok], pivot.field("g").to_numpy()[ok], rows[1][ok], pivot.field("key").to_numpy()[ok], rows[3][ok])
                    yield _found(LARGE_MEMBER, rows[0], rows[1], ka=rows[3], label=rows[2], small=rows[4])

        return stored(out.unionByName(mine.join(F.broadcast(pivots), "path").select(*MEMBERS, "pivot").mapInArrow(stars, FOUND)))

    def labelled(self, df: DataFrame) -> DataFrame:
        """``df`` with its classes' present components as ``label``."""
        if self.labels is None:
            return df.withColumn("label", F.col("g"))
        return df.drop("label").join(self.labels.select(F.col("node").alias("g"), "label"), "g", "left").withColumn("label", F.coalesce("label", "g"))

    def link(self, links: DataFrame) -> None:
        """Add confirmed links (stored): components of the components they join."""
        if not links.limit(1).count():
            return
        if self.labels is None:
            self.labels = stored(components(links))
            return
        for x in ("a", "b"):
            links = self.labelled(links.withColumnRenamed(x, "g")).select("label", *({"a", "b"} - {x})).withColumnRenamed("label", x)
        comp = stored(components(links))
        old = self.labels.withColumnRenamed("label", "mid").join(comp.select(F.col("node").alias("mid"), "label"), "mid", "left").select("node", F.coalesce("label", "mid").alias("label"))
        new = comp.join(self.labels.select("node"), "node", "left_anti").select("node", "label")
        self.labels = stored(old.unionByName(new))

    def absorb(self, found: DataFrame) -> DataFrame | None:
        """Confirm and link what was found; small nodes' members of which a link was refuted: (path, g, key, small)."""
        edges = found.where(F.col("kind") == EDGE)
        pairs = stored(edges.groupBy("a", "b").agg(F.min("ka").alias("ka"), F.min("kb").alias("kb")))
        if not pairs.limit(1).count():
            return None
        links = stored(self.confirm(pairs))
        self.link(links)
        refuted = stored(pairs.join(links, ["a", "b"], "left_anti").select("a", "b"))
        bad = edges.select("path", "a", "b").join(refuted, ["a", "b"], "left_semi").select("path").distinct()
        return found.where(F.col("kind") == SMALL_MEMBER).join(bad, "path", "left_semi").select("path", F.col("a").alias("g"), F.col("ka").alias("key"), "small")

    def unresolved(self, found: DataFrame) -> DataFrame:
        """Members of large nodes that hold several components: (path, g, key, small), the node's size ``n`` and number of
        ``blocks``, whether a member is ``apart`` from the node's largest component, and how many (``k``) are."""
        large = found.where(F.col("kind") == LARGE_MEMBER).select("path", F.col("a").alias("g"), F.col("ka").alias("key"), "small")
        lab = stored(self.labelled(large).select(*MEMBERS))
        parts = lab.groupBy("path", "label").agg(F.count("*").alias("c"))
        nodes = stored(parts.groupBy("path").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top")))
        open_ = nodes.where("top.c < n").select("path", "n", F.col("top.label").alias("most"), (F.col("n") - F.col("top.c")).alias("k"))
        mine = by_hot(lab, open_, "path", nodes, lab.count()).where("n is not null")
        return stored(mine.select("path", "g", "key", "small", "n", "k", (F.col("label") != F.col("most")).alias("apart"), F.ceil(F.col("n") / self.block).cast("long").alias("blocks")))

    @staticmethod
    def units(open_: DataFrame) -> DataFrame:
        """Members dealt to blocks, (path, g, key, small): those apart from the largest component to every block, the others to one.

        So all pairs between components meet; others lie in the largest component.
        """
        one = F.array(F.pmod(F.xxhash64("g"), F.col("blocks")))
        dealt = open_.withColumn("i", F.explode(F.when(F.col("apart"), F.expr("sequence(0L, blocks - 1)")).otherwise(one)))
        return dealt.select(F.xxhash64("path", "i").alias("path"), "g", "key", "small")

    def settle(self, units: DataFrame) -> None:
        """Verify all pairs between components within units (path, g, key, small), and link. Only members of open pairs, by their sketches, travel with their bodies."""
        units = self.labelled(units).select(*MEMBERS).repartition("path").sortWithinPartitions("path", "g")
        units = stored(units.mapInArrow(_open(self.agree_of, self.least), MEMBER).dropDuplicates(["path", "g"]))
        if not units.limit(1).count():
            return
        full = self.bodies(units.select("g", "key").distinct())
        run = _settle(self.agree_of, self.least, self.judge())
        dealt = units.join(full, "g").select(*MEMBERS, "body").repartition("path").sortWithinPartitions("path", "g")
        self.link(stored(dealt.mapInArrow(run, "a long, b long")))


class _Overlap:
    """Which of several packed sets are similar enough to one of them. Sets are held as places of four bytes among all distinct elements."""

    def __init__(self, bodies: list[bytes], percent: int, most: int = 1 << 20):
        known, part, held, once = np.zeros(0, U), [], 0, True
        for b in bodies:
            part.append(unpack_sorted(b))
            held += len(part[-1])
            if held > max(most, len(known)):
                known, part, held, once = distinct(np.concatenate([known, *part])), [], 0, False
        known = distinct(np.concatenate([known, *part]))
        places = [np.searchsorted(known, s).astype(np.int32) for s in (part if once else map(unpack_sorted, bodies))]
        self.percent = percent
        self.size = np.array([len(p) for p in places], np.int64)
        self.stops = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.concatenate(places)
        self.mark = np.zeros(len(known), bool)

    def __call__(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.stops[x] : self.stops[x + 1]]
        self.mark[own] = True
        if len(others) * 4 > len(self.size):
            both = np.add.reduceat(self.mark[self.flat], self.stops[:-1], dtype=np.int64)[others]
        else:
            both = np.array([int(self.mark[self.flat[self.stops[y] : self.stops[y + 1]]].sum()) for y in others.tolist()], np.int64)
        self.mark[own] = False
        return 100 * both >= self.percent * (self.size[x] + self.size[others] - both)


class SetJoin(PairJoin):
    """State of one similarity join of shingle sets."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int, branch: int, small: int):
        self.spark = docs.sparkSession
        self.src = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
        self.width, self.percent, self.branch, self.small = width, percent, branch, small
        self.measured = stored(self.src.mapInArrow(_measure(width), "key long, n_shingles long, g long, sketch binary"))
        known = self.measured.where("g is not null and key is not null")
        self.classes = stored(known.groupBy("g").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))

    full: DataFrame | None = None  # (g, body): full sets fetched so far

    def bodies(self, need: DataFrame) -> DataFrame:
        """Fetch the full sets of classes, again from the texts.

        Texts pass a bitmap of the wanted ids, of fixed size, where they are read, so only the sets
        that are wanted (and a few more) are made; the join behind it is exact, one set a class.
        """
        if self.full is not None:
            need = need.join(self.full.select("g"), "g", "left_anti")
        need = stored(need)
        if self.full is not None and not need.limit(1).count():
            return self.full
        place = F.pmod(F.xxhash64("key"), F.lit(1 << BITS)) + 1  # bitmaps count from 1
        shared = self.spark.sparkContext.broadcast(bitmap(need.select(place.alias("x"))))
        width = self.width

        @frugal
        def chosen(batches):
            for b in batches:
                b = b.filter(pa.array(held_in(shared.value, b.column(2).to_numpy() - 1)))
                if not b.num_rows:
                    continue
                _, data, off = columns(b, "key", "text")
                for i, j in slices(off, 2 << 20):
                    gs, bodies = [], []
                    for s in sets(data, off[i : j + 1], width):
                        if len(s):
                            gs.append(signature(s))
                            bodies.append(pack_sorted(s))
                    yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(bodies, pa.binary())], ["g", "body"])

        src = self.src.where("key is not null and text is not null").select("key", "text", place.alias("x"))
        wanted = src.mapInArrow(chosen, "g long, body binary").join(need.select("g"), "g", "left_semi")
        got = stored(wanted.dropDuplicates(["g"]))
        shared.destroy()
        self.full = got if self.full is None else self.full.unionByName(got)
        return self.full

    def judge(self):
        percent = self.percent
        return lambda bodies: _Overlap(bodies, percent)


def by_hot(df: DataFrame, table: DataFrame, on: str, counts: DataFrame, total: int) -> DataFrame:
    """``df`` left join ``table`` on a column of whose values some hold much of ``df``.

    ``counts`` has (on, n); values with more than a thousandth of ``total`` rows, fewer than 1000, are joined by
    a broadcast, the others by hash.
    """
    limit = max(total // 1000, 1)
    hot = F.broadcast(stored(table.join(counts.where(F.col("n") > limit).select(on), on, "left_semi")))
    names = [c for c in table.columns if c != on]
    known = df.join(hot.select(on, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__{c}") for c in names)), on, "left")
    quick = known.where(F.col("__hot") | F.col(on).isNull()).select(*df.columns, *(F.col(f"__{c}").alias(c) for c in names))
    return quick.unionByName(known.where(F.col("__hot").isNull() & F.col(on).isNotNull()).select(*df.columns).join(table, on, "left").select(*df.columns, *names))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = 4, branch: int = 2, first: int = 3, last: int = 9, small: int = 128) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept."""
    j = SetJoin(docs, key, text, width, percent, branch, small)
    classes = j.classes.select("g", "key", "n", "sketch")
    sizes = stored(classes.mapInArrow(_paths(trees, first, branch), "path long").groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
    shared = j.spark.sparkContext.broadcast(bitmap(sizes.select((F.col("path").bitwiseAND((1 << BITS) - 1) + 1).alias("x"))))
    members = classes.mapInArrow(_entries(trees, first, branch, shared), MEMBER)
    for depth in range(first, last + 1):
        total = int(sizes.agg(F.sum("n")).first()[0] or 0)
        found = j.find(members, sizes, total)
        again = j.absorb(found)
        open_ = j.unresolved(found)
        deep = F.lit(depth < last) & (F.col("blocks") > 1) & (F.col("k") * F.col("blocks") > 2 * F.col("n"))
        units = j.units(open_.where(~deep))
        j.settle(units if again is None else units.unionByName(again))
        deeper = open_.where(deep)
        if depth == last or not deeper.limit(1).count():
            break
        with_sketch = j.labelled(deeper.select("path", "g", "key")).join(j.classes.select("g", "n", "sketch"), "g").select("path", "g", "label", "key", "n", "sketch")
        members = stored(with_sketch.mapInArrow(_deeper(branch), MEMBER))
        sizes = stored(members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
    shared.destroy()
    found = j.measured.select("key", "n_shingles", "g")
    named = j.classes.select("g", F.col("key").alias("least"))
    if j.labels is not None:
        n_labels = j.labels.count()
        linked = stored(named.join(j.labels.select(F.col("node").alias("g"), "label"), "g"))
        groups = stored(linked.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("n")))
        comp = by_hot(linked, groups.select("label", "component"), "label", groups.select("label", "n"), n_labels).select("g", "component")
        named = named.join(comp, "g", "left").select("g", F.coalesce("component", "least").alias("component"))
    else:
        named = named.select("g", F.col("least").alias("component"))
    per = found.where("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    out = by_hot(found, stored(named), "g", per, j.measured.count())
    comp_id = F.when(F.col("key").isNull(), None).otherwise(F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", comp_id.alias("component_id"), F.coalesce(comp_id == F.col("key"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; ids are taken to be unique.

    Rows of one id go or stay together; rows with a null id stay. The ids to drop are joined as a narrow table; texts are shuffled once.
    """
    out = stored(near_duplicates(docs, key, text, **settings).where("not kept").select(F.col(key)).distinct())
    return docs.join(out, key, "left_anti").select(docs.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
