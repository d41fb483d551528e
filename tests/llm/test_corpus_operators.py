"""Operators over whole corpora against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SCHEMA, rows, words

from zephyrine.llm import components, katz, latent, line_dedup, nbsvm, near_dup, pieces


def components_of(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("one_task", [10**6, 10])
def test_components(spark, one_task):
    r = random.Random(1)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    want = components_of(300, links)
    assert got == {n: want[n] for n in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, width):
    w = words(t)
    return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "kw"), [(2, {}), (5, {"small": 4, "first": 1, "last": 2})])
def test_near_duplicates(docs, small, width, kw, monkeypatch):
    monkeypatch.setattr(near_dup.PairJoin, "block", 3)
    s = [shingles(t, width) for _, t in small]
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = components_of(len(s), links)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, width=width, **kw).collect()}
    assert len(got) == len(s)
    for i, _ in small:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s[i]), want[i], want[i] == i)


def test_near_duplicates_odd_rows(spark, nothing):
    assert near_dup.near_duplicates(nothing).count() == 0
    d = spark.createDataFrame(rows([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b  c d e f")]), SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(d).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(r, x, n):
    b = list(x)
    for _ in range(n):
        k = r.random()
        if k < 0.4 and b:
            b[r.randrange(len(b))] = "Z"
        elif k < 0.7:
            b.insert(r.randint(0, len(b)), "Y")
        elif b:
            b.pop(r.randrange(len(b)))
    return "".join(b)


def test_banded_distance():
    r = random.Random(4)
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b, m = mutate(r, a, r.randint(0, 4)), r.randint(0, 3)
        assert line_dedup.within(a, b, m) == (edit_distance(a, b) <= m)


def test_line_dedup(spark, nothing):
    r = random.Random(6)
    base = ["".join(r.choice("abcdé fgh") for _ in range(r.randint(24, 50))).strip().ljust(24, "x") for _ in range(30)]
    texts = [(i, "\n".join(mutate(r, r.choice(base), r.randint(0, 3)) if r.random() < 0.8 else r.choice(["short", "", " " + base[0] + "\t"]) for _ in range(r.randint(0, 8)))) for i in range(70)] + [(500, None), (None, base[0])]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    occ = [(i, k, strip(x)) for i, t in texts if t and i is not None for k, x in enumerate(t.split("\n")) if len(strip(x)) >= 24]
    lines = sorted({x for _, _, x in occ})
    comp = components_of(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(lines[a]) - len(lines[b])) <= 2 and edit_distance(lines[a], lines[b]) <= 2])
    label = dict(zip(lines, comp, strict=True))
    lead = {}
    for i, k, x in sorted(occ):
        lead.setdefault(label[x], (i, k))
    for i, t in texts:
        if i is not None and t is not None:
            assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if len(strip(x)) < 24 or lead[label[strip(x)]] == (i, k))
    assert got[500].text is None and got[None].text == base[0]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """Later copies of lines of any length but zero go; short lines have no near ones."""
    texts = ["Top\n\nAll rights reserved.\né", "top\n All rights reserved.\t\n\né\nTop", "All rights reserved!\n \n{\n}\n{"]
    spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()}
    want = ["Top\n\nAll rights reserved.\né", "top\n", "All rights reserved!\n \n{\n}"]
    assert [got[i].n_chars for i in range(3)] == [len(x) for x in want]
    assert [got[i].text_sha256 for i in range(3)] == [hashlib.sha256(x.encode()).hexdigest() for x in want]
    assert [(got[i].n_exact, got[i].n_near) for i in range(3)] == [(0, 0), (3, 0), (1, 0)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, small, nothing, order):
    toks = {i: [*words(t), None] for i, t in small}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    counts, ctx = [Counter() for _ in range(order)], Counter()
    grams = {i: [[(*["<s>"] * order, *w)[order + k - n : order + k + 1] for n in range(order)] for k in range(len(w))] for i, w in toks.items()}
    for i, gs in grams.items():
        if not held[i]:
            for g in gs:
                for n, x in enumerate(g):
                    counts[n][x] += 1
                    ctx[x[:-1]] += n > 0
    k = 5
    total = lambda c: np.array([0, *(sum(v == r for v in c.values()) for r in range(1, k + 2)), sum(c.values()), len(c)])
    m = katz.Model(np.array([total(c) for c in counts]), k)
    dis = lambda c, d: d[c] * c if c <= k else c - d[0]
    uni = counts[0]

    def direct(x):  # the share of a seen n-gram
        return dis(counts[len(x) - 1][x], m.d[len(x) - 1]) / (ctx[x[:-1]] if len(x) > 1 else m.n)

    after = {}
    for c in counts[1:]:
        for x in c:
            after.setdefault(x[:-1], []).append(x)
    alpha = {c: (1 - sum(map(direct, xs))) / (1 - sum(direct(x[1:]) for x in xs)) for c, xs in after.items()}

    def p(x):
        if counts[len(x) - 1][x]:
            return direct(x)
        return m.unknown if len(x) == 1 else alpha.get(x[:-1], 1) * p(x[1:])

    assert abs(sum(p(w) for w in uni) + m.unknown - 1) < 1e-9
    for c in list(alpha)[:10] + list(alpha)[-10:]:  # exactly normalised
        assert abs(sum(p((*c, *w)) for w in uni) + p((*c, "never seen")) - 1) < 1e-9
    got = {r.doc_id: r for r in katz.score(docs, order=order).collect()}
    for i, w in toks.items():
        s = sum(math.log10(p(g[-1])) for g in grams[i])
        b = sum(math.log10((uni.get((x,), 0) + 1) / (m.n + m.v + 1)) for x in w)
        r = got[i]
        assert math.isclose(r.score, s, rel_tol=1e-7) and math.isclose(r.base_score, b, rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum((x,) in uni for x in w), m.n)
    assert katz.score(nothing, order=order).count() == 0


def test_katz_when_splits_change(spark, sf, tmp_path, monkeypatch):
    """Texts cut anew are cut the same, though the settings that decide on splits change between two reads."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d.repartition(6).write.parquet(f"{tmp_path}/d")
    want = {r.doc_id: (r.n_tokens, round(r.score, 6)) for r in katz.score(d).collect()}
    monkeypatch.setattr(pieces, "release", lambda df: spark.conf.set("spark.sql.files.maxPartitionBytes", "20000"))  # between the reads
    try:
        got = {r.doc_id: (r.n_tokens, round(r.score, 6)) for r in katz.score(spark.read.parquet(f"{tmp_path}/d"), store=False).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_answers_to_another_cut_are_refused():
    keys = np.array([3, 5, 2**63], np.uint64)
    pieces.check([pieces.digest(keys[:1]), pieces.digest(keys[1:])], keys)
    with pytest.raises(ValueError, match="cut"):
        pieces.check([pieces.digest(keys[:2])], keys)


def test_nbsvm_held_out(spark):
    r = random.Random(7)
    good = ["the", "sea", "land", "of", "and", "north", "wind", "is"]
    data = []
    for i in range(240):
        y = i % 2
        w = [r.choice(good) for _ in range(r.randint(20, 60))]
        data.append((i, " ".join(w) if y else " ".join(x.upper() + "!!" if r.random() < 0.6 else x for x in w), y))
    data += [(1000, None, 1), (1001, "", 0), (1002, "x", None)]
    d = spark.createDataFrame(data, "key long, text string, label int")
    model = nbsvm.train(d.where("key % 3 <> 1"), bits=12, max_train=200)
    got = {x.key: x.score for x in nbsvm.score(d, model, "key").collect()}
    right = [(got[i] >= 0.5) == (y == 1) for i, _, y in data[:240] if i % 3 == 1]
    assert sum(right) / len(right) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    one = nbsvm.train(d.where("label = 1"), bits=10)
    assert all(s > 0.5 for s in (x.score for x in nbsvm.score(d, one, "key").collect()))
    assert nbsvm.score(d, nbsvm.train(d.limit(0), bits=10), "key").count() == 243


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    cols = np.concatenate([[i % 2, 2 + rng.integers(5)] for i in range(60)])
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w, b = nbsvm.fit_hinge(np.arange(0, 121, 2), cols, y, np.ones(7), 1.0, 30)
    assert w[1] + b > 0 > w[0] + b


def brute_lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
        p = q
    return p[-1]


def test_lcs():
    r = random.Random(8)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 15))] for _ in range(2))
        assert latent.common(a, b) == brute_lcs(a, b)


def test_decontamination(spark, nothing):
    r = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, make(20) + ". " + make(15) + ".") for i in range(12)] + [(90, None), (91, "")]
    texts, want = [], set()
    for i in range(80):
        t = make(r.randint(30, 200))
        if i % 4 == 0:
            k = r.randrange(12)
            p = items[k][1].split(" ")
            if i % 8 == 0:  # a paraphrase: some words changed
                for j in r.sample(range(len(p)), 5):
                    p[j] = r.choice(vocab)
            t = t + "\n" + " ".join(p) + "\n" + make(20)
            want.add((i, k))
        texts.append((i, t))
    texts += [(900, None), (901, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(rows(texts), SCHEMA)
    got = {(x.key0, x.item_id) for x in latent.search(d, bench).withColumnRenamed("doc_id", "key0").collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = {x.doc_id for x in latent.drop_contaminated(d, bench).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in got}
    assert latent.search(nothing, bench).count() == 0 and latent.search(d, bench.limit(0)).count() == 0


def test_decontamination_of_full_blocks(spark):
    """More windows in a block than ``k``, and several blocks: whole items at any offset are all found."""
    r = random.Random(10)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n: " ".join(r.choice(signs) + r.choice(signs) for _ in range(n))
    items = [(i, make(r.randint(300, 500))) for i in range(60)]
    texts = [(i, f"{make(r.randint(0, 60))} {t} {make(r.randint(0, 60))}") for i, t in items]
    got = {(x.doc_id, x.item_id) for x in latent.search(spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string"), k=64, block=256).collect()}
    assert got == {(i, i) for i, _ in items}


def plain_passages(texts, width, step):
    """Word counts of every passage: (text, Counter)."""
    return [(i, Counter(w[a : a + width])) for i, t in texts if (w := words(t)) for a in range(0, len(w), step)]


def test_fit_takes_passages_of_all_documents(spark, monkeypatch):
    """Twelve of 2412 documents hold what the vectors outside the windows' space should be: as much of it as by an exact SVD."""
    r = random.Random(14)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(vocab[i * 50 : i * 50 + 50])) for i in range(3)]
    texts = [(i, " ".join(f"x{r.randrange(500)}" for _ in range(9)) + " " + r.choice(vocab)) for i in range(2400)]
    texts += [(5000 + i, " ".join([vocab[4 * i], vocab[4 * i + 50], "x1", "x2"] * 150)) for i in range(12)]
    seen, real = [], latent.fit
    monkeypatch.setattr(latent, "fit", lambda *a, **kw: seen.append((a[1], a[2], real(*a, **kw))) or seen[-1][2])
    latent.search(spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string"), k=15)
    ((it, idf, v),) = seen
    at = {w: int(np.flatnonzero(it.terms == latent.Items._hashes(w)[0])[0]) for _, t in items for w in t.split()}
    x = np.zeros((len(plain_passages(texts, 50, 50)), len(it.terms)))
    for row, (_, c) in enumerate(plain_passages(texts, 50, 50)):
        for w, n in c.items():
            if w in at:
                x[row, at[w]] = n * idf[at[w]]
    own = np.zeros((3, len(it.terms)))
    for row, (_, t) in enumerate(items):
        own[row, [at[w] for w in t.split()]] = [idf[at[w]] for w in t.split()]
    q, _ = np.linalg.qr(own.T)
    rest = x - x @ q @ q.T
    best = (np.linalg.svd(rest, compute_uv=False)[:12] ** 2).sum()
    assert v.shape == (150, 15) and np.allclose(v.T @ v, np.eye(15), atol=1e-4) and np.allclose(v @ (v.T @ q), q, atol=1e-4)
    assert 0.99 * best <= (np.linalg.norm(rest @ v) ** 2) <= 1.001 * best


def test_candidates_against_brute_force(spark):
    """Every text and item of which a passage and a window have the cosine, by plain counts, is a candidate."""
    r = random.Random(15)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, make(r.randint(10, 130))) for i in range(15)]
    texts = []
    for i in range(60):
        w = items[i % 15][1].split()
        texts.append((i, make(r.randint(0, 90)) + " " + " ".join(x for x in w[r.randrange(len(w)) :] if r.random() < 0.7) + " " + make(20)))
    df = Counter(x for _, t in texts for x in set(words(t)))
    idf = lambda x: math.log((len(texts) + 1) / (df[x] + 1)) + 0.1
    norm = lambda c: math.sqrt(sum((n * idf(x)) ** 2 for x, n in c.items()))
    windows = [(i, Counter(t.split()[s : s + 50])) for i, t in items for s in latent.Items.windows_of(len(t.split()), 50)]
    want = set()
    for d, p in plain_passages(texts, 50, 25):
        for i, w in windows:
            if sum(n * w[x] * idf(x) ** 2 for x, n in p.items()) >= 0.3501 * norm(p) * norm(w):
                want.add((d, i))
    got = {(x.doc_id, x.item_id) for x in latent.search(spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string"), lcs=0.0, answer=0.0, sure=0.0).collect()}
    assert len(want) > 30 and want <= got and len(got) < 2 * len(want)


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_overlap_of_packed_sets(most):
    r = np.random.default_rng(11)
    sets = [np.unique(r.integers(0, 3000, r.integers(1, 400)).astype(np.uint64) * np.uint64(2**50 + 7)) for _ in range(40)]
    overlap = near_dup._Overlap([pieces.pack_sorted(s) for s in sets], 20, most)
    for x in range(40):
        others = np.array([y for y in range(40) if y != x])
        assert overlap(x, others).tolist() == [100 * len(np.intersect1d(sets[x], sets[y])) >= 20 * len(np.union1d(sets[x], sets[y])) for y in others]


def test_units_are_settled_whole():
    """Whatever batches a unit comes in, true links and labels give the same components as all pairs do."""
    r = random.Random(12)
    for n in (2, 9, 60):
        true = {(i, j) for i in range(n) for j in range(n) if i < j and r.random() < 1.5 / n}
        label = [0 if i < n // 3 else i for i in range(n)]

        def judge(bodies, true=true):
            names = [int(b) for b in bodies]
            return lambda x, others: np.array([(min(names[x], names[y]), max(names[x], names[y])) in true for y in others.tolist()], bool)

        cols = [pa.array([5] * n), pa.array(range(n)), pa.array(label), pa.array(range(n)), pa.array([b"x"] * n, pa.binary()), pa.array([str(i).encode() for i in range(n)], pa.binary())]
        b = pa.RecordBatch.from_arrays(cols, [*near_dup.MEMBERS, "body"])
        run = near_dup._settle(lambda x, y: np.full(len(x), 64), 35, judge)
        got = [(x["a"], x["b"]) for out in run([b.slice(0, 1), b.slice(1)]) for x in out.to_pylist()]
        known = [(i, label[i]) for i in range(n)]
        assert components_of(n, known + got) == components_of(n, known + list(true)) and all((min(p), max(p)) in true for p in got)


def test_only_open_pairs_travel_with_their_sets(spark):
    """Members without a pair that may be similar ask for no set, and a pair that many nodes hold is verified once."""
    asked, dealt = [], []

    class Stub(near_dup.PairJoin):
        agree_of = staticmethod(lambda x, y: np.where(x[:, 0] == y[:, 0], 64, 0))

        def bodies(self, need):
            asked.extend(x.g for x in need.collect())
            return spark.createDataFrame([(g, str(g).encode()) for g in range(40)], "g long, body binary")

        def judge(self):
            return lambda bodies: lambda x, others: np.ones(len(others), bool)

        def link(self, links):
            dealt.extend((x.a, x.b) for x in links.collect())

    kind = lambda g: bytes([7 if g in (3, 5) else 9 if g in (20, 21, 22) else 100 + g])
    units = [(path, g, g, kind(g)) for path in range(12) for g in range(40)]
    Stub().settle(spark.createDataFrame(units, "path long, g long, key long, small binary"))
    assert sorted(asked) == [3, 5, 20, 21, 22]
    assert len(dealt) == 3 and components_of(40, dealt) == components_of(40, [(3, 5), (20, 21), (21, 22)])
