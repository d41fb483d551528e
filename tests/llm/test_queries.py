"""The registered queries over whole tables, and the parts of operators, against plain versions of them."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import SCHEMA, rows, words

from zephyrine.llm import bpe, nbsvm, queries, repetition, secrets, token_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def longest_repeats(w, least):
    """Words covered by repeats of ``least`` words or more, and the longest repeat, by comparing all places."""
    cover, top = set(), 0
    for i in range(len(w)):
        n = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            n = max(n, k)
        top = max(top, n)
        if n >= least:
            cover.update(range(i, i + n))
    return len(cover), top


def test_covered_words_against_all_places(spark):
    r = random.Random(21)
    made = [" ".join(r.choice("abcdefgh" * (1 + i % 3)) + str(r.randrange(1 + i % 7)) for _ in range(r.randint(50, 110))) for i in range(40)]
    made += [t[: len(t) // 2] + t for t in made[:12]] + ["w " * 70]
    d = spark.createDataFrame(rows(list(enumerate(made))), SCHEMA)
    got = {x.doc_id: x for x in repetition.quality_rules(d, min_repeat=3).collect()}
    for i, t in enumerate(made):
        w = words(t, lower=False)
        covered, top = longest_repeats(w, 3)
        assert (got[i].covered_words, got[i].longest_repeat) == (covered, top if top >= 3 else 0)


def test_op4(spark, sf, texts):
    t = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(x.encode()), n, n > 2048)


def test_op5(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(texts)
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    for i, r in got.items():
        assert r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.5 else 0)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [got[i].predicted == marks[i] for i in texts if held[i] and marks.get(i) is not None]
    assert sum(right) >= 0.9 * len(right)


def test_op8(spark, sf, texts):
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in QUERIES["op8_secrets"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(base)) and [x for x in r.spans.split(",") if x and not x.startswith("guess")] == base


def test_op9(spark, sf, texts):
    t = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def plain_cost(v):
    """The cheapest segmentation over all pieces at all places."""
    low = v.lower()
    leet = low.translate(secrets.LEET)
    size = [math.log10(secrets._size(c)) for c in v]

    def pieces(i, j):
        x = v[i:j]
        yield sum(size[i:j])
        for word, extra in ((low[i:j], 0.0), (leet[i:j], 0.61)):
            if j - i >= 2 and word in secrets.RANK:
                case = 0.0 if x == low[i:j] else 0.31 if x in (low[i:j].upper(), low[i:j].capitalize()) else 0.31 * (j - i)
                yield math.log10(secrets.RANK[word] + 1) + case + extra
                break
        if j - i >= 3 and len(set(x)) == 1:
            yield math.log10(secrets._size(x[0]) * (j - i))
        for width in range(2, (j - i) // 2 + 1):
            if (j - i) % width == 0 and x == x[:width] * ((j - i) // width):
                yield sum(size[i : i + width]) + math.log10((j - i) // width)
        if j - i >= 3 and all(a + b in secrets.NEXT for a, b in zip(low[i:j], low[i + 1 : j], strict=False)):
            yield math.log10(47 * (j - i))
        for form in secrets.DATES:
            if (m := form.match(v, i)) and m.end() == j:
                yield math.log10(119 if j - i == 4 else 365 * 119)

    best = [0.0] + [math.inf] * len(v)
    for j in range(1, len(v) + 1):
        for i in range(j):
            best[j] = min(best[j], best[i] + (math.log10(2) if i else 0.0) + min(pieces(i, j)))
    return best[-1]


def test_guess_cost_against_all_segmentations():
    r = random.Random(22)
    parts = ["password", "admin", "P@ssw0rd", "MASTER", "2020", "1999-12-31", "qwerty", "aaaa", "abab", "xyxyxy", "7", "Z", "!", "é", "love", "Key", "lkj", "q8", "0", "test"]
    for v in ["q8mYz", *("".join(r.choice(parts) for _ in range(r.randint(1, 6)))[:40] for _ in range(1500))]:
        want = plain_cost(v)
        assert math.isclose(secrets.guess_cost(v), want, abs_tol=1e-9), v
        for limit in (4.0, 10.0):
            got = secrets.guess_cost(v, limit)
            assert math.isclose(got, want, abs_tol=1e-9) if want < limit - 1e-9 else got >= limit - 1e-9, v


def test_hinge_against_projected_gradient():
    """The same minimum as a plain solver of the dual."""
    rng = np.random.default_rng(23)
    n, m, c = 40, 12, 0.7
    lists = [np.sort(rng.choice(m, 4, replace=False)) for _ in range(n)]
    y = np.where(rng.random(n) < 0.35, 1, -1)
    values = rng.normal(size=m)
    x = np.zeros((n, m))
    for i, f in enumerate(lists):
        x[i, f] = values[f] / np.linalg.norm(values[f])
    top = c * np.array([n / (2 * (y == k).sum()) for k in y])
    q = (y[:, None] * y) * (x @ x.T + 1)
    a = np.zeros(n)
    step = 1 / np.linalg.norm(q, 2)
    for _ in range(50_000):
        a = np.clip(a - step * (q @ a - 1), 0, top)
    w, b = nbsvm.fit_hinge(np.arange(0, 4 * n + 1, 4), np.concatenate(lists), y, values, c, 5000)

    def loss(w, b):
        return (w @ w + b * b) / 2 + (top * np.maximum(0, 1 - y * (x @ w + b))).sum()

    assert math.isclose(loss(w, b), loss(x.T @ (a * y), (a * y).sum()), rel_tol=0.02)


def test_classifier_against_one_pass(spark):
    """Log-count ratios of all rows, and scores, as one pass in plain arrays gives them."""
    r = random.Random(24)
    data = [(i, " ".join(r.choice(["sea", "land", "WIN", "free!!", "x1"][(i % 2) : 4 + i % 2]) for _ in range(r.randint(0, 30))), i % 2) for i in range(90)]
    d = spark.createDataFrame(data, "key long, text string, label int")
    model = nbsvm.train(d, bits=10, min_count=2)
    found = []
    for _, t, _ in data:
        b = t.encode()
        found.append(nbsvm.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 10)[1])
    counts = np.zeros((2, 1024))
    for f, (_, _, y) in zip(found, data, strict=True):
        counts[y][f] += 1
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    values = np.where(counts.sum(axis=0) >= 2, np.log(share[1] / share[0]), 0).astype(np.float32)
    assert np.allclose(model["values"], values)
    used = [f[values[f] != 0] for f in found]
    w, bias = nbsvm.fit_hinge(np.concatenate([[0], np.cumsum([len(f) for f in used])]), np.concatenate(used), np.array([2 * y - 1 for _, _, y in data]), values.astype(np.float64), 1.0, 20)
    got = {x.key: x.score for x in nbsvm.score(d, model, "key").collect()}
    for (i, _, _), f in zip(data, found, strict=True):
        margin = (w * values)[f].sum() / (np.linalg.norm(values[f].astype(np.float64)) or 1.0) + bias
        assert math.isclose(got[i], 1 / (1 + math.exp(-3 * margin)), rel_tol=1e-3)


def test_classifier_odd_rows(spark):
    schema = "doc_id long, text string, key string, score string, label int, w double"
    d = spark.createDataFrame([(1, "sea " * 200_000, "k", "s", 1, 0.0), (1, "sea", None, None, None, None), (None, None, None, None, None, None), (-1, "", "k", "s", 0, 0.0)], schema)
    got = nbsvm.score(d, nbsvm.train(d.select("doc_id", "text", "label"), key="doc_id", bits=10, min_count=1)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == [(False, -1), (False, 1), (False, 1), (True, 0)]
    assert all(0 <= x.score <= 1 for x in got)


def test_secrets_odd_rows(spark):
    schema = "doc_id long, text string, key string, found string, spans string"
    long = "x " * 200_000 + "token=abcdefghijklmnop"
    d = spark.createDataFrame([(1, long, "k", "f", "s"), (1, long, "k", "f", "s"), (None, None, None, None, None), (-1, "", "k", "f", "s")], schema)
    got = secrets.scan(d).collect()
    assert sorted(((x.doc_id or 0), [(s.kind, s.start, s.end) for s in x.found]) for x in got) == [(-1, []), (0, []), (1, [("assign", 400_000, 400_022)]), (1, [("assign", 400_000, 400_022)])]


def test_stages_on_odd_rows(spark, sf, nothing):
    """Nulls, empty texts, repeated ids and rows, names that operators use: no stage crashes, and what each keeps is defined."""
    r = random.Random(25)
    text = lambda n: "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12)) for _ in range(n))
    a, b = text(8), text(8)
    odd = [(None, None, *[None] * 7), (None, a, *[None] * 7), (5, a, "en", None, None, None, None, None, None), (5, a, "en", None, None, None, None, None, None), (6, a, None, "s", 0, "k", "g", "l", "p"), (7, b, None, None, None, None, None, None, None), (8, "", "", "", 0, "", "", "", ""), (-1, text(9), None, None, None, None, None, None, None)]
    d = spark.createDataFrame(odd, SCHEMA)
    ids = lambda x: sorted((y.doc_id is None, y.doc_id or 0) for y in x.select("doc_id").collect())
    n = (True, 0)
    want = {"quality rules": [(False, -1), (False, 5), (False, 5), (False, 6), (False, 7), n], "MinHash near-dedup": [(False, -1), (False, 5), (False, 5), (False, 7), (False, 8), n, n]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, sf)
        if k < 4:
            assert out.columns == d.columns and set(out.columns) == set(stage(spark, nothing, sf).columns)
        assert stage(spark, nothing, sf).count() == 0
        if name in want:
            assert ids(out) == want[name], name
        elif name != "line dedup":
            assert ids(out) == ids(d), name
        else:
            assert (False, 7) in ids(out) and (False, 6) not in ids(out) and ids(out).count(n) == 2


def test_bpe_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    d = spark.createDataFrame(rows([(3, "the sea"), (3, "the sea"), (None, "the sea"), (4, None), (5, "")]), SCHEMA)
    got = sorted(((x.doc_id or 0), x.n_tokens) for x in bpe.encode(d, path).collect())
    assert got == [(0, 2), (3, 2), (3, 2), (4, 0), (5, 0)]
