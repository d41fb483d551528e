"""Row-wise operators against plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import words

from zephyrine.llm import bpe, html_text, repetition, secrets, textops, token_counts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't <|endoftext|>x<|startoftext|>y café \x1c\x1d a\x1cb DON'T'S x'll 12a3 İstanbul  z ﬁ 'tis A'RE", "Σ ΑΣ ٣½² _a_ é́ ́x \n\t ", "<|endoftext|>", "日本 语 İ ǅ"]


def test_words_match_regex():
    texts = ["Ab  c\n", "", "éé\tX", " ", "y"]
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    doc, st, en, h = textops.words(np.frombuffer(data, np.uint8), off)
    assert [(d, data[a:b].decode().lower()) for d, a, b in zip(doc, st, en, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert len(set(h.tolist())) == 5


def test_long_text_hashes_do_not_depend_on_segments():
    t = ("alpha beta " * 120_000).encode()
    _, _, _, h = textops.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    assert len(h) == 240_000 and len(set(h.tolist())) == 2


def brute_quality(t):
    w = words(t, lower=False)
    lines = [x for x in (t or "").split("\n") if words(x)]
    wins = {}
    for i in range(len(w) - 2):
        wins.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for v in wins.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(docs, small):
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for i, t in small:
        n, chars, sym, dup, rep = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got.values() if r.kept}
    assert {r.doc_id for r in repetition.keep_good(docs).collect()} == kept
    assert repetition.keep_good(docs).columns == docs.columns


def test_lcp_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        toks, owner = [], []
        for d in range(r.randint(1, 4)):
            k = r.randint(0, 25)
            toks += [r.choice([1, 2, 3]) for _ in range(k)]
            owner += [d] * k
        best = repetition.lcp_neighbours(np.array(toks, np.uint64), np.array(owner, np.int64))
        for i in range(len(toks)):
            top = 0
            for j in range(len(toks)):
                n = 0
                while i != j and max(i, j) + n < len(toks) and owner[i + n] == owner[j + n] == owner[i] == owner[j] and toks[i + n] == toks[j + n]:
                    n += 1
                top = max(top, n)
            assert best[i] == top


def test_long_repeats_are_rejected(spark):
    r = random.Random(2)
    clean = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    part = " ".join(f"v{i}" for i in range(100))
    d = spark.createDataFrame([(1, clean), (2, clean + " " + part + " x " + part)], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.quality_rules(d).collect()}
    assert got[1].kept and not got[2].kept and got[2].longest_repeat == 100 and got[2].covered_words == 200


def test_token_counts(docs, small):
    t = token_counts.load(TOKENIZER)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, TOKENIZER).collect()}
    for i, x in small:
        assert got[i].n_tokens == len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((x or "").encode())
    c = token_counts.Counter(TOKENIZER)
    assert c.count(ODD) == [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]


def test_special_strings_keep_their_spelling():
    t, c = token_counts.load(TOKENIZER), token_counts.Counter(TOKENIZER)
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|StartOfText|>x", "A<|endoftext|>B c", "<|x"]
    assert c.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_secret_letters_fold_as_ascii():
    for t in ("to\u212aen=abcdefghijklmnop", "api to\u212aen=abcdefghijklmnop", "\u017fecret=abcdefghijklmnop"):
        assert not [x for x in secrets.spans_of(t) if x[0] == "assign"]
    assert [x[0] for x in secrets.spans_of("ToKeN=abcdefghijklmnop")] == ["assign"]


def test_minus_one_is_an_id(spark):
    from zephyrine.llm import katz, near_dup

    d = spark.createDataFrame([(-1, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id for r in bpe.encode(d, TOKENIZER).collect()} == {-1, 7, None}
    assert {r.doc_id for r in katz.score(d).collect()} == {-1, 7, None}
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(d).collect()} == {(-1, -1), (7, -1), (None, None)}


def test_whole_tokens_are_proved():
    t = token_counts.load(TOKENIZER)
    some = sorted(token_counts.whole_tokens(TOKENIZER))[::997]
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in some)


def test_bpe_round_trip(spark, small):
    t = token_counts.load(TOKENIZER)
    texts = [*small, *enumerate(ODD, 5000)]
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), TOKENIZER, keep_ids=True).collect()}
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert list(got[i].ids) == ids and got[i].decoded == text and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_secret_spans():
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    t = f'x token = "{key}" AKIAABCDEFGHIJKLMN0 password: token = abcdefghijkl pwd=Zq8!vT2#mN4x passwd: letmein123'
    got = secrets.spans_of(t)
    assert ("assign", t.index("token"), t.index(key) + 40) in got
    assert [k for k, _, _ in got].count("assign") == 1  # the failing match of "password: token" is used up
    assert ("hex", t.index(key), t.index(key) + 40) in got
    assert any(k == "access" for k, _, _ in got)
    assert [t[a:b] for k, a, b in got if k == "guess"] == ["Zq8!vT2#mN4x"]
    assert secrets.spans_of("") == []
    assert secrets.guess_cost("password2020") < 6 < 10 < secrets.guess_cost("Zq8!vT2#mN4x")
    assert secrets.guess_cost("aaaaaaaaaaaa") < 4 and secrets.guess_cost("qwertyuiop") < 4 and secrets.guess_cost("1999-12-31") < 6


def test_long_secret_values_are_taken_whole():
    r = random.Random(12)
    signs = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789!$@"
    for n in (128, 129, 240, 100_000):
        v = "".join(r.choice(signs) for _ in range(n - 1)) + "Q"
        assert ("guess", 4, 4 + n) in secrets.spans_of(f"pwd={v} x")
        late = "a" * n + "Zq8!vT2#mN4x"  # costly only behind the first 128
        assert ("guess", 4, 4 + len(late)) in secrets.spans_of(f"pwd={late}")
    for cheap in ("a" * 100_000, "ab" * 50_000, "op" * 50_000, "password" + "a" * 5000 + "2020", "opopopop" * 400 + "admin"):
        assert not [x for x in secrets.spans_of(f"pwd={cheap}") if x[0] == "guess"]


def test_secret_base_against_regex(docs, small):
    assert {r.doc_id for r in secrets.scan(docs).collect()} == {i for i, _ in small}
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["0af", "AKIA", "Z9", "token", "=", ":", " ", '"', "secret", "é", "api_key", "x_."]) for _ in range(40))
        hexes = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        keys = [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        got = secrets.spans_of(t)
        assert [(a, b) for k, a, b in got if k == "hex"] == hexes and [(a, b) for k, a, b in got if k == "access"] == keys


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and you accept.</div>
<article><h1>The title</h1><p>The first of the long paragraphs &amp; it is about   the
sea and the land.</p><p>Short.<p><b>Bold<br>end</b><aside>related of the</aside></article>
<div id="comments"><p>I think that the article is bad and it was the worst of all.</p></div><form><input value="x"><label>Name</label></form>
<footer>&copy; the site</footer></body></html>"""


def test_html_extraction(spark):
    assert html_text.extract(PAGE) == "The title\nThe first of the long paragraphs & it is about the sea and the land.\nShort.\nBold end"
    assert html_text.extract("") == "" and html_text.extract(None) == ""
    assert html_text.extract("<article><p>The end of it &am") == "The end of it &am"
    assert html_text.extract("<p>unclosed <!-- comment") == ""
    long = "The sea is in the north of the land and it is as cold as it was in the past, " * 4
    plain = f"<body><div><a href=x>one</a> <a href=y>two</a></div><div><p>{long}</p><p>And so on.</p><p>{long}</p></div><div>&copy; 2020 us</div></body>"
    assert html_text.extract(plain).split("\n") == [long.strip(), "And so on.", long.strip()]
    got = html_text.extract_text(spark.createDataFrame([(1, "u", None), (2, None, PAGE)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.n_chars) for r in got} == {(1, 0), (2, len(html_text.extract(PAGE)))}


def test_self_closed_foreign_elements():
    assert html_text.extract('<article><p>The sea <svg width="1"/>is <math/>cold.</p><p>The end <svg><path/>no</svg>of it.</p></article>') == "The sea is cold.\nThe end of it."
    assert html_text.extract("<article><p>The sea.</p><script src=x />no</script><p>The end.</p></article>") == "The sea.\nThe end."


def test_marks_by_whole_parts():
    sea = "<article><p>The sea is in the north.</p></article>"
    for c in ("content with-sidebar", "has-sidebar", "content sidebar-right", "layout sidebar-left", "no-header"):
        assert html_text.extract(f'<div class="{c}">{sea}</div>') == "The sea is in the north."
    for c in ("comments", "user-comments", "comment content"):
        assert html_text.extract(f'<div class="{c}">{sea}</div>') == ""
    head = '<div class="{}"><h1>Title here</h1></div>'
    assert html_text.extract(f"<article>{head.format('entry-header')}<p>The sea.</p></article>") == "Title here\nThe sea."
    assert html_text.extract(f"<main>{head.format('site-sidebar')}<p>The sea.</p></main>") == "The sea."
    assert html_text.extract(f'<div class="related">{sea}</div><main><p>The land.</p></main>') == "The land."


def test_formulas_and_unquoted_values():
    assert html_text.extract("<article><p>The sea <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> is.</p></article>") == "The sea x=1 is."
    link = "The sea is in the north of the land and it is as cold as it was in the past. " * 4
    assert html_text.extract(f"<div><p><a href=/foo/>{link}</a></p></div>") == ""
    assert html_text.extract(f'<div><p><a name="x"/>{link}</p></div>') == link.strip()


def test_long_and_broken_pages():
    text = "The sea is in the north of the land. " * 50_000
    assert html_text.extract(f"<article><p>{text}</p></article>") == text.strip()
    assert html_text.extract("<article><p>The sea." + "<b>" * 200_000 + "</i>" * 200_000) == "The sea."
    assert html_text.extract("<article>" + "<p>The sea." * 50_000) == "\n".join(["The sea."] * 50_000)


def test_html_tables(spark):
    schema = "page_id long, url string, html string, key string, text string, n_chars string"
    rows = [(1, "u", PAGE, "a", "b", "c"), (1, "u", PAGE, "a", "b", "c"), (None, None, "<p>", None, None, None), (-1, "v", "", "a", None, "")]
    got = html_text.extract_text(spark.createDataFrame(rows, schema))
    text = html_text.extract(PAGE)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (-1, "v", "", 0)], key=str)
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_empty_tables(nothing):
    assert repetition.quality_rules(nothing).count() == 0
    assert token_counts.count_tokens(nothing, TOKENIZER).count() == 0
    assert secrets.scan(nothing).count() == 0
    assert bpe.encode(nothing, TOKENIZER).count() == 0
