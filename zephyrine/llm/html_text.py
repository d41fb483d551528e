"""HTML extraction by two-pass block rules.

The page is cut into blocks at block-level tags. Scripts, styles, and containers that by element
or by class, id or role are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments are dropped with all they hold. A mark counts part by part of a name (``site-footer``), but not behind ``with``, ``has``
or ``no``; ``header`` is none in an article or beside a word for one (``entry-header``), and a mark of the layout (``sidebar-right``)
is none beside a name of the content. First pass: by length, link density and stop-word density
a block is good, bad, near-good or short. Second pass: near-good and short blocks, which are
ambiguous, take the label that the nearest decided neighbours on both sides agree on; if they differ, near-good
blocks are kept and short ones follow the nearer neighbour (the one before it on a tie). Where a page
marks its article (``article`` or ``main`` with text), only blocks in it count, its edges count as
good neighbours, and a long block without stop words is ambiguous rather than bad. If nothing is good, but a container dropped
by its class, id or role holds an article, that one is taken, with what the rules keep of it.

Null or empty html gives an empty text. Broken markup (tags never closed, or cut off) is read as
browsers do, but that ``<b/>`` ends at once where the slash is no part of a value. Formulas keep their text. Whole pages are read
in one pass over the tags; nothing is capped. Repeated rows give repeated results, other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .textops import frugal

#: Frequent function words of the languages at hand.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with his they at be this have from or had by not but what all were we when your can said there use an each which she do how their if will",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son aux d l s mais comme on elle leur être cette",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta",
}
STOP = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml textarea title object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("nav footer aside form button select fieldset menu dialog head".split())
#: Words in class, id and role that mark what isn't the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar sidebar side aside widget widgets related recommended recommendations trending share sharing social comment comments respond disqus replies footer header masthead topbar complementary contentinfo search form copyright skip".split())
#: Marks of reader comments, of the layout, words for the article, and words that turn the mark behind them.
COMMENTS = frozenset("comment comments respond disqus replies".split())
LAYOUT = frozenset("sidebar side aside nav navbar menu header".split())
CONTENT = frozenset("article content entry post story".split())
TURN = frozenset("with without has no".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
#: How an element is hidden: not at all, by a mark outside any article, or for good.
SHOWN, MARKED, GONE = 0, 1, 2

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINKS_HIGH = 0.4


class Block:
    __slots__ = ("text", "linked", "heading", "article", "marked", "label")

    def __init__(self, text: str, linked: int, heading: bool, article: bool, marked: bool):
        self.text, self.linked, self.heading, self.article, self.marked, self.label = text, linked, heading, article, marked, ""


def marks(names: list[str], in_article: bool) -> set[str]:
    """The words in class, id and role names by which an element isn't part of an article."""
    content = any(n in CONTENT for n in names)
    found = set()
    for n in names:
        parts = [x for x in re.split(r"[_\-:]+", n) if x]
        beside = in_article or not CONTENT.isdisjoint(parts)
        for before, x in zip(["", *parts], parts, strict=False):
            if x in HINTS and before not in TURN and not (x == "header" and beside) and not (content and x in LAYOUT):
                found.add(x)
    return found


def hiding(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element isn't part of an article, and if so, for good or by a mark only."""
    if name in OUT or (name == "header" and not in_article):
        return GONE
    if name in ("html", "body", "article", "main") and not re.search(r"comment|repl(?:y|ies)", attributes, re.I):
        return SHOWN
    if "=" in attributes and (found := NAMES.findall(attributes)):
        why = marks([x for f in found for x in "".join(f).lower().split()], in_article)
        if why:
            return MARKED if name in BLOCK and not in_article and COMMENTS.isdisjoint(why) else GONE
    return SHOWN


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without what is hidden for good."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = gone = marked = depth = heading = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, bool(heading), depth > 0, marked > 0))
        parts.clear()
        linked = 0

    def count(name: str, hide: int, step: int) -> None:
        nonlocal links, gone, marked, depth, heading
        held[name] += step
        gone += step * (hide == GONE)
        marked += step * (hide == MARKED)
        depth += step * (name in ("article", "main"))
        links += step * (name == "a")
        heading += step * (name in HEADINGS)

    def leave() -> str:
        name, hide = stack.pop()
        if hide == MARKED:
            close()
        count(name, hide, -1)
        return name

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at and not gone:
            text = entities.unescape(page[at:stop])
            parts.append(text)
            if links:
                linked += len("".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if name in BLOCK:
                close()
            if held[name]:
                while leave() != name:
                    pass
            continue
        if name in BLOCK:
            close()
            while stack and (stack[-1][0] == "p" or stack[-1][0] == "li" == name or stack[-1][0] not in BLOCK and held["p"]):
                leave()
        elif name == "br":
            parts.append(" ")
        closed = CLOSED.search(attributes)
        if name in ("svg", "math") and closed:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or closed:
            continue
        hide = hiding(name, attributes, depth > 0)
        stack.append((name, hide))
        count(name, hide, 1)
    close()
    return out


def classify(blocks: list[Block]) -> list[Block]:
    """The good blocks, after both passes."""
    marked = any(b.article for b in blocks)
    blocks = [b for b in blocks if b.article] if marked else blocks
    for b in blocks:
        size = len(b.text)
        words = LETTERS.findall(b.text.lower())
        density = sum(w in STOP for w in words) / len(words) if words else 0.0
        if b.linked > LINKS_HIGH * max(1, size - b.text.count(" ")) and not b.heading:
            b.label = "bad"
        elif "\N{COPYRIGHT SIGN}" in b.text and size < LENGTH_HIGH and not marked:
            b.label = "bad"
        elif size < LENGTH_LOW or b.heading:
            b.label = "short"
        elif density >= STOP_HIGH:
            b.label = "good" if size > LENGTH_HIGH or marked else "near"
        elif density >= STOP_LOW or marked:
            b.label = "near"
        else:
            b.label = "bad"
    decided = [(i, b.label) for i, b in enumerate(blocks) if b.label in ("good", "bad")]
    edge = "good" if marked else "bad"
    before, k = (-1, edge), 0
    keep = []
    for i, b in enumerate(blocks):
        while k < len(decided) and decided[k][0] <= i:
            before = decided[k]
            k += 1
        if b.label in ("good", "bad"):
            final = b.label
        else:
            after = decided[k] if k < len(decided) else (len(blocks), edge)
            if before[1] == after[1]:
                final = before[1]
            elif b.label == "near" or (b.heading and after[1] == "good"):
                final = "good"
            else:
                final = before[1] if i - before[0] <= after[0] - i else after[1]
            if not marked and not decided and b.label == "near":
                final = "good"
        if final == "good":
            keep.append(b)
    return keep


def extract(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    good = classify([b for b in blocks if not b.marked]) or classify([b for b in blocks if b.marked and b.article])
    return "\n".join(b.text for b in good)


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, ``text`` and its length ``n_chars`` in code points."""

    @frugal
    def run(batches):
        for b in batches:
            texts = pa.array([extract(p.as_py()) for p in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts, pc.utf8_length(texts).cast(pa.int64())], ["key", "url", "text", "n_chars"])

    src = df.select(df[key].cast("long").alias("key"), df[url].cast("string").alias("url"), df[page].cast("string").alias("html"))
    return src.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
