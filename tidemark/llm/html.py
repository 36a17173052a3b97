"""Main-content extraction by the maximum-scoring subsequence of a page.

A page is a sequence of words and tags. Words score by where they stand and
tags cost; the weights are log-odds counted over a bounded sample of pages
that mark their content with `article` or `main`, so such pages label the
rest: words of menus and boxes count against the elements they stand in. Words
inside marked content that aren't links score 1 at least. One linear scan finds
the contiguous region of the highest sum, on pages with default weights alone
where no word of the page scores above nothing; what stands in a skipped
container scores nothing, so that a box never cuts an article. Its text blocks are returned, without containers that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms,
comments). A class word that only begins like one of those containers
(`related-work`, `related-posts`) decides nothing: such an element is left out
where its own words and tags, with the same weights, don't sum to more than
nothing, as lists of links don't. Where a page has its `article` or `main` only inside elements that
a class, id or role marks so, these elements are spared.

Null html is empty, and an empty page has the empty text. A page whose region
has no words has the empty text. Repeated rows give repeated results, empty
tables none. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import batches
from .tables import hash_unit

#: Elements whose content is no markup; without an end tag they run to the end of the page, as in a browser.
RAW = ("script", "style", "textarea", "title", "iframe")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset(
    ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
)
#: Elements that are never main text, and words of class, id or role that mark such elements.
SKIP = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "noscript", "template", "svg", "canvas", "select", "datalist", "button"))
SKIP_WORDS = frozenset(
    ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget")
)
#: Words of these that also begin the names of parts of an article; before another word they leave it to the scores.
SOFT_WORDS = frozenset(("alert", "consent", "notice", "notices", "promotion", "related", "replies", "search", "share", "social"))
#: Before `header` these say that it is an article's own.
OWN_HEADER = frozenset(("article", "content", "entry", "post", "section", "story"))
CONTENT = frozenset(("article", "main"))
_NEVER_SKIPPED = frozenset(("html", "body", "article", "main"))
#: First parts of class words that tell what an element has or lacks (`has-sidebar`), not what it is.
_ABOUT = frozenset(("has", "no", "with", "without", "not"))
#: An element of these ends an open one of the same name.
_SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that have weights of their own, besides blocks and void ones; all others share one.
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "picture", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"))
_WEIGHED = BLOCKS | VOID | INLINE | SKIP | frozenset(RAW)
_SPACE = re.compile(r"\s+")
DEFAULT_WORD, DEFAULT_TAG = 1.0, -3.0


HARD, SOFT = 1, 2


def _skipped(name: str, attributes: str) -> int:
    """HARD: never main text; SOFT: by its score; else 0."""
    if name in _NEVER_SKIPPED:
        return 0
    if name in SKIP:
        return HARD
    marks = {_marks(w) for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    return HARD if HARD in marks else SOFT if SOFT in marks else 0


def _marks(token: str) -> int:
    """A class word that is one of SKIP_WORDS, or begins or ends with one and doesn't say what the element has or lacks."""
    parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    if not parts or parts[0] in _ABOUT:
        return 0
    if parts[-1] in SKIP_WORDS:
        return 0 if parts[-1] == "header" and parts[0] in OWN_HEADER else HARD
    return 0 if parts[0] not in SKIP_WORDS else SOFT if parts[0] in SOFT_WORDS else HARD


def pieces(page: str) -> list[tuple]:
    """(kind, words or 1, text, block number, skipped, inside content, soft) in page order.

    kind names the weight; soft is where the outermost element begins that its score decides on, or -1.
    """
    holders: set[int] = set()
    own = list(_scan(page, frozenset(), holders))
    if holders and all(p[4] or p[6] >= 0 for p in own if p[0] in CONTENT):
        own = list(_scan(page, holders, set()))
    return own


def _scan(page: str, spared, holders: set[int]):
    """The pieces; elements that begin at `spared` are never marked; `holders` takes those marked by class that hold content."""
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, skipped, in content, where it begins if it is marked by class, else -1, soft
    block, skipped, inside, links, soft = 0, False, False, 0, -1
    holder = "body"
    for m in _PIECE.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            kind = name if name in _WEIGHED else "other"
            if m[2]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                yield "/" + kind, 1, "", block, skipped, inside, soft
                if at is not None:
                    del stack[at:]
            else:
                if name in _SELF_CLOSING and stack and any(x[0] == name for x in stack[-4:]):
                    at = max(i for i in range(len(stack)) if stack[i][0] == name)
                    if not any(x[0] in ("ul", "ol", "table", "dl", "div") for x in stack[at:]):
                        del stack[at:]
                skipped, inside, soft = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, False, -1)
                mark = 0 if m.start() in spared else _skipped(name, m[4])
                skip, content = skipped or mark == HARD, inside or name in CONTENT
                if mark == SOFT and soft < 0:
                    soft = m.start()
                if name in CONTENT:
                    holders.update(x[3] for x in stack if x[3] >= 0)
                yield kind, 1, "", block, skip, content, soft
                if name not in VOID and not m[4].endswith("/"):
                    stack.append((name, skip, content, m.start() if mark and name not in SKIP else -1, soft))
            if name in BLOCKS:
                block += 1
            skipped, inside, soft = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, False, -1)
            holder = next((x[0] for x in reversed(stack) if x[0] in BLOCKS), "body")
            links = sum(x[0] == "a" for x in stack)
            if name == "br":
                yield "space", 0, " ", block, skipped, inside, soft
        elif m[0][0] != "<" or m[0] == "<":
            text = entities.unescape(m[0])
            if n := len(text.split()):
                yield f"word {'link' if links else holder}", n, text, block, skipped, inside, soft
            else:
                yield "space", 0, text, block, skipped, inside, soft


def _count(rows):
    """Per kind: words or tags inside marked content, and outside it."""
    totals: dict[str, list[int]] = {}
    for batch in batches(rows):
        for page in batch.column("html").to_pylist():
            own = pieces(page or "")
            if any(p[5] for p in own):
                for kind, n, _, _, skipped, inside, soft in own:
                    totals.setdefault(kind, [0, 0])[0 if inside and not skipped and soft < 0 else 1] += n
    yield pa.RecordBatch.from_pydict({"kind": pa.array(list(totals), pa.string()), "n_in": pa.array([v[0] for v in totals.values()], pa.int64()), "n_out": pa.array([v[1] for v in totals.values()], pa.int64())})


def fit_weights(pages: DataFrame, most: int = 4000) -> dict[str, float]:
    """Weights of kinds, which are names of a fixed list, from about `most` pages, chosen by a hash of the id: clipped log-odds for words, at most -0.05 for tags."""
    total = pages.count()
    sample = pages.where(hash_unit(F.col("page_id"), 5) < most / total if total > most else F.lit(True)).select("html")
    counts = sample.mapInArrow(_count, "kind string, n_in long, n_out long").groupBy("kind").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    weights = {}
    for r in counts.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "kind").collect():
        odds = math.log((r["n_in"] + 0.5) / (r["n_out"] + 0.5))
        weights[r["kind"]] = max(-4.0, min(2.0, odds)) if r["kind"].startswith("word") else min(-0.05, max(-4.0, odds - 2.0))
    return weights


def _weight(piece: tuple, weights: dict[str, float]) -> float:
    kind = piece[0]
    if kind == "space":
        return 0.0
    if not kind.startswith("word"):
        return weights.get(kind, DEFAULT_TAG)
    if kind == "word link":
        return weights.get(kind, -DEFAULT_WORD)
    own = weights.get(kind, DEFAULT_WORD)
    return max(own, DEFAULT_WORD) if piece[5] else own


def extract(page: str, weights: dict[str, float]) -> tuple[str, float]:
    """The main text and the score of its region."""
    found = pieces(page)
    if not any(p[0].startswith("word") and not p[4] and _weight(p, weights) > 0 for p in found):
        weights = {}
    own = [(*p[:5], p[6], p[1] * _weight(p, weights)) for p in found]
    sums: dict[int, float] = {}
    for _, _, _, _, skipped, soft, score in own:
        if soft >= 0 and not skipped:
            sums[soft] = sums.get(soft, 0.0) + score
    own = [(text, block, skipped or sums.get(soft, 1.0) <= 0, kind, score) for kind, _, text, block, skipped, soft, score in own]
    best = total = 0.0
    begin = best_begin = best_end = 0
    for i, (_, _, skipped, _, score) in enumerate(own):
        if total <= 0:
            total, begin = 0.0, i
        if not skipped:
            total += score
        if total > best:
            best, best_begin, best_end = total, begin, i + 1
    if best <= 0:
        return "", 0.0
    blocks: dict[int, list[str]] = {}
    first, last = own[best_begin][1], own[best_end - 1][1]
    for text, block, skipped, kind, _ in own:
        if text and not skipped and first <= block <= last and (kind == "space" or block in blocks or kind.startswith("word")):
            blocks.setdefault(block, []).append(text)
    texts = (_SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n\n".join(x for x in texts if x), best


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars, region_score of each page."""

    def run(rows):
        for batch in batches(rows):
            found = [extract(p or "", weights) for p in batch.column("html").to_pylist()]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["page_id", "url", "text", "n_chars", "region_score"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, region_score double")


def op5(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    return extract_pages(pages, fit_weights(pages))
