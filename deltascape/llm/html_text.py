"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each under a root-to-leaf path of block elements. Every path gets two ratios: text
length by node and punctuation marks by node. They are smoothed along the page's nodes and fused, on a logarithmic
scale. What elements say of themselves enters as bounded factors: an article's paths weigh more, a menu's, form's or
advert's less, and a path of links by the share of its text that is none. Paths whose value is over the threshold, set
by the spread of the page's own values, hold the content; so a path of an article without text to speak of goes, and
one outside with much text stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import select_present

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"[ \t\n\r\f\v]+")
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、！？]")
#: Elements of HTML, fixed values: inline ones, void ones, those whose content is no text, and those that are no article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas audio video textarea title noframes noembed xmp".split())
APART = set("nav header footer aside form menu dialog button select fieldset".split()) | RAW | {"head"}
#: An opening tag of the key closes the open elements of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of a class, id or role that name what is no article.
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense alert announcement banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus "
    "feedback footer gdpr header menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget complementary contentinfo".split()
)
OWN_WORDS = set("ad ads advert comment comments promo reply sponsored teaser related".split())
WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An open block element."""

    __slots__ = ("apart", "article", "path", "tag")

    def __init__(self, tag: str, path: int, apart: bool, article: bool):
        self.tag, self.path, self.apart, self.article = tag, path, apart, article


class Run:
    """Text of one block and where it stands."""

    __slots__ = ("apart", "article", "heading", "linked", "parts", "path", "text")

    def __init__(self, node: Node):
        self.heading = node.tag in HEADINGS
        self.path, self.apart, self.article, self.parts, self.linked, self.text = node.path, node.apart, node.article, [], 0, ""


def _apart(tag: str, attributes: str) -> bool:
    """Whether an element's name or attributes say that it is no part of an article."""
    if tag in APART:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", next((v for v in values if v), "")).lower()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(words & (OWN_WORDS if tag == "article" else APART_WORDS))


def blocks(page: str) -> list[Run]:
    """Blocks of a page in order, also those apart; broken markup is read as browsers do, roughly."""
    stack = [Node("", 0, False, False)]
    opened: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}  # a path is a number, found by the path above and the element
    runs: list[Run] = []
    run: Run | None = None
    links = 0
    raw = ""
    at, end = 0, len(page)
    while at < end:
        if raw:  # all up to the closing tag is no markup
            found = re.compile(rf"</{raw}(?=[\s>/]|\Z)", re.I).search(page, at)
            at, raw = (found.start() if found else end), ""
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        piece = m.group()
        tag = m[2] or m[5]
        if tag is None:
            if piece[0] == "<" and len(piece) > 1:
                continue
            if run is None:
                run = Run(stack[-1])
                runs.append(run)
            run.parts.append(html.unescape(piece) if "&" in piece else piece)
            if links:
                run.linked += len(piece.strip())
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag not in ("img", "wbr") or closing:
                continue
        if tag == "br":
            if run is not None:
                run.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                run = None
            continue
        run, links = None, 0
        if closing:
            while opened.get(tag, 0):  # one without an opening tag closes nothing
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
            continue
        while tag in ENDS_PARAGRAPH and stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()):
            opened[stack.pop().tag] -= 1
        if tag == "body":  # a head that was not closed
            while len(stack) > 1 and stack[-1].tag != "html":
                opened[stack.pop().tag] -= 1
        up = stack[-1]
        opened[tag] = opened.get(tag, 0) + 1
        apart = up.apart or _apart(tag, attributes)
        stack.append(Node(tag, paths.setdefault((up.path, tag), len(paths) + 1), apart, up.article or tag in ("article", "main")))
        if tag in RAW and not attributes.endswith("/"):
            raw = tag
    for r in runs:
        r.text = SPACES.sub(" ", "".join(r.parts)).strip(" ")
    return [r for r in runs if r.text]


def smooth(values: np.ndarray) -> np.ndarray:
    """A Gaussian of radius one along the page."""
    padded = np.pad(values, 1, mode="edge")
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


#: Factors of a path: under an article, outside one where the page has one, set apart by name, and the least of a path of links.
IN_ARTICLE, OUTSIDE, SET_APART, ALL_LINKS = 2.0, 0.5, 1 / 12, 0.1
#: A path's value must reach this share of the deviation of the page's values, but no more than MOST_BOUND and no less than LEAST_BOUND.
SPREAD, LEAST_BOUND, MOST_BOUND = 0.5, 1.5, 8.0
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def path_ratios(runs: list[Run]) -> np.ndarray:
    """Of each block, the fused ratios of its path: length and punctuation by node, smoothed along the page."""
    sums: dict[tuple[int, bool], np.ndarray] = {}
    for r in runs:
        key = (r.path, r.apart)
        sums[key] = sums.get(key, 0.0) + np.array([len(r.text), len(PUNCTUATION.findall(r.text)), 1.0])
    means = np.array([sums[r.path, r.apart] for r in runs])
    length, marks = smooth(np.log2(1 + means[:, 0] / means[:, 2])), smooth(np.log2(1 + means[:, 1] / means[:, 2]))
    return length * (1 + marks)


def path_factors(runs: list[Run]) -> np.ndarray:
    """Of each block, what its path's elements and links say, as a factor of its ratios."""
    text: dict[tuple[int, bool], int] = {}
    linked: dict[tuple[int, bool], int] = {}
    for r in runs:
        key = (r.path, r.apart)
        text[key] = text.get(key, 0) + len(r.text)
        linked[key] = linked.get(key, 0) + min(r.linked, len(r.text))
    some = any(r.article and not r.apart for r in runs)
    out = []
    for r in runs:
        place = SET_APART if r.apart else IN_ARTICLE if r.article else OUTSIDE if some else 1.0
        out.append(place * max(ALL_LINKS, 1.0 - linked[r.path, r.apart] / text[r.path, r.apart]))
    return np.array(out)


def main_text(page: str | None) -> str:
    """The blocks of the content paths, joined by blank lines."""
    runs = blocks(page or "")
    if not runs:
        return ""
    value = path_ratios(runs) * path_factors(runs)
    # a heading has the highest value of the text that it heads, up to the next heading, where that is more
    below, place = 0.0, None
    for i, r in reversed(list(enumerate(runs))):
        if (r.apart, r.article) != place:
            below, place = 0.0, (r.apart, r.article)
        value[i] = max(value[i], below) if r.heading else value[i]
        below = value[i] if r.heading else max(below, value[i])
    by_path: dict[tuple[int, bool], list[float]] = {}
    for r, v in zip(runs, value, strict=True):
        by_path.setdefault((r.path, r.apart), []).append(v)
    bound = min(MOST_BOUND, max(LEAST_BOUND, SPREAD * float(np.std(value))))
    kept = {p for p, v in by_path.items() if np.mean(v) >= bound}
    return "\n\n".join(r.text for r in runs if (r.path, r.apart) in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url and html are read): page_id, url, text, n_chars.

    The text of a null, empty or contentless page is empty. Rows that repeat a page each have a result. Extra columns
    play no part; an empty table gives no rows.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = select_present(pages, "page_id", "url", "html")
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("page_id", "url")]
    return rows.mapInPandas(read, f"{', '.join(kinds)}, text string, n_chars long").withColumn("n_chars", F.col("n_chars").cast("long"))
