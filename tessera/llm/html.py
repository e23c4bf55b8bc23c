"""Main text of web pages from flat text blocks (operator 7).

A page is cut into text blocks at its block tags.  A block's features are its word
count and link density, those of the blocks before and after it, and what encloses it.
A decision tree, grown on the small labelled table below, tells main text from the rest.

Defined results: a null or empty page, and one without main text, gives the empty
string; pages are read to their end however they are cut off (an open tag or comment
runs to the end, an open title, script or style of the head to the head's end); repeated rows give equal rows; other columns, whatever their names,
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|(\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Tags left out with all up to their end tag, and where to look for it no further: then the tag alone is left out (and a list's or button's own text).
FRAME = r"</?(?:html|body|main|article|section|nav|header|footer|aside)\b"
LEFT_OUT = {tag: re.compile(rf"</{tag}\s*>|(?={FRAME}{stop})", re.I) for tag, stop in {"select": r"|<select\b", "button": r"|<button\b", "iframe": "", "object": ""}.items()}
OWN_TEXT = re.compile(r"[^<]*+(?:</?(?:option|optgroup|hr)\b[^>]*+>[^<]*+)*+", re.I)
#: Where an <svg> ends, as in browsers: its end tag, or a tag of text that is not in a <foreignObject>.
SVG_END = re.compile(rf"</svg\s*>|(<foreignobject\b.*?(?:</foreignobject\s*>|\Z))|(?={FRAME}|</?(?:p|div|h[1-6]|ul|ol|dl|table|blockquote|pre)\b)", re.S | re.I)
#: What ends a head that an open <title> or <script> would run over.
HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
#: Tags within a line of text; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that enclose blocks and are followed by their end tag.
ENCLOSING = set("html body nav header footer aside form dialog menu article main section div ul ol dl table blockquote figure details fieldset".split())
PLAIN_BOILER = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
MAIN_TAGS = {"article", "main"}
#: Tags that hold the page or its main text: no class, id or attribute makes them boilerplate.
NEVER_BOILER = {"html", "body", "article", "main"}
#: Words in class, id and role that mark what is not, or is, main text.
BOILER_NAMES = set(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice gdpr popup modal"
    " overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies disqus respond breadcrumb breadcrumbs pagination pager"
    " toolbar widget copyright masthead topbar skip complementary contentinfo".split()
)
MAIN_NAMES = set("article main content post entry story body text".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "main")


def marks(tag: str, attributes: str, in_main: bool) -> tuple[int, int]:
    """Whether a tag opens boilerplate, and whether it opens main text."""
    names: set[str] = set()
    if "=" in attributes:
        for found in ATTRIBUTE.finditer(attributes):
            names.update(x.lower() for x in NAME.findall(found[2] or found[3] or found[4] or ""))
    boiler = tag not in NEVER_BOILER and (tag in PLAIN_BOILER or bool(names & BOILER_NAMES) or tag == "header" and not in_main or ("hidden" in attributes.split()))
    return int(boiler), int(tag in MAIN_TAGS or not boiler and bool(names & MAIN_NAMES) and tag in ("div", "section"))


def after_svg(page: str, at: int) -> int:
    """Where the drawing that ``at`` is in ends."""
    while found := SVG_END.search(page, at):
        if not found[1]:
            return found.end()
        at = found.end()
    return len(page)


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the non-empty blocks of a page, and their features."""
    texts: list[str] = []
    rows: list[tuple[int, int, int, int]] = []  # words, words in links, boiler, main
    stack: list[tuple[str, int, int]] = []
    boiler = main = 0
    parts: list[str] = []
    linked = link_from = 0
    in_link = False

    def words_of(pieces: list[str]) -> int:
        return len(unescape("".join(pieces)).split())

    def close() -> None:
        nonlocal linked, link_from
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                within = linked + (words_of(parts[link_from:]) if in_link else 0)
                texts.append(" ".join(words))
                rows.append((len(words), min(within, len(words)), boiler, main))
            parts.clear()
        linked = link_from = 0

    at = 0
    in_head = True  # until an open <title> or <script> had to be ended by the head's end
    no_end: dict[str, int] = {}  # up to where a tag has no end tag
    while token := TOKEN.search(page, at):
        begin, end = token.span()
        if begin > at:
            parts.append(page[at:begin])
        at = end
        if token[1]:
            if token[1].lower() == "title":
                close()
            else:
                parts.append(" ")
            if token[2] is not None and in_head:
                in_head = False
                if ended := HEAD_END.search(page, begin):
                    at = ended.start()
            continue
        if not token[4]:
            continue
        tag = token[4].lower()
        if tag == "svg" or tag in LEFT_OUT:
            parts.append(" ")
            if token[3] or token[5].endswith("/"):
                continue
            if tag == "svg":
                at = after_svg(page, end)
            elif begin >= no_end.get(tag, 0):
                ended = LEFT_OUT[tag].search(page, end)
                if ended and ended[0]:
                    at = ended.end()
                else:
                    no_end[tag] = ended.start() if ended else len(page)
            if tag in ("select", "button") and at == end:
                at = OWN_TEXT.match(page, end).end()
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                if in_link:
                    linked += words_of(parts[link_from:])
                in_link, link_from = not token[3], len(parts)
            continue
        close()
        if tag not in ENCLOSING:
            continue
        if not token[3]:
            b, m = marks(tag, token[5], bool(main))
            stack.append((tag, b, m))
            boiler, main = boiler + b, main + m
        elif any(x[0] == tag for x in stack):
            while stack:
                name, b, m = stack.pop()
                boiler, main = boiler - b, main - m
                if name == tag:
                    break
    if at < len(page):
        parts.append(page[at:])
    close()
    own = np.array([(w, k / w, b, m) for w, k, b, m in rows], np.float64).reshape(-1, 4)
    edge = np.zeros((1, 2))
    around = np.concatenate([edge, own[:, :2], edge])
    return texts, np.concatenate([own[:, :2], around[:-2], around[2:], own[:, 2:]], axis=1)


#: The labelled table: small pages in whose blocks a leading + marks main text.
LABELLED = (
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News of the day</a></li></ul></nav><div class=ad>Buy two pay one until Sunday in all our shops</div>"
    "<article><h1>+The river</h1><p>+It rose for three days and then fell back to where it had been before the rain.</p><p>+Nobody was hurt.</p><p>+Done.</p></article>"
    "<footer>Company name and street, all rights reserved</footer></body>",
    "<body><header><a href=/>Site</a> <a href=/a>About</a></header><main><h1>+A long title about bread and salt</h1><p>+Bread needs flour, water, salt and time, <a href=/s>more than most</a> people give it.</p>"
    "<ul><li>+Flour</li><li>+Water</li></ul><div class='share buttons'>Share this</div><aside>Read also what we wrote last year on the subject of wheat and rye</aside><p>+Bake it hot.</p></main>"
    "<div id=comments><h2>Comments</h2><p>I tried this twice and it failed both times, no idea what went wrong there.</p><p>Great!</p></div><footer><p>Imprint</p></footer></body>",
    "<body><div class=menu><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><p>+Once there was a village by the sea where all boats were painted in the same blue colour, and nobody knew why.</p>"
    "<p>+An old man said that his father had once found a ship full of blue paint, and that it had never run out since then.</p><p><a href=/p>Previous</a> <a href=/n>Next</a></p><p>Copyright</p></body>",
    "<body><div class='cookie notice'>We use cookies to make this site work and to measure how it is used by you and others</div><div id=content><h2>+Results</h2><p>+Won.</p>"
    "<p>+The home side scored in the first minute and again in the last.</p><p>+<a href=/t>The whole table</a></p></div><div class=sidebar><p>Weather: rain in the morning, then dry with some sun in the north</p></div></body>",
    "<body><form><p>Search the archive</p></form><article><header><h1>+Night train</h1><p>+By our own reporter</p></header><p>+It leaves at nine.</p><form><p>Your mail address for our letter</p></form><p>+It gets there at six in the morning, if all goes well.</p>"
    "<section class=comments><p>First, and what a nice train that is, I would take it any day of the week.</p></section></article><p><a href=/x>Terms</a> <a href=/y>Privacy</a></p></body>",
    "<body><p><a href=/>Start</a></p><p><a href=/b>Blog</a></p><div><p>+This page has no frame at all, just a few paragraphs that follow each other from top to bottom of it.</p><p>+The second paragraph is shorter but still has enough words to stand.</p></div>"
    "<p><a href=/i>Imprint</a></p><p><a href=/c>Contact us here</a></p></body>",
    "<body><nav><a href=/>A menu whose single entry is as long as any sentence in the text of the page itself</a></nav><article><p>+Short.</p><p>+<a href=/l>Linked words only</a></p><p>+A list of things: one, two, three, four, five, six, seven, eight, nine and ten.</p></article>"
    "<footer>A footer that goes on and on about who made this page and when and why, with no link in it</footer></body>",
    "<body><nav><a href=/>Home</a></nav><article><h1>+Cut off</h1><p>+The rest of this page was never",
    "<body><div id=main><p>+Just one",
    "<body><p>+No frame, no menu, and after this only paragraph of the page there is nothing else to be read",
    "<body><article><p>+Two words</p></article></body>",
    "<body><p><a href=/>Only a link</a></p></body>",
    "<html><head><title>No end of the head</title><body class='home has-sidebar comments-open'><nav><a href=/>Home</a></nav><article class='post ad-free'><h1>+Salt</h1><p>+It was carried over the hills for as long as anyone remembers.</p>"
    "<svg class=icon /><p>+Then came the railway.</p></article><div class=sidebar><p>Read more of what people liked this week</p></div></body>",
    "<html class=no-widget><body><form><p>Find a page</p></form><main id=search-results><h1>+What was found</h1><p>+Three old maps of the valley, drawn by the same hand within a year.</p><object data=map.svg /><p>+Two more.</p></main>"
    "<footer><p>All rights reserved by those who made this page</p></footer></body></html>",
)


def examples() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, labels = [], []
    for page in LABELLED:
        texts, _ = blocks(page)
        rows.append(blocks(page.replace("+", ""))[1])
        labels += [text.startswith("+") for text in texts]
    return np.concatenate(rows), np.array(labels)


@cache
def tree() -> tuple:
    """The decision tree: (feature, threshold, branch up to it, branch above) or a label."""
    return grow(*examples())


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | bool:
    """Splits by Gini impurity; of equal splits the last feature in FEATURES (what encloses a block) wins."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = None
    for feature in reversed(range(x.shape[1])):
        values = np.unique(x[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= threshold
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-9:
                best = impurity, feature, threshold, low
    if best is None:
        return bool(y.mean() >= 0.5)
    _, feature, threshold, low = best
    return feature, float(threshold), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(node: tuple | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(node, bool):
        return np.full(len(x), node)
    feature, threshold, below, above = node
    low = x[:, feature] <= threshold
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    texts, features = blocks(page)
    return "\n".join(text for text, good in zip(texts, classify(tree(), features)) if good) if texts else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            found = pa.array([main_text(x) for x in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, text])

    kept = pages.drop(text)
    return kept.mapInArrow(run, kept.withColumn(text, F.lit(None).cast("string")).schema)
