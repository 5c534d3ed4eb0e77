"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, left to right, as a flat row of text blocks: block-level tags end a block, inline tags do
not. A block has its word count and link density, those of its two neighbours, and what the tags
around it say: inside an article, inside boilerplate (by tag, role, class or id), a heading. A
small decision tree, grown on the labelled pages below, keeps or drops each block.

Defined cases: null html is empty; a page without kept blocks gives an empty text; unclosed comments,
scripts and tags run to the end of their parent or the page; a page of one block is judged like any
other; repeated rows give repeated rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of HTML and of common page markup.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HIDDEN = "script style noscript template title textarea select svg iframe object canvas math".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar"
    " nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer comment comments"
    " commentlist reply replies disqus respond cookie cookies consent gdpr notice notices alert popup"
    " modal overlay newsletter subscribe subscription signup login share sharing social related"
    " recommended recommendations widget widgets pagination pager toolbar copyright disclaimer skip"
    " form search teaser outbrain taboola".split()
)
MAIN_WORDS = frozenset("article content story post entry main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>" + "|".join(HIDDEN) + r")\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?a-z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_UNSEEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    start: int
    words: int
    link_words: int
    inside: int
    boiler: int
    heading: int


def _standing(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate and whether it holds main text, by its tag and names."""
    boiler, main = tag in BOILER_TAGS, tag in MAIN_TAGS
    if attrs and tag not in ("html", "body"):
        for kind, *values in _NAMES.findall(attrs):
            value = next((v for v in values if v), "").lower()
            if kind.lower() == "role":
                boiler |= value in BOILER_ROLES
                main |= value == "main"
            else:
                names = set(_WORDS.findall(value))
                boiler |= bool(names & BOILER_WORDS)
                main |= bool(names & MAIN_WORDS)
        boiler |= bool(_UNSEEN.search(attrs))
    return boiler, main and not boiler


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    boiler = main = 0
    parts: list[str] = []
    links: list[str] = []
    in_link, heading, start, at = False, 0, 0, 0

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inside = len(" ".join(links).split())
                words = len(text.split())
                found.append(Block(text, start, words, min(inside, words), min(main, 1), min(boiler, 1), heading))
            parts.clear()
            links.clear()

    def add(piece: str) -> None:
        nonlocal start
        if "&" in piece:
            piece = html.unescape(piece)
        if not parts:
            start = at
        parts.append(piece)
        if in_link:
            links.append(piece)

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["hidden"]:
                close_block()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not token["end"]
            continue
        close_block()
        if token["end"]:
            if tag in HEADINGS:
                heading = 0
            if any(open_tag == tag for open_tag, _, _ in stack):
                while True:
                    name, was_boiler, was_main = stack.pop()
                    boiler -= was_boiler
                    main -= was_main
                    if name == tag:
                        break
                in_link = False
            continue
        if tag in VOID or tag in ("p", "li") or token["attrs"].endswith("/"):
            # Paragraphs and items hold no blocks, and their end tags may be missing.
            continue
        heading = int(tag in HEADINGS)
        if heading:
            continue
        if tag in MAIN_TAGS:
            # A menu, header, footer or form that was never closed does not hold the article.
            while stack and stack[-1][1] and stack[-1][0] in ("nav", "header", "footer", "form", "ul", "ol"):
                _, was_boiler, was_main = stack.pop()
                boiler -= was_boiler
                main -= was_main
        is_boiler, is_main = _standing(tag, token["attrs"])
        stack.append((tag, is_boiler, is_main))
        boiler += is_boiler
        main += is_main
    if at < len(page):
        add(page[at:])
    close_block()
    return found


FEATURES = (
    "words",
    "link density",
    "words before",
    "link density before",
    "words after",
    "link density after",
    "inside main",
    "inside boilerplate",
    "heading",
)


def block_features(blocks: list[Block]) -> np.ndarray:
    own = np.array(
        [(b.words, b.link_words / b.words, b.inside, b.boiler, b.heading) for b in blocks], dtype=float
    ).reshape(-1, 5)
    around = np.zeros((len(own) + 2, 2))
    around[1:-1] = own[:, :2]
    return np.hstack([own[:, :2], around[:-2], around[2:], own[:, 2:]])


#: Labelled pages: pieces of html in order, each with 1 if its blocks belong to the main text. Small on
#: purpose; the variety is in the kinds of page, not in the wording.
LABELLED: list[list[tuple[int, str]]] = [
    [
        (0, "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"),
        (0, "<div class='ad'>Buy two and get the third one for free today.</div>"),
        (1, "<article><h1>The river rises</h1><p>After three days of rain the river stands two metres above its usual level.</p>"),
        (1, "<p>Yes.</p><p>Helpers have filled sand bags since <a href=z>Monday</a> morning.</p></article>"),
        (0, "<footer>&copy; 2020 example.org. All rights reserved.</footer></body></html>"),
    ],
    [
        (0, "<header><h1>Daily example</h1><p>News from the whole region, every day</p></header>"),
        (1, "<main><h2>Short note</h2><p>Closed.</p><ul><li>One egg</li><li>Two spoons of flour</li></ul>"),
        (1, "<blockquote>He said that nothing would change before the end of the year.</blockquote>"),
        (0, "<aside>Readers also liked these five stories about gardens and houses.</aside>"),
        (1, "<p>The council meets again in two weeks to vote on the plan.</p></main>"),
        (0, "<section class='comments'><h3>Comments</h3><p>I fully agree with this article, thank you very much for it!</p></section>"),
    ],
    [
        (0, "<div id='cookie-notice'>We use cookies to make this site better. By using it you agree.</div>"),
        (0, "<div class='menu'><a href=a>Start</a> <a href=b>Shop</a> <a href=c>Contact</a></div>"),
        (1, "<div class='content'><h1>How to mend a chair</h1><p>Take the old glue off with a sharp knife before you begin.</p>"),
        (1, "<table><tr><td>Glue</td><td>Wood</td></tr></table><p>Then wait for a night.</p>"),
        (0, "<form action=s><p>Enter your address to get our letter every week.</p></form>"),
        (1, "<p>The chair will hold for many years.</p></div>"),
        (0, "<div class='sidebar'><h3>Latest</h3><p>The new season starts with five fresh ideas for the garden.</p></div>"),
    ],
    [
        (0, "<p><a href=1>Home</a> | <a href=2>About us</a> | <a href=3>Archive</a></p>"),
        (1, "<div><p>The first trains of the morning were late because a tree had fallen on the line during the storm.</p>"),
        (1, "<p>Workers removed it within two hours, and by noon all of the trains were running on time again.</p>"),
        (1, "<p>According to the <a href=4>operator</a> nobody was hurt, and the damage to the wires is small.</p></div>"),
        (0, "<p><a href=5>Next story</a></p><p><a href=6>Older stories from this month</a></p><p>Contact</p>"),
    ],
    [
        (0, "<ul><li><a href=1>Politics</a></li><li><a href=2>Sports</a></li><li><a href=3>Culture and media</a></li></ul>"),
        (1, "<div><h1>Old mill opens its doors to visitors</h1><p>For the first time in fifty years the wheel of the old mill turns again, and visitors may watch it.</p>"),
        (1, "<p>Volunteers spent six summers on the repair of the roof, the floor and the heavy gears of oak.</p></div>"),
        (0, "<div class='share'>Share this story with all of your friends and colleagues now</div>"),
        (0, "<div class='related'><a href=5>Another mill burns down in the north of the country</a></div>"),
        (0, "<p>Imprint</p><p>Privacy</p>"),
    ],
    [
        (0, "<nav>Skip to the text of this page, please</nav>"),
        (1, "<article><p>One.</p><p>Two words.</p><p>And a longer paragraph with some more words at the end of it.</p>"),
        (1, "<p><a href=q>See the full list of all the winners here</a></p>"),
        (0, "<div class='advert'>The best shoes for the winter are waiting for you in our shop.</div>"),
        (1, "<h2>What comes next</h2><p>Nobody knows.</p></article>"),
        (0, "<div id='comments'><article class='comment'><p>First! What a great read this was today.</p></article></div>"),
        (0, "<footer><p>Written by volunteers in a small town near the sea since the year 1990.</p></footer>"),
    ],
    [
        (0, "<ul class='nav'><li>Start</li></ul>"),
        (1, "<article><h1>Snow</h1><p>It snowed all night.</p><p>The roads are closed until further notice and nobody"),
    ],
    [
        (1, "<main><p>Soup first.</p><p>Then fish with rice.</p><p>Late at night, cake.</p>"),
    ],
    [
        (1, "<article><p><a href=1>A table of all the results</a></p><p>Good night.</p><p>End.</p></article>"),
    ],
    [
        (1, "<p>A page may be no more than a few lines of text that somebody wrote by hand a long time ago.</p>"),
        (1, "<p>It has no menu, no header and no footer, and every line of it is what the reader came for.</p>"),
        (1, "<p>That is how the first pages of the web looked, and a few of them are still there today.</p>"),
    ],
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    features, labels = [], []
    for page in LABELLED:
        text = "".join(piece for _, piece in page)
        ends = np.cumsum([len(piece) for _, piece in page])
        blocks = blocks_of(text)
        features.append(block_features(blocks))
        labels += [page[int(np.searchsorted(ends, b.start, side="right"))][0] for b in blocks]
    return np.vstack(features), np.array(labels)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """Nested (feature, limit, below, above) of the best Gini splits; a leaf is a share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            below = x[:, feature] <= limit
            n = int(below.sum())
            if min(n, len(y) - n) < least:
                continue
            p, q = y[below].mean(), y[~below].mean()
            cost = 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)
            if cost < best[0] - 1e-12:
                best = (cost, feature, limit)
    _, feature, limit = best
    if feature is None:
        return share
    below = x[:, feature] <= limit
    return (
        feature,
        float(limit),
        grow_tree(x[below], y[below], depth - 1, least),
        grow_tree(x[~below], y[~below], depth - 1, least),
    )


@cache
def trained_tree():
    return grow_tree(*labelled_blocks())


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf of each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, limit, low, high = tree
    below = x[:, feature] <= limit
    out = np.empty(len(x))
    out[below] = classify(low, x[below])
    out[~below] = classify(high, x[~below])
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = classify(trained_tree(), block_features(blocks)) >= 0.5
    return " ".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


@pandas_udf(StringType())
def extracted(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per page."""
    text = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
