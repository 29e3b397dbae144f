"""Main text of web pages: flat text blocks, described by word counts and link densities of themselves and
their neighbours, classified by a decision tree that is trained here on the blocks of a few labelled pages.

A page is cut into blocks by one scan, whose time is linear in its length whatever the markup. Besides its words and
links a block knows what the tags around it mean: whether it stands in an article, and whether in a part that HTML sets
apart. Words of class and id are a weak hint, but for readers' comments: nothing else tells their prose from the author's.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import map_arrow

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose text is set apart from the page's, by what HTML means them for.
APART = {"nav", "footer", "aside", "menu", "dialog", "select", "button", "svg", "head", "object", "canvas", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CONTENT = {"article", "main"}
CLOSES_ITSELF = {"p", "li", "option", "dt", "dd", "tr"}
#: Containers whose names may hint at boilerplate; names of paragraphs, headings and articles tell nothing.
NAMED = {"div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "header", "span", "fieldset", "center", "details", "form", "figure", "address"}
NOISE = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha consent cookie cookies copyright disclaimer "
    "feedback foot footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "privacy promo promotion promoted recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
#: Words that may stand beside those in a name (ad-slot, site-footer, sidebar-right).
BESIDE = set("area bar block body bottom box col column container content first global group holder inner item items last left links list main outer page panel primary right secondary section site slot small text top unit wrap wrapper".split())
#: A part of a name that says readers' comments, alone or grown together with a word beside it; and the parts that may stand with it (post-comments, comments__list, reader-comments).
COMMENT = re.compile(r"(?:user|reader|post|article|page|blog|site|entry|all)?s?comments?(?:list|section|area|thread|wrapper|container|box|block|body|item|content|text)?|disqus|replies|reply|respond")
WITH_COMMENT = BESIDE | set("all area article author blog body discussion div entry facebook fb latest more new news page post posts public reader readers recent section site story thread user users view visitor visitors wp your".split())
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style|name|href|data-main)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?=[\s/>]|$))", re.I)
#: apart: 2 in a part that is set apart or beside an article, 1 in a form; region: 2 in an article or main, 1 on a page without one, 0 beside one.
FEATURES = ("apart", "region", "named", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")

_WORDS = "most of what pages of this kind have to say stands in paragraphs like this one which go on for some lines have a few commas and hardly ever a link".split()
_LENGTHS = {"LONG": (31, 52, 24, 75, 40, 110, 28, 60, 22, 36, 160), "MID": (12, 8, 17, 6, 14, 10, 20, 9, 13)}
#: Pages as they are written, with places for paragraphs of several lengths; data-main marks their main text.
_PAGES = [
    """<body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a><li><a href=/b>Contact</a></ul></nav><div class=ad>Buy more of this now.</div>
    <article data-main><h1>A title</h1><p>LONG</p><p>Yes.</p><p>MID</p><ul><li>one</li><li>two of them</li></ul><p>LONG LONG</p></article>
    <footer>All rights reserved, MID</footer></body>""",
    """<body><header><h1>The site</h1><p>MID</p></header><div id=cookie-notice>We use cookies.<button>OK</button></div><main><div class=post data-main><h2>Title</h2><p>LONG</p>
    <p>See <a href=/x>this other page</a></p></div><form><label>Name</label><p>MID</p></form><aside><p>LONG</p></aside><div class=ad-slot>Buy</div>
    <p data-main>The end.</p><section id=comments><h3>Comments</h3><article class=comment><p>LONG</p></article></section></main><div class=sidebar><p>LONG</p></div><footer>x</footer></body>""",
    """<body><div class=nav><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sports</a></div><div id=content data-main><h1>What happened in town</h1><p>LONG</p><p>MID</p><p>LONG</p>
    <p>MID</p></div><div class=sidebar><h3>More</h3><p>MID</p></div><div class=footer><a href=/t>Terms</a> <a href=/p>Privacy</a></div><div>copyright of the site</div></body>""",
    """<body><table><tr><td><a href=/1>one</a><td><a href=/2>two</a><td><a href=/3>three</a></tr><tr><td data-main><p>LONG</p><p>LONG</p><h2>And then</h2><p>LONG</p></td></tr></table>
    <p>written in the year</p></body>""",
    """<p data-main>LONG</p><p data-main>LONG</p><p data-main>MID</p>""",
    """<div data-main>LONG</div>""",
    """<body><form action=/><div class=menu><a href=/>Start</a></div><div data-main><p>LONG</p><p>LONG</p><p>LONG</p></div><div><label>Your name</label><input><p>Send us a line.</p></div></form></body>""",
    """<body><main><article data-main><h1>News</h1><p>MID</p><p>LONG</p><p><a href=/ref>a source that is named here</a></p></article><div class=share><a href=/f>Share</a></div>
    <ul class=related><li><a href=/r>one more page about it</a><li><a href=/q>the next page on that</a></ul><div class=tags>Tags: this, that</div></main></body>""",
    """<body><div class=notice>MID</div><div class=newsletter><p>LONG</p></div><div data-main><h1>Title</h1><p>LONG</p><p>LONG</p><p>MID</p><p>LONG</p></div><div class=ads>Buy now, MID</div></body>""",
    """<body><div><a href=/1>one of the many other pages that may be read on this site</a></div><div><a href=/2>and the next one of those pages that may be read here</a></div><div data-main><p>LONG</p><p>LONG</p></div>
    <div><a href=/3>yet another one of these pages that can be read</a> now</div><div><a href=/4>last one of those pages</a></div></body>""",
    """<body><p>MID</p><nav><p>LONG</p></nav><main data-main><ul><li><a href=/1>first source of this text</a><li><a href=/2>second one</a></ul><p>word</p></main><p>LONG</p><p>x</p></body>""",
    """<body><article data-main>word</article></body>""",
    """<body><article data-main><p>a few words only</p></article></body>""",
    """<body><main data-main>Two sentences. They stand alone.</main></body>""",
    """<body><nav><a href=/>Home</a></nav><article data-main><p>LONG</p><h2>Sources</h2><ul><li><a href=/1>First of them</a><li><a href=/2>Second</a><li><a href=/3>The third source of all</a></ul><p><a href=/4>One more</a></p></article></body>""",
    """<body><article><p data-main>LONG</p><form><p>LONG</p><label>Your mail</label><p>LONG MID</p></form><p data-main>LONG</p><form><fieldset>LONG LONG</fieldset></form></article></body>""",
    """<body><div><a href=/>Home</a></div><div data-main><h1>What links say</h1><p>LONG <a href=/r>one link</a> LONG</p><p>MID <a href=/s>some words of a link</a> LONG</p><p>LONG <a href=/t>three words more</a></p><p>LONG</p></div><div>see <a href=/n>next page</a></div></body>""",
    """<body><p data-main>LONG <a href=/r>a link of five words</a> MID</p><p data-main>LONG</p><p data-main>MID LONG <a href=/s>it</a></p><div>or <a href=/u>another page of ours</a></div></body>""",
    """<body><article><p data-main>LONG</p><nav><a href=/1>one</a> <a href=/2>two</a></nav><p data-main>LONG</p><aside><h3>More</h3><ul><li><a href=/3>third page on it</a><li><a href=/4>fourth</a></ul></aside><p data-main>MID</p><p data-main><a href=/5>source</a></p><footer><a href=/6>author</a></footer></article></body>""",
    """<body><main><nav><ul><li><a href=/1>part one</a><li><a href=/2>part two</a></ul></nav><h1 data-main>Parts</h1><p data-main>LONG <a href=/r>link</a></p><form><a href=/f>Forgot it</a></form><aside><p>MID <a href=/4>so</a></p></aside><ul data-main><li><a href=/k>kept</a></ul></main></body>""",
    """<body><article><p data-main>LONG</p><div class=ad>Buy this</div><p data-main>LONG LONG</p><div class=promo-box><p>MID</p></div><p data-main>LONG</p><div class=ad-slot>LONG</div><p data-main>LONG MID</p></article></body>""",
    """<body><main><h1 data-main>Top</h1><div class=share>Share it</div><p data-main>LONG LONG</p><div class=newsletter-box>MID</div><p data-main>LONG</p><div class=related>MID</div><p data-main>LONG MID LONG</p></main></body>""",
    """<body><div><a href=/a>Home</a> <a href=/b>News</a></div><table data-main><tr><td>LONG LONG</td></tr></table></body>""",
    """<body><p><a href=/a>Back to the start</a></p><p data-main>LONG</p></body>""",
    """<body><p><a href=/a>Home</a></p><div data-main>LONG MID</div><p><a href=/b>Next</a></p></body>""",
    """<body><article data-main><p>LONG</p><p>Yes.</p></article></body>""",
    """<body><nav><a href=/>Home</a></nav><main data-main><h1>One</h1><p>MID</p><p>No more</p></main></body>""",
    """<body><article data-main><p>MID</p><p>x</p></article><footer><p>LONG</p></footer></body>""",
    """<body><article data-main><h1>Up</h1></article></body>""",
    """<body><div><article data-main>all of it</article></div></body>""",
    """<body><div class=head><a href=/>Start</a></div><article data-main><h2>Short news</h2></article><div>end</div></body>""",
    """<body><article data-main><p>MID</p></article></body>""",
    """<body><p><a href=/>Home</a><div data-main><p>LONG</p></div><div data-main><p>LONG</p></div></body>""",
    """<body><h1 data-main>What it says</h1><p data-main>LONG MID</p><p data-main>LONG LONG</p></body>""",
    """<body><ul><li><a href=/a>a</a><li><a href=/b>b and more</a></ul><div><p data-main>MID, MID</p><p data-main>LONG LONG</p><p data-main>LONG</p><p data-main>MID MID</p></div></body>""",
    """<body><div><a href=/1>first</a> | <a href=/2>second</a></div><h2 data-main>Heading of a part</h2><p data-main>LONG</p><blockquote data-main>LONG LONG</blockquote><p data-main>LONG</p><div>page of the site</div></body>""",
    """<body><div data-main>LONG LONG LONG<br>LONG</div><div><a href=/>top</a></div></body>""",
    """<body><article><p data-main>LONG</p><div class=ad>LONG</div><p data-main>MID</p><div class=related-links>MID</div><ul class=share-links><li><a href=/f>On this site</a><li>or that</ul></article></body>""",
    """<body><div data-main><p>LONG</p><p>LONG MID</p></div><div>Popular today</div><ul><li><a href=/1>what the people of this town have said about it so far</a><li><a href=/2>why the old bridge was closed and what comes in its place</a></ul><div>More of this</div>
    <ul><li><a href=/3>the ten best places to see before the summer ends here</a><li><a href=/4>one more of those</a></ul></body>""",
    """<body><div><a href=/a>first page of the whole long list of pages</a></div><div>Latest news</div><div><a href=/b>another one of the pages that are listed here today</a></div><div>Read next</div><div><a href=/c>and the last one of them which is about the sea</a></div>
    <h1 data-main>What is new</h1><p data-main>LONG</p><p data-main>Yes.</p><p data-main>LONG MID</p></body>""",
    """<body><div data-main><h1>Two words</h1><p>MID</p><p>No.</p><p>MID</p><h2>Next part</h2><p>MID</p><p>LONG</p></div><div>You may like</div><div><a href=/1>the story of a house which stood for three hundred years</a></div><div>Also here</div><div><a href=/2>how to read a map when there is no sun to be seen</a></div></body>""",
    """<body><div data-main><p>MID</p><p>LONG</p></div><div><a href=/1>a page that tells the same story as it was seen from the other side</a></div><div data-main><p>MID LONG</p></div><ul><li><a href=/2>what else was said on that day in the town</a></ul><p data-main>MID</p>
    <div><a href=/3>the whole list of all of the pages on this site</a></div><p data-main>LONG</p><p data-main>MID MID</p><div><a href=/4>back to the first of the pages we have on it</a></div></body>""",
    """<body><p data-main>MID</p><nav><a href=/1>all the pages there are on the rivers of this land</a></nav><p data-main>LONG</p><aside><a href=/2>a page on the longest of these rivers and its towns</a></aside><p data-main>MID LONG</p><footer><a href=/3>who wrote these pages and why it was done at all</a></footer></body>""",
    """<body><article><p data-main>MID</p><nav><a href=/1>all the pages there are on the rivers of this land</a></nav><p data-main>LONG</p><p data-main>Yes.</p><aside><a href=/2>a page on the longest of these rivers and its towns</a></aside><h2 data-main>Next part</h2><aside><a href=/2>a page on some of these rivers and its towns</a></aside><p data-main>MID LONG</p></article></body>""",
    """<body><article data-main><h1>One</h1><p>LONG</p><p>It was so then</p><p>MID</p><p>And that is all</p><p>LONG</p><p>They all went home</p></article><footer>All rights reserved</footer></body>""",
    """<body><div data-main><p>LONG</p><p>It was so then</p><p>MID</p><p>Not one of them</p><p>LONG</p><p>They all went home</p><p>MID</p></div></body>""",
    """<body><div class=banner data-main><p>LONG</p><p>LONG LONG</p><p>LONG</p></div><p data-main>LONG</p><div class=widget>MID</div><div class=legal>LONG</div><p><a href=/>back</a></p></body>""",
]


def written(pages: list[str] = _PAGES, times: int = 4) -> list[str]:
    """Each page `times` times, with paragraphs of other lengths each time."""
    used = {k: itertools.cycle(v) for k, v in _LENGTHS.items()}
    say = lambda n: " ".join(itertools.islice(itertools.cycle(_WORDS), n))
    return [re.sub(r"LONG|MID", lambda m: say(next(used[m[0]])), page) for _ in range(times) for page in pages]


LABELLED = written()


@dataclass
class Tree:
    """Binary decision tree: a leaf has a label, an inner node sends rows with feature <= threshold left."""

    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    label: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.label)
        low = x[:, self.feature] <= self.threshold
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, leaf: int = 3) -> Tree:
    """CART with the Gini measure, at least `leaf` rows on both sides of a split; among equal splits the first feature and the lowest threshold win."""
    if depth == 0 or y.all() or not y.any():
        return Tree(label=bool(2 * y.sum() >= len(y)))

    def gini(part: np.ndarray) -> float:
        p = part.mean()
        return 2 * p * (1 - p) * len(part)

    best = (gini(y) - 1e-12, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) >= leaf and (cost := gini(y[low]) + gini(y[~low])) < best[0] - 1e-12:
                best = (cost, f, float(t))
    if best[1] < 0:
        return Tree(label=bool(2 * y.sum() >= len(y)))
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf))


def _says_comments(word: str, first: bool) -> bool:
    """Whether a class or id names readers' comments; first: only if it begins so, as an article's name may tell of its own comments."""
    parts = [p for p in word.split("-") if p and not p.isdigit()]
    found = [bool(COMMENT.fullmatch(p)) for p in parts]
    return any(found) and (found[0] or not first) and all(f or p in WITH_COMMENT for f, p in zip(found, parts, strict=True))


def _hints(name: str, named: dict[str, str]) -> tuple[bool, bool]:
    """(whether class or id names boilerplate, whether they name readers' comments)."""
    words = f"{named.get('class', '')} {named.get('id', '')}".replace("_", "-").split()
    comment = name not in ("html", "body", "main") and any(_says_comments(w, name == "article") for w in words)
    hint = name in NAMED and any((parts := set(w.split("-"))) & NOISE and parts <= NOISE | BESIDE for w in words)
    return hint, comment


def _tag_end(page: str, at: int) -> int:
    """The end of a tag's text, which quoted values may hold `>` in; -1 without one."""
    while found := END.search(page, at):
        if not found[1]:
            return found.start()
        close = page.find(found[1], found.end())
        at = close + 1 if close >= 0 else found.end()  # a quote without a partner is none
    return -1


def blocks(page: str) -> tuple[list[str], np.ndarray, list[bool]]:
    """(texts of the page's blocks in order, their features, whether data-main marks them): a block is what stands between two block-level tags."""
    texts: list[str] = []
    facts: list[tuple[int, bool, bool, bool, int, float]] = []
    pieces: list[str] = []
    # a frame holds what was so before its element: name, apart, inside, named, main
    stack: list[tuple[str, int, bool, bool, bool]] = []
    open_names: Counter[str] = Counter()
    apart, inside, named, main = 0, False, False, False
    linked = 0
    link_depth = -1  # of the open link, -1 without one

    def flush() -> None:
        nonlocal linked
        words = html.unescape("".join(pieces)).split()
        pieces.clear()
        if words:
            texts.append(" ".join(words))
            facts.append((apart, inside, named, main, len(words), min(1.0, linked / len(words))))
        linked = 0

    def text(part: str) -> None:
        nonlocal linked
        if part:
            pieces.append(part)
            if link_depth >= 0:
                linked += len(part.split())

    def pop() -> None:
        nonlocal apart, inside, named, main, link_depth
        name, apart, inside, named, main = stack.pop()
        open_names[name] -= 1
        if link_depth > len(stack):
            link_depth = -1

    at, end = 0, len(page)
    while at < end:
        found = OPEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        start = found.start()
        if page.startswith("<!--", start):
            close = page.find("-->", start + 2)
            at = close + 3 if close >= 0 else end
            continue
        tag = NAME.match(page, start)
        if not tag:
            close = page.find(">", start)
            at = close + 1 if close >= 0 else end
            continue
        close = _tag_end(page, tag.end())
        if close < 0:  # a tag that never ends takes what follows with it
            break
        name, ends, at = tag[1].lower(), page[start + 1] == "/", close + 1
        if name in RAW and not ends:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            pieces.append(" ")
        if name == "a":
            link_depth = -1
            if not ends:  # a name without an address marks a place and is no link
                own = {m[1].lower() for m in ATTRIBUTE.finditer(page, tag.end(), at - 1)}
                link_depth = len(stack) if "href" in own or "name" not in own else -1
        elif ends:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            if name in CLOSES_ITSELF and stack and stack[-1][0] == name:
                pop()
            own = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(page, tag.end(), at - 1)}
            stack.append((name, apart, inside, named, main))
            open_names[name] += 1
            hint, comment = _hints(name, own)
            hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
            if name in APART or hidden or comment or own.get("role") in ROLES - {"form"} or name == "header" and not inside:
                apart = 2
            elif name == "form" or own.get("role") == "form":
                apart = max(apart, 1)
            elif name in CONTENT and apart < 2:
                apart, inside, named = 0, True, False
            named, main = named or hint, main or "data-main" in own
    flush()
    own = np.array([(f[0], 0, f[2], f[4], f[5]) for f in facts], float).reshape(-1, 5)
    article = np.array([f[1] and f[0] == 0 for f in facts], bool)
    own[:, 1] = np.where([f[1] for f in facts], 2, 0) if article.any() else 1
    own[own[:, 1] == 0, 0] = 2  # what stands beside an article is set apart, whatever its length
    near = np.zeros((len(own) + 2, 2))
    near[1:-1] = own[:, 3:]
    return texts, np.hstack([own, near[:-2], near[2:]]), [f[3] for f in facts]


def trained(labelled: list[str] = LABELLED) -> Tree:
    """The tree of the blocks of labelled pages."""
    found = [blocks(page) for page in labelled]
    return grow(np.vstack([x for _, x, _ in found]), np.concatenate([np.array(y, bool) for _, _, y in found]))


def main_text(page: str, tree: Tree) -> str:
    texts, features, _ = blocks(page)
    return "\n".join(t for t, keep in zip(texts, tree.predict(features), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", labelled: list[str] = LABELLED) -> DataFrame:
    """Columns of pages but the html, + text (empty if none) and n_chars.

    Null and empty html give an empty text; own columns named text or n_chars are replaced, others stay, whatever their
    names. Each page is handled alone, so rows may repeat and have any id, and tables may be empty; a page is read
    whole, however long, in time that is linear in its length.
    """
    tree = trained(labelled)
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py() or "", tree) for page in part.column(html_column)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*others, "text", "n_chars"],
                )

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    return map_arrow(pages.select(*others, html_column), of, f"{kinds}, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
