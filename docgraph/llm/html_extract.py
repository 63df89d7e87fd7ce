"""Main text of web pages by tag-path ratios.

Each text node has a tag path from the root; a class counts as part of the tag. Per path, the text length and the punctuation of
its nodes are aggregated to ratios (per node), smoothed over the sequence of nodes in the page, and fused by their product.
A path scores as its own nodes do on average, or as a part of what all nodes below one of the elements around it do, so that a short list
in an article is carried by the article. Paths that reach a share of the page's mean are content, all their nodes
with them; what lies between two content nodes of one article or main element is content too.

Elements that are no text by their meaning (navigation, page headers and footers, asides, forms, scripts) are left out before. Elements
that are only named like adverts, notices or comments count for little: their names do not decide, but their ratios have to be
so much the higher, and nothing around them carries them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements and roles that are no article text; a header is one only outside of articles.
OTHER_TAGS = frozenset("nav footer aside form button select menu dialog label input datalist".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Parts of class names and ids that hint at what is no article text, and what the ratios of such elements count.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer sidebar notice notices cookie cookies consent gdpr popup newsletter comment comments commentlist disqus".split()
)
HINTED = 0.02
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Paths below this share of the page's mean fused ratio are no content.
SHARE = 0.2
#: What the mean of an element counts for the paths below it, for each step down, and up to how many steps.
CARRY, STEPS = 0.5, 4

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ARTICLES = ("article", "main")


class Page:
    """The text nodes of a page and the tree of its tag paths; all steps take time linear in the page.

    nodes: (path, block number, outermost article or main element (0: none), text); paths: for each path, the path it extends
    (itself at the root), and whether its last element is hinted or ends the climb of what carries it.
    """

    def __init__(self, page: str):
        self.nodes: list[tuple[int, int, int, str]] = []
        self.parent, self.hinted, self.top = [0], [False], [True]
        self._known: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, path, left out, article
        self._open: dict[str, list[int]] = {}  # places of the open elements of a tag in the stack
        self._read(page)

    def _push(self, tag: str, attributes: str, number: int) -> None:
        _, path, other, article = self._stack[-1]
        hinted = False
        label = tag
        if not other:
            other, hinted, name = _judged(tag, attributes, bool(article))
            label = f"{tag}.{name}" if name else tag
        place = self._known.setdefault((path, label), len(self.parent))
        if place == len(self.parent):
            self.parent.append(path)
            self.hinted.append(hinted)
            self.top.append(tag in ("html", "body"))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, place, other, article or (number if tag in _ARTICLES else 0)))

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._open[self._stack.pop()[0]].pop()

    def _nearest(self, tags) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _read(self, page: str) -> None:
        block, at, end = 0, 0, len(page)
        while at < end:
            tag = _TAG.search(page, at)
            stop = tag.start() if tag else end
            _, path, other, article = self._stack[-1]
            if stop > at and not other:
                self.nodes.append((path, block, article, html.unescape(page[at:stop])))
            if not tag or tag[2] and not tag[4]:  # a tag that never ends swallows the rest
                break
            at = tag.end()
            if not tag[2]:
                continue
            name = tag[2].lower()
            if name in BLOCK:
                block += 1
            if tag[1]:
                if self._open.get(name):
                    self._pop_to(self._open[name][-1])
            elif name in RAW:
                if not tag[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else end
            elif name not in VOID:
                ends, within = ({"p"}, {"td", "th", "button", "object"}) if name in CLOSES_P else IMPLIED_END.get(name, ((), ()))
                place, barrier = self._outermost(ends, self._nearest(within)), 0
                if place > barrier:
                    self._pop_to(place)
                self._push(name, tag[3], tag.start() + 1)

    def _outermost(self, tags, beyond: int) -> int:
        """The place of the outermost open element of these tags inside the place ``beyond``; 0 if there is none."""
        found = 0
        for t in tags:
            places = self._open.get(t)
            if places and places[-1] > beyond:
                k = len(places) - 1
                while k and places[k - 1] > beyond:
                    k -= 1
                found = min(found or places[k], places[k])
        return found


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is no text by its meaning, whether its names hint at that, and its class."""
    if tag in OTHER_TAGS or tag == "header" and not in_article:
        return True, False, ""
    hinted, name = False, ""
    if "=" in attributes or "hidden" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                return True, False, ""
            if key == "role" and value.lower() in OTHER_ROLES:
                return True, False, ""
            if key in ("class", "id") and tag not in ("html", "body", *_ARTICLES):
                hinted = hinted or any(part.lower() in HINTS for part in _NAME_PART.findall(value))
                name = value if key == "class" else name
    return False, hinted, name


def path_scores(page: Page, solid: list[int]) -> tuple[np.ndarray, float]:
    """The score of each path and the mean of the page, from the nodes ``solid``, which are those that are not blank."""
    n = len(page.parent)
    path = np.array([page.nodes[i][0] for i in solid])
    length = np.array([len(page.nodes[i][3].strip()) for i in solid], float)
    points = np.array([len(PUNCTUATION.findall(page.nodes[i][3])) for i in solid], float)
    count = np.bincount(path, minlength=n)
    per_node = lambda x: np.bincount(path, x, n)[path] / count[path]
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), [0.25, 0.5, 0.25], "valid")
    hinted = np.zeros(n, bool)
    for k in range(n):  # a path is younger than the one it extends
        hinted[k] = page.hinted[k] or hinted[page.parent[k]]
    fused = smooth(per_node(length)) * smooth(per_node(points) + 1) * np.where(hinted[path], HINTED, 1.0)
    sums, below = np.bincount(path, fused, n), count.astype(float)
    own = np.divide(sums, below, out=np.zeros(n), where=below > 0)
    for k in range(n - 1, 0, -1):
        if not page.hinted[k]:
            sums[page.parent[k]] += sums[k]
            below[page.parent[k]] += below[k]
    mean_below = np.divide(sums, below, out=np.zeros(n), where=below > 0)
    for k in np.flatnonzero(count):
        up, weight = k, 1.0
        for _ in range(STEPS):
            if page.top[up]:
                break
            own[k] = max(own[k], weight * mean_below[up])
            if page.hinted[up]:
                break
            up, weight = page.parent[up], weight * CARRY
    return own, float(fused.mean())


def main_text(page: str | None, share: float = SHARE) -> str:
    """The main text of a page: blocks joined by one space, white space within them made one space."""
    read = Page(page or "")
    nodes = read.nodes
    solid = [i for i, node in enumerate(nodes) if node[3] and not node[3].isspace()]
    if not solid:
        return ""
    score, mean = path_scores(read, solid)
    chosen = np.array([score[nodes[i][0]] >= share * mean for i in solid])
    kept = set()
    article = np.array([nodes[i][2] for i in solid])
    last = np.maximum.accumulate(np.where(chosen, np.arange(len(solid)), -1))
    following = np.minimum.accumulate(np.where(chosen, np.arange(len(solid)), len(solid))[::-1])[::-1]
    for k, i in enumerate(solid):
        gap = not chosen[k] and last[k] >= 0 and following[k] < len(solid) and article[k] > 0
        if chosen[k] or gap and article[k] == article[last[k]] == article[following[k]] and not _hinted(read, nodes[i][0]):
            kept.add(i)
    out, block = [], None
    for i, node in enumerate(nodes):
        if node[1] != block:
            out.append(" ")
            block = node[1]
        if i in kept:
            out.append(node[3])
        elif node[3].isspace():
            out.append(" ")
    return " ".join("".join(out).split())


def _hinted(page: Page, path: int) -> bool:
    while path and not page.hinted[path]:
        path = page.parent[path]
    return bool(path)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html): the page's main text.

    n_chars counts code points. Null or empty html, and a page without article text, give an empty text.
    Null page_id and url are passed through, rows that repeat an id each give a row, other columns are ignored,
    broken markup is read as far as it goes, and an empty table gives an empty result.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
