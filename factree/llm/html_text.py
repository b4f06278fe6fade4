"""Main text of web pages by a minimum cut.

A page is cut into blocks (text between block-level tags). A logistic classifier on a block's own words, links, digits and
punctuation gives log odds of content. It is trained on the table itself: blocks inside <article> or <main> and blocks inside
elements that are never content (navigation, footers, forms) label each other's kind, in a bounded sample of pages (PAGES,
BLOCKS); a table without both kinds has the weights PLAIN. Tags, classes and ids around a block add to its odds. The odds become
the capacities of its edges from the source (content) or to the sink (boilerplate). The document tree is part of the graph: a
block hangs on its element and each element on its parent by edges whose capacity is the price of labelling them apart, and
neighbours in page order are joined by edges that cost less the farther apart they are in the tree; edges that leave a marked
element cost next to nothing. The blocks that the maximum flow leaves on the source's side are the main text: a two-word
paragraph among others stays although its words alone look like a menu, and a full sentence in a footer goes.

Comments, scripts, styles, titles, form controls and markup never become blocks; text in <math> is content like any other. An unclosed
<script>, <style>, <title> or <textarea> swallows the rest of the page as in browsers; other unclosed tags lose nothing. Character
references are decoded once; a run of the ASCII white space characters inside a block (line-break tags included) becomes one
space. Unclosed and crossed tags are taken as browsers do in essence: a block-level tag ends a paragraph, an end tag closes up
to its match or nothing.

Defined results: null or empty html and pages without content have the empty text and 0 characters; repeated pages are
done one by one; an empty table gives no rows; null ids pass through but are no training pages; other columns are not looked at. One
page is in memory at a time besides its batch, whatever its length; time grows with its length however deep its tags nest.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import by_batches

#: Pages that the classifier is trained on at most, and labelled blocks of each.
PAGES, BLOCKS = 500, 100

# Names of HTML elements by what they mean here.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
SKIPPED = frozenset("template svg object audio video canvas".split())  # left out if they are closed
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form button select option dialog menu noscript head fieldset".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "select", "noscript"}

# Tags that end an open one of the same kind, and those that it can't be looked for beyond.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
}

# Words in class, id or role that mark boilerplate or content.
BAD_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar "
    "side rail widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot copyright legal comment comments commentlist disqus reply replies "
    "respond discussion related recommended share sharing social follow newsletter subscribe subscription signup login search pagination pager toolbar skip hidden "
    "complementary contentinfo dialog form tagcloud".split()
)
GOOD_HINTS = frozenset("article content main post entry story body text prose".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
HINT = re.compile(r"[a-z]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(eq=False)
class Element:
    name: str
    parent: Element | None
    hint: int = 0  # 1 content, -1 boilerplate, -2 boilerplate for sure
    depth: int = 0
    article: bool = False
    marks: float = 0.0  # hints of it and what is around it, the innermost counts most
    never: bool = False  # it or what is around it is boilerplate for sure

    def __post_init__(self) -> None:
        around = self.parent.marks if self.parent else 0.0
        self.marks = (1 if self.hint > 0 else -1) + 0.4 * around if self.hint else around
        self.never = self.hint == -2 or self.parent is not None and self.parent.never


@dataclass
class Block:
    text: str
    parent: Element
    linked: int
    odds: float = 0.0


def hint_of(name: str, attributes: str) -> int:
    good = 1 if name in ("article", "main") else 0
    if name in NEVER:
        return -2
    if name == "header":
        return -1
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
            if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                return -2
            words = {w for w in HINT.findall(CAMEL.sub(" ", value).lower())}
            if words & BAD_HINTS:
                return -1 if not good or words & {"comment", "comments", "ad", "ads", "advert", "related", "promo", "reply", "sponsored", "widget"} else 1
            if words & GOOD_HINTS:
                good = 1
    return good


def blocks_of(page: str) -> list[Block]:
    root = Element("#", None)
    now, out, text, linked, links = root, [], [], 0, 0
    at, size = 0, len(page)
    opened: Counter[str] = Counter()  # names of now and what is around it
    unclosed: set[str] = set()

    def up_to(element: Element) -> None:
        """Closes what is open below element."""
        nonlocal now
        while now is not element:
            opened[now.name] -= 1
            now = now.parent

    def flush() -> None:
        nonlocal linked
        if text:
            flat = SPACES.sub(" ", "".join(text)).strip(" ")
            if flat:
                out.append(Block(flat, now, linked))
            text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            part = entities.unescape(part) if "&" in part else part
            text.append(part)
            linked += len(part) if links else 0

    while at < size:
        left = page.find("<", at)
        if left < 0:
            add(page[at:])
            break
        if left > at:
            add(page[at:left])
        after = page[left + 1 : left + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", left):
                end = page.find("-->", left + 4) if not page.startswith(("<!-->", "<!--->"), left) else page.find(">", left) - 2
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", left)
                at = end + 1 if end >= 0 else size
            continue
        m = TAG.match(page, left) or LOOSE_TAG.match(page, left)
        if m is None:
            if after.isalpha() and after.isascii() or after == "/" and page[left + 2 : left + 3].isalpha():
                break  # the page ends within a tag
            if after == "/":
                end = page.find(">", left)
                at = end + 1 if end >= 0 else size
                continue
            add("<")
            at = left + 1
            continue
        at = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if not closing and name in RAW and not attributes.endswith("/"):
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = close + 1 if close >= 0 else size
            continue
        if not closing and name in SKIPPED and not attributes.endswith("/") and name not in unclosed:
            end = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
            if end is None:
                unclosed.add(name)
            else:
                at = end.end()
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in BLOCK:
            flush()
            if closing:
                if opened[name]:
                    up = now
                    while up.name != name:
                        up = up.parent
                    up_to(up.parent)
                    links = 0
            else:
                if name in CLOSES_P:
                    while now.name == "p":
                        up_to(now.parent)
                same, stop = SIBLINGS.get(name, ((), ()))
                if any(opened[x] for x in same):
                    up = now
                    while up is not root and up.name not in same and up.name not in stop:
                        up = up.parent
                    if up.name in same:
                        up_to(up.parent)
                if name not in VOID:
                    hint = 0 if name == "header" and now.article else hint_of(name, attributes)  # an article's own head holds its title
                    now = Element(name, now, hint, now.depth + 1, now.article or name in ("article", "main"))
                    opened[name] += 1
        elif not closing and name not in VOID and attributes and not attributes.endswith("/") and hint_of("span", attributes) < 0:
            # an inline element that is marked as boilerplate stands as a block of its own
            flush()
            now = Element(name, now, -1, now.depth + 1, now.article)
            opened[name] += 1
        elif closing and now.name == name:
            flush()
            up_to(now.parent)
    flush()
    return out


def features(b: Block) -> list[float]:
    """Of the words alone; tags and classes do not count here."""
    words = b.text.count(" ") + 1
    return [
        1.0,
        min(math.log1p(words) / 3, 1.5),
        min(1.0, b.linked / len(b.text)),
        float(b.text[-1] in ".!?:…»”\""),
        min(1.0, sum(b.text.count(x) for x in ".,;!?") / words),
        min(1.0, sum(b.text.count(x) for x in "0123456789") / len(b.text)),
        float("©" in b.text or "|" in b.text),
    ]


# Weights of the features where a table has nothing to learn from.
PLAIN = (-1.4, 2.0, -3.0, 0.8, 0.5, -0.5, -1.5)
#: Words alone add at most so much to the odds.
MOST = 2.0
#: What marks around a block add: in an article (for each 1 of marks), in something marked as boilerplate, in what is never content, and
#: outside the article of a page that has one.
GOOD, BAD, NEVER_ODDS, OUTSIDE = 1.5, 5.0, -8.0, -3.0
#: Price of parting a block or element from its parent, or neighbours of one parent; of leaving a marked element.
SMOOTH, LEAVE = 1.0, 0.05
#: Steps in the tree after which neighbours are taken as strangers.
FAR = 20


def seeds(blocks: list[Block]) -> list[tuple[list[float], bool]]:
    """Features and kind of the blocks whose kind the tags alone tell."""
    out = []
    for b in blocks:
        if b.parent.never:
            out.append((features(b), False))
        elif b.parent.article and b.parent.marks > 0:
            out.append((features(b), True))
    return out


def fit(x: np.ndarray, content: np.ndarray, penalty: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; both kinds weigh the same."""
    if not len(x) or content.all() or not content.any():
        return np.array(PLAIN)
    share = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum())
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - content)) + penalty * w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def train(spark: SparkSession, pages: DataFrame, most: int = PAGES) -> np.ndarray:
    """The classifier's weights from the blocks that tags tell, in at most `most` pages, those whose ids have the least CRCs."""
    ids = pages.select(F.col("page_id").alias("__id")).filter("__id IS NOT NULL").distinct()
    ids = ids.orderBy(F.crc32(F.col("__id").cast("string").cast("binary")), "__id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds(blocks_of(p or ""))[:BLOCKS] for p in batch.column("html").to_pylist()]
            rows = [np.array([[*x, kind] for x, kind in f], dtype=np.float64).tobytes() for f in found if f]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    sample = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("__id")).select("html")
    rows = sorted(bytes(r["x"]) for r in by_batches(sample, run, "x binary").limit(4 * most).collect())
    x = np.frombuffer(b"".join(rows)).reshape(-1, len(PLAIN) + 1)
    return fit(x[:, :-1], x[:, -1] == 1)


def classify(blocks: list[Block], weights: Sequence[float]) -> None:
    """Log odds of content."""
    has_article = any(b.parent.article and b.parent.marks > 0 for b in blocks)
    for b in blocks:
        words = sum(w * x for w, x in zip(weights, features(b), strict=True))
        odds = max(-MOST, min(MOST, words))
        marks = b.parent.marks
        odds += GOOD * marks if marks > 0 else BAD * marks
        if b.parent.never:
            odds = min(odds, 0.0) + NEVER_ODDS
        elif has_article and not b.parent.article:
            odds += OUTSIDE
        b.odds = odds


def closeness(a: Element, b: Element) -> float:
    """Price of labelling neighbours in page order apart: less with each step between them in the tree, LEAVE across a mark."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            marked, a = a.hint, a.parent
        else:
            marked, b = b.hint, b.parent
        steps += 1
        if marked or steps > FAR:
            return LEAVE
    return SMOOTH / max(1, steps)


def graph_of(blocks: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Odds of the blocks, then 0 for each element of the tree that holds one, and the edges between them."""
    odds, edges, numbers = [b.odds for b in blocks], {}, {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = closeness(blocks[k - 1].parent, b.parent)
        at, below, price = b.parent, k, SMOOTH
        while at is not None:
            known = at in numbers
            number = numbers.setdefault(at, len(odds))
            if not known:
                odds.append(0.0)
            edges[below, number] = price
            if known:
                break
            below, price, at = number, LEAVE if at.hint else SMOOTH, at.parent
    return odds, edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; a node's terminal capacity is |odds|, to the source if positive."""
    n = len(odds)
    source, sink = n, n + 1
    capacity: list[float] = []
    to: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            capacity.append(c)

    for k, x in enumerate(odds):
        if x > 0:
            join(source, k, x, 0.0)
        elif x < 0:
            join(k, sink, -x, 0.0)
    for (a, b), c in edges.items():
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if capacity[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        upto = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:  # blocking flow, one path after the other without recursion
            if x == sink:
                least = min(capacity[e] for e in path)
                cut = None
                for k, e in enumerate(path):
                    capacity[e] -= least
                    capacity[e ^ 1] += least
                    if cut is None and capacity[e] <= 1e-9:
                        cut = k
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while upto[x] < len(out[x]):
                e = out[x][upto[x]]
                if capacity[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                upto[x] += 1
            else:
                if x == source:
                    break
                e = path.pop()
                x = to[e ^ 1]
                upto[x] += 1
                continue
            path.append(e)
            x = to[e]


def main_text(page: str, weights: Sequence[float] = PLAIN) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    classify(blocks, weights)
    content = minimum_cut(*graph_of(blocks))
    return "\n".join(b.text for b, c in zip(blocks, content, strict=False) if c)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html)."""
    weights = tuple(map(float, train(spark, pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", weights) for p in batch.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return by_batches(rows, run, "page_id long, url string, text string, n_chars long")
