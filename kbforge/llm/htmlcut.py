"""Main text of web pages: blocks labelled by a minimum cut.

1. A page is read into blocks, the runs of text between borders of block elements, and their tree of elements. What never is
   text (scripts, styles, templates, form fields, comments, hidden elements) is left out while reading; character references
   are decoded, white space is one blank.
2. A classifier gives each block costs. Its text part is a logistic model of length, links, punctuation and tag. It is fitted on
   a bounded sample of blocks (``SAMPLE_PAGES``, ``SAMPLE_BLOCKS``) whose elements say what they are (an ``article`` or
   ``main``, a ``nav`` or ``footer``); the names themselves are no part of it. What an element's name, role, class and id say
   is added as stated weights. The sum is the cost of the other label, and becomes the block's capacity to one terminal.
3. Neighbouring blocks are joined by edges, the weaker the more borders lie between them; each block is joined to its element
   and each element to the one around it. The maximum flow gives the cheapest labelling; blocks on the source's side are the
   text, in page order, one to a line. Where labellings are equally cheap, the one that keeps most is taken.

All of a page is handled in one task in time about linear in its length. Nothing but the fitted weights is shared. A class or
role that would take most words of a page together with its heading names the page, not a part of it, and is not heeded. A
null or empty page, and one without text, gives an empty text; null ids and repeated rows stay, other columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kbforge.llm.token_words import slices

#: Bounds of the sample that the text model is fitted on.
SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 20_000

#: Fixed values of HTML: elements without an end, with raw text or without text of the page, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button datalist title head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the second kind ends where one of the first begins, if no element of the third lies between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}

#: Weights of what markup says, as log-odds of text against the rest.
ELEMENTS = {"article": 2.0, "main": 2.0, "nav": -7.0, "menu": -7.0, "aside": -6.0, "footer": -6.0, "header": -6.0, "form": -5.0, "fieldset": -5.0, "dialog": -6.0, "label": -4.0, "legend": -4.0, "search": -6.0}
ROLES = {
    "article": 2.0, "main": 2.0, "navigation": -7.0, "menu": -7.0, "menubar": -7.0, "complementary": -6.0, "contentinfo": -6.0, "banner": -6.0, "search": -6.0,
    "form": -5.0, "dialog": -6.0, "alertdialog": -6.0, "alert": -6.0, "status": -6.0, "toolbar": -6.0,
}
#: Elements whose blocks the text model learns as no text. Adverts, notices and comments read like text, so it cannot learn these.
BESIDE = frozenset(("nav", "menu", "header", "footer"))
#: Words of a class or an id.
GOOD_WORDS = frozenset("article content entry main post story text body prose".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts adsense sponsor sponsored promo promotion banner sidebar sidenav widget menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus replies respond discussion pagination pager toc search form copyright "
    "disclaimer skip tags".split()
)
#: Of these, words that in an article, or beside a good word, name its own head.
HEAD_WORDS = frozenset(("header", "masthead"))
GOOD, BAD = 1.5, -6.0
#: Smoothness: between neighbours (divided by the borders between them), a block and its element, an element and the one around it.
NEAR, OWN, AROUND = 1.5, 0.6, 0.4
#: An edge is weaker by the factor e for each such difference between the weights of what is said of its ends.
CONTRAST = 2.0
#: The text model's say is held between these.
MOST = 3.0

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HEADING = re.compile(r"h[1-6]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    """An open element: its number, the one around it, and the weight of what its markup says."""

    tag: str
    number: int
    around: int
    good: float = 0.0
    bad: float = 0.0
    in_article: bool = False


@dataclass
class Block:
    element: int
    tag: str
    text: str
    linked: int
    #: Borders of block elements since the block before.
    borders: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _said(tag: str, attributes: str, in_article: bool) -> tuple[float, float, bool]:
    """The weights for and against text of a start tag, and whether the element is hidden."""
    own = ELEMENTS.get(tag, 0.0)
    if tag == "header" and in_article:
        own = 0.0
    good, bad = max(own, 0.0), min(own, 0.0)
    if not attributes or attributes.isspace():
        return good, bad, False
    given = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        given.setdefault(name.lower(), "".join(values))
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return good, bad, True
    if tag not in ("html", "body"):
        role = ROLES.get(given.get("role", "").strip().lower(), 0.0)
        words = {w.lower() for w in _PART.findall(given.get("class", "") + " " + given.get("id", ""))}
        named = bool(words & GOOD_WORDS)
        if named or in_article:
            words -= HEAD_WORDS
        good = max(good, role, GOOD if named else 0.0)
        bad = min(bad, role, BAD if words & BAD_WORDS else 0.0)
    return good, bad, False


def read(html: str | None) -> Page:
    """The blocks of a page and their elements."""
    html = html or ""
    page = Page([Element("", 0, 0)])
    open_, links, borders = [page.elements[0]], 0, 0
    counts: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked, borders
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next(e for e in reversed(open_) if e.tag in BLOCKS or not e.tag)
                page.blocks.append(Block(at.number, at.tag, text, linked, borders))
                borders = 0
            parts, linked = [], 0
        borders += 1

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)

    def pop(at: int) -> None:
        nonlocal links
        if any(e.tag in BLOCKS for e in open_[at:]):
            close()
        for e in open_[at:]:
            links -= e.tag == "a"
            counts[e.tag] -= 1
        del open_[at:]

    def last(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for k in range(len(open_) - 1, 0, -1) if any(counts[t] for t in tags) else ():
            if open_[k].tag in tags:
                return k
            if open_[k].tag in stop:
                break
        return 0

    at, size = 0, len(html)
    while at < size:
        found = _TAG.search(html, at)
        if not found:
            take(html[at:])
            break
        take(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in ("html", "body"):
                continue
            if tag == "p" and not last({"p"}, BLOCKS):
                close()
            elif k := last({tag}, frozenset() if tag in BLOCKS else BLOCKS):
                pop(k)
            continue
        if tag == "br":
            parts.append("\n")
        if tag == "hr":
            close()
        if tag in VOID:
            continue
        within = open_[-1].in_article
        good, bad, hidden = _said(tag, found[3], within)
        if tag in SKIPPED or hidden:
            if not found[3].endswith("/"):
                at = _after(html, tag, at)
            if tag in BLOCKS:
                close()
            continue
        if tag in BLOCKS:
            if k := last({"p"}, BLOCKS - {"p"}):
                pop(k)
            if tag in ENDED_BY and (k := last(*ENDED_BY[tag])):
                pop(k)
            close()
        elif tag == "a" and (k := last({"a"}, BLOCKS)):
            pop(k)
        links += tag == "a"
        element = Element(tag, len(page.elements), open_[-1].number, good, bad, within or tag in ("article", "main"))
        counts[tag] += 1
        page.elements.append(element)
        open_.append(element)
    close()
    return page


_ENDS: dict[str, re.Pattern] = {}


def _after(html: str, tag: str, at: int) -> int:
    """Where a skipped element ends: elements of its own name inside count, but for raw text."""
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
    depth = 1
    for found in _ENDS[tag].finditer(html, at):
        depth += -1 if found[1] else 0 if tag in ("script", "style", "title", "textarea", "head") else 1
        if not depth:
            return found.end()
    # Nothing ends it: a page cut short, or an end tag that was forgotten in a block, which then hides nothing.
    return at if tag in BLOCKS else len(html)


def features(block: Block) -> list[float]:
    """What the text model sees of a block; nothing that names the block's part of the page."""
    text = block.text
    words, size = text.count(" ") + 1, len(text)
    commas = min((text.count(".") + text.count(",")) * 8 / size, 1.0)
    return [1.0, log1p(words), max(0.0, block.linked / size - 0.3), float(text[-1] in ".!?…。\"”»"), commas, float("©" in text or "(c)" in text), float(bool(_HEADING.fullmatch(block.tag)))]


#: The text model that fitting starts from and is held near to, by so many blocks for each in the sample and at least ``LEAST_HELD``;
#: it stands alone where the sample does not show both kinds of block. Without links or other signs a block counts as text.
START = (0.0, 0.7, -6.0, 0.5, 0.5, -3.0, 0.7)
HELD, LEAST_HELD = 0.1, 200


def markup(page: Page) -> tuple[list[float], list[bool | None]]:
    """For each element the weight of what it and those around it say, and for each block what they name it: text, something else, or nothing."""
    words = [0] * len(page.elements)
    heading = [False] * len(page.elements)
    for block in page.blocks:
        words[block.element] += block.text.count(" ") + 1
    # The page's heading, its main element or else its first article.
    for tag in ("h1", "main", "article"):
        if not any(heading):
            for e in [e for e in page.elements if e.tag == tag][: 1 if tag == "article" else None]:
                heading[e.number] = True
    for e in reversed(page.elements[1:]):
        words[e.around] += words[e.number]
        heading[e.around] |= heading[e.number]
    good, bad, beside = [0.0] * len(page.elements), [0.0] * len(page.elements), [False] * len(page.elements)
    for e in page.elements[1:]:
        whole = heading[e.number] and 2 * words[e.number] > words[0] and e.tag not in ("nav", "header", "footer", "aside")
        good[e.number] = max(good[e.around], e.good)
        bad[e.number] = min(bad[e.around], 0.0 if whole else e.bad)
        beside[e.number] = beside[e.around] or e.tag in BESIDE and e.bad < 0
    return list(map(sum, zip(good, bad))), [False if beside[b.element] else True if good[b.element] >= 2 and not bad[b.element] else None for b in page.blocks]


def score(block: Block, weights: list[float]) -> float:
    return max(-MOST, min(MOST, sum(w * x for w, x in zip(weights, features(block)))))


def keep(page: Page, weights: list[float]) -> list[bool]:
    """Which blocks are text: the cheapest cut of the page's graph."""
    blocks, edges = page.blocks, []
    if not blocks:
        return []
    said = markup(page)[0]
    costs = [round(1000 * (score(b, weights) + said[b.element])) for b in blocks]

    def strength(most: float, a: int, b: int) -> int:
        """Of an edge between elements: weaker, the more unlike what is said of them."""
        return round(1000 * most * exp(-abs(said[a] - said[b]) / CONTRAST))

    #: Elements that hold blocks, and all around them, become nodes without a terminal.
    node: dict[int, int] = {}
    for k, (block, before) in enumerate(zip(blocks, [None, *blocks])):
        if before:
            edges.append((k - 1, k, strength(NEAR / block.borders, before.element, block.element)))
        e, inner, own = block.element, k, round(1000 * OWN)
        while e not in node:
            node[e] = len(blocks) + len(node)
            edges.append((inner, node[e], own))
            if not e:
                break
            around = page.elements[e].around
            inner, own, e = node[e], strength(AROUND, e, around), around
        else:
            edges.append((inner, node[e], own))
    return minimum_cut(costs + [0] * len(node), edges)[: len(blocks)]


def minimum_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source's side of a minimum cut, the largest of those equally cheap.

    ``excess``: a node's capacity from the source, or below 0 to the sink. Edges ``a, b, capacity`` work both ways. Flow goes along shortest
    ways, level by level, until none is left (Dinic).
    """
    left = list(excess)
    heads: list[list[int]] = [[] for _ in left]
    to, room = [], []
    for a, b, capacity in edges:
        if capacity > 0 and a != b:
            heads[a].append(len(to))
            heads[b].append(len(to) + 1)
            to += (b, a)
            room += (capacity, capacity)
    while True:
        level = [-1] * len(left)
        queue = deque(v for v, x in enumerate(left) if x > 0)
        for v in queue:
            level[v] = 0
        reached = False
        while queue:
            v = queue.popleft()
            if left[v] < 0:
                reached = True
                continue
            for e in heads[v]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if not reached:
            break
        turn = [0] * len(left)
        for start in [v for v, x in enumerate(left) if x > 0]:
            way: list[int] = []
            v = start
            while left[start] > 0:
                if left[v] < 0:
                    flow = min(left[start], -left[v], min((room[e] for e in way), default=left[start]))
                    left[start] -= flow
                    left[v] += flow
                    for e in way:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    cut = next((k for k, e in enumerate(way) if not room[e]), len(way) if left[v] < 0 else 0)
                    v = to[way[cut] ^ 1] if cut < len(way) else v
                    del way[cut:]
                    continue
                while turn[v] < len(heads[v]):
                    e = heads[v][turn[v]]
                    if room[e] > 0 and level[to[e]] == level[v] + 1:
                        break
                    turn[v] += 1
                if turn[v] < len(heads[v]):
                    way.append(e)
                    v = to[e]
                elif way:
                    v = to[way.pop() ^ 1]
                    turn[v] += 1
                else:
                    break
    # Who can still reach the sink lies on its side.
    sinks = [x < 0 for x in left]
    queue = deque(v for v, x in enumerate(sinks) if x)
    while queue:
        v = queue.popleft()
        for e in heads[v]:
            if room[e ^ 1] > 0 and not sinks[to[e]]:
                sinks[to[e]] = True
                queue.append(to[e])
    return [not x for x in sinks]


def text_of(html: str | None, weights: list[float]) -> str:
    page = read(html)
    return "\n".join(b.text for b, kept in zip(page.blocks, keep(page, weights)) if kept)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> list[float]:
    """Logistic weights near ``START`` by Newton's method; both kinds count alike."""
    share = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge, start = max(HELD * len(y), LEAST_HELD), np.array(START)
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - ridge * (w - start)
        w += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w.tolist()


def fit(pages: DataFrame) -> list[float]:
    """The text model's weights from the blocks of a sample whose markup names them; at most ``SAMPLE_BLOCKS`` reach the driver."""
    # The least hashes of id and url are found without the pages; more than so many pages fall below only if ids and urls repeat.
    place = F.xxhash64("page_id", "url")
    most = pages.select(place.alias("h")).orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if most is None:
        return list(START)
    sample = pages.filter(place <= most).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = read(html)
                rows = [(b.text, features(b), named) for b, named in zip(page.blocks, markup(page)[1]) if named is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.list_(pa.float64()), pa.bool_()))], names=["text", "x", "y"])

    rows = sample.mapInArrow(run, "text string, x array<double>, y boolean").select("x", "y", F.xxhash64("text", "x").alias("h")).orderBy("h", "x", "y").limit(SAMPLE_BLOCKS).select("x", "y").collect()
    y = np.array([r.y for r in rows], bool)
    if not len(y) or y.all() or not y.any():
        return list(START)
    return fitted(np.array([r.x for r in rows]), y)


def main_text(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page; map-only but for the sample."""
    weights = weights or fit(pages)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2).to_pylist()):
                texts = [text_of(html, weights) for html in part]
                head = [batch.column(k).slice(at, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at += len(part)

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


#: The standard pages name their article; there the cut must give just that, which can be said by patterns.
SQL = r"""
WITH parts AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS ps FROM pages),
bare AS (SELECT page_id, url, list_transform(ps, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS ps FROM parts),
plain AS (SELECT page_id, url, list_transform(ps, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS ps FROM bare),
trimmed AS (SELECT page_id, url, array_to_string(list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM trimmed
"""
