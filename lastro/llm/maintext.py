"""Main text of pages by minimum cuts.

A page becomes blocks: runs of text between the boundaries of block elements. A classifier gives
each block log-odds of being content, which are its capacities to the two terminals. Neighbours
in page order are tied by an edge that weakens with their distance in the tree, and blocks of one
container by another. The minimum cut, by max-flow, is the cheapest labelling: blocks on the
source's side are content.

The classifier has two parts. What elements, roles and class names say is stated below as
log-odds. What a block looks like (length, links, marks, neighbours) is a logistic regression,
fitted to blocks which the first part is sure of, around weights that hold where none are.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import importable, text_slices

#: Pages, and blocks of them, that the regression is fitted to, about.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 20_000
#: Bytes of pages that are worked on at once.
PART = 2 << 20

# An attribute's value begins after `=`; a quote or a tag that isn't closed runs to the end.
TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(>|\Z)|(!--)|[!?/])""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|href)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/]|$)""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content isn't text of the page, to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu "
    "nav object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio canvas datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element closes if it is the nearest of these around it, and where the search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: An end tag closes nothing beyond these, unless it is their own.
WALLS = frozenset("td th table caption button object".split())
#: Levels that are looked up in the tree at most.
LEVELS = 32

#: Log-odds of content that elements, roles and parts of class names and ids state. They hold for all that is inside.
ELEMENTS = {
    "article": 4.0, "main": 5.0, "nav": -7.0, "aside": -7.5, "footer": -7.0, "header": -5.0, "form": -6.0, "search": -6.0, "dialog": -6.0, "menu": -5.0, "fieldset": -4.0, "button": -12.0, "select": -12.0,
    "datalist": -12.0, "svg": -12.0, "template": -12.0, "object": -12.0, "video": -12.0, "audio": -12.0, "canvas": -12.0,
}
ROLES = {
    "main": 5.0, "article": 4.0, "navigation": -7.0, "banner": -6.0, "contentinfo": -7.0, "complementary": -7.0, "search": -6.0, "form": -6.0, "dialog": -6.0, "alertdialog": -6.0, "alert": -6.0, "menu": -6.0,
    "menubar": -6.0, "toolbar": -6.0, "tablist": -6.0,
}
GOOD = dict.fromkeys("article main content story post entry body prose".split(), 2.0)
BAD = {
    **dict.fromkeys("nav navbar navigation menu menubar submenu dropdown breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer sidebar aside rail widget widgets".split(), -6.0),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion promoted banner banners outbrain taboola".split(), -7.0),
    **dict.fromkeys("notice notices cookie cookies consent gdpr alert popup modal overlay disclaimer copyright legal privacy".split(), -7.0),
    **dict.fromkeys("form forms search login signin signup register subscribe subscription newsletter".split(), -6.0),
    **dict.fromkeys("comment comments commentlist reply replies respond responses disqus discussion".split(), -9.0),
    **dict.fromkeys("share sharing social follow related recommended recommendations trending popular tagcloud skip hidden".split(), -6.0),
}
#: What an element states is added to this part of what the ones around it state.
INHERITED = 0.6

#: What notices and buttons say.
FIXED_WORDS = ("\N{COPYRIGHT SIGN}", "copyright", "cookie", "all rights reserved", "privacy policy", "terms of use", "terms of service", "subscribe", "sign in", "log in", "advertisement", "sponsored", "read more", "share this")
#: The features of a block's looks, and the weights that the regression starts from and is drawn to.
FEATURES = {
    "one": -1.5, "words": 0.8, "links": -4.0, "paragraph": 0.8, "heading": 0.6, "cell": -0.8, "sentence": 0.6, "marks": 0.3, "fixed": -1.5, "words before": 0.2, "words after": 0.2, "links around": -1.0,
}
PRIOR = tuple(FEATURES.values())
#: Blocks that the starting weights count for, how sure a training block's elements are, and the most that looks say.
PRIOR_BLOCKS, SURE, MOST_LOOKS = 200.0, 3.0, 3.0
#: Capacities of the edges between neighbours, and between blocks of one container, in log-odds; units of a log-odd.
BESIDE, TOGETHER, UNITS = 1.2, 0.6, 1000


@dataclass(slots=True)
class Block:
    """text; tag: the element around it; container: number of the element around that; said: log-odds that elements state; links: characters in links."""

    text: str
    tag: str
    container: int
    said: float
    links: int


def decode(text: str) -> str:
    """Character references as characters; ones beyond Unicode are U+FFFD."""
    if "&" not in text:
        return text
    if "&#0" in text:
        text = re.sub(r"&#0+(?=[0-9])", "&#", text)
    return references.unescape(re.sub(r"&#[0-9]{8,};?", "�", text) if "&#" in text else text)


def _stated(name: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """Log-odds that an element states, and whether it states any."""
    said = 0.0 if name == "header" and in_article else ELEMENTS.get(name, 0.0)
    if "=" in attributes or "hidden" in attributes:
        parts: set[str] = set()
        for found in ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key in ("class", "id"):
                parts.update(p.lower() for p in NAME_PARTS.findall(value))
            elif key == "role":
                said += ROLES.get(value.strip().lower(), 0.0)
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                said -= 12.0
        if parts:
            bad = min((BAD[p] for p in parts if p in BAD), default=0.0)
            good = max((GOOD[p] for p in parts if p in GOOD), default=0.0)
            if in_article and "header" in parts and not parts & (BAD.keys() - {"header"}):
                bad = 0.0
            said += bad + good
    return said, said != 0.0


class _Tree:
    """Open elements while a page is read: name, number, log-odds stated so far, inside an article."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]
        self.parents, self.depths = [0], [0]

    def push(self, name: str, attributes: str) -> None:
        _, number, said, inside = self.stack[-1]
        own, states = _stated(name, attributes, inside)
        if states:
            said = own if name == "main" else INHERITED * said + own
        self.places.setdefault(name, []).append(len(self.stack))
        if name in WALLS:
            self.walls.append(len(self.stack))
        self.parents.append(number)
        self.depths.append(len(self.stack))
        self.stack.append((name, len(self.parents) - 1, said, inside or name in ("article", "main")))

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in WALLS:
                self.walls.pop()

    def close_for(self, name: str) -> None:
        top = self.stack[-1][0]
        if top == "p" or (top in HEADINGS and name in HEADINGS):
            self.pop_to(len(self.stack) - 1)
        if name in CLOSES:
            wanted, ends = CLOSES[name]
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - LEVELS), -1):
                if self.stack[k][0] in wanted:
                    return self.pop_to(k)
                if self.stack[k][0] in ends:
                    return None
        return None

    def close(self, name: str) -> None:
        places = self.places.get(name)
        if places and (places[-1] > self.walls[-1] or name in WALLS):
            self.pop_to(places[-1])

    def distance(self, a: int, b: int) -> int:
        """Steps between two elements by way of one that is around both; LEVELS at most."""
        steps = 0
        while a != b and steps < LEVELS:
            if self.depths[a] >= self.depths[b]:
                a = self.parents[a]
            else:
                b = self.parents[b]
            steps += 1
        return steps


def blocks(page: str) -> tuple[list[Block], _Tree]:
    """The blocks of a page in order, in time that grows with its length."""
    tree, found = _Tree(), []
    text: list[str] = []
    links, link_at = 0, 0  # characters in links of the run; size of the stack where the open link began

    def end_run() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                name, number, said, _ = tree.stack[-1]
                found.append(Block(joined, name, tree.parents[number] if number else 0, said, min(links, len(joined))))
            text.clear()
        links = 0

    at = 0
    while at < len(page):
        tag = TAG.search(page, at)
        upto = tag.start() if tag else len(page)
        if upto > at:
            piece = decode(page[at:upto])
            text.append(piece)
            if link_at:
                links += len(piece.strip())
        if tag is None:
            break
        at = tag.end()
        name = tag[2]
        if name is None:
            # A comment, or what is read as one.
            end = page.find("-->", at - 2) if tag[5] else page.find(">", at)
            if end < 0:
                break
            at = end + (3 if tag[5] else 1)
            continue
        if not tag[4]:
            break
        name = name.lower()
        if tag[1]:
            if name == "a":
                link_at = 0
            elif name in BLOCKS or "-" in name:
                end_run()
                tree.close(name)
                if link_at > len(tree.stack):
                    link_at = 0
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
        elif name == "br":
            text.append(" ")
        elif name == "a":
            link_at = len(tree.stack) if "href" in tag[3].lower() else 0
        elif name in BLOCKS or "-" in name:
            end_run()
            tree.close_for(name)
            if link_at > len(tree.stack):
                link_at = 0
            if name not in VOID:
                tree.push(name, tag[3])
    end_run()
    return found, tree


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(found)
    words = np.log1p(np.array([b.text.count(" ") + 1 for b in found], float))
    links = np.array([b.links / len(b.text) for b in found], float)
    sides = lambda x: (np.append(0.0, x[:-1]), np.append(x[1:], 0.0))
    before, after = sides(words)
    around = sum(sides(links)) / 2
    return np.column_stack([
        np.ones(n), words, links, [b.tag == "p" for b in found], [b.tag in HEADINGS for b in found], [b.tag in ("li", "td", "th", "dt", "dd", "option", "legend", "summary") for b in found],
        [b.text[-1] in ".!?:;…»”\"" for b in found], np.log1p([sum(map(b.text.count, ".,;!?")) for b in found]), [any(map(b.text.lower().__contains__, FIXED_WORDS)) for b in found], before, after, around,
    ]).astype(float)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to the starting weights by as much as PRIOR_BLOCKS blocks."""
    start = np.array(PRIOR)
    w = start.copy()
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + PRIOR_BLOCKS * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_BLOCKS * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def min_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut (of several, the one with the fewest such nodes).

    unary: capacity from the source if positive, to the sink if negative. edges: two nodes and
    the capacity between them, either way. Dinic's max-flow.
    """
    n = len(unary)
    excess = list(unary)
    out: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    while True:
        level = [0 if e > 0 else -1 for e in excess]
        front = [i for i in range(n) if level[i] == 0]
        depth, reached = 0, False
        while front and not reached:
            depth += 1
            onward = []
            for a in front:
                for e in out[a]:
                    b = to[e]
                    if room[e] and level[b] < 0:
                        level[b] = depth
                        onward.append(b)
                        reached = reached or excess[b] < 0
            front = onward
        if not reached:
            return [lv >= 0 for lv in level]
        arc = [0] * n
        for source in range(n):
            if level[source] != 0:
                continue
            path: list[int] = []
            a = source
            while excess[source] > 0:
                if excess[a] < 0:
                    flow = min(excess[source], -excess[a], min(room[e] for e in path))
                    excess[source] -= flow
                    excess[a] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    keep = next((k for k, e in enumerate(path) if not room[e]), len(path))
                    a = to[path[keep] ^ 1] if keep < len(path) else a
                    del path[keep:]
                    continue
                own = out[a]
                while arc[a] < len(own) and not (room[own[arc[a]]] and level[to[own[arc[a]]]] == level[a] + 1):
                    arc[a] += 1
                if arc[a] < len(own):
                    path.append(own[arc[a]])
                    a = to[own[arc[a]]]
                elif path:
                    a = to[path.pop() ^ 1]
                    arc[a] += 1
                else:
                    break


def label(found: list[Block], tree: _Tree, weights: np.ndarray) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    if not found:
        return []
    looks = np.clip(features(found) @ weights, -MOST_LOOKS, MOST_LOOKS)
    unary = [round(UNITS * (b.said + float(x))) for b, x in zip(found, looks, strict=True)]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, round(UNITS * BESIDE / (1 + tree.distance(found[i - 1].container, b.container)))))
        before = last.get(b.container)
        if before is not None and before < i - 1:
            edges.append((before, i, round(UNITS * TOGETHER)))
        last[b.container] = i
    return min_cut(unary, edges)


def main_text(page: str, weights: np.ndarray) -> str:
    found, tree = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, label(found, tree, weights), strict=True) if good)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html", PART):
        for key, page in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, _ = blocks(page or "")
            if found:
                said = np.array([b.said for b in found])
                sure = np.flatnonzero(np.abs(said) >= SURE)
                for a in range(0, len(sure), 1000):
                    some = sure[a : a + 1000]
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(some), pa.int64()), "place": pa.array(some, pa.int64()), "content": pa.array(said[some] > 0), "x": pa.array(features(found)[some].tolist(), pa.list_(pa.float64()))})


def train(pages: DataFrame) -> np.ndarray:
    """Weights of the looks, from about SAMPLE_PAGES pages and SAMPLE_BLOCKS of their blocks, both chosen by hashes."""
    importable(pages.sparkSession)
    total = pages.count()
    own = pages.select(F.xxhash64(F.col("page_id").cast("string"), F.col("url").cast("string")).alias("key"), F.col("html").cast("string").alias("html"))
    part = 1 << 30
    some = own.filter(F.pmod(F.col("key"), F.lit(part)) < F.lit(max(1, min(part, SAMPLE_PAGES * part // max(total, 1)))))
    rows = some.mapInArrow(_samples, "key long, place long, content boolean, x array<double>")
    drawn = rows.withColumn("draw", F.xxhash64("key", "place")).orderBy("draw", "key", "place", "content", "x").limit(SAMPLE_BLOCKS).collect()  # SAMPLE_BLOCKS at most
    x = np.array([r.x for r in drawn], float).reshape(len(drawn), len(PRIOR))
    return fit(x, np.array([r.content for r in drawn], float))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: the article's blocks, joined in page order by two line feeds.

    Inside a block character references are decoded, white space (Unicode's) is one space, and
    the ends are trimmed. A null or empty html, or one without content, gives an empty text;
    repeated rows are extracted each; null ids and urls stay null; other columns have no part in
    it; an empty table gives no rows. Pages of any length are read whole; markup that isn't
    closed is read to the page's end, as browsers do. Ties of a cut go to boilerplate.
    """
    importable(pages.sparkSession)
    weights = train(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html", PART):
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

