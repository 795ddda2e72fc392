"""Main text of web pages by minimum cuts.

A page is cut into blocks.  Each block gets the log odds of being content: from where
it stands (elements and class words around it, fixed values below) and from its own
text, by a logistic regression over a few binned measures of it.  The regression learns
from all blocks of all pages whose place leaves no doubt, as counts by bin, so what
leaves the tasks is one number per bin and label whatever the corpus.  The log odds
become a block's terminal capacities, to the source where positive and to the sink
where negative.  Blocks that follow each other and blocks in one element are joined by
edges, the stronger the closer they are in the tree.  The minimum cut then labels all
blocks of the page at once; those on the source's side are the main text.

Blocks whose terminal capacity is at least that of all their edges keep its side in
every minimum cut, so they are merged into their terminal first, which is exact; what
is left, if anything, goes through augmenting paths on level graphs.  Capacities are
whole numbers, so a page has the same result everywhere.

Defined results: a null, empty or textless html gives an empty text; a null page_id or
url is carried along; repeated rows give repeated results; text after a tag, comment or
script that never ends is part of it; white space is Unicode's, and br counts as white
space; an empty table gives an empty result; further columns aren't carried.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm import dom

#: Places of a block, and their log odds: in what is apart from the text, in the page's main element, beside it, or, on a
#: page without one, in what class words call content or anywhere else.
APART, MAIN, BESIDE, NAMED, ANYWHERE = range(5)
BY_PLACE = (-8.0, 4.0, -3.0, 2.5, 1.2)
BY_TAG = {"p": 0.8, "h1": 0.4, "h2": 0.4, "h3": 0.4, "h4": 0.4, "h5": 0.4, "h6": 0.4, "pre": 0.6, "blockquote": 0.6}
#: An article is the main element from this share of the text that isn't set apart.
LEAST_ARTICLE = 1 / 3
#: Log odds by text, at most.
TEXT = 2.5
#: Capacity of the edge between blocks that follow each other, by their distance in the tree, and between siblings.
FOLLOWS, SIBLINGS, FARTHEST = 1.6, 0.5, 8
#: Capacities are multiples of this.
SCALE = 1024

WORD_EDGES = (3, 6, 11, 21, 41, 81)
SIZES = (len(WORD_EDGES) + 1, 4, 3)  # words, share in links, how it ends
#: What the regression starts from and is drawn to, bin by bin: constant, then each measure's bins.
PRIOR = np.array([0.0, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 0.3, 0.2, -1.0, -2.5, -0.3, 0.6, 0.0])
PRIOR_ROWS = 20.0


def _bins(text: str, linked: int) -> int:
    """The block's bin: its words, the share of it in links and how it ends."""
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    link = 0 if not linked else 1 if share < 0.25 else 2 if share < 0.6 else 3
    ends = 1 if text[-1] in ".!?…。！？" or text[-2:-1] in (".", "!", "?") else 2 if text[-1] in ":;," else 0
    return (bisect_right(WORD_EDGES, words) * SIZES[1] + link) * SIZES[2] + ends


def _design() -> np.ndarray:
    """One row per bin: 1 for the constant and for the bin of each measure."""
    grid = np.stack(np.meshgrid(*[np.arange(s) for s in SIZES], indexing="ij"), -1).reshape(-1, len(SIZES))
    return np.concatenate([np.ones((len(grid), 1)), *[np.eye(s)[grid[:, k]] for k, s in enumerate(SIZES)]], 1)


def fit_bins(counts: np.ndarray) -> np.ndarray:
    """Log odds of content by bin; counts: by bin, blocks that surely aren't content and that surely are."""
    x = _design()
    n, w = counts.sum(1).astype(float), PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts[:, 1] - n * p) - PRIOR_ROWS * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w)), slope)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return np.clip(x @ w, -TEXT, TEXT)


def places(page: dom.Page) -> list[int]:
    """The place of each block."""
    n = len(page.tag)
    shut = [False] * n  # in what no main element can be in
    for e in range(n):
        up = page.parent[e]
        shut[e] = up >= 0 and shut[up] or page.tag[e] in dom.APART or page.hidden[e] or bool(page.words[e] & dom.COMMENT_WORDS)
    characters, every = [0] * n, 0
    for text, e in zip(page.text, page.inside, strict=True):
        if e < 0 or not shut[e]:
            every += len(text)
        if e >= 0:
            characters[e] += len(text)
    for e in range(n - 1, -1, -1):
        if page.parent[e] >= 0:
            characters[page.parent[e]] += characters[e]
    mains = {e for e in range(n) if not shut[e] and (page.tag[e] == "main" or page.role[e] == "main")}
    articles = [e for e in range(n) if not shut[e] and page.tag[e] == "article"]
    if not mains and articles:
        largest = max(articles, key=lambda e: (characters[e], -e))
        if characters[largest] >= LEAST_ARTICLE * every:
            mains = {largest}
    around = [False] * n  # a main element: class words there say nothing about its text
    for e in mains:
        while e >= 0 and not around[e]:
            around[e] = True
            e = page.parent[e]

    place = [ANYWHERE] * n
    for e in range(n):
        up = page.parent[e]
        before = place[up] if up >= 0 else BESIDE if mains else ANYWHERE
        tag, words = page.tag[e], page.words[e]
        if before == APART or shut[e]:
            place[e] = APART
        elif around[e] or tag in ("html", "body"):
            place[e] = MAIN if e in mains else before
        elif tag == "form" or page.role[e] in dom.APART_ROLES or _told_apart(tag, words, before):
            place[e] = APART
        else:
            place[e] = NAMED if before == ANYWHERE and words & dom.CONTENT_WORDS else before
    return [place[e] if e >= 0 else BESIDE if mains else ANYWHERE for e in page.inside]


def _told_apart(tag: str, words: frozenset[str], before: int) -> bool:
    """By tag or class words; a header inside the main element is its title."""
    if tag == "header" or "header" in words:
        return before not in (MAIN, NAMED)
    return bool(words & dom.APART_WORDS) and not words & dom.LAYOUT_WORDS


def _distance(page: dom.Page, a: int, b: int) -> int:
    """Steps between two elements in the tree; FARTHEST or more count as FARTHEST.  A child has a larger number than its parent."""
    steps = 0
    while a != b and steps < FARTHEST:
        if a > b:
            a = page.parent[a]
        else:
            b = page.parent[b]
        steps += 1
    return steps


def network(page: dom.Page, by_bin: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Terminal capacities (to the source where positive) and edges, as whole numbers."""
    terminals, edges = [], []
    last: dict[int, int] = {}
    for k, (text, linked, e, place) in enumerate(zip(page.text, page.linked, page.inside, places(page), strict=True)):
        tag = page.tag[e] if e >= 0 else ""
        terminals.append(round(SCALE * (BY_PLACE[place] + BY_TAG.get(tag, 0.0) + by_bin[_bins(text, linked)])))
        if k:
            edges.append((k - 1, k, round(SCALE * FOLLOWS / (1 + _distance(page, page.inside[k - 1], e)))))
        up = page.parent[e] if e >= 0 else -1
        if up in last:
            edges.append((last[up], k, round(SCALE * SIBLINGS)))
        last[up] = k
    return terminals, edges


def minimum_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut."""
    n = len(terminals)
    pull, near = list(terminals), [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    free = [sum(w for _, w in each) for each in near]  # capacity to nodes without a side
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if side[k] is None and abs(pull[k]) >= free[k]:
            side[k] = pull[k] > 0
            for other, w in near[k]:
                if side[other] is None:
                    free[other] -= w
                    pull[other] += w if side[k] else -w
                    todo.append(other)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        reached = _flow(rest, pull, near, side)
        for k in rest:
            side[k] = k in reached
    return [bool(s) for s in side]


def _flow(rest: list[int], pull: list[int], near: list[list[tuple[int, int]]], side: list[bool | None]) -> set[int]:
    """Nodes that the source still reaches once no more flow fits: shortest augmenting paths, level by level."""
    at = {k: i for i, k in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in rest:
        if pull[k] > 0:
            edge(source, at[k], pull[k], 0)
        elif pull[k] < 0:
            edge(at[k], sink, -pull[k], 0)
        for other, w in near[k]:
            if side[other] is None and other > k:
                edge(at[k], at[other], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {k for k in rest if level[at[k]] >= 0}
        next_edge = [0] * len(out)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                here = to[path[cut] ^ 1]
                del path[cut:]
            while next_edge[here] < len(out[here]):
                e = out[here][next_edge[here]]
                if room[e] and level[to[e]] == level[here] + 1:
                    break
                next_edge[here] += 1
            if next_edge[here] < len(out[here]):
                path.append(e)
                here = to[e]
            elif here == source:
                break
            else:
                here = to[path.pop() ^ 1]
                next_edge[here] += 1


def main_text(html: str, by_bin: np.ndarray) -> str:
    page = dom.parse(html)
    return "\n".join(text for text, kept in zip(page.text, minimum_cut(*network(page, by_bin)), strict=True) if kept)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by bin and label, where the place leaves no doubt."""
    for batch in batches:
        found: Counter = Counter()
        for html in batch.column("html"):
            page = dom.parse(html.as_py() or "")
            for text, linked, place in zip(page.text, page.linked, places(page), strict=True):
                if place in (APART, MAIN):
                    found[_bins(text, linked), place == MAIN] += 1
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bin", "content", "n"])


def fit(pages: DataFrame) -> np.ndarray:
    """Log odds by bin, learned from all pages; without any block that is sure, the prior's."""
    counted = pages.select("html").mapInArrow(_count, "bin int, content boolean, n long")
    counts = np.zeros((int(np.prod(SIZES)), 2))
    for row in counted.groupBy("bin", "content").agg(F.sum("n").alias("n")).collect():  # two rows a bin at most
        counts[row["bin"], int(row["content"])] = row["n"]
    return fit_bins(counts)


def extract(pages: DataFrame, by_bin: np.ndarray | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    by_bin = fit(pages) if by_bin is None else by_bin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", by_bin) for html in batch.column("html")]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
