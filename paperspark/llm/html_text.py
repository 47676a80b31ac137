"""HTML extraction by minimum-cut labelling.

A page becomes a list of text blocks. A linear classifier gives each block
the cost of being called boilerplate or content, which become its capacities
to the two terminals. Blocks near each other in page order and in the DOM
are joined by smoothness edges. The minimum cut labels all blocks of the page
together; the content blocks' text is the result.
"""

from __future__ import annotations

import html
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperspark.llm.common import slices

SLICE_CHARS = 4 << 20

TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|select|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    regex.S | regex.I)
HINT = regex.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", regex.I)

# Elements that start a block of their own. Others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
BREAKS = frozenset(("br", "hr", "img", "input", "wbr"))
# An open element of the key ends where one of the value begins.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"},
}

# Weights of the classifier: log odds of content.
OUTSIDE_TAGS = frozenset("nav footer aside form menu button fieldset head dialog".split())
OUTSIDE_WORDS = regex.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|foot\w*|side-?bar\w*|widget\w*|"
    r"cookie\w*|consent|notices?|popup|modal|newsletter|subscribe\w*|share|sharing|social|related|recommend\w*|"
    r"breadcrumbs?|pagination|pager|comments?|commentlist|respond|reply|login|search|toolbar|masthead|"
    r"navigation|contentinfo|complementary|copyright|legal|tags?|disclaimer|discussion\w*|threads?|disqus|replies|"
    r"gdpr\w*|privacy|rail|overlay|alert|signup|paywall|trending|teasers?)(?:$|[\s_-])", regex.I)
INSIDE_WORDS = regex.compile(
    r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body-?text|prose|text)(?:$|[\s_-])", regex.I)
W_OUTSIDE, W_HEADER, W_INSIDE, W_WORD = -8.0, -3.0, 3.0, 1.5
W_BIAS, W_LENGTH, W_LINKS, W_SENTENCE, W_HEADING = -1.0, 0.7, -4.0, 0.5, 1.0
SMOOTH = 0.9  # of two blocks of one parent, next to each other
REACH = 2  # blocks up to so many places apart are joined
LINK_BLOCKS = 2  # blocks that one link can hold; a longer one was not closed


class Block:
    """``path`` numbers the elements around a block, ``hinted`` those whose
    class, id or role alone speaks against them; ``structure`` is the cost of
    its elements without those words."""

    __slots__ = ("parts", "linked", "path", "hinted", "structure", "cost", "text")

    def __init__(self, path: tuple[int, ...], hinted: frozenset[int], structure: float, cost: float):
        self.parts, self.linked, self.path, self.hinted, self.text = [], 0, path, hinted, ""
        self.structure, self.cost = structure, cost


def element_cost(tag: str, attrs: str, inside: bool) -> tuple[float, float]:
    """Log odds that an element adds to all blocks inside it: by its tag, and
    by the words of its attributes. A word cannot outweigh that an element is
    the article itself."""
    cost = word = 0.0
    if tag in OUTSIDE_TAGS:
        cost = W_OUTSIDE
    elif tag == "header":
        cost = W_HEADER if inside else W_OUTSIDE
    elif tag in ("article", "main"):
        cost = 0.0 if inside else W_INSIDE
    if attrs and tag not in ("html", "body"):
        hints = " ".join(h.strip("\"'") for h in HINT.findall(attrs))
        if hints:
            if OUTSIDE_WORDS.search(hints):
                word = -W_WORD if tag in ("article", "main") else W_OUTSIDE
            elif INSIDE_WORDS.search(hints):
                word = W_WORD
    return cost, word


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with their costs before the text counts."""
    out: list[Block] = []
    # Tag, cost by tags, cost by words, inside an article, number, numbers of
    # elements with words against them.
    stack = [("", 0.0, 0.0, False, 0, frozenset())]
    # ``link`` is the number of blocks that the open link may still enter.
    block, number, link, at = None, 0, 0, 0

    def add(raw: str) -> None:
        nonlocal block, link
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if block is None:
            if not text.strip():
                return
            _, structure, word, _, _, hinted = stack[-1]
            block = Block(tuple(e[4] for e in stack), hinted, structure, structure + word)
            out.append(block)
            link = max(0, link - 1)
            if stack[-1][0] in ("h1", "h2", "h3"):
                block.cost += W_HEADING
        block.parts.append(text)
        if link:
            block.linked += len(text)

    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            # The block that is open counts too.
            link = 0 if end else LINK_BLOCKS + (block is None)
        elif tag in BREAKS:
            if block is not None:
                block.parts.append(" ")
            if tag == "hr":
                block = None
        elif tag in BLOCK_TAGS:
            block = None
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                number += 1
                _, structure, word, inside, _, hinted = stack[-1]
                by_tag, by_word = element_cost(tag, attrs, inside)
                if not attrs.rstrip().endswith("/"):
                    stack.append((tag, structure + by_tag, word + by_word, inside or tag in ("article", "main"), number,
                                  hinted | {number} if by_word < 0 else hinted))
    add(page[at:])
    for b in out:
        words = "".join(b.parts).split()
        b.text = " ".join(words)
        b.cost += W_BIAS + W_LENGTH * math.log1p(len(words)) + W_LINKS * min(1.0, b.linked / max(1, len(b.text)))
        if b.text[-1:] in ".!?…。":
            b.cost += W_SENTENCE
    return [b for b in out if b.text]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between near blocks, weaker with distance in order and DOM."""
    edges = []
    for i, a in enumerate(blocks):
        for j in range(i + 1, min(len(blocks), i + 1 + REACH)):
            b = blocks[j]
            same = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                same += 1
            steps = len(a.path) + len(b.path) - 2 * same  # 2 for siblings
            edges.append((i, j, SMOOTH / ((j - i) * max(1.0, steps / 2))))
    return edges


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True pays nothing where the cost is positive,
    and every edge between different labels pays its weight.

    Nodes whose own capacity exceeds all of their edges have their label in
    every minimum cut; they are set first and their edges become capacities
    of their neighbours. A maximum flow decides the rest.
    """
    n = len(costs)
    capacity = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(capacity[i]) > sum(near[i].values()):
            label[i] = capacity[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                if label[j] is None:
                    capacity[j] += w if label[i] else -w
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        inside = max_flow_side(rest, capacity, near)
        for i in rest:
            label[i] = i in inside
    return label


def max_flow_side(nodes: list[int], capacity: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths."""
    source, sink = -1, -2
    residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    residual[source], residual[sink] = {}, {}
    for i in nodes:
        if capacity[i] > 0:
            residual[source][i], residual[i][source] = capacity[i], 0.0
        elif capacity[i] < 0:
            residual[i][sink], residual[sink][i] = -capacity[i], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in residual[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return set(came)
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(residual[i][j] for i, j in path)
        for i, j in path:
            residual[i][j] -= flow
            residual[j][i] += flow


def without_wide_hints(blocks: list[Block]) -> list[float]:
    """Costs in which words of an element that holds most of the page's text
    do not count: they name the page, not a part of it."""
    total = sum(len(b.text) for b in blocks)
    held: dict[int, int] = {}
    for b in blocks:
        for element in b.hinted:
            held[element] = held.get(element, 0) + len(b.text)
    wide = {element for element, n in held.items() if 2 * n > total}
    return [b.cost - W_OUTSIDE * len(b.hinted & wide) for b in blocks]


def main_text(page: str | None) -> tuple[str, int, int]:
    """Text of the content blocks, and the numbers of blocks and of these.

    If the cut leaves no content, words on elements that hold most of the text
    are not counted; if there still is none, blocks are content by their
    elements alone, however short they are. A page of menus, notices and
    footers stays empty."""
    blocks = blocks_of(page) if page else []
    edges = smoothness(blocks)
    labels = min_cut([b.cost for b in blocks], edges)
    if blocks and not any(labels):
        costs = without_wide_hints(blocks)
        labels = min_cut(costs, edges)
        if not any(labels):
            labels = [b.structure >= 0 and cost > W_OUTSIDE / 2 and 2 * b.linked < len(b.text)
                      for b, cost in zip(blocks, costs)]
    kept = [b.text for b, content in zip(blocks, labels) if content]
    return " ".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_blocks, n_content`` of every page's whole html
    (null or without content: the empty string). Repeated rows stay repeated,
    an empty table gives an empty one; long pages are taken whole, in time
    linear in their length but for the few blocks that need a maximum flow;
    other columns are ignored. Blocks of equal cost on both sides of a cut are
    boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for a, b in slices((len(x or "") for x in found), SLICE_CHARS):
                part = batch.slice(a, b - a)
                texts, n, m = zip(*map(main_text, found[a:b])) if b > a else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_content"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_blocks bigint, n_content bigint")
