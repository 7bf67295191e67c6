"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A linear classifier gives each block a score, the log odds that it is content, from
its length, links, punctuation and the elements around it; the score is the capacity of its edge from the source (if
it speaks for content) or to the sink. Blocks that follow each other are joined by a smoothness edge, a strong one if they have
the same parent element, and blocks with the same parent by edges to a node of that element. The minimum cut labels all blocks at the least cost.

No feature decides alone: a long paragraph outweighs an element's name that speaks weakly against it, and blocks whose own score
is small follow their neighbours. The weights are set by hand, as there are no labelled pages to fit them on.

Most capacities decide a node at once, or make it follow its only neighbour; such nodes are taken out first, which
leaves the minimum cut as it is, and the flow is found on what remains.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import free_name

# Fixed values of HTML: elements without an end tag, of block level, with raw text, and the ones an element ends by opening.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is no text of the page: raw text up to the end tag, or the page's end; and markup that is no text as far as it is closed.
RAW = frozenset("script style textarea title xmp iframe".split())
UNREAD = frozenset("noscript template svg math object canvas audio video".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Fixed values of the classifier: elements, roles and names that speak against content, and for it.
AGAINST = frozenset("nav footer aside form button select option label menu dialog fieldset head".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
AGAINST_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|bottom-?bar|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|discussions?|disqus|footer|gdpr|login|masthead|menu|modal|"
    r"nav|navbar|navigation|navlinks?|navmenu|newsletter|notices?|notifications?|overlay|pager|pagination|popup|promo|promos|promoted|promotions?|replies|respond|responses|sidebar|signup|sponsor\w*|"
    r"subscribe|toolbar|topbar|widgets?)(?:$|[\s_-])",
    re.I,
)
# Names that content has too: they speak weakly inside of an element for content or a name for it, and fully elsewhere.
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:legal|privacy|recommend\w*|related|reply|search|share|sharing|side|social|tags)(?:$|[\s_-])", re.I)
FOR = frozenset(("article", "main"))
FOR_NAMES = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Weights of the score, and of the edges between neighbours with the same parent and with different ones, and to the parent's node.
BIAS, WORD, MOST_WORDS, LINKS, SENTENCE, PARAGRAPH, INSIDE, NAMED, OUTSIDE, DOUBTFUL = -1.0, 0.06, 60, -4.0, 0.6, 0.8, 2.0, 0.5, -8.0, -2.5
NEXT, NEXT_ELSEWHERE, PARENT = 1.0, 0.3, 0.4

# Attributes as HTML reads them: a quote opens a value only after "=", of any length; one that never closes is part of a name. Nothing is tried twice.
ATTRIBUTES = r"""(?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{ATTRIBUTES})(?P<empty>/?)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
END_TAGS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW | UNREAD}
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")


@dataclass(slots=True)
class Element:
    name: str
    number: int
    parent: int
    outside: bool
    doubtful: bool
    inside: bool
    named: bool


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    element: Element
    tag: str

    def score(self) -> float:
        s = BIAS + WORD * min(self.words, MOST_WORDS) + LINKS * self.linked / max(1, len(self.text))
        if self.text[-1] in ".!?…:;»”\"":
            s += SENTENCE
        if self.tag == "p" or self.tag in HEADINGS:
            s += PARAGRAPH
        e = self.element
        return s + INSIDE * e.inside + NAMED * e.named + OUTSIDE * e.outside + DOUBTFUL * e.doubtful


@dataclass
class Graph:
    """Scores of nodes (positive: to be content) and weights of undirected edges."""

    scores: list[float] = field(default_factory=list)
    edges: list[dict[int, float]] = field(default_factory=list)

    def node(self, score: float) -> int:
        self.scores.append(score)
        self.edges.append({})
        return len(self.scores) - 1

    def edge(self, a: int, b: int, weight: float) -> None:
        self.edges[a][b] = self.edges[b][a] = self.edges[a].get(b, 0.0) + weight

    def cut(self) -> list[bool]:
        """The side of each node in a minimum cut: True with the source. Changes the graph."""
        n = len(self.scores)
        label: list[bool | None] = [None] * n
        follows: list[tuple[int, int]] = []
        todo, scores, edges = list(range(n)), self.scores, self.edges
        gone = [False] * n
        while todo:
            i = todo.pop()
            if gone[i]:
                continue
            near, score = edges[i], scores[i]
            total = sum(near.values())
            if abs(score) >= total:
                label[i] = score >= 0
                for j, w in near.items():
                    scores[j] += w if label[i] else -w
            elif len(near) == 1:
                (j,) = near
                scores[j] += score
                follows.append((i, j))
            else:
                continue
            gone[i] = True
            for j in near:
                del edges[j][i]
                todo.append(j)
        rest = [i for i in range(n) if not gone[i]]
        if rest:
            reached = self._source_side(rest)
            for i in rest:
                label[i] = i in reached
        for i, j in reversed(follows):
            label[i] = label[j]
        return [bool(x) for x in label]

    def _source_side(self, nodes: list[int]) -> set[int]:
        """Max-flow by shortest augmenting paths; the nodes that the source still reaches."""
        room: dict[int, dict[int, float]] = {i: dict(self.edges[i]) for i in nodes}
        supply = {i: max(0.0, self.scores[i]) for i in nodes}
        demand = {i: max(0.0, -self.scores[i]) for i in nodes}
        while True:
            before: dict[int, int] = {i: -1 for i in nodes if supply[i] > 1e-12}
            queue, end = deque(before), -1
            while queue:
                i = queue.popleft()
                if demand[i] > 1e-12:
                    end = i
                    break
                for j, w in room[i].items():
                    if w > 1e-12 and j not in before:
                        before[j] = i
                        queue.append(j)
            if end < 0:
                return set(before)
            path = [end]
            while before[path[-1]] >= 0:
                path.append(before[path[-1]])
            flow = min(supply[path[-1]], demand[end], *(room[b][a] for a, b in zip(path, path[1:], strict=False)), float("inf"))
            supply[path[-1]] -= flow
            demand[end] -= flow
            for a, b in zip(path, path[1:], strict=False):
                room[b][a] -= flow
                room[a][b] += flow


def _element(name: str, rest: str, parent: Element, number: int) -> Element:
    """The element that opens in `parent`; its own parent is the nearest one of block level."""
    outside, doubtful, inside, named = parent.outside, parent.doubtful, parent.inside or name in FOR, parent.named
    against, unsure = name in AGAINST or (name == "header" and not parent.inside), False
    if rest and "=" in rest or "hidden" in rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key == "role":
                against = against or value.lower() in AGAINST_ROLES
                inside = inside or value.lower() in FOR
            elif key in ("class", "id"):
                if name not in ("html", "body"):
                    against = against or (name not in FOR and AGAINST_NAMES.search(value) is not None)
                    unsure = unsure or (name not in FOR and DOUBTFUL_NAMES.search(value) is not None)
                    named = named or FOR_NAMES.search(value) is not None
            elif key == "style":
                against = against or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key == "hidden" or (key in ("aria-hidden", "aria-modal") and value.lower() == "true"):
                against = True
    against = against or (unsure and not inside and not named)
    return Element(name, number, parent.number if parent.name in BLOCKS else parent.parent, outside or against, doubtful or unsure, inside, named)


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order.

    Elements of raw text that never close take the rest of the page, as in browsers; the tags of others that hold no text (noscript, svg, ...) are
    passed over where they never close, and what follows is read.
    """
    out: list[Block] = []
    top = Element("", 0, 0, False, False, False, False)
    stack, number, runs, linked, links = [top], 0, [], 0, 0

    def flush() -> None:
        nonlocal linked
        if runs:
            words = "".join(runs).split()
            runs.clear()
            if words:
                owner = next((e for e in reversed(stack) if e.name in BLOCKS), top)
                out.append(Block(" ".join(words), len(words), linked, owner, owner.name))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        runs.append(text)
        if links:
            linked += len(text)

    at, unclosed = 0, set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if name in END_TAGS:
            if m["end"] or m["end2"] or (m["empty"] and name in ("svg", "math")):
                continue
            close = None if name in unclosed else END_TAGS[name].search(page, at)
            if close:
                at = close.end()
            elif name in RAW:
                at = len(page)
            else:
                unclosed.add(name)
            continue
        if m["end"] or m["end2"]:
            if name in BLOCKS:
                flush()
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    links -= stack.pop().name == "a"
                links -= stack.pop().name == "a"
            continue
        if name == "br":
            runs.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            ended = ENDS.get(name, ()) + (("p",) if name not in ("button", "label", "select", "option") else ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ended:
                    for e in stack[k:]:
                        links -= e.name == "a"
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS:
                    break
        number += 1
        stack.append(_element(name, m["rest"] or m["rest2"] or "", stack[-1], number))
        links += name == "a"
    if at < len(page):
        say(page[at:])
    flush()
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    graph, parents = Graph(), {}
    for block in found:
        graph.node(block.score())
    for i, block in enumerate(found):
        if i:
            graph.edge(i - 1, i, NEXT if found[i - 1].element.parent == block.element.parent else NEXT_ELSEWHERE)
        parents.setdefault(block.element.parent, []).append(i)
    for members in parents.values():
        if len(members) > 1:
            hub = graph.node(0.0)
            for i in members:
                graph.edge(i, hub, PARENT)
    return graph.cut()[: len(found)]


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, labels(found), strict=True) if content)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every row of `pages` without its html, and text: the main text of the whole page.

    A null or empty page has the empty text. Broken markup is read leniently. Rows that repeat an id are all answered; an empty
    table gives an empty one. A column named text is replaced.
    """
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text")]
    own = free_name(pages, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(own).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), texts], names=[*(f.name for f in keep), "text"])

    rows = pages.select(*(f.name for f in keep), F.col(html_col).alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string"])
    return rows.mapInArrow(run, schema)
