"""Main text of HTML pages by minimum-cut labelling of their text blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage

# Fixed names of the markup language and of common containers.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style head title template noscript iframe object svg math canvas audio video select "
    "textarea button datalist noframes".split())
RAW = frozenset("script style title textarea noscript iframe template noframes".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
AROUND = frozenset("nav aside footer form menu dialog search".split())
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story body text prose".split())
AROUND_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs consent "
    "cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notification pagination pager popup promo promoted promotion recommended "
    "related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags toc toolbar widget alert".split())
# Of these, words that also name topics: beside other words they are no more than a hint.
HINTS = frozenset("alert banner header login notice notification promotion recommended related "
                  "search share sharing social tags subscription".split())
TALK_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses".split())

_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|\Z)"
                        r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LEAVES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",),
           "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",), "p": ()}


@dataclass(eq=False)
class Element:
    tag: str
    parent: "Element | None"
    depth: int
    hidden: bool
    around: bool      # inside a container of what surrounds the main text
    main: bool        # inside a container of the main text
    link: bool
    hints: int        # containers inside the main text whose names hint at the opposite
    block: "Element"  # the nearest block element, itself included


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    size: int = 0


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    hidden, around, main, link, hints = (
        parent.hidden, parent.around, parent.main, parent.link, parent.hints) \
        if parent else (False, False, False, False, 0)
    words: set[str] = set()
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" \
                    or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
            elif name == "role":
                around |= value in ("navigation", "banner", "contentinfo", "complementary",
                                    "search", "dialog", "alert", "form")
                main |= value in ("main", "article")
            elif name in ("class", "id"):
                words.update(w.lower() for w in _WORD.findall(value))
    hidden |= tag in HIDDEN
    if tag in AROUND or words & TALK_WORDS:
        around = True
    elif tag in MAIN:
        main = True
    elif tag == "header":
        around |= not main
    elif tag not in ("body", "html"):
        if words & AROUND_WORDS:
            if main and words & AROUND_WORDS <= HINTS and words - AROUND_WORDS:
                hints += 1
            else:
                around = True
        elif words & MAIN_WORDS:
            main = True
    made = Element(tag, parent, parent.depth + 1 if parent else 0, hidden, around, main,
                   link or tag == "a", hints, None)
    made.block = made if tag in BLOCKS or not parent else parent.block
    return made


def parse_blocks(html: str) -> list[Block]:
    """Visible text blocks in page order.

    Block tags end a block; ``br`` is white space.  An end tag closes up to its start tag, if
    that is open, and an item or paragraph closes one of its kind before it.  Raw text, such
    as a script, goes on to its end tag whatever it holds, or to the end of the page.
    """
    root = here = _open("", "", None)
    blocks: list[Block] = []
    current: Block | None = None
    at = 0
    open_: Counter = Counter()  # tags of the elements that hold this place

    def up_to(node: Element | None) -> None:
        """Close all elements below ``node``."""
        nonlocal here
        while here is not node:
            open_[here.tag] -= 1
            here = here.parent

    def text(piece: str) -> None:
        nonlocal current
        if here.hidden or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(here.block)
            blocks.append(current)
        current.parts.append(piece)
        length = len(piece.strip())
        current.size += length
        if here.link:
            current.linked += length

    while found := _MARKUP.search(html, at):
        closing, tag, attributes = found[1], found[2], found[3]
        text(html[at:found.start()])
        at = found.end()
        if not tag:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:-3])
            continue
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            current = None
        if closing:
            if open_[tag]:
                while here.tag != tag:
                    up_to(here.parent)
                up_to(here.parent)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            stops = _LEAVES.get(tag)
            node = here.block
            if node.tag == "p":
                up_to(node.parent)  # a block start ends an open paragraph
            elif stops and open_[tag]:
                while node.parent and node.tag != tag and node.tag not in stops:
                    node = node.parent.block
                if node.tag == tag:
                    up_to(node.parent)
        here = _open(tag, attributes, here)
        open_[tag] += 1
    text(html[at:])
    return blocks


def preference(block: Block, has_main: bool) -> float:
    """Log odds that a block is main text."""
    element = block.element
    if element.around:
        return -12.0
    linked = block.linked / max(block.size, 1)
    if element.main and not element.hints:
        return 8.0 - 3.0 * (linked > 0.8)
    text = "".join(block.parts)
    odds = min(block.size, 400) / 100 - 5 * linked
    odds += 0.5 * any(c in text for c in ".!?。")
    odds += 1.0 * (element.tag in PROSE)
    odds -= 1.0 * (element.tag in ("li", "td", "th"))
    if element.main:
        return odds + 2.0 - 1.5 * element.hints
    return odds - (4.0 if has_main else 1.0)


def closeness(a: Block, b: Block) -> float:
    """Smoothness of two blocks in turn: less the further their common container is, up to
    forty steps."""
    x, y = a.element, b.element
    steps = 0
    while x is not y and steps < 40:
        if x.depth >= y.depth and x.parent:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    if a.element.around != b.element.around or a.element.main != b.element.main:
        return 0.25
    return 2.0 / (1 + steps / 2)


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node that is labelled against its odds costs them, and an
    edge between different labels costs its weight.

    Odds are terminal capacities.  Flow is pushed along shortest paths from nodes with
    source capacity left to nodes with sink capacity left; what a search from the source
    still reaches at the end is the source side, the main text.
    """
    count = len(odds)
    gives, takes = [max(o, 0.0) for o in odds], [max(-o, 0.0) for o in odds]
    near: list[list[int]] = [[] for _ in range(count)]
    room: dict[tuple[int, int], float] = {}
    for a, b, weight in edges:
        if (a, b) not in room:
            near[a].append(b)
            near[b].append(a)
        room[a, b] = room.get((a, b), 0.0) + weight
        room[b, a] = room.get((b, a), 0.0) + weight
    full = [False] * count  # no way to the sink is left; nothing can change that
    for start in range(count):
        while gives[start] > 1e-9 and not full[start]:
            came, queue, goal = {start: start}, deque([start]), -1
            while queue:
                node = queue.popleft()
                if takes[node] > 1e-9:
                    goal = node
                    break
                for other in near[node]:
                    if other not in came and not full[other] and room[node, other] > 1e-9:
                        came[other] = node
                        queue.append(other)
            if goal < 0:
                for node in came:
                    full[node] = True
                break
            path, node = [], goal
            while node != start:
                path.append((came[node], node))
                node = came[node]
            flow = min([gives[start], takes[goal], *(room[step] for step in path)])
            gives[start] -= flow
            takes[goal] -= flow
            for a, b in path:
                room[a, b] -= flow
                room[b, a] += flow
    return full


def main_text(html: str) -> str:
    """The main blocks of a page, one per line."""
    blocks = [b for b in parse_blocks(html) if b.size]
    has_main = any(b.element.main and not b.element.around for b in blocks)
    edges = [(i, i + 1, closeness(a, b)) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    last: dict[int, int] = {}  # blocks of one container, whatever stands between them
    for i, block in enumerate(blocks):
        owner = id(block.element.parent)
        if i - last.get(owner, i) > 1:
            edges.append((last[owner], i, 0.5))
        last[owner] = i
    labels = minimum_cut([preference(b, has_main) for b in blocks], edges)
    lines = (" ".join(unescape("".join(b.parts)).split()) for b, kept in zip(blocks, labels) if kept)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points); no shuffle.

    A text block is labelled main text or not by a minimum cut over the page: costs come
    from its containers, links and length, smoothness from page order and the containers
    that blocks share.  Null or empty html, and pages without main text, give an empty text.
    All rows are kept, repeated ones too; columns that are called like a result are
    replaced.
    """
    from pyspark.sql import types as T

    columns = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in columns),
                           T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(len(columns)).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  [*columns, "text", "n_chars"])

    return arrow_stage(pages.select(*columns, F.col(html_col).cast("string").alias("__html")),
                       run, schema)
