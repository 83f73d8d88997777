"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier gives each block a bounded cost for either label: graded evidence from its length,
sentences, share of link text, element and depth, and from the names, roles and classes of the elements around it. These costs
are the capacities to the two terminals; edges between neighbours on the page, weaker the further they are apart in the DOM, and
between blocks of one parent element make it dear to tell them apart. The minimum cut, found by maximum flow, labels all
blocks of the page together.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.llm.common import pieces, small_batches
from photofold.llm.words import lean

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>))|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([\w-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: Left out whole where they are closed; without an end tag it is the tag alone.
_LEFT_OUT = {
    t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "noscript template svg iframe select object canvas".split()
}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu fieldset input option head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notification popup modal overlay share sharing "
    "social related recommended comment comments disqus reply replies respond subscribe subscription newsletter signup login footer "
    "masthead topbar toolbar widget pagination pager disclaimer alert copyright skip".split()
)
#: Of these, the ones that name texts of others, which may have article elements of their own.
OTHER_TEXTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion related recommended comment "
    "comments disqus reply replies respond cookie cookies consent gdpr".split()
)
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())

#: Elements that hold running text: a class of theirs that has a boilerplate word among others says little.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption caption".split())

# Evidence for a block, from its text and from the elements around it; the sum is bounded.
MOST = 3.0
LENGTH, SENTENCE, SHORT = 0.9, 0.3, -0.2
PARAGRAPH, HEADING, CONTENT = 0.4, 0.5, 0.8
LINKED, MARKED, HINTED, DEEP = -2.4, -2.4, -0.6, -0.02
LONG_WORDS = 30
#: Shares of the page's text between which a mark around it fades, by its kind.
FADING = ((0.35, 0.65), (0.85, 0.95), (0.85, 0.95))
# Smoothness: blocks next to each other, those one further, and blocks of one parent; each step in the DOM weakens the first two.
NEIGHBOUR, SECOND, SIBLING, STEP = 0.8, 0.3, 0.5, 0.8
#: Steps that the border of a marked element counts for.
BORDER = 6


@dataclass(slots=True)
class Mark:
    """An element that names itself as boilerplate, and what lies in it: all text, text in content elements below it, and text in any."""

    kind: int
    above: Mark | None
    text: float = 0.0
    inner: float = 0.0
    content: float = 0.0
    #: How far the marks down to this count against a block, and against one with a content element between.
    plain: float = 0.0
    wrapped: float = 0.0


@dataclass(slots=True)
class Element:
    tag: str
    hidden: bool
    content: bool
    link: bool
    hinted: bool
    steps: int
    mark: Mark | None
    #: The innermost mark above the innermost content element.
    clear: Mark | None
    number: int
    #: The element that holds the text here, and the one around that, as places in the page.
    holder: Element | None
    outer: int


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    parent: int
    depth: int
    content: bool
    hinted: bool
    linked: float
    mark: Mark | None
    clear: Mark | None
    #: DOM steps from the block before.
    steps: int


LAYOUT, OTHERS, TAG = range(3)


def _hints(tag: str, attrs: str, above: Element | None) -> tuple[bool, bool, int | None, bool, bool]:
    """Whether the element is hidden, lies in content, the kind of its boilerplate mark, whether it is itself content, and whether its
    names hint at boilerplate without marking it."""
    hidden, content = (above.hidden, above.content) if above else (False, False)
    mark, main, named, whole = None, tag in CONTENT_TAGS, set(), set()
    if attrs and attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.split():
                    words = {w.lower() for w in _PART.findall(name)}
                    named |= words
                    if words <= BOILERPLATE_WORDS:
                        whole |= words
            elif key == "role":
                if value.lower() in BOILERPLATE_ROLES:
                    mark = LAYOUT if value.lower() == "form" else TAG
                main |= value.lower() == "main"
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                hidden = True
    if tag in ("html", "body"):
        return False, content or main, None, False, False
    main |= not CONTENT_WORDS.isdisjoint(named)
    telling = whole if tag in TEXT_TAGS else named
    if tag in BOILERPLATE_TAGS or (not content and tag == "header"):
        mark = LAYOUT if tag == "form" else TAG
    elif mark is None and not telling.isdisjoint(OTHER_TEXTS):
        mark = OTHERS
    elif mark is None and (not BOILERPLATE_WORDS.isdisjoint(telling) or (not content and "header" in telling)):
        mark = LAYOUT
    return hidden, content or main, mark, main and mark is None, mark is None and not BOILERPLATE_WORDS.isdisjoint(named)


def _fades(kind: int, share: float) -> float:
    """How far a mark counts that holds this share of the text."""
    low, high = FADING[kind]
    return min(1.0, max(0.0, (high - share) / (high - low)))


def weigh_marks(blocks: list[Block], marks: list[Mark]) -> None:
    """Say how far each mark counts. A mark around the page's main text says nothing about it.

    For content elements in it, it fades with their share of the text of all content elements (of all text, unless it is a layout's);
    for other text in it, with the share of the page, where no content element lies elsewhere. ``marks`` are in page order, so each
    comes after those around it.
    """
    total = content = 0.0
    for b in blocks:
        size = len(b.text) * (1 - b.linked)
        total += size
        content += size * b.content
        if b.mark:
            b.mark.text += size
            b.mark.content += size * b.content
        if b.clear:
            b.clear.inner += size
    for m in reversed(marks):
        if m.above:
            m.above.text += m.text
            m.above.inner += m.inner
            m.above.content += m.content
    for m in marks:
        elsewhere = content - m.content
        outside = elsewhere if m.kind == LAYOUT else total - m.text
        wrapped = _fades(m.kind, m.inner / (m.inner + outside)) if m.inner else 1.0
        plain = 1.0 if m.inner or elsewhere > 0 or m.kind == TAG or not total else _fades(m.kind, m.text / total)
        m.plain = plain + (m.above.plain if m.above else 0.0)
        m.wrapped = wrapped + (m.above.wrapped if m.above else 0.0)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order; scripts, styles, comments, hidden elements and markup are gone, references decoded.

    One pass: open elements are known by place and by tag, so a page of any depth takes time in proportion to its length.
    """
    stack: list[Element] = []
    places: dict[str, list[int]] = {}
    blocks: list[Block] = []
    marks: list[Mark] = []
    buffer: list[str] = []
    raw = linked = elements = 0
    lowest, last_steps = 0, 0  # the least steps of the element on top since the block before, and that block's

    def text(part: str) -> None:
        nonlocal raw, linked
        if part:
            buffer.append(part)
            if not part.isspace():
                raw += len(part)
                if stack and stack[-1].link:
                    linked += len(part)

    def flush() -> None:
        nonlocal raw, linked, lowest, last_steps
        above = stack[-1] if stack else None
        if raw and not (above and above.hidden):
            words = html.unescape("".join(buffer)).split()
            if words:
                holder = above.holder if above else None
                depth = holder.steps if holder else 0
                steps = last_steps + depth - 2 * min(lowest, depth)
                of = (above.content, bool(holder and holder.hinted), linked / raw, above.mark, above.clear) if above else (False, False, linked / raw, None, None)
                blocks.append(Block(" ".join(words), holder.tag if holder else "", holder.outer if holder else -1, depth, *of, steps))
                lowest = last_steps = depth
        buffer.clear()
        raw = linked = 0

    def cut(place: int) -> None:
        nonlocal lowest
        while len(stack) > place:
            places[stack.pop().tag].pop()
        lowest = min(lowest, stack[-1].steps if stack else 0)

    def close(tag: str, barriers: tuple[str, ...] = ()) -> None:
        if at := places.get(tag):
            if all(not places.get(b) or places[b][-1] < at[-1] for b in barriers):
                cut(at[-1])

    unclosed: set[str] = set()
    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _LEFT_OUT and not m["close"]:
            if m["attrs"].endswith("/"):
                continue
            end = None if tag in unclosed else _LEFT_OUT[tag].search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
            flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"]:
            close(tag)
            continue
        if tag in VOID:
            continue
        if not inline:
            close("p", ("table", "td", "th", "div", "section", "article", "li", "blockquote", "button"))
            if tag == "li":
                close("li", ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr"):
                close(tag, ("table",))
        above = stack[-1] if stack else None
        hidden, content, kind, clears, hinted = _hints(tag, m["attrs"], above)
        root = tag in ("html", "body")
        mark = above.mark if above and not root else None
        clear = mark if clears else above.clear if above and not root else None
        if kind is not None:
            mark = Mark(kind, mark)
            marks.append(mark)
        elements += 1
        around = above.holder if above else None
        steps = (around.steps if around else 0) + (0 if inline else BORDER if kind is not None else 1)
        link = tag == "a" or bool(above and above.link)
        outer = -1 if around is None else around.number
        element = Element(tag, hidden, content, link, hinted, steps, mark, clear, elements, around, outer)
        if not inline:
            element.holder = element
        stack.append(element)
        places.setdefault(tag, []).append(len(stack) - 1)
    text(page[at:])
    flush()
    weigh_marks(blocks, marks)
    return blocks


_ENDS = re.compile(r"[.!?…。](?=\s|$)")


def evidence(block: Block) -> float:
    """Above 0: the cost of calling the block boilerplate; below 0: of calling it content."""
    words, sentence = block.text.count(" ") + 1, _ENDS.search(block.text) is not None
    score = LENGTH * min(words, LONG_WORDS) / LONG_WORDS + SENTENCE * sentence if words >= 4 or sentence else SHORT
    score += PARAGRAPH * (block.tag == "p") + HEADING * (len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit())
    counts = 0.0
    if block.mark:
        counts = block.mark.plain - (block.clear.plain if block.clear else 0.0) + (block.clear.wrapped if block.clear else 0.0)
    score += CONTENT * block.content * max(0.0, 1 - counts)
    score += LINKED * block.linked + MARKED * counts + HINTED * block.hinted + DEEP * min(block.depth, 20)
    return max(-MOST, min(MOST, score))


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost.

    A block whose own score outweighs all its edges keeps its sign in every minimum cut; its edges then count
    for its neighbours' terminals. The flow runs on the rest.
    """
    scores, around = list(scores), [[] for _ in scores]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    label: list[bool | None] = [None] * len(scores)
    loose = [sum(w for _, w in x) for x in around]
    ready = deque(i for i in range(len(scores)) if abs(scores[i]) > loose[i])
    while ready:
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = scores[i] > 0
        for j, w in around[i]:
            if label[j] is None:
                scores[j] += w if label[i] else -w
                loose[j] -= w
                if abs(scores[j]) > loose[j]:
                    ready.append(j)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        for i, x in zip(rest, _flow_labels(rest, scores, edges)):
            label[i] = x
    return label


def _flow_labels(rest: list[int], scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths with level graphs; then what the source still reaches."""
    place = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, k in place.items():
        if scores[i] > 0:
            add(source, k, scores[i], 0.0)
        elif scores[i] < 0:
            add(k, sink, -scores[i], 0.0)
    for a, b, w in edges:
        if a in place and b in place:
            add(place[a], place[b], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path.clear()
                a = source
                continue
            while following[a] < len(heads[a]):
                e = heads[a][following[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(heads[a]):
                path.append(heads[a][following[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks next to each other on the page, the weaker the further they are apart in the DOM, and blocks of one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR * STEP ** max(b.steps - 2, 0)))
        if i > 1:
            edges.append((i - 2, i, SECOND * STEP ** max(b.steps + blocks[i - 1].steps - 4, 0)))
        key = (b.parent, id(b.mark))  # a mark parts the children of an element
        if key in last:
            edges.append((last[key], i, SIBLING))
        last[key] = i
    return edges


def label_blocks(blocks: list[Block]) -> list[bool]:
    """The labels of least cost: what each block's own evidence says against, and an edge's weight wherever its ends differ."""
    return minimum_cut([evidence(b) for b in blocks], smoothness(blocks))


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, content in zip(blocks, label_blocks(blocks)) if content)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    A null or empty page, and one without content, has the empty text. White space of any kind within a block is one
    space. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty
    result. Each page is read whole, in place, without a shuffle.
    """
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20, "html"):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    whole = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    out = whole.mapInArrow(lean(run), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
