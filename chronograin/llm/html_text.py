"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text at its block-level tags. A classifier gives every block the cost of
calling it content and of calling it boilerplate, from its words, links, tag and surrounding elements; these
become the capacities of its terminal edges. Blocks that follow one another, and blocks that share their parent
element, are tied by smoothness edges, weaker the further apart they lie in the tree. The minimum cut, by
maximum flow, separates content from boilerplate with the least total cost.

Blocks whose terminal edge outweighs all their ties are on that side of some minimum cut whatever
the others do; they are settled first, and the flow runs on what is left.

Defined results: NULL, empty and text-free html give an empty text; markup that does not parse is read
as far as it goes and plain text stays text; repeated pages are extracted each; an empty table gives an
empty result; other columns are ignored. Nothing of a page is capped.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronograin.llm.common import per_batch, settle

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?:svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+(?<=/)>
      | <(?P<raw>script|style|noscript|template|iframe|object|svg|math|textarea|select|title|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>
      | <[!?/][^>]*>""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
# attributes without any of these need no parsing
_MAYBE_HIDDEN = re.compile("hidden|display|&", re.I)
_WORD = re.compile(r"[a-z0-9]+")

# tags that do not end a block
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends what is open of its own kind
SIBLINGS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOILER_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# words in class, id or role of an element
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side rail widget widgets nav "
    "navigation navbar menu breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies respond "
    "disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login search share sharing social follow related recommended recommendations more pagination pager tags toolbar "
    "copyright legal disclaimer contentinfo complementary skip".split()
)
MAIN_WORDS = frozenset("article main content story post entry body text".split())

ADJACENT = 0.6
SIBLING = 0.8


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    # what the element and those around it say of their blocks
    boiler: bool = False
    main: bool = False
    hidden: bool = False


@dataclass
class Block:
    parent: Element
    tag: str
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _hides(attributes: str) -> bool:
    """Whether ``hidden``, ``aria-hidden="true"`` or a style of ``display: none`` is among the attributes."""
    if not _MAYBE_HIDDEN.search(attributes):
        return False
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        # the first of repeated attributes counts
        found.setdefault(name.lower(), html.unescape("".join(values)).strip().lower())
    if found.get("hidden", "until-found") != "until-found" or found.get("aria-hidden") == "true":
        return True
    shown = ("", False)
    for declaration in re.sub(r"/\*.*?(?:\*/|\Z)", "", found.get("style", ""), flags=re.S).split(";"):
        name, _, value = declaration.partition(":")
        if name.strip() == "display":
            value, mark, _ = value.partition("!")
            # the last declaration counts, unless an important one stands before
            if mark or not shown[1]:
                shown = (value.strip(), bool(mark))
    return shown[0] == "none"


def _element(tag: str, attributes: str, parent: Element | None) -> Element:
    words: set[str] = set()
    if "=" in attributes:
        for found in _NAMES.findall(attributes):
            words.update(_WORD.findall("".join(found).lower()))
    out = Element(tag, parent, parent.depth + 1 if parent else 0)
    inside = parent is not None and parent.main
    out.hidden = (parent is not None and parent.hidden) or bool(attributes and _hides(attributes))
    out.main = inside or tag in MAIN_TAGS
    out.boiler = parent is not None and parent.boiler
    if tag in ("html", "body"):
        return out
    if tag == "header":
        # the heading of an article is part of it
        out.boiler = out.boiler or not inside
    elif tag in BOILER_TAGS:
        out.boiler = True
    if words & BOILER_WORDS and not (tag in MAIN_TAGS and not inside and not words & {"comment", "comments", "reply"}):
        out.boiler = True
    if not out.boiler and words & MAIN_WORDS:
        out.main = True
    return out


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in page order."""
    root = Element("", None, 0)
    top, links, at = root, 0, 0
    block = Block(root, "")
    found: list[Block] = []

    def text(piece: str) -> None:
        if piece:
            block.pieces.append(piece)
            if links:
                block.linked += len(piece)

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if token["close"] else 1
            elif tag == "br":
                text(" ")
            continue
        if block.pieces:
            found.append(block)
        if token["close"]:
            seek = top
            while seek is not root and seek.tag != tag:
                seek = seek.parent
            if seek is not root:
                top = seek.parent
        else:
            ends = SIBLINGS.get(tag)
            if ends and top.tag in ends:
                while top.tag in ends:
                    top = top.parent
                links = 0
            if tag not in VOID and not token["attributes"].endswith("/"):
                top = _element(tag, token["attributes"], top)
        leaf = top.tag in ("p", "li", "td", "th", "dt", "dd", "pre", "blockquote") or top.tag in HEADINGS
        block = Block(top.parent if leaf else top, top.tag)
        block_hidden = top.hidden or top.boiler
        if leaf and (block_hidden != (block.parent.hidden or block.parent.boiler) or top.main != block.parent.main):
            # the element's own names speak for its text
            block.parent = top
    text(page[at:])
    if block.pieces:
        found.append(block)
    out = []
    for b in found:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
        if b.text and not b.parent.hidden:
            out.append(b)
    return out


def log_odds(block: Block) -> float:
    """The classifier: log of the odds that a block is content."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.linked / max(1, sum(map(len, block.pieces))))
    odds = -1.2 + 0.65 * math.log1p(words) - 4.0 * share
    odds += 0.8 * (block.tag == "p") + 0.8 * (block.tag in HEADINGS) + 0.4 * (block.text[-1] in ".!?:;\"'”»…")
    odds -= 1.0 * (block.tag == "li" and share > 0.5)
    odds -= 2.0 * ("©" in block.text and words < 40)
    odds += 4.0 * block.parent.main
    odds -= 9.0 * block.parent.boiler
    return odds


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
        if a is None or b is None:
            return steps + 1
    return steps


def ties_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges between blocks: page order, and the next block of the same parent."""
    ties: dict[tuple[int, int], float] = {}
    latest: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            ties[i - 1, i] = ADJACENT / (1 + _distance(blocks[i - 1].parent, b.parent))
        before = latest.get(id(b.parent))
        if before is not None:
            ties[before, i] = ties.get((before, i), 0.0) + SIBLING
        latest[id(b.parent)] = i
    return ties


def minimum_cut(source: list[float], sink: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source, given terminal capacities and undirected ties."""
    n = len(source)
    net = [a - b for a, b in zip(source, sink, strict=True)]
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in ties.items():
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(net[i]) >= sum(around[i].values()):
            side[i] = net[i] > 0
            for j, w in around[i].items():
                net[j] += w if side[i] else -w
                del around[j][i]
                queue.append(j)
            around[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        reached = _max_flow(left, net, around)
        for i in left:
            side[i] = i in reached
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], net: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches once the flow is at its maximum (Dinic's algorithm)."""
    capacity: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    source, sink = -1, -2
    capacity[source] = {i: net[i] for i in nodes if net[i] > 0}
    capacity[sink] = {}
    for i in nodes:
        if net[i] > 0:
            capacity[i][source] = 0.0
        elif net[i] < 0:
            capacity[i][sink] = -net[i]
            capacity[sink][i] = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in capacity[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        ahead = {i: [j for j in capacity[i] if level.get(j) == level[i] + 1] for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(capacity[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    capacity[a][b] -= push
                    capacity[b][a] += push
                path = [source]
                continue
            while ahead[i] and capacity[i][ahead[i][-1]] <= 1e-12:
                ahead[i].pop()
            if ahead[i]:
                path.append(ahead[i][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The content blocks of a page, in page order, one line each."""
    blocks = blocks_of(page or "")
    odds = [log_odds(b) for b in blocks]
    # -log of both probabilities: what it costs to call a block boilerplate, or content
    as_boiler = [math.log1p(math.exp(min(o, 50.0))) for o in odds]
    as_content = [math.log1p(math.exp(min(-o, 50.0))) for o in odds]
    kept = minimum_cut(as_boiler, as_content, ties_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    settle(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"text": [main_text(p) for p in batch.column(2).to_pylist()]}

    text = T.StructType([T.StructField("text", T.StringType(), False)])
    found = per_batch(pages.select("page_id", "url", "html"), run, text, ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
