"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier over a block's own shape (words,
full stops, links, tag) gives its cost of being called boilerplate or content; these are
the capacities of its arcs from the source and to the sink.  Elements that say what they
are, by their tag or by a class of their own, are nodes too: an article has capacity from
the source, a menu to the sink, as much for each block that it holds.  Smoothness arcs
join blocks that follow one another and blocks that are children of one element, stronger
the more of their ancestors they share, and each block to the nearest element that says
something.  The minimum cut labels all nodes of a page at once: content is what the source
still reaches.  So the label of a block follows from its shape, its neighbours and its
element together, and each of them can be outvoted.

What an element says against content is void where it cannot be meant: on an element that
holds most of the page's prose together with its first article, main or h1, and on the
fullest such element of a page where something is said against every text but headings.

The weights are fixed parameters: the tables have no labelled pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands between a tag's name and its end; a quote counts only at the start of a value.
_ATTRS = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|math|object|title|canvas|video|audio)(?=[\s/>]){_ATTRS}(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
#: One attribute, its value quoted either way or bare; what stands inside a value is never a name.
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the tag closes an open one of these.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "body": ("head",),
}
#: An implied end does not reach beyond these.
_FENCE = frozenset("ul ol dl table select div section article main body".split())
#: Elements that say by their tag that they are not the article; a form may wrap a whole page.
AWAY = frozenset("nav footer aside form button select menu head dialog search".split())
#: Classes, ids and roles that name what is no article.
NEGATIVE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist discussion "
    "respond replies disqus cookie cookies consent gdpr copyright footer footnav login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification outbrain pager pagination paywall popup recommended recommendations sharing sidebar signup skyscraper sponsor "
    "sponsored subscribe taboola toolbar topbar tweet contentinfo complementary".split()
)
#: Words that name such a part or the article's subject or looks.
AMBIGUOUS = frozenset("alert legal promo promotion related rss share skip social tags warning widget".split())
#: A class with one of these tells of a page's state, layout or subject, not of the element.
STATE = frozenset("has no not with without is layout open closed enabled disabled on off active category cat topic tagged format type template".split())
POSITIVE = frozenset("article articlebody body content entry main post story text".split())

#: Weights of the linear classifier; positive speaks for content.
WEIGHTS = {"bias": -1.0, "words": 2.0, "stops": 0.6, "paragraph": 1.0, "heading": 0.8, "list": -0.5, "links": -1.5}
#: What an element says, for each block that it holds.
CUES = {"article": 3.0, "positive": 1.0, "weak": -4.0, "strong": -6.0, "unseen": -6.0}
#: Weights of the arcs to the next block, to the next child of the same element, and to the element that says something.
ADJACENT, NEAR, BELONGS = 0.8, 0.5, 6.0
#: Own score from which a block is prose.
PROSE = 1.0


class Element:
    """An open or closed element; ``said`` is what it says of itself, ``cue`` the nearest element whose saying holds."""

    __slots__ = ("tag", "up", "depth", "said", "cue", "prose", "anchor")

    def __init__(self, tag: str, up: Element | None, said: str = "") -> None:
        self.tag, self.up, self.said = tag, up, said
        self.depth = up.depth + 1 if up else 1
        self.cue: Element | None = None
        self.prose, self.anchor = 0, False


class Block:
    """A run of text in ``inner``; ``shared`` is how many elements it shares with the block before it."""

    __slots__ = ("inner", "shared", "parts", "link_chars", "text")

    def __init__(self, inner: Element | None, shared: int) -> None:
        self.inner, self.shared = inner, shared
        self.parts: list[str] = []
        self.link_chars, self.text = 0, ""

    @property
    def depth(self) -> int:
        return self.inner.depth if self.inner else 0


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _unseen(style: str) -> bool:
    """Whether inline ``style`` says display:none or visibility:hidden; of a repeated property the last counts."""
    said = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        said[name.strip()] = value.replace("!important", "").strip()
    return said.get("display") == "none" or said.get("visibility") == "hidden"


def _named(token: str) -> str:
    """What one class, id or role says: strong, weak, unseen, header (strong but in an article), positive or nothing."""
    words = [w for w in _WORD.split(_CAMEL.sub("-", token).lower()) if w]
    if not words or words[-1] == "hidden":
        return "unseen" if words and words[:-1] in ([], ["is"], ["visually"]) else ""
    if not STATE.isdisjoint(words):
        return ""
    if words[0] == "header" or (words[-1] == "header" and words[0] in ("site", "page", "main", "top", "global")):
        return "header"
    if len(words) == 1:
        return "strong" if words[0] in NEGATIVE else "weak" if words[0] in AMBIGUOUS else "positive" if words[0] in POSITIVE else ""
    ends = {words[0], words[-1]}
    # tags-politics is a subject, entry-tags a list of tags.
    if not ends.isdisjoint(NEGATIVE) or words[-1] in AMBIGUOUS:
        return "weak"
    return "positive" if not ends.isdisjoint(POSITIVE) else ""


def _said(tag: str, attrs: str) -> str:
    """What an element says of itself; classes count for nothing on html, body, main and article."""
    given = _attributes(attrs) if "=" in attrs or "hidden" in attrs.lower() else {}
    if tag in ("html", "body"):
        return ""
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _unseen(given.get("style", "")):
        return "unseen"
    if tag in ("main", "article"):
        return "article"
    if tag in AWAY:
        return "strong"
    if tag == "header":
        return "header"
    told = {_named(t) for name in ("class", "id", "role") for t in given.get(name, "").split()}
    return next((x for x in ("unseen", "strong", "weak", "header", "positive") if x in told), "")


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text of ``page``, empty ones left out, and its elements, both in page order."""
    stack: list[tuple[str, Element | None]] = []
    elements: list[Element] = []
    opened: Counter[str] = Counter()
    out: list[Block] = []
    inner: Element | None = None
    links = low = 0
    now: Block | None = None

    def add(raw: str) -> None:
        nonlocal now, low
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(inner, low)
            low = now.depth
            out.append(now)
        now.parts.append(raw)
        if links:
            now.link_chars += len(raw.strip())

    def pop_to(k: int) -> None:
        nonlocal links, now, inner, low
        for tag, e in reversed(stack[k:]):
            links -= tag == "a"
            opened[tag] -= 1
            if e is not None:
                now, inner = None, e.up
                low = min(low, e.depth - 1)
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if opened[tag]:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag == "p":
                now = None
            continue
        block = tag in BLOCKS or "-" in tag
        if block:
            now = None
            if opened["p"]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in _FENCE)
                if stack[k][0] == "p":
                    pop_to(k)
            ends = CLOSES.get(tag, ())
            if any(opened[x] for x in ends):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ends or stack[k][0] in _FENCE)
                if stack[k][0] in ends:
                    pop_to(k)
        if tag == "br":
            add("\n")
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if block:
                inner = Element(tag, inner, _said(tag, m["attrs"]))
                elements.append(inner)
            stack.append((tag, inner if block else None))
            opened[tag] += 1
            links += tag == "a"
    add(page[at:])
    kept: list[Block] = []
    low = 0
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        low = min(low, b.shared) if kept else 0
        if b.text:
            b.shared = low
            kept.append(b)
            low = b.depth
    return kept, elements


def block_score(block: Block) -> float:
    """The classifier's score of a block's own shape; positive for content."""
    w, text, tag = WEIGHTS, block.text, block.inner.tag if block.inner else ""
    score = w["bias"] + w["words"] * min((text.count(" ") + 1) / 15, 1) + w["stops"] * (text[-1] in ".!?:;…。！？\"”")
    score += w["paragraph"] * (tag in ("p", "pre", "blockquote")) + w["heading"] * (tag[:1] == "h" and tag[1:].isdigit()) + w["list"] * (tag == "li")
    return score + w["links"] * min(block.link_chars / len(text), 1)


def settle_cues(blocks: list[Block], scores: list[float], elements: list[Element]) -> None:
    """Give every element its ``cue``: the nearest element above it, or itself, whose saying holds; None without one.

    Inside an article only what speaks against it is heard, inside what is no article
    nothing but a stronger word against it.
    """
    first = next((e for e in elements if e.said == "article" or e.tag == "h1"), None)
    e = first
    while e is not None:
        e.anchor, e = True, e.up
    total = 0
    for b, score in zip(blocks, scores, strict=True):
        if score >= PROSE:
            size = len(b.text)
            total += size
            if b.inner is not None:
                b.inner.prose += size
    for e in reversed(elements):
        if e.up is not None:
            e.up.prose += e.prose
    voided: set[Element] = set()

    def settle() -> bool:
        """Whether a block of text, headings aside, has nothing said against it."""
        rank = {"": 0, "positive": 1, "article": 2, "weak": 3, "strong": 4, "unseen": 4}
        for e in elements:
            above = e.up.cue if e.up is not None else None
            held = rank[above.said] if above is not None else 0
            if e.said == "header":
                e.said = "" if held == 2 else "strong"
            own = rank[e.said]
            if own > 2 and (e in voided or (e.tag not in ("nav", "footer") and e.anchor and 2 * e.prose >= total and e.prose)):
                own = 0
            e.cue = e if own > held else above
        return any(
            s > 0 and (b.inner is None or (b.inner.tag[:1] != "h" and (b.inner.cue is None or rank[b.inner.cue.said] < 3))) for b, s in zip(blocks, scores, strict=True)
        )

    if not settle() and total:
        against = [e for e in elements if e.cue is e and e.said in ("weak", "strong", "unseen") and e.tag not in ("nav", "footer", "head", "button", "select", "menu", "dialog")]
        if against:
            voided.add(max(against, key=lambda e: e.prose))
            settle()


def graph(blocks: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Scores of the nodes (the blocks, then the elements that say something) and the smoothness arcs between them."""
    scores = [block_score(b) for b in blocks]
    arcs: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    node: dict[Element, int] = {}
    for i, b in enumerate(blocks):
        if i:
            arcs[i - 1, i] = ADJACENT * (b.shared + 1) / (max(b.depth, blocks[i - 1].depth) + 1)
        parent = b.inner.up if b.inner is not None else None
        key = id(parent)
        if key in last and parent is not None:
            pair = last[key], i
            arcs[pair] = arcs.get(pair, 0.0) + NEAR * (parent.depth + 1) / (b.depth + 1)
        last[key] = i
        cue = b.inner.cue if b.inner is not None else None
        if cue is not None:
            if cue not in node:
                node[cue] = len(scores)
                scores.append(0.0)
            scores[node[cue]] += CUES[cue.said]
            arcs[i, node[cue]] = BELONGS
    return scores, arcs


def minimum_cut(scores: list[float], arcs: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    A positive score is an arc from the source, a negative one to the sink.  Of
    several minimum cuts the one with the smallest source side is taken.  A node whose
    own score outweighs all its arcs has the label of that score in every minimum cut;
    such nodes are settled first, and the flow is pushed through the rest.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in arcs.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, label = list(scores), [None] * n
    slack = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or (abs(own[i]) <= slack[i] + 1e-9 and near[i]):
            continue
        label[i] = own[i] > 0
        for j, w in near[i].items():
            own[j] += w if label[i] else -w
            del near[j][i]
            slack[j] -= w
            todo.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, max_flow(left, own, near), strict=True):
            label[i] = side
    return label


def max_flow(nodes: list[int], own: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Blocking flows over shortest paths (Dinitz); True for the nodes that the source still reaches."""
    place = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    heads: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i in nodes:
        k = place[i]
        if own[i] > 0:
            join(source, k, own[i], 0.0)
        elif own[i] < 0:
            join(k, sink, -own[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                join(k, place[j], w, w)
    while True:
        level = [-1] * len(heads)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for a in heads[i]:
                if cap[a] > 1e-9 and level[to[a]] < 0:
                    level[to[a]] = level[i] + 1
                    queue.append(to[a])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        tried = [0] * len(heads)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(cap[a] for a in path)
                for a in path:
                    cap[a] -= flow
                    cap[a ^ 1] += flow
                # Go on from the first arc that is full.
                k = next(k for k, a in enumerate(path) if cap[a] <= 1e-9)
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[i] < len(heads[i]):
                a = heads[i][tried[i]]
                if cap[a] > 1e-9 and level[to[a]] == level[i] + 1:
                    break
                tried[i] += 1
            else:
                if i == source:
                    break
                i = to[path.pop() ^ 1]
                tried[i] += 1
                continue
            path.append(a)
            i = to[a]


def main_text(page: str | None) -> str:
    """The content blocks of ``page`` in page order, one a line; empty where there are none."""
    blocks, elements = blocks_of(page or "")
    settle_cues(blocks, [block_score(b) for b in blocks], elements)
    labels = minimum_cut(*graph(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=False) if content)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with the main text in column ``into``.

    Null and empty pages give an empty text.  Character references are decoded, white
    space inside a block becomes one space, blocks are joined by one newline.  Nothing is
    dropped or capped but boilerplate.  Rows stay as they are, repeated ones too; a column
    that is already named ``into`` is replaced; an empty table gives an empty result.
    """
    import pyspark.sql.types as T

    kept = [f for f in pages.schema.fields if f.name not in (html_col, into)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*names, into])

    rows = pages.select(F.col(html_col).cast("string").alias("__html"), *names)
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))


#: DuckDB SQL of the registered query on the given tables, whose pages hold one article of
#: headings and paragraphs and no other character references in it than these four.
ORACLE_SQL = r"""
WITH inside AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
parts AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'),
         lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS p FROM inside),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(p, lambda x: x <> ''), chr(10)), '') AS text FROM parts)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
