"""Main text of web pages by minimum cut.

A page is cut into blocks of text. Blocks and the elements above them are the nodes of a graph. A linear classifier gives
each block a cost for either label, by its length, its links and how it begins; an element has one by what its tag,
role or class tells, for each block that it holds. These costs are the capacities to the two terminals. Edges join blocks
with the element that they stand in, elements with their parents (the stronger the more blocks they hold), and
neighbouring blocks, the weaker the further apart they are in the document tree. Where no mark lies above, an edge is
also the weaker the more a block differs from the others of its element. The maximum flow separates content from
boilerplate at the least total cost: a mark reaches the blocks below it through edges only, so what a block looks like
and what stands around it can outweigh it.

A class or identifier is judged name by name. Its last telling word decides: ``related-posts`` lies apart,
``social-studies-lesson`` holds a doubtful word only. Doubtful names, and names that another name of the element
contradicts, cost little, so that long text overrules them. Where articles hold half of a page's letters or more, what
lies outside of them, but for a first heading, is hardly content. Length counts words; two characters of a script that is
written without spaces are one word.

Scripts, styles, titles and text fields are left out up to their closing tag or the end of the page; drawings, formulas,
buttons, lists of choices, embedded and unscripted parts up to their own closing tag, and where that is missing only the
tag itself is. Character references are decoded, white space inside a block becomes one space, and the content blocks are
joined in page order by a line feed. A null or empty page, or one without content, gives an empty text. Pages of any
length are taken whole and one by one, repeated rows too; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
#: Elements whose text is no markup: up to the closing tag, or the end of the page.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea")}
#: Elements left out as a whole; without a closing tag of their own, only the tag goes.
LEFT_OUT = frozenset({"noscript", "template", "iframe", "svg", "math", "select", "button", "object"})
FOREIGN = frozenset({"svg", "math"})  # here a tag that ends in a slash is an element without content
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset({"hr"})
#: An opening tag that ends an open element of these kinds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, **{f"h{n}": {"p"} for n in range(1, 7)}, **{t: {"p"} for t in ("div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "form", "nav", "aside", "footer", "header", "main")}}
APART_TAGS = frozenset({"nav", "aside", "footer", "form", "menu", "dialog", "search", "fieldset", "head"})
CONTENT_TAGS = frozenset({"article", "main"})
APART_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"})
APART_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promotion recommended related replies reply share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Those of APART_WORDS that no other name of the element takes back.
SURE_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising comment comments cookie cookies disqus nav navbar navigation newsletter promo promotion sponsor sponsored subscribe".split())
#: Words that say nothing of what a name stands for.
PLAIN_WORDS = frozenset("area articles bar block bottom box button cell col column container elem element fixed form group holder icon inner item items left link links list lg md module news outer page panel posts products right row section site sm stories sub the this title top topics unit wide wrap wrapper xl xs".split())
#: Words before one of APART_WORDS that take its meaning away.
NO_MARK = frozenset("has have no not with without hide hides after before under over".split())
#: Classifier: weights of what is known of a block; above 0 speaks for content.
LENGTH, LINKS, NOTICE, BIAS, OUTSIDE = 2.0, -3.0, -4.0, -0.4, -3.0
#: Weights of an element's marks, for each block in it.
APART, DOUBT, INSIDE, NAMED = -6.0, -0.8, 3.0, 1.0
#: Smoothness: along the document tree, for an element and for each block in it, between neighbouring blocks, and the
#: difference of evidence that weakens an edge without a mark above by the factor e.
TREE, TREE_EACH, NEXT, CONTRAST = 2.0, 1.0, 1.0, 1.5
#: Scripts written without spaces: Thai to Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NOTICE_START = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)


class Block:
    __slots__ = ("heading", "inside", "linked", "path", "text")

    def __init__(self, path: tuple[int, ...], inside: bool, heading: bool) -> None:
        self.path = path  # the elements around it, by their number on the page, 0 first
        self.inside, self.heading = inside, heading
        self.text: list[str] = []
        self.linked = 0


def _named(value: str, within: bool) -> tuple[float, bool]:
    """The weight of a class or identifier that speaks of parts apart, and whether it speaks of content."""
    weight, sure, content, pure = 0.0, False, False, False
    for name in value.split():
        found = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        words = [w for before, w in zip(["", *found], found) if before not in NO_MARK]
        good = sum(w in CONTENT_WORDS for w in words)
        bad = [w for w in words if w in APART_WORDS and not (within and w in ("header", "tags"))]
        content |= good > 0
        pure |= good > 0 and not bad
        if not bad:
            continue
        telling = [w for w in words if w not in PLAIN_WORDS and w not in CONTENT_WORDS]
        clear = telling[-1] in bad and len(bad) >= good
        sure |= clear and telling[-1] in SURE_WORDS
        weight = min(weight, APART if clear else DOUBT)
    return (max(weight, DOUBT) if pure and not sure else weight), content


def _hints(tag: str, attributes: str, within: bool) -> tuple[float, bool, bool]:
    """How much speaks for an element lying apart (at most 0), does it hold the content, is it named as if it did?"""
    apart, named = APART * (tag in APART_TAGS or (tag == "header" and not within)), False
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), next((x for x in m.groups()[1:] if x), "")
            hidden = False
            if key in ("class", "id"):
                weight, content = _named(value, within)
                named |= content
                if tag not in ("html", "body"):
                    apart = min(apart, weight)
            elif key == "role":
                hidden = value.lower() in APART_ROLES
            elif key == "hidden" and not m[0].lower().startswith("aria"):
                hidden = True
            elif key == "aria-hidden":
                hidden = value.lower() == "true"
            elif key == "style":
                hidden = bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            if hidden:
                apart = APART
    return apart, tag in CONTENT_TAGS, named and apart > APART


def tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; what is left out is one tag without a name."""
    out: list[tuple[int, int, str, bool, str]] = []
    opened: dict[str, list[int]] = {}
    until: dict[int, int] = {}  # the tag that closes an element left out
    at = 0
    while m := TOKEN.search(html, at):
        at = m.end()
        tag, closing, attributes = (m[2] or "").lower(), bool(m[1]), m[3] or ""
        empty = attributes.endswith("/") and (tag in FOREIGN or (tag in RAW and any(opened.get(t) for t in FOREIGN)))
        if tag in RAW and not closing:
            if not empty:
                end = RAW[tag].search(html, at)
                at = end.end() if end else len(html)
            tag = ""
        elif tag in LEFT_OUT:
            if not closing and not empty:
                opened.setdefault(tag, []).append(len(out))
            elif closing and opened.get(tag):
                until[opened[tag].pop()] = len(out)
            tag = ""
        out.append((m.start(), at, tag, closing, attributes))
    if not until:
        return out
    kept, i = [], 0
    while i < len(out):
        last = until.get(i, i)
        kept.append((out[i][0], out[last][1], *out[i][2:]))
        i = last + 1
    return kept


def blocks(html: str) -> tuple[list[Block], dict[int, float]]:
    """Blocks of text in page order, and the weights of the elements' marks."""
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, apart, inside, number
    out: list[Block] = []
    marks: dict[int, float] = {}
    open_: Block | None = None
    serial, links, at = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal open_
        if not raw:
            return
        if open_ is None:
            if raw.isspace():
                return
            open_ = Block(tuple(f[3] for f in stack), stack[-1][2], any(f[0] == "h1" for f in stack))
            out.append(open_)
        open_.text.append(raw)
        if links:
            open_.linked += len(raw.strip())

    for start, end, tag, closing, attributes in tags(html):
        text(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag == "br":
            text(" ")
        elif tag in BLOCK_TAGS:
            open_, links = None, 0
            if closing:
                if any(f[0] == tag for f in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                while stack[-1][0] in CLOSES.get(tag, ()):
                    stack.pop()
                if tag not in VOID:
                    _, apart, inside, _ = stack[-1]
                    a, i, n = _hints(tag, attributes, inside)
                    serial += 1
                    clear = a <= APART
                    if clear:
                        marks[serial] = a
                    elif a or (not apart and (i or n)):  # what lies apart holds no content, whatever it is called
                        marks[serial] = a + (INSIDE * i + NAMED * n) * (not apart)
                    stack.append((tag, apart or clear, (inside or i) and not (apart or clear), serial))
        elif tag == "img" and open_ is not None:
            open_.text.append(" ")
    text(html[at:])
    return out, marks


def evidence(text: str, linked: int) -> float:
    """How much more it costs to call a block boilerplate than to call it content."""
    words = text.count(" ") + 1 + len(UNSPACED.findall(text)) / 2
    return BIAS + LENGTH * math.tanh(words / 12) + LINKS * min(1.0, linked / max(1, len(text))) + NOTICE * bool(NOTICE_START.match(text))


def min_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, of a graph with these capacities to the terminals and undirected edges (Dinic)."""
    n = len(content)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def join(u: int, v: int, there: float, back: float) -> None:
        graph[u].append(len(head))
        head.append(v)
        room.append(there)
        graph[v].append(len(head))
        head.append(u)
        room.append(back)

    for i in range(n):
        if content[i] > 0:
            join(source, i, content[i], 0.0)
        if boilerplate[i] > 0:
            join(i, sink, boilerplate[i], 0.0)
    for u, v, w in edges:
        join(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = head[path[keep] ^ 1]
                del path[keep:]
                continue
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if room[e] > 1e-9 and level[head[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(graph[u]):
                path.append(graph[u][turn[u]])
                u = head[path[-1]]
            elif path:
                u = head[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def _apart_by(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps between two elements of the document tree."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def page_graph(paths: list[tuple[int, ...]], own: list[float], marks: dict[int, float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Evidence of all nodes (blocks first) and edges. Elements without a mark and with one node below are passed over."""
    below: dict[int, set[int]] = {}  # elements below an element, as negative numbers, and blocks
    held: dict[int, int] = {}
    for i, path in enumerate(paths):
        inner = i
        for e in reversed(path):
            held[e] = held.get(e, 0) + 1
            known = below.setdefault(e, set())
            known.add(inner)
            inner = -1 - e
    node: dict[int, int] = {}
    weight, edges = list(own), []
    mean = {e: 0.0 for e in below}
    told = [o + sum(marks.get(e, 0.0) for e in path) for o, path in zip(own, paths)]
    for i, path in enumerate(paths):
        for e in path:
            mean[e] += told[i] / held[e]
    for e in below:
        if e in marks or len(below[e]) > 1:
            node[e] = len(weight)
            weight.append(marks.get(e, 0.0) * held[e])
    seen: set[int] = set()
    free: list[bool] = []  # blocks without a mark above
    for i, path in enumerate(paths):
        at, n, like = i, 1, own[i]
        marked = sum(e in marks for e in path)
        free.append(not marked)
        for e in reversed(path):
            if e in node:
                edges.append((at, node[e], (TREE + TREE_EACH * n) * (1.0 if marked else math.exp(-abs(like - mean[e]) / CONTRAST))))
                at, n, like = node[e], held[e], mean[e]
                if at in seen:
                    break
                seen.add(at)
            marked -= e in marks
        if i:
            alike = math.exp(-abs(own[i] - own[i - 1]) / CONTRAST) if free[i] and free[i - 1] else 1.0
            edges.append((i - 1, i, alike * NEXT / (1 + _apart_by(paths[i - 1], path) / 2)))
    return weight, edges


def page_costs(found: list[tuple[Block, str]]) -> list[float]:
    """Evidence of each block, with what its place beside articles tells."""
    inside = sum(len(text) for b, text in found if b.inside)
    beside = 2 * inside >= sum(len(text) for _, text in found) and inside > 0
    return [evidence(text, b.linked) + OUTSIDE * (beside and not b.inside and not b.heading) for b, text in found]


def main_text(html: str) -> str:
    cut, marks = blocks(html)
    found: list[tuple[Block, str]] = []
    for b in cut:
        text = " ".join(unescape("".join(b.text)).split())
        if text:
            found.append((b, text))
    weight, edges = page_graph([b.path for b, _ in found], page_costs(found), marks)
    keep = min_cut([max(0.0, e) for e in weight], [max(0.0, -e) for e in weight], edges)
    return "\n".join(text for (_, text), k in zip(found, keep) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) if x else "" for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars."""
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "id long, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
