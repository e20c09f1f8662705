"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text. A classifier gives each block a cost of being called content and one of being called
boilerplate, from statistics of the block (length, share of linked text, end of a sentence, repetition, controls beside it) and, as
bounded evidence beside these, from the names of the elements around it: the capacities to the two terminals. Blocks
that follow one another, and blocks under one parent, are tied by smoothness edges whose capacity falls with their distance in
the document tree. The minimum cut is the labelling of least cost. Blocks inside elements that are never the article (menus,
footers, scripts) are tied to the boilerplate terminal without limit, that is, left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))?)?")
_GAP = re.compile(r"[\s/]*")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[\s_-]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: Never part of the article, whatever they hold.
NEVER = frozenset("head script style noscript template title nav footer aside button select option textarea iframe svg canvas object audio video dialog menu fieldset datalist map search".split())
CONTROLS = frozenset("button input select textarea".split())
#: Elements that an opening tag of the key ends, unless one of BARRIER stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BARRIER = ("ul", "ol", "dl", "table", "select")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class names and ids that tell boilerplate, with their weight; the weight of an element is that of its weightiest word.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox anzeige werbung publicidad publicite banner sponsor sponsored sponsors promo promos promoted promotion outbrain taboola cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar sidenav widget widgets related recommended recommendations share sharing social follow "
    "comment comments commentlist disqus replies respond reactions nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar copyright login signin register pagination pager tagcloud disclaimer survey paywall".split()
)
_WEAK = frozenset("header foot side rail alert popular trending recommend reply search tags skip legal teaser teasers".split())
_ARTICLE = frozenset("article articlebody content contents post entry story main maincontent text body bodytext prose hentry".split())
#: A name that begins or ends so tells the state of a page ("has-sidebar", "comments-open"), not what the element is.
_STATE_FIRST = frozenset("has with no without is show hide category tag cat type status format theme layout template".split())
_STATE_LAST = frozenset("open closed enabled disabled on off active visible hidden allowed true false".split())
#: What may stand beside those words in the name of a part of a page ("share-buttons"). Beside another word they qualify an ordinary noun ("share-price"), and count as weak.
_STRUCTURE = frozenset(
    "list box item items wrapper wrap container holder area block bar bars button buttons btn link links section inner outer form row col column cell group panel strip slot unit content contents text body title heading head header "
    "footer foot main top bottom left right center middle side inline small large big primary secondary site page pages global sticky fixed float floating icon icons label region zone card cards tray stack counter thread tree post posts article "
    "articles story stories news email mail message messages entry feed grid wall first last new view element component module div id js css".split()
)
STRONG, WEAK = 7.0, 2.0
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Headings of reader comments; without a heading element, only with a number.
_REMARKS = r"(?:comments?|responses|kommentare?|leserkommentare|commentaires?|comentarios?|coment[áa]rios?|commenti|reacties|kommentarer|komentarze|комментари(?:и|ев)|コメント|评论|評論|댓글)"
_REMARKS_HEAD = re.compile(rf"^(?:\d+\s*)?(?:(?:reader|user|recent|leser)\s+)?{_REMARKS}(?:\s*[(\[]?\d+[)\]]?)?\s*:?$", re.I)
_REMARKS_COUNT = re.compile(rf"^(?:\d+\s*{_REMARKS}|{_REMARKS}\s*[(\[]?\d+[)\]]?)\s*:?$", re.I)
#: Lines that stand in each of a list of remarks: a time of the day, a time that has passed, or an answer asked for.
_REMARK_LINE = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d+\s*(?:s|sec|min|mins|h|hrs?|d|seconds?|minutes?|hours?|days?|weeks?|months?|years?)\s+ago\b|\b(?:vor|il y a|hace|há)\s+\d+\b|^(?:reply|antworten|répondre|responder|rispondi|report)$", re.I)
_SHORT = re.compile(
    r"^(?:advertisement|sponsored|anzeige|werbung|publicit[ée]|publicidad|read more|weiterlesen|share(?: this)?|subscribe|sign (?:in|up)|log ?in|menu|skip to .*|accept(?: all)?(?: cookies)?|"
    r"©.*|\(c\) .*|copyright .*|all rights reserved.*|comments?(?: \(\d+\))?|reply|report|related (?:articles|posts|stories))\W*$",
    re.I,
)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    never: bool
    link: bool
    heading: bool
    mark: float = 0.0
    article: int = 0  # 2: an element for articles; 1: a name of one


@dataclass(slots=True)
class Block:
    parts: list[str]
    element: int
    container: int
    depth: int
    apart: int
    heading: bool
    linked: int = 0
    text: str = ""
    words: int = 0
    mark: float = 0.0
    core: bool = False
    remark: bool = False


@dataclass
class Page:
    elements: list[Element]
    blocks: list[Block]
    #: number of controls by the block element that holds them
    controls: Counter = field(default_factory=Counter)
    #: headers outside an article that are not right under the body
    headers: list[int] = field(default_factory=list)


def named(label: str) -> tuple[float, bool]:
    """Weight of boilerplate, and whether the names are those of an article, for a class and id."""
    weight, article = 0.0, False
    for name in label.split():
        words = [w.lower() for w in _SPLIT.split(_HUMP.sub("-", name)) if w]
        if not words or len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
            continue
        is_article = any(w in _ARTICLE for w in words)
        if any(w in _STRONG for w in words):
            parts = all(w in _STRONG or w in _WEAK or w in _STRUCTURE or w.isdigit() or len(w) < 2 for w in words)
            weight = max(weight, STRONG if parts else WEAK)
        elif any(w in _WEAK for w in words):
            if not (is_article and words[-1] == "header"):  # the head of an article is a part of it
                weight = max(weight, WEAK)
        elif is_article:
            article = True
    return weight, article and not weight


def parse(page: str) -> Page:
    """Elements and blocks of text of a page in order. Unclosed, misnested and cut off markup is read as a browser would, in the main. The time is linear in the page."""
    root = Element("", -1, 0, False, False, False)
    elements, out = [root], Page([root], [])
    out.elements = elements
    stack = [0]  # numbers of open elements
    where: dict[str, list[int]] = {}  # places in the stack by tag
    block_at: list[int] = [0]  # places in the stack of block elements
    current: Block | None = None
    low = 0  # least depth since the last block
    at, end = 0, len(page)

    def close_to(k: int) -> None:
        nonlocal current, low
        while len(stack) > k:
            tag = elements[stack.pop()].tag
            where[tag].pop()
            if tag in BLOCK:
                block_at.pop()
                current = None
        low = min(low, elements[stack[-1]].depth)

    def say(text: str) -> None:
        nonlocal current, low
        if not text:
            return
        top = elements[stack[-1]]
        if top.never:
            return
        if current is None:
            if not text.strip():
                return
            container = elements[stack[block_at[-1]]]
            current = Block([], stack[-1], stack[block_at[-1]], container.depth, container.depth + (out.blocks[-1].depth if out.blocks else 0) - 2 * min(low, container.depth), top.heading)
            out.blocks.append(current)
            low = container.depth
        text = html.unescape(text) if "&" in text else text
        current.parts.append(text)
        if top.link:
            current.linked += len(text.strip())

    while at < end:
        m = page.find("<", at)
        if m < 0:
            say(page[at:])
            break
        if m > at:
            say(page[at:m])
        nxt = page[m + 1 : m + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", m):
                k = page.find("-->", m + 4)
                at = end if k < 0 else k + 3
            else:
                k = page.find(">", m)
                at = end if k < 0 else k + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, m + 1 + closing)
        if name is None:
            if closing and page[m + 2 : m + 3]:  # a bogus comment
                k = page.find(">", m)
                at = end if k < 0 else k + 1
            else:
                say("<")
                at = m + 1
            continue
        tag = name[0].lower()
        at = name.end()
        attrs: dict[str, str] = {}
        slash = False
        while True:
            gap = _GAP.match(page, at)
            slash, at = gap[0].endswith("/"), gap.end()
            if at >= end or page[at] == ">":
                at += 1
                break
            a = _ATTR.match(page, at)
            attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            at = a.end()
        if closing:
            if where.get(tag):
                close_to(where[tag][-1])
            elif tag in BLOCK:
                current = None
            continue
        if tag == "br":
            say("\n")
            continue
        if tag in CONTROLS:
            out.controls[stack[block_at[-1]]] += 1
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if tag in BLOCK:
            top_block = elements[stack[block_at[-1]]]
            if top_block.tag == "p" or top_block.tag in HEADINGS and tag in HEADINGS:  # a block element ends an open paragraph
                close_to(block_at[-1])
        if tag in ENDS:
            inner = max((where[t][-1] for t in ENDS[tag] if where.get(t)), default=0)
            if inner > max((where[t][-1] for t in BARRIER if where.get(t)), default=0):
                outer = inner
                for t in ENDS[tag]:  # a row also ends the row that the open cell is in
                    if where.get(t) and inner - where[t][-1] == 1:
                        outer = min(outer, where[t][-1])
                close_to(outer)
        top = elements[stack[-1]]
        e = Element(tag, stack[-1], top.depth + (tag in BLOCK), top.never or tag in NEVER, top.link or tag == "a", top.heading or tag in HEADINGS)
        if tag in ("article", "main"):
            e.article = 2
        elif tag == "header" and not (where.get("article") or where.get("main")):
            if elements[stack[block_at[-1]]].tag in ("body", "html", ""):
                e.never = True
            else:
                out.headers.append(len(elements))
        elif tag == "form":
            e.mark = STRONG
        if attrs and tag not in ("html", "body"):
            role = attrs.get("role", "").lower()
            if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
                e.never = True
            if role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody":
                e.article = 2
            elif role in _BOILER_ROLE:
                e.mark = STRONG
            if "class" in attrs or "id" in attrs:
                weight, article = named(html.unescape(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
                if tag in HEADINGS or tag == "article" and weight < STRONG:
                    weight = 0.0
                e.mark = max(e.mark, weight)
                if article and not e.article:
                    e.article = 1
        if tag in ("td", "th"):
            say(" ")
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            k = page.find(">", close.end()) if close else -1
            at = end if k < 0 else k + 1
            if tag in BLOCK:
                current = None
            continue
        if slash and tag in ("svg", "path", "circle", "use", "g", "rect"):
            continue
        if tag in BLOCK:
            current = None
            block_at.append(len(stack))
        where.setdefault(tag, []).append(len(stack))
        elements.append(e)
        stack.append(len(elements) - 1)
    for b in out.blocks:
        b.text = " ".join("".join(b.parts).split())
        b.parts = []
        b.words = b.text.count(" ") + 1 + (0 if b.text.isascii() else len(_WIDE.findall(b.text)) // 2)
    # distances stay those of neighbours among the blocks kept, as an upper bound
    out.blocks = [b for b in out.blocks if b.text]
    return out


def extents(page: Page) -> tuple[list[int], list[int]]:
    """Numbers of the first and last block in each element; the first is above the last where there is none."""
    elements, n = page.elements, len(page.blocks)
    first, last = [n] * len(elements), [-1] * len(elements)
    for k, b in enumerate(page.blocks):
        first[b.element], last[b.element] = min(first[b.element], k), max(last[b.element], k)
    for e in range(len(elements) - 1, 0, -1):
        p = elements[e].parent
        first[p], last[p] = min(first[p], first[e]), max(last[p], last[e])
    return first, last


def has_above(elements: list[Element], e: int, above: int) -> bool:
    while e > above:
        e = elements[e].parent
    return e == above


def remarks(page: Page, first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Ranges of blocks that readers wrote: what follows a heading of comments under the same parent, up to a heading of its level
    or above; and siblings of one tag of which each has several blocks, the first of them short, and a line of a time or an answer."""
    elements, blocks, out = page.elements, page.blocks, []
    done = 0
    for k, b in enumerate(blocks):
        if k < done or len(b.text) > 60 or not (_REMARKS_HEAD if b.heading else _REMARKS_COUNT).match(b.text):
            continue
        e = b.container
        level = int(elements[e].tag[1]) if elements[e].tag in HEADINGS else 6
        if level == 1 or k == 0:
            continue
        while e and last[e] == k:  # alone in what is around it
            e = elements[e].parent
        stop = next((j for j in range(k + 1, last[e] + 1) if blocks[j].heading and elements[blocks[j].container].tag in HEADINGS and int(elements[blocks[j].container].tag[1]) <= level), last[e] + 1)
        out.append((k, stop))
        done = stop
    signs = [0]
    for b in blocks:
        signs.append(signs[-1] + (len(b.text) <= 80 and b.words <= 12 and _REMARK_LINE.search(b.text) is not None))
    if not signs[-1]:
        return out
    siblings: dict[tuple[int, str], list[int]] = {}
    for e in range(1, len(elements)):
        if last[e] > first[e] and elements[e].tag in ("li", "div", "article", "section", "dd"):
            siblings.setdefault((elements[e].parent, elements[e].tag), []).append(e)
    for items in siblings.values():
        if len(items) > 1 and all(signs[last[e] + 1] > signs[first[e]] and blocks[first[e]].words <= 12 and not blocks[first[e]].heading for e in items):
            out += [(first[e], last[e] + 1) for e in items]
    return out


def weigh(page: Page) -> float:
    """Sets ``mark`` and ``core`` of the blocks; returns how surely what is outside the core is no article, 0 to 1.

    The core is the element that most likely is the article: one for articles, or named so, that holds most unlinked words; of nested
    ones the innermost that still holds most. Marks of elements around the core say nothing of it. Without any such element
    the same holds of elements around the first h1 that hold half of the page, and of those beside which there is next to nothing.
    """
    elements, blocks = page.elements, page.blocks
    n = len(elements)
    mass, marked, h1 = [0.0] * n, [0.0] * n, -1
    for b in blocks:
        mass[b.element] += b.words * max(0.0, 1 - b.linked / len(b.text))
    own = mass[:]
    for e in range(n - 1, 0, -1):
        mass[elements[e].parent] += mass[e]
    for e in range(1, n):  # weightiest mark at or above the element
        marked[e] = max(marked[elements[e].parent], elements[e].mark)
    for b in blocks:
        k = b.element
        while k and elements[k].tag not in BLOCK:
            k = elements[k].parent
        if b.heading and elements[k].tag == "h1":
            h1 = k
            break
    free = sum(own[e] for e in range(n) if marked[e] < STRONG)

    def core_of(kind: int) -> int:
        found = [e for e in range(1, n) if elements[e].article == kind and mass[e] > 0 and elements[e].mark < STRONG]
        clear = [e for e in found if marked[e] < STRONG]
        if clear and (kind == 2 or max(mass[e] for e in clear) >= 0.25 * free):
            found = clear
        elif clear or free >= 10:  # one in a marked element only where next to nothing stands elsewhere
            return 0
        if not found:
            return 0
        best = max(found, key=lambda e: (mass[e], -e))
        return max((e for e in found if mass[e] >= 0.6 * mass[best]), key=lambda e: (elements[e].depth, mass[e], -e))

    first, last = extents(page)
    core = core_of(2) or core_of(1)
    for e in page.headers:  # a header is the article's if it is short, holds the first h1, unlinked, and stands in the core, or without one in what holds most of the page
        own_h1 = first[e] <= last[e] and h1 > 0 and any(b.container == h1 and not b.linked for b in blocks[first[e] : min(last[e], first[e] + 7) + 1])
        within = has_above(elements, e, core) if core else 2 * (mass[elements[e].parent] - mass[e]) >= mass[0] - mass[e] > 0
        if not (own_h1 and within and last[e] - first[e] < 8):
            elements[e].mark = STRONG
    done = 0
    for a, b in sorted(remarks(page, first, last)):  # ranges may lie in one another
        for k in range(max(a, done), b):
            blocks[k].remark = True
        done = max(done, b)
    around: set[int] = set()
    if core:
        k = core
        while k:
            around.add(k)
            k = elements[k].parent
    elif h1 > 0:
        k = h1
        while k:
            if 2 * mass[k] >= mass[0]:
                around.add(k)
            k = elements[k].parent
    if not core and all(e.article < 2 for e in elements):  # an empty article is one, too
        around |= {e for e in range(1, n) if elements[e].mark and elements[e].tag != "form" and mass[e] >= max(30.0, 0.5 * mass[0]) and free < 30 and 10 * free < mass[e]}
    inside, sees = [False] * n, [0.0] * n
    for e in range(1, n):
        p = elements[e].parent
        inside[e] = inside[p] or e == core
        sees[e] = max(sees[p], 0.0 if e in around else elements[e].mark)
    for b in blocks:
        b.mark, b.core = STRONG + 2.0 if b.remark else sees[b.element], inside[b.element]
    if not core:
        return 0.0
    held = sum(own[e] for e in range(n) if inside[e] and sees[e] < STRONG)
    rest = sum(own[e] for e in range(n) if not inside[e] and sees[e] < STRONG)
    sure = max(0.0, 2 * held / (held + rest) - 1) if held + rest else 0.0
    return max(sure, 0.5) if elements[core].article == 2 and held else sure


def costs(b: Block, sure: float, has_core: bool, again: int, controls: int) -> float:
    """Cost of calling a block boilerplate less that of calling it content."""
    dense = min(1.0, b.linked / max(1, len(b.text)))
    score = 0.4 + min(2.0, 0.5 * math.log1p(b.words)) - (2.5 if b.core else 4.5) * max(0.0, dense - 0.2) / 0.8
    if b.text[-1] in ".!?:;…\"'”’»)。！？」":
        score += 0.5
    if b.heading:
        score += 1.0
    if b.words < 8 and again > 2:
        score -= 1.5
    if controls and not b.core:
        score -= 1.5
    if len(b.text) < 120 and _SHORT.match(b.text):
        score -= 4.0
    if b.core:
        score += 2.0
    elif has_core:
        score -= 8.0 * sure
    return score - b.mark


def smoothness(apart: int) -> float:
    """Capacity of the edge of two blocks, by their distance in the tree."""
    return 1.2 / (1 + 0.5 * max(0, apart - 2))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the side of the source. Capacities from the source, to the sink, and both ways between nodes."""
    n = len(source)
    keep = list(range(n))
    gain = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    # a node whose own gain outweighs all its edges keeps its side in every minimum cut: settle it, and hand its edges to its neighbours
    todo = deque(keep)
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, c in near[i].items():
                if label[j] is None:
                    gain[j] += c if label[i] else -c
                    del near[j][i]
                    todo.append(j)
            near[i] = {}
    left = [i for i in keep if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    # blocking flows on what is left: nodes 0.. are blocks, s and t the terminals
    index = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(len(left) + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in left:
        if gain[i] > 0:
            edge(s, index[i], gain[i], 0.0)
        elif gain[i] < 0:
            edge(index[i], t, -gain[i], 0.0)
        for j, c in near[i].items():
            if i < j:
                edge(index[i], index[j], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * len(graph)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        at = [0] * len(graph)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(graph[a]):
                path.append(graph[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break
    for i in left:
        label[i] = level[index[i]] >= 0
    return [bool(x) for x in label]


def main_text(source: str | None) -> str:
    """The text of the blocks labelled content, joined by blank lines; empty if there is none."""
    if not source:
        return ""
    page = parse(source)
    found = page.blocks
    if not found:
        return ""
    sure = weigh(page)
    has_core = any(b.core for b in found)
    again = Counter(b.text for b in found)
    score = [costs(b, sure, has_core, again[b.text], page.controls[b.container]) for b in found]
    edges = []
    before: dict[bool, int] = {}
    for i, b in enumerate(found):  # the block before, and the one before of the same kind where another kind stands between
        marked = b.mark >= STRONG
        if i and (found[i - 1].mark >= STRONG) != marked:
            edges.append((i - 1, i, 0.15 * smoothness(b.apart)))
        if marked in before and found[before[marked]].core == b.core:
            edges.append((before[marked], i, smoothness(b.apart)))
        before[marked] = i
    last: dict[tuple[int, bool], int] = {}
    for i, b in enumerate(found):  # the nearest earlier block under the same parent
        key = (page.elements[b.container].parent, b.mark >= STRONG)
        j = last.get(key)
        if j is not None and j != i - 1:
            edges.append((j, i, 0.6))
        last[key] = i
    content = minimum_cut([max(0.0, x) for x in score], [max(0.0, -x) for x in score], edges)
    return "\n\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html): the article of the whole page.

    Null and empty pages, and pages of boilerplate only, have an empty text. Nothing depends on other rows: repeated rows get
    equal results, and ids and urls may be null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
