"""Main text of web pages by wrapper induction.

Pages of one host are parsed to DOM trees, and in groups of ``GROUP`` pages at most each is aligned with a pattern page by simple tree
matching. Nodes whose text is the same on most pages of the group are the host's template; the slots that vary are content.
The article is the outermost ``article`` or ``main`` element, or, where a site has neither, the varying slot that holds most of the text over
the group. In it, parts that are never article text by their tag, role or name (menus, forms, adverts,
comments and the like) are left out, as are template nodes. A name counts if all its words say so, and, but for comments, only where the part
has no more than half of the page's text or is mostly links.

A host may have a third of all pages: its pages are dealt to as many groups as its number of pages needs. Texts that are the same
on copies of one page are no template: only pages with different titles count.

Defined results: a null or empty page has an empty text; text without markup is one block. A null address is a host of its own.
Repeated rows are pages of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import pick, staged

GROUP = 64
#: Share of the pages with different titles that must have the same text for it to be template, and their least number.
TEMPLATE_SHARE = 0.5
TEMPLATE_PAGES = 3
#: Hosts with their number of groups are broadcast up to this many (under 100 MB) and joined by shuffle beyond.
BROADCAST_HOSTS = 1_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements that hold no article text. A header inside an article keeps its headings.
DROPPED = set("script style noscript template iframe svg math object nav footer aside form button select option input label textarea dialog menu head title".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar note".split())
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb"
    " breadcrumbs footer masthead notice notices cookie cookies consent gdpr comment comments respond replies discussion disqus"
    " newsletter subscribe subscription signup login related recommended share sharing social popup modal overlay widget toolbar pagination pager hidden".split()
)
#: Words that may stand beside these in a name without changing what it says.
NEUTRAL = set(
    "site page container wrapper wrap inner outer box block area list section bar panel left right top bottom buttons button links link item items"
    " row col column module unit slot zone holder form icons thread small large".split()
)
#: Names of readers' comments, which may be longer than the article.
COMMENTS = set("comment comments respond replies discussion disqus".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Start tags that end an open paragraph.
BLOCKS = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SCOPES = set("table ul ol dl div article section main body aside nav header footer form td th blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*$", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "text", "size", "inner", "label", "shape", "height", "linked")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.text, self.size = "", 1
        self.inner, self.label, self.shape = [], (tag, attributes.get("class", "")), 0
        self.height, self.linked = 0, 0


def parse(source: str) -> Node:
    """A tree of elements and strings; open elements end where HTML lets them, or with the page."""
    root = Node("#page", {})
    stack, at = [root], 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            _add_text(stack[-1], source[at:])
            break
        _add_text(stack[-1], source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            _close(stack, name)
            continue
        if name in BLOCKS:
            _close_within(stack, {"p"}, SCOPES)
        if name in CLOSES:
            _close_within(stack, CLOSES[name], {"table", "ul", "ol", "dl", "select"} if name != "li" else {"ul", "ol", "menu"})
        node = Node(name, {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(m[3] or "")})
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if name == "textarea" or name == "title":
                _add_text(node, source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif name not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    _measure(root)
    return root


def _add_text(node: Node, text: str) -> None:
    if text:
        node.children.append(html.unescape(text))


def _close(stack: list[Node], name: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return


def _close_within(stack: list[Node], names: set[str], scope: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _measure(root: Node) -> None:
    """Text, characters of links, number of nodes, height and shape of every subtree, without recursion: pages may be nested deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        parts = []
        for c in node.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in DROPPED:
                parts.append(c.text if c.tag in INLINE else f" {c.text} ")
                node.size += c.size
            else:
                node.size += c.size
        node.text = _BLANK.sub(" ", "".join(parts)).strip(" ")
        node.inner = [c for c in node.children if isinstance(c, Node)]
        node.height = 1 + max((c.height for c in node.inner), default=0)
        node.linked = len(node.text) if node.tag == "a" else sum(c.linked for c in node.inner)
        node.shape = hash((node.label, *[c.shape for c in node.inner]))


def elements(node: Node) -> list[Node]:
    return node.inner


#: Children are aligned in numpy from so many pairs on, with the same result.
MANY_PAIRS = 1000
#: Python calls that a level of the trees may take.
CALLS = 6


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees, and its pairs."""
    # Calls of Python functions by each other take no stack but the heap's, so trees may be as deep as they like.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + CALLS * min(a.height, b.height)))
    sizes: dict[tuple[int, int], int] = {}
    size = _match_size(a, b, sizes)
    pairs, todo = [], [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo += zip(x.inner, y.inner, strict=True)
        elif x.inner and y.inner:
            todo += _aligned(x.inner, y.inner, sizes)
    return size, pairs


def _match_size(a: Node, b: Node, sizes: dict) -> int:
    if a.label != b.label:
        return 0
    # Trees of one shape match in full.
    if a.shape == b.shape:
        return a.size
    if not a.inner or not b.inner:
        return 1
    key = (a.shape, b.shape)
    if key not in sizes:
        # Children of one shape at either end match each other in some best match.
        first, last = 0, _same_end(a.inner, b.inner)
        n, m = len(a.inner) - last, len(b.inner) - last
        while first < min(n, m) and a.inner[first].shape == b.inner[first].shape:
            first += 1
        ends = sum(c.size for c in a.inner[:first]) + sum(c.size for c in a.inner[n:])
        sizes[key] = 1 + ends + _best(a.inner[first:n], b.inner[first:m], sizes)
    return sizes[key]


def _same_end(a: list[Node], b: list[Node]) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k].shape == b[-1 - k].shape:
        k += 1
    return k


def _best(a: list[Node], b: list[Node], sizes: dict) -> int:
    """Best sum of matches of two lists of children."""
    if len(a) * len(b) < MANY_PAIRS:
        return _align(a, b, sizes)[-1][-1]
    gain = _gains(a, b, sizes)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row = _next_row(row, gain(x))
    return int(row[-1])


def _aligned(a: list[Node], b: list[Node], sizes: dict) -> list[tuple[Node, Node]]:
    """Pairs of a best match of two lists of children, from the end; of equal matches the one furthest to the end."""
    last = _same_end(a, b)
    pairs = list(zip(a[::-1][:last], b[::-1][:last], strict=True))
    i, j = len(a) - last, len(b) - last
    if not i or not j:
        return pairs
    # Large tables are not held: every ``step``-th row is, and the rows between are computed again.
    large = i * j >= MANY_PAIRS
    step = math.isqrt(i) + 1 if large else i + 1
    if large:
        gain = _gains(a[:i], b[:j], sizes)
        held, row = [], np.zeros(j + 1, np.int64)
        for k in range(i):
            if k % step == 0:
                held.append(row)
            row = _next_row(row, gain(a[k]))
    while i and j:
        low = (i - 1) // step * step
        if large:
            best = [held[low // step]]
            for x in a[low:i]:
                best.append(_next_row(best[-1], gain(x)))
        else:
            best = _align(a[:i], b[:j], sizes)
        while i > low and j:
            c, d, above, row = a[i - 1], b[j - 1], best[i - 1 - low], best[i - low]
            if c.label == d.label and row[j] == above[j - 1] + _match_size(c, d, sizes):
                pairs.append((c, d))
                i, j = i - 1, j - 1
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return pairs


def _gains(a: list[Node], b: list[Node], sizes: dict):
    """A function from a node of ``a`` to the sizes of its matches with all of ``b``; nodes of one shape have the same."""
    number = {s: k for k, s in enumerate(dict.fromkeys(y.shape for y in b))}
    kinds = list({y.shape: y for y in b}.values())
    kind_of = np.array([number[y.shape] for y in b])
    made: dict[int, np.ndarray] = {}

    def gain(x: Node) -> np.ndarray:
        if x.shape not in made:
            made[x.shape] = np.array([_match_size(x, y, sizes) for y in kinds], np.int64)
        return made[x.shape][kind_of]

    return gain


def _next_row(above: np.ndarray, gain: np.ndarray) -> np.ndarray:
    row = above.copy()
    np.maximum(above[1:], above[:-1] + gain, out=row[1:])
    return np.maximum.accumulate(row, out=row)


def _align(a: list[Node], b: list[Node], sizes: dict) -> list[list[int]]:
    """Best sums of matches of the first i nodes of ``a`` and the first j of ``b``."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        above, row = best[-1], [0]
        for j, y in enumerate(b):
            across = above[j] + _match_size(x, y, sizes) if x.label == y.label else 0
            row.append(max(above[j + 1], row[j], across))
        best.append(row)
    return best


def _title(page: Node) -> str:
    for tag in ("title", "h1"):
        for node in _walk(page):
            if node.tag == tag:
                return _BLANK.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip() or node.text
    return page.text[:80]


def _walk(node: Node):
    todo = [node]
    while todo:
        here = todo.pop()
        yield here
        todo += reversed(elements(here))


def _named(node: Node) -> list[str]:
    """Words of names that say a part is no article; a name of other words as well says something else."""
    found = []
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower().split():
        words = re.findall(r"[a-z]+", name)
        if words and all(w in DROPPED_NAMES or w in NEUTRAL or w == "header" for w in words):
            found += [w for w in words if w in DROPPED_NAMES or w == "header"]
    return found


def _unwanted(node: Node, in_article: bool, whole: int) -> bool:
    """Whether a part holds no article text, by its element, or by its name unless it has most of the page's ``whole`` text."""
    a = node.attributes
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return True
    names = _named(node)
    if not names or names == ["header"] and in_article:
        return False
    length = len(node.text)
    return 2 * length <= whole or 2 * node.linked >= length or any(w in COMMENTS for w in names)


def template_of(pages: list[Node]) -> tuple[list[set[int]], list[Node | None]]:
    """For each page the nodes (by ``id``) that are template, and the slot with most varying text."""
    chosen, titles = [], set()
    for page in pages:
        title = _title(page)
        if title not in titles:
            titles.add(title)
            chosen.append(page)
    pattern = max(chosen, key=lambda p: p.size)
    aligned = [match_trees(pattern, page)[1] for page in pages]
    texts: dict[int, Counter] = {}
    counted = {id(page) for page in chosen}
    for page, pairs in zip(pages, aligned, strict=True):
        if id(page) in counted:
            for x, y in pairs:
                texts.setdefault(id(x), Counter())[y.text] += 1
    need = max(TEMPLATE_PAGES, TEMPLATE_SHARE * len(chosen))
    constant = {node: text for node, c in texts.items() for text, k in c.most_common(1) if text and k >= need}
    template = [{id(y) for x, y in pairs if constant.get(id(x)) == y.text} for pairs in aligned]
    # Direct text of the wanted parts, summed over pages: the slot with most of it is where articles stand.
    weight: Counter = Counter()
    for page, pairs, fixed in zip(pages, aligned, template, strict=True):
        length = len(page.text)
        for x, y in pairs:
            if id(y) not in fixed and y.tag not in INLINE and y.tag not in ("#page", "html", "body"):
                own = sum(len(c.text) for c in elements(y) if c.tag in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol"))
                weight[id(x)] += 0 if _unwanted(y, False, length) else own
    best = max(weight, key=weight.get) if weight and max(weight.values()) else None
    slots = [next((y for x, y in pairs if id(x) == best), None) for pairs in aligned]
    return template, slots


def _article(page: Node, slot: Node | None) -> Node:
    """The outermost article or main element with most text, else the slot, else the body."""
    for tag in ("article", "main"):
        found, todo = [], [page]
        while todo:
            node = todo.pop()
            if node.tag == tag or node.attributes.get("role") == tag:
                found.append(node)
            elif node is page or not _unwanted(node, False, len(page.text)):
                todo += elements(node)
        if found:
            return max(reversed(found), key=lambda n: len(n.text))
    if slot is not None and len(slot.text) * 2 >= len(page.text):
        return slot
    return next((n for n in _walk(page) if n.tag == "body"), page)


def article_text(page: Node, template: set[int], slot: Node | None) -> str:
    root = _article(page, slot)
    in_article, whole = root.tag in ("article", "main"), len(page.text)
    blocks, current = [], []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(current)).strip(" ")
        current.clear()
        if text:
            blocks.append(text)

    # Entries: a string, a node to open, or None at the end of a block.
    todo: list = [(c, False) for c in reversed(root.children)]
    while todo:
        item, headings_only = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if not headings_only:
                current.append(item)
        elif id(item) in template or _unwanted(item, in_article, whole):
            flush()
        else:
            heading = re.fullmatch("h[1-6]", item.tag) is not None
            inner = (headings_only or item.tag in ("header", "hgroup")) and not heading
            if item.tag not in INLINE:
                flush()
                todo.append((None, False))
            todo += [(c, inner) for c in reversed(item.children)]
    flush()
    return " ".join(blocks)


def _extract(key, table: pa.Table):
    sources = [s or "" for s in table.column("html").to_pylist()]
    pages = [parse(s) for s in sources]
    template, slots = template_of(pages)
    texts = [article_text(p, t, s) for p, t, s in zip(pages, template, slots, strict=True)]
    return pa.table(
        {
            "page_id": table.column("page_id"),
            "url": table.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }
    )


_extract.__annotations__.clear()


def main_texts(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = pick(pages, page_id="page_id", url="url", html="html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.withColumn("host", host)
    parts = staged(pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts")).withColumnRenamed("host", "h"), "hosts")
    if parts.count() <= BROADCAST_HOSTS:
        parts = F.broadcast(parts)
    dealt = pages.join(parts, F.col("host") == F.col("h")).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")))
    id_type = pages.schema["page_id"].dataType.simpleString()
    # Dealt by both, or all groups of a host would meet in one task.
    dealt = dealt.select("page_id", "url", "html", "host", "part").repartition("host", "part")
    return dealt.groupBy("host", "part").applyInArrow(
        _extract, f"page_id {id_type}, url string, text string, n_chars long"
    )
