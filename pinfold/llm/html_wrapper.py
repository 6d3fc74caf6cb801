"""Main text of web pages by wrapper induction.

Pages of one host and layout are aligned with two reference pages of their group by simple
tree matching: the largest order-preserving mapping of equal-labelled nodes, by dynamic
programming over the children of matched nodes; among equally large ones, the one with the
most equal nodes.  A block of a reference that nearly all distinct pages of the group share,
text included, is template; blocks that vary are content.  What markup already names (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) never counts
as content, and article elements bound it where there are any: all of them but comments and
teasers.

Every page is parsed and aligned once, where it lies.  Votes are counts per (group,
reference block) over distinct contents, so that repeated pages are one vote; an article
that would be template for the most part (``COPY``) is a copy, and is kept whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.runtime import BROADCAST_BYTES, arrow_map, broadcast_checked, materialise

#: A block is template from this share of the distinct pages of a host and layout on, two at least.
SHARE, LEAST_PAGES = 0.8, 2
#: An article is a copy of other pages if template would be more than this share of its characters.
COPY = 0.75
#: Cells of a table of the dynamic programme; larger ones are halved, with the same result.
CELLS = 1 << 20
#: Pairs of shapes that a reference remembers.
MOST_KNOWN = 100_000
#: Elements whose presence makes the layout of a page.
LAYOUT = r"(?i)<(article|aside|footer|header|main|nav)[ \t\r\n>]"
#: HTML vocabulary: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul caption option".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form iframe object embed svg canvas audio video button select textarea input label menu dialog datalist annotation annotation-xml applet map".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe signup login share sharing social sidebar breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar toolbar skip paywall byline-share".split()
)
#: Words that name furniture around an article; inside one only where links make up most of the text.
WEAK_WORDS = frozenset("related recommended recommendations search discussion tags widget widgets subscription".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
MAIN_WORDS = frozenset("content main article post entry story article-body articlebody post-content entry-content main-content story-body".split())
TEASERS = frozenset("card cards teaser teasers preview excerpt related recommended promo promoted sponsored".split())
CLOSED_BY = {
    **{t: frozenset(["p"]) for t in BLOCK - frozenset("body html option caption td th tr tbody thead tfoot li dt dd".split())},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"]),
}
#: Elements that an implied end never crosses.
SCOPE = frozenset("html body table ul ol dl div section article td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "label", "attrs", "kids", "inner", "digest", "shape", "size", "number", "core", "wanted")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids, self.number = tag, attrs, [], -1
        self.label, self.inner, self.digest, self.shape, self.size, self.core, self.wanted = tag, [], 0, 0, 1, False, True

    def get(self) -> dict[str, str]:
        return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTR.findall(self.attrs)} if self.attrs else {}


def parse(page: str) -> Node:
    """DOM tree of a page; kids are nodes or decoded strings.  Any input has a tree."""
    root = Node("#root")
    stack, opened = [root], Counter()

    def end_from(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        cdata, closing, tag, attrs = m.groups()
        if cdata:
            stack[-1].kids.append(cdata)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif opened[tag] > 0:
                end_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        closes = CLOSED_BY.get(tag)
        if closes and any(opened[c] > 0 for c in closes):
            k = len(stack) - 1
            while k > 0:
                if stack[k].tag in closes:
                    end_from(k)
                elif stack[k].tag in SCOPE:
                    break
                k -= 1
        node = Node(tag, attrs.strip())
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            if stop > at:
                node.kids.append(page[at:stop])
            at = page.find(">", stop) + 1 if close else end
            at = at or end
            continue
        stack.append(node)
        opened[tag] += 1
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Labels, sizes, shapes and digests of all nodes, leaves first.  A shape is the tree of
    labels; a digest has the texts as well."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        if node.attrs and ("class" in node.attrs or "role" in node.attrs):
            got = node.get()
            node.label = f"{node.tag}.{' '.join((got.get('class') or '').split())}.{got.get('role') or ''}"
        parts = [k.digest if isinstance(k, Node) else k.strip() for k in node.kids]
        node.digest = hash((node.label, *[p for p in parts if p != ""]))
        inner = node.inner = [k for k in node.kids if isinstance(k, Node)]
        node.shape = hash((node.label, *[k.shape for k in inner]))
        node.size = 1 + sum(k.size for k in inner)
        node.core = node.tag in ("article", "main") or any(k.core for k in inner)


def _inner(node: Node) -> list[Node]:
    return node.inner


def tree_match(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest mapping of two trees by simple tree matching.

    It depends on shapes alone, so ``memo`` knows it by pairs of shapes.
    """
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (x.shape, y.shape)
        if key not in memo:
            if x.label != y.label or x.shape == y.shape:
                memo[key] = x.size if x.label == y.label else 0
            elif todo := _unknown(x.inner, y.inner, memo):
                stack.extend(todo)
                continue
            else:
                memo[key] = 1 + int(Worth(x.inner, y.inner, memo).best()[-1])
        stack.pop()
    return memo[a.shape, b.shape]


def _unknown(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of children of equal labels and so far unknown shapes, one of each shape."""
    left, right = ({n.shape: n for n in nodes}.values() for nodes in (xs, ys))
    return [(x, y) for x in left for y in right if x.label == y.label and (x.shape, y.shape) not in memo]


#: Worth of a matched node; an equal one counts one more.
EQUAL = 1 << 31


class Worth:
    """What children of two nodes are worth to each other: the size of their mapping, and
    with ``equal`` their equal nodes where sizes tie."""

    def __init__(self, xs: list[Node], ys: list[Node], memo: dict, equal: bool = False) -> None:
        left, right = ({n.shape: n for n in nodes} for nodes in (xs, ys))
        table = [[memo[i, j] if x.label == y.label else 0 for j, y in right.items()] for i, x in left.items()]
        self.table = np.array(table, np.int64).reshape(len(left), len(right)) * (EQUAL if equal else 1)
        left, right = ({shape: k for k, shape in enumerate(side)} for side in (left, right))
        self.rows, self.columns = [left[n.shape] for n in xs], np.array([right[n.shape] for n in ys], np.int64)
        self.xs, self.digests, self.equal = xs, np.array([y.digest for y in ys], np.int64), equal

    def row(self, i: int, c: int, d: int) -> np.ndarray:
        worth = self.table[self.rows[i]][self.columns[c:d]]
        return worth + self.xs[i].size * (self.digests[c:d] == self.xs[i].digest) if self.equal else worth

    def best(self, a: int = 0, b: int | None = None, c: int = 0, d: int | None = None, back: bool = False) -> np.ndarray:
        """Best worth of children a to b with each beginning of c to d; ``back``: each end."""
        d = len(self.columns) if d is None else d
        row = np.zeros(d - c + 1, np.int64)
        some = range(a, len(self.xs) if b is None else b)
        for i in reversed(some) if back else some:
            worth = self.row(i, c, d)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (worth[::-1] if back else worth)))
        return row[::-1] if back else row

    def walk(self, a: int, b: int, c: int, d: int) -> Iterator[tuple[int, int]]:
        """Pairs of the best matching, from its whole table."""
        table = np.zeros((b - a + 1, d - c + 1), np.int64)
        for i in range(b - a):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + self.row(a + i, c, d)))
        table, i, j = table.tolist(), b - a, d - c
        while i and j:
            if table[i][j] == table[i][j - 1]:
                j -= 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                yield a + i, c + j


def _pairs(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of the best matching of two lists of children, in linear space."""
    head, n = 0, min(len(xs), len(ys))
    # equal ends are worth the most that either side can be
    while head < n and xs[head].digest == ys[head].digest:
        head += 1
    tail = 0
    while tail < n - head and xs[-1 - tail].digest == ys[-1 - tail].digest:
        tail += 1
    out = [*zip(xs[:head], ys[:head]), *zip(xs[len(xs) - tail :], ys[len(ys) - tail :])]
    xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
    if not xs or not ys:
        return out
    for x, y in _unknown(xs, ys, memo):
        tree_match(x, y, memo)
    worth = Worth(xs, ys, memo, True)
    stack = [(0, len(xs), 0, len(ys))]
    while stack:
        a, b, c, d = stack.pop()
        if b - a < 2 or (b - a) * (d - c) <= CELLS:
            out.extend((xs[i], ys[j]) for i, j in worth.walk(a, b, c, d))
            continue
        middle = (a + b) // 2
        cut = c + int(np.argmax(worth.best(a, middle, c, d) + worth.best(middle, b, c, d, back=True)))
        stack += [(a, middle, c, cut), (middle, b, cut, d)]
    return out


def mapping(a: Node, b: Node, memo: dict | None = None) -> dict[int, Node]:
    """id of each node of ``a`` that is matched, to its node of ``b``; below nodes of ``b``
    that are not ``wanted`` nothing is looked for."""
    out: dict[int, Node] = {}
    memo = {} if memo is None else memo
    stack = [(a, b)] if a.label == b.label else []
    while stack:
        x, y = stack.pop()
        out[id(x)] = y
        if not (y.wanted and x.inner and y.inner):
            continue
        if x.digest == y.digest:
            stack.extend(zip(x.inner, y.inner))
        elif len(x.inner) == len(y.inner) == 1:
            stack.extend((i, j) for i, j in zip(x.inner, y.inner) if i.label == j.label)
        else:
            stack.extend(_pairs(x.inner, y.inner, memo))
    return out


def _dropped(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED and not (node.tag == "form" and node.core) or node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    got = node.get()
    if "hidden" in got or (got.get("aria-hidden") or "").lower() == "true" or "display:none" in (got.get("style") or "").replace(" ", "").lower():
        return True
    if (got.get("role") or "").lower() in DROPPED_ROLES:
        return True
    if node.tag in ("html", "body", "main", "article"):
        return node.tag == "article" and bool(set((got.get("class") or "").lower().split()) & COMMENTS)
    names = _names(got)
    # what wraps the article is layout, whatever its class says
    if names & COMMENTS or not node.core and names & DROPPED_WORDS:
        return True
    return not node.core and bool(names & WEAK_WORDS) and (not in_article or _is_links(node))


def _is_links(node: Node) -> bool:
    """Whether half of the characters below a node stand in links."""
    total = linked = 0
    stack: list = [(node, False)]
    while stack:
        item, inside = stack.pop()
        if isinstance(item, str):
            n = len(item.strip())
            total, linked = total + n, linked + n * inside
        elif item.tag not in DROPPED:
            stack.extend((k, inside or item.tag == "a") for k in item.kids)
    return 2 * linked >= total


def _names(got: dict) -> set[str]:
    names = f"{got.get('class') or ''} {got.get('id') or ''}".lower()
    return set(WORDS.findall(names)) | set(names.split())


def _blocks_of(top: Node, in_article: bool) -> list[tuple[Node, str]]:
    """Blocks below a node in page order: the element that holds the text, and the text."""
    out: list[tuple[Node, str]] = []
    holder, run = top, []

    def flush() -> None:
        nonlocal run
        text = " ".join("".join(run).split())
        if text:
            out.append((holder, text))
        run = []

    # entries: (node or string, enclosing block, whether inside an article); None ends a block
    stack: list = [(k, top, in_article) for k in reversed(top.kids)]
    while stack:
        item, block, inside = stack.pop()
        if item is None:
            flush()
            holder = block
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif not _dropped(item, inside):
            deeper = inside or item.tag == "article"
            if item.tag in BLOCK:
                flush()
                holder = item
                stack.append((None, block, inside))
                stack.extend((k, item, deeper) for k in reversed(item.kids))
            else:
                stack.extend((k, block, deeper) for k in reversed(item.kids))
    flush()
    return out


def _regions(root: Node) -> tuple[list[Node], bool]:
    """The elements that bound the content, in page order, and whether markup names them."""
    found: dict[int, list[Node]] = {0: [], 1: [], 2: []}
    # entries: node, and the levels of the candidates around it, which it belongs to
    stack: list[tuple[Node, frozenset[int]]] = [(root, frozenset())]
    while stack:
        node, around = stack.pop()
        level = _level(node)
        if level is not None and level not in around:
            found[level].append(node)
            around |= {level}
        if level != 0:
            stack.extend((k, around) for k in reversed(node.kids) if isinstance(k, Node) and not _dropped(k, False))
    only_teasers = None
    for level in (0, 1, 2):
        filled = [n for n in found[level] if _blocks_of(n, True)]
        if whole := [n for n in filled if not _names(n.get()) & TEASERS]:
            return whole, level < 2
        only_teasers = only_teasers or (filled and (filled, level < 2))
    # teasers are content only where a page has nothing else
    return only_teasers or ([root], False)


def _level(node: Node) -> int | None:
    """0 for an article, 1 for a main element, 2 for a block with a main word, else None."""
    if node.tag == "article":
        return 0
    got = node.get()
    if node.tag == "main" or (got.get("role") or "") == "main" or (got.get("itemprop") or "").lower() == "articlebody":
        return 1
    return 2 if got and node.tag in BLOCK and _names(got) & MAIN_WORDS else None


def content_blocks(root: Node) -> tuple[list[tuple[Node, str]], bool]:
    """Blocks of the content in page order, and whether markup bounds it."""
    tops, named = _regions(root)
    return [block for top in tops for block in _blocks_of(top, named)], named


def number(root: Node) -> dict[int, str]:
    """Number the nodes that hold blocks; their number to their text.  What holds none of
    them is not ``wanted``."""
    texts: dict[int, str] = {}
    for k, (node, text) in enumerate(content_blocks(root)[0]):
        if node.number < 0:
            node.number = k
            texts[k] = text
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.inner)
    for node in reversed(order):
        node.wanted = node.number >= 0 or any(k.wanted for k in node.inner)
    return texts


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    kind = pa.list_(pa.struct([("text", pa.string()), ("same", pa.list_(pa.int64()))]))
    for batch in batches:
        made, digests, bounded = [], [], []
        for page, references in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
            root = parse(page or "")
            blocks, named = content_blocks(root)
            same: list[list[int]] = [[] for _ in blocks]
            for r, reference in enumerate(references or ()):
                if reference not in known:
                    if len(known) >= 256:
                        known.clear()
                    tree = parse(reference)
                    known[reference] = (tree, number(tree), {})
                tree, texts, memo = known[reference]
                if len(memo) > MOST_KNOWN:
                    memo.clear()
                match = mapping(root, tree, memo)
                for (node, text), found in zip(blocks, same):
                    other = match.get(id(node))
                    if other is not None and other.number >= 0 and texts[other.number] == text:
                        found.append((r << 40) + other.number)
            made.append([{"text": text, "same": found} for (_, text), found in zip(blocks, same)])
            digests.append(xxhash.xxh3_64_intdigest("\n".join(text for _, text in blocks)) - (1 << 63))
            bounded.append(named)
        columns = [*batch.columns[:2], *batch.columns[3:5], pa.array(digests, pa.int64()), pa.array(bounded, pa.bool_()), pa.array(made, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "layout", "digest", "named", "blocks"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    ``text`` joins the content blocks in page order by one newline; inside a block white
    space is one space.  It is empty for null, empty or contentless pages.  A null url, or
    one without a host, is aligned with nothing.  Repeated rows get equal rows and vote
    once; an empty table gives an empty result; other columns are ignored.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    layout = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LAYOUT), F.lit(1)), F.lower))), " ")
    group = ["host", "layout"]
    plain = plain.withColumn("host", host).withColumn("layout", layout)
    chosen = plain.where("host is not null and length(html) > 0").withColumn("h", F.xxhash64("html"))
    # least and greatest hash: two pages at random, the same in every run
    ends = chosen.groupBy(*group).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    ends = broadcast_checked(materialise(ends, "wrapper-ends"), *group)
    picked = chosen.join(ends, group).where("h = low or h = high").groupBy(*group, "h").agg(F.min("html").alias("html"))
    references = materialise(picked.groupBy(*group).agg(F.sort_array(F.collect_list("html")).alias("references")), "wrapper-references")
    paired = plain.join(_sized(references), group, "left").select("page_id", "url", "html", *group, "references")
    cut = materialise(
        paired.transform(arrow_map, _extract, "page_id long, url string, host string, layout string, digest long, named boolean, blocks array<struct<text: string, same: array<long>>>"), "wrapper-blocks"
    )
    refs = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["same"])))
    distinct = cut.where("host is not null and size(blocks) > 0").groupBy(*group, "digest").agg(F.first(refs).alias("refs"))
    distinct = materialise(distinct, "wrapper-votes")
    votes = distinct.select(*group, F.explode("refs").alias("ref")).groupBy(*group, "ref").agg(F.count("*").alias("n"))
    n_pages = distinct.groupBy(*group).agg(F.count("*").alias("pages"))
    template = votes.join(n_pages, group).where((F.col("n") >= share * F.col("pages")) & (F.col("n") >= least_pages))
    template = materialise(template.groupBy(*group).agg(F.collect_set("ref").alias("template")), "wrapper-template")
    out = cut.join(broadcast_checked(template, *group, "template"), group, "left")
    out = out.withColumn("varying", F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap("template", b["same"]), F.lit(False))))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    # what copies share is no furniture
    kept = F.when(F.col("named") & (chars("varying") < (1 - COPY) * chars("blocks")), F.col("blocks")).otherwise(F.col("varying"))
    out = out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _sized(references: DataFrame) -> DataFrame:
    """The references for broadcast, where their measured characters allow."""
    chars = F.aggregate("references", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    total = references.agg(F.coalesce(F.sum(chars), F.lit(0))).first()[0]
    return F.broadcast(references) if 2 * total <= BROADCAST_BYTES else references
