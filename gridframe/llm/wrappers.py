"""Main text of web pages by wrapper induction: pages of one host are aligned as trees, and what is the same in them is template."""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import pieces, small
from gridframe.session import cut_lineage

#: Levels of a tree whose labels make its layout.
LAYOUT = 3

#: A tag with its attributes, quoted or not, of up to TAG characters. No part of it is tried in two ways.
TAG = 1 << 16
WHOLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where a quote is not closed: the first bracket ends it.
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'>/]+)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: An element that the start of another closes, up to the nearest of the outer ones.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
#: Elements that never hold article text.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas nav aside form button select textarea footer menu dialog audio video".split())
#: Roles, and whole class and id names, of elements that don't belong to the article.
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist discussion respond disqus replies widget widgets toolbar pagination pager skip "
    "main-nav site-nav top-nav main-menu site-menu top-menu comment-list comments-area comments-section comment-respond related-posts related-articles share-buttons social-links social-share cookie-banner cookie-notice "
    "cookie-consent newsletter-signup ad-banner ad-container ad-slot ad-wrapper widget-area skip-link".split()
)
#: The same, but only outside the article.
OUTER = frozenset("header footer masthead topbar colophon copyright site-header site-footer".split())


#: Levels of a tree. What is nested deeper becomes a child of that level, so no text is lost.
DEEPEST = 300


class Node:
    __slots__ = ("tag", "label", "children", "out", "article")

    def __init__(self, tag: str, label: str, out: bool, article: bool):
        self.tag, self.label, self.out, self.article = tag, label, out, article
        self.children: list = []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else m[5].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _next(page: str, at: int, last: int) -> tuple[tuple[int, int], re.Match | None, int]:
    """The text from ``at`` on, the tag behind it (None for a comment or declaration) and the place behind that; -1 at the end. ``last`` is the last bracket."""
    look = at
    while True:
        start = page.find("<", look)
        if start < 0:
            return (at, len(page)), None, -1
        if page.startswith("<!--", start):
            end = page.find("-->", start)
            return (at, start), None, len(page) if end < 0 else end + 3
        if page.startswith(("<!", "<?"), start):
            return (at, start), None, page.find(">", start) + 1 or len(page)
        found = None if start > last else WHOLE.match(page, start, start + TAG) or BROKEN.match(page, start)
        if found is not None:
            return (at, start), found, found.end()
        look = start + 1


def parse(page: str | None) -> Node:
    """The tree of a page; tolerant of what is not closed. Each node knows whether it lies outside of any article text."""
    root = Node("", "", False, False)
    stack, at, page = [root], 0, page or ""
    last = page.rfind(">")
    while True:
        start, m, at = _next(page, at, last)
        if start[1] > start[0]:
            text = page[start[0] : start[1]]
            stack[-1].children.append(text)
        if at < 0:
            return root
        tag = m[2].lower() if m else ""
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag in ("td", "th", "button"):
                    break
        if tag in CLOSES:
            inner, outer = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in outer:
                    break
                if stack[i].tag in inner.split():
                    del stack[i:]
        above = stack[-1]
        inside = m[3]
        attrs = _attributes(inside) if inside and not inside.isspace() else {}
        names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower()
        parts = set(names.split())
        whole = tag in ("html", "body", "article", "main")
        role = attrs.get("role", "").lower()
        article = above.article or tag in ("article", "main") or role in ("main", "article")
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None
        out = above.out or tag in DROPPED or role in ROLES or hidden or not whole and not parts.isdisjoint(NAMES)
        out = out or not above.article and (tag == "header" or not parts.isdisjoint(OUTER)) and not whole
        node = Node(tag, f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '', names).split()))}", out, article)
        above.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|$", re.I).search(page, at)
            if not out and tag in ("xmp",):
                node.children.append(page[at : end.start()])
            at = end.end()
        elif tag not in VOID and not inside.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)


def blocks(root: Node) -> list[tuple[str, int, bool]]:
    """(text, place, in an article) of the blocks that may be article text, in page order.

    A block is what stands between the edges of block elements; its place is a hash of the labels from the root. Line breaks and cells are
    white space within a block.
    """
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []

    def flush(place: int, article: bool) -> None:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, place, article))

    def walk(node: Node, place: int) -> None:
        place = zlib.crc32(node.label.encode(), place)
        for child in node.children:
            if isinstance(child, str):
                held.append(child)
            elif child.out:
                if child.tag in BLOCK:
                    flush(place, node.article)
            elif child.tag in BLOCK:
                flush(place, node.article)
                walk(child, place)
                flush(zlib.crc32(child.label.encode(), place), child.article)
            elif child.tag in ("br", "td", "th"):
                held.append(" ")
                walk(child, place)
                held.append(" ")
            else:
                walk(child, place)

    walk(root, 0)
    flush(0, False)
    return out


def _mark(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _key(place: int, mark: int) -> int:
    return (place & 0x7FFFFFFF) << 32 | mark


def outline(root: Node) -> list:
    """[label, hash of the own text, children] of a tree, for the alignment; parts that never hold article text are left out."""
    own = " ".join(references.unescape(" ".join(c for c in root.children if isinstance(c, str))).split())
    return [root.label, _mark(own) if own else 0, [outline(c) for c in root.children if not isinstance(c, str) and not c.out]]


#: Pairs of nodes in a gap between equal subtrees beyond which equal texts under equal labels count as the same besides.
GAP = 10_000
#: Sizes of alignments that a task keeps, and weights of children that one table keeps; what is dropped is worked out again.
KNOWN = 1 << 20
#: Parts into which the rows of a table are cut, so that a way through it is found without keeping it whole.
PARTS = 32


class Signed:
    """A node of an outline with a hash of its whole subtree, one of its labels alone, and its number of nodes."""

    __slots__ = ("node", "sign", "shape", "size", "children")

    def __init__(self, node: list):
        self.node, self.children = node, [Signed(c) for c in node[2]]
        self.sign = hash((node[0], node[1], *[c.sign for c in self.children]))
        self.shape = hash((node[0], *[c.shape for c in self.children]))
        self.size = 1 + sum(c.size for c in self.children)

    def all(self) -> list[list]:
        found, waiting = [], [self]
        while waiting:
            at = waiting.pop()
            found.append(at.node)
            waiting += reversed(at.children)
        return found


def match(a: list, b: list) -> list[tuple[list, list]]:
    """Simple tree matching (Yang, 1991): pairs of nodes of the largest alignment that keeps labels, levels and order, for trees of any size.

    Equal subtrees at either end of two lists of children are paired at once, which loses nothing. What is left between them is aligned by the table
    of all pairs, which holds sizes only: these follow from the labels, so each pair of shapes is worked out once. Rows of the table are numpy vectors,
    of which a few are kept at a time, so memory grows with the longer list, not with the product.
    """
    return _pairs(Signed(a), Signed(b), {})


def same_text(a: Signed, b: Signed, known: dict | None = None) -> set[int]:
    """Nodes of one tree (by ``id``) whose text is the same in another: those aligned with such a node and, in a gap of more than GAP pairs, all
    whose labels and text stand in the gap's other side. ``known`` keeps sizes of alignments from call to call."""
    gaps: list[tuple[list[Signed], list[Signed]]] = []
    found = {id(x) for x, y in _pairs(a, b, {} if known is None else known, gaps) if x[1] and x[1] == y[1]}
    for x, y in gaps:
        there = {path for _, path in _paths(y)}
        found |= {id(n) for n, path in _paths(x) if path in there}
    return found


def _paths(nodes: list[Signed]) -> Iterator[tuple[list, int]]:
    """Nodes with a text of their own, each with a hash of it and of the labels that lead to it."""
    waiting = [(n.node, 0) for n in nodes]
    while waiting:
        node, above = waiting.pop()
        here = hash((above, node[0]))
        if node[1]:
            yield node, hash((here, node[1]))
        waiting += [(child, here) for child in node[2]]


def _pairs(a: Signed, b: Signed, known: dict, gaps: list | None = None) -> list[tuple[list, list]]:
    """Pairs of two trees; the outermost gaps of more than GAP pairs are added to ``gaps``."""
    out, waiting = [], [(a, b, gaps)]
    while waiting:
        a, b, gaps = waiting.pop()
        if a.node[0] != b.node[0]:
            continue
        if a.sign == b.sign and a.size == b.size:
            out += zip(a.all(), b.all(), strict=True)
            continue
        out.append((a.node, b.node))
        waiting += reversed(_aligned(a.children, b.children, known, gaps))
    return out


def _ends(x: list[Signed], y: list[Signed], hashed: str) -> tuple[int, int]:
    """How many subtrees at the start and at the end of two lists have one hash."""
    x, y = ([(getattr(n, hashed), n.size) for n in side] for side in (x, y))
    start = end = 0
    least = min(len(x), len(y))
    while start < least and x[start] == y[start]:
        start += 1
    while end < least - start and x[-1 - end] == y[-1 - end]:
        end += 1
    return start, end


def _aligned(x: list[Signed], y: list[Signed], known: dict, gaps: list | None) -> list[tuple[Signed, Signed, list | None]]:
    """Pairs of two lists of children, each with the list that its own gaps go to."""
    start, end = _ends(x, y, "sign")
    head, tail = zip(x[:start], y[:start], strict=True), zip(x[len(x) - end :], y[len(y) - end :], strict=True)
    x, y = x[start : len(x) - end], y[start : len(y) - end]
    inner = gaps if len(x) == len(y) == 1 else None
    if gaps is not None and inner is None and sum(n.size for n in x) * sum(n.size for n in y) > GAP:
        gaps.append((x, y))
    return [(a, b, None) for a, b in head] + [(x[i], y[j], inner) for i, j in _way(x, y, known)] + [(a, b, None) for a, b in tail]


def _weight(a: Signed, b: Signed, known: dict) -> int:
    """Number of pairs of the largest alignment of two trees."""
    if a.node[0] != b.node[0]:
        return 0
    if a.shape == b.shape and a.size == b.size:
        return a.size
    if not a.children or not b.children:
        return 1
    key = (a.shape, b.shape)
    n = known.get(key)
    if n is None:
        start, end = _ends(a.children, b.children, "shape")
        x, y = a.children[start : len(a.children) - end], b.children[start : len(b.children) - end]
        n = 1 + sum(c.size for c in a.children[:start]) + sum(c.size for c in a.children[len(a.children) - end :])
        if len(x) == len(y) == 1:
            n += _weight(x[0], y[0], known)
        elif x and y:
            table = Table(x, y, known)
            best = table.first()
            for i in range(len(x)):
                best = table.below(best, i)
            n += int(best[-1])
        if len(known) >= KNOWN:
            known.clear()
        known[key] = n
    return n


class Table:
    """The table of simple tree matching of two lists of children, by rows. Row i holds, for each j, the weight of the first i against the first j."""

    def __init__(self, x: list[Signed], y: list[Signed], known: dict):
        self.x, self.known, self.kept = x, known, {}
        kinds: dict[int, int] = {}
        self.kind = np.array([kinds.setdefault(n.shape, len(kinds)) for n in y])
        self.samples = list({n.shape: n for n in y}.values())

    def weights(self, i: int) -> np.ndarray:
        """Of child i against each shape in the other list."""
        one = self.x[i]
        found = self.kept.get(one.shape)
        if found is None:
            found = np.array([_weight(one, n, self.known) for n in self.samples], np.int32)
            if (len(self.kept) + 1) * len(found) <= KNOWN:
                self.kept[one.shape] = found
        return found

    def first(self) -> np.ndarray:
        return np.zeros(len(self.kind) + 1, np.int32)

    def below(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i + 1, given row i or the left part of it."""
        out = row.copy()
        np.maximum(row[1:], row[:-1] + self.weights(i)[self.kind[: len(row) - 1]], out=out[1:])
        return np.maximum.accumulate(out, out=out)

    def way(self, row: np.ndarray, i: int, to: int, j: int, found: list[tuple[int, int]]) -> int:
        """Adds the pairs on the best way back from (``to``, j) to row i, given that row; returns the column it ends in."""
        step = -(-(to - i) // PARTS)
        marks, last = [row[: j + 1]], row[: j + 1]
        for k in range(i, to):
            last = self.below(last, k)
            if (k + 1 - i) % step == 0:
                marks.append(last)
        if step > 1:
            for at in reversed(range(i, to, step)):
                if j:
                    j = self.way(marks[(at - i) // step], at, min(at + step, to), j, found)
            return j
        while to > i and j:
            here, above = marks[to - i], marks[to - i - 1]
            weight = int(self.weights(to - 1)[self.kind[j - 1]])
            if weight and here[j] == above[j - 1] + weight:
                to, j = to - 1, j - 1
                found.append((to, j))
            elif here[j] == above[j]:
                to -= 1
            else:
                j -= 1
        return j


def _way(x: list[Signed], y: list[Signed], known: dict) -> list[tuple[int, int]]:
    """Numbers of the children that the largest alignment pairs. Of several such alignments, it is the one that pairs the last children it can."""
    # Subtrees of one shape at the end are paired by any best way back.
    end = 0
    while end < min(len(x), len(y)) and x[-1 - end].shape == y[-1 - end].shape and x[-1 - end].size == y[-1 - end].size:
        end += 1
    found = [(len(x) - k, len(y) - k) for k in range(1, end + 1)]
    x, y = x[: len(x) - end], y[: len(y) - end]
    if len(x) == len(y) == 1:
        found += [(0, 0)] * (x[0].node[0] == y[0].node[0])
    elif x and y:
        table = Table(x, y, known)
        table.way(table.first(), 0, len(x), len(y), found)
    return found[::-1]


def keys_of(tree: list, kept: set[int]) -> list[tuple[int, int]]:
    """(number in page order, hash of place and text) of the nodes of a tree that are in ``kept`` (by ``id``)."""
    out, waiting, number = [], [(tree, 0)], 0
    while waiting:
        node, place = waiting.pop()
        tag = node[0].split(".", 1)[0]
        here = zlib.crc32(node[0].encode(), place) if tag in BLOCK or not tag else place
        if id(node) in kept:
            out.append((number, _key(here, node[1])))
        number += 1
        waiting += [(child, here) for child in reversed(node[2])]
    return out


def layout(tree: list) -> int:
    """Hash of the labels of a tree's first levels, whatever their number and order."""
    labels, level = [], [tree]
    for depth in range(LAYOUT):
        level = [child for node in level for child in node[2]]
        labels += sorted({f"{depth} {node[0]}" for node in level})
    return _mark("\n".join(labels))


def text_of(page: str | None, template: frozenset[int]) -> str:
    """The main text, given the template of the page's host: all blocks that are not template. Where a page marks an article that
    holds at least half of this text, it is the blocks of the article among them."""
    found = [(text, article) for text, place, article in blocks(parse(page)) if _key(place, _mark(text)) not in template]
    marked = sum(len(text) for text, article in found if article)
    trusted = marked and 2 * marked >= sum(len(text) for text, _ in found)
    return "\n".join(text for text, article in found if article or not trusted)


OUTLINES = "host string, layout long, tree binary, page long, places array<long>, keys array<long>"


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its layout, its packed tree, and its places, each alone and with its texts (``keys``). Pages with the same blocks have one hash (``page``)."""
    from xxhash import xxh64_intdigest

    for batch in pieces(batches, 1):
        layouts, trees, hashes, places, keys = [], [], [], [], []
        for page in batch.column(1).to_pylist():
            root = parse(page)
            tree, found = outline(root), blocks(root)
            layouts.append(layout(tree))
            trees.append(zlib.compress(json.dumps(tree, separators=(",", ":")).encode()))
            own = {(place, None) for _, place, _ in found} | {(place, _key(place, _mark(text))) for text, place, _ in found}
            hashes.append(xxh64_intdigest("\n".join(text for text, _, _ in found).encode("utf-8", "replace")))
            places.append([place for place, _ in own])
            keys.append([key for _, key in own])
        longs = pa.list_(pa.int64())
        columns = [batch.column(0), pa.array(layouts, pa.int64()), pa.array(trees, pa.binary()), pa.array(hashes, pa.uint64()).view(pa.int64()), pa.array(places, longs), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "tree", "page", "places", "keys"])


def _constant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of trees of one host and layout, all aligned with one of them, the nodes of that one with the same text in the whole run.
    A run is a row without a node besides; copies alone are none."""
    unpack = lambda tree: Signed(json.loads(zlib.decompress(tree)))
    group = first = kept = before = None
    known: dict = {}

    def found() -> Iterator[pa.RecordBatch]:
        if kept is not None:
            nodes = [(None, None), *keys_of(first.node, kept)]
            host, layout = group
            columns = [pa.array([host] * len(nodes), pa.string()), pa.array([layout] * len(nodes), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*nodes, strict=True))], ["host", "layout", "node", "key"])

    for batch in batches:
        for host, layout, tree, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, layout) != group:
                yield from found()
                group, first, kept, before = (host, layout), unpack(one), None, one
            if tree != before and (kept is None or kept):
                same = same_text(first, unpack(tree), known) if tree != one else None
                kept = kept if same is None else same if kept is None else kept & same
            before = tree
    yield from found()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        texts = [text_of(page, frozenset(template or ())) for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def host_of(url: Column) -> Column:
    """Host of an address in small letters, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page.

    All pages of a host are counted: what has the same text at the same place, in more than half of the distinct pages that have this
    place, is template. So are nodes with equal text in all pages of a layout, if they differ: each page is aligned by simple tree
    matching with one of them, that of the least hash. A page's blocks are kept if they are not template, inside a marked article too; menus, page headers, footers, sidebars,
    notices, adverts, forms, scripts and reader comments go by element, role and name, whether they vary or not. Where a page marks an
    article and at least half of what is kept lies in it, the rest goes. Character references are decoded, white space in a block becomes one
    space, blocks are joined by a line end. Nothing is cut off.
    Pages are aligned one by one wherever they lie and counts are pre-aggregated, so a frequent host is no burden. Templates go to every task if there are few; else they are joined by host. A host with one page, or with copies only, has no template. Pages without a host count as one host. A
    null html is empty, and empty pages have the empty text. Repeated rows come back as often as they went in. Other columns are not
    read. An empty table gives an empty one.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    several = rows.groupBy("host").agg(F.min(F.xxhash64("id")).alias("lo"), F.max(F.xxhash64("id")).alias("hi")).where("lo < hi").select("host")
    several, _ = small(several)
    known = rows.join(several, "host", "left_semi").select("host", "html")
    outlined = cut_lineage(known.mapInArrow(_outlines, OUTLINES))
    hashed = F.struct(F.xxhash64("tree").alias("h"), "tree")
    first = outlined.groupBy("host", "layout").agg(F.min(hashed).alias("one"), F.max(F.xxhash64("tree")).alias("hi")).where("one.h < hi").select("host", "layout", F.col("one.tree").alias("one"))
    first, _ = small(first)
    runs = outlined.select("host", "layout", "tree").join(first, ["host", "layout"]).select("host", "layout", "tree", "one").sortWithinPartitions("host", "layout", F.xxhash64("tree"))
    runs = cut_lineage(runs.mapInArrow(_constant, "host string, layout long, node long, key long").groupBy("host", "layout", "node", "key").agg(F.count(F.lit(1)).alias("n")))
    whole = runs.where("node IS NULL").select("host", "layout", F.col("n").alias("runs"))
    aligned = runs.where("node IS NOT NULL").join(whole, ["host", "layout"]).where("n = runs").select("host", "key")
    counts = outlined.select("host", "page", F.explode(F.arrays_zip("places", "keys")).alias("e")).select("host", "page", F.col("e.places").alias("place"), F.col("e.keys").alias("key"))
    counts = counts.distinct().groupBy("host", "place", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.where("n > 1"))
    pages_with = counts.where("key IS NULL").select("host", "place", F.col("n").alias("pages"))
    counted = counts.where("key IS NOT NULL").join(pages_with, ["host", "place"]).where("2 * n > pages").select("host", "key")
    templates, _ = small(aligned.unionByName(counted).groupBy("host").agg(F.collect_set("key").alias("template")))
    joined = rows.join(templates, "host", "left").select("id", "url", "html", "template")
    types = f"id {pages.schema[id].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string"
    out = joined.mapInArrow(_extract, types)
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
