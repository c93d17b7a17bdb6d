"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching into a template of slots."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .html_dom import BLOCK, Node, parse

#: Pages of a host that one wrapper is induced from; a host of twice as many gets several wrappers.
PAGES = 500
#: Pages with different articles that must have one text in a slot before it counts as the template's, and their share.
REPEATS, SHARE = 3, 0.6
#: Share of the varying text that an element needs for its role to decide, and that a slot needs to be gone down into.
ROLE, HEAVY = 0.5, 0.8
#: Elements that are no part of an article wherever they stand.
_OUT_TAGS = frozenset("head nav footer aside form button dialog menu label fieldset".split())
#: Whole class names, ids and roles that settle what alignment leaves open: small varying blocks among the article's.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation breadcrumb breadcrumbs "
    "masthead topbar sidebar widget cookie cookies cookie-notice consent gdpr notice popup modal newsletter subscribe share sharing social related "
    "related-posts recommended recommendations comment comments commentlist disqus replies pagination pager toolbar contentinfo complementary hidden".split()
)
_MAIN_NAMES = frozenset("main articlebody article article-body article-content post post-content post-body entry entry-content content main-content story story-body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def is_out(node: Node) -> bool:
    """Is the node by its tag no part of an article? A header is the heading of an article only inside one."""
    if node.tag != "header":
        return node.tag in _OUT_TAGS or "hidden" in node.names.split()
    up = node.parent
    while up is not None and up.tag not in ("article", "main", "section", "div"):
        up = up.parent
    return up is None


def has(node: Node, tag: str) -> bool:
    return any(n.tag == tag or has(n, tag) for n in node.children())


def label(node: Node) -> str:
    """Tag and names; numbers in names are a page's own."""
    return f"{node.tag} {re.sub('[0-9]+', '#', node.names)}"


def role(tag: str, names: str) -> int:
    """0 to 2 for an article, a main part and one named so; 9 for others."""
    return 0 if tag == "article" else 1 if tag == "main" else 2 if set(names.split()) & _MAIN_NAMES and tag not in ("html", "body") else 9


class Slot:
    """A node of the template: label, slots below it in order, and what pages have had there."""

    __slots__ = ("label", "below", "texts", "pages", "out", "size")

    def __init__(self, label: str):
        self.label, self.below, self.texts, self.pages, self.out, self.size = label, [], Counter(), 0, False, 0


def folded(nodes: list[Node]) -> list[tuple[str, list[Node], list]]:
    """(label, nodes, what is below) of runs of neighbours with one label: repeated items are one slot."""
    out = []
    for name, run in groupby((n for n in nodes if n.tag not in ("br", "hr", "img", "meta", "link", "wbr")), key=label):
        run = list(run)
        out.append((name, run, folded([c for n in run for c in n.children()])))
    return out


def matching(page: list, slots: list[Slot], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered forests: the largest number of equal labels, and the pairs of roots that give it."""
    both = {p[0] for p in page} & {s.label for s in slots}  # others match nothing, however many a template has
    rows, columns = ([k for k, x in enumerate(labels) if x in both] for labels in ([p[0] for p in page], [s.label for s in slots]))
    page, slots = [page[k] for k in rows], [slots[k] for k in columns]
    n, m = len(page), len(slots)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up = best[i + 1], best[i]
        for j in range(m):
            w = max(row[j], up[j + 1])
            if page[i][0] == slots[j].label:
                key = (id(page[i]), id(slots[j]))
                if key not in memo:
                    memo[key] = 1 + matching(page[i][2], slots[j].below, memo)[0]
                w = max(w, up[j] + memo[key])
            row[j + 1] = w
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((rows[i], columns[j]))
    return best[n][m], pairs[::-1]


def own_text(nodes: list[Node]) -> str:
    return " ".join(" ".join(x for n in nodes for x in n.items if isinstance(x, str)).split())


class Wrapper:
    """The template of a group of pages, grown page by page."""

    def __init__(self):
        self.root = Slot("#root")

    def add(self, tree: Node) -> None:
        """Align a page and add what the template lacks."""
        self._add(folded(tree.children()), self.root, {}, False)

    def _add(self, page, slot, memo, out):
        _, pairs = matching(page, slot.below, memo)
        to = dict(pairs)
        at = 0
        for i, (name, nodes, below) in enumerate(page):
            if i in to:
                child = slot.below[to[i] + at]
            else:
                child = Slot(name)
                left = max((j for k, j in pairs if k < i), default=-1) + at + 1
                slot.below.insert(left, child)
                at += 1
            child.out = out or is_out(nodes[0])
            for n in nodes:
                n.slot = child
            self._add(below, child, memo, child.out)

    def note(self, tree: Node) -> None:
        """Note the texts of an aligned page; a page with the same article as another says nothing about the template."""
        by: dict[int, tuple[Slot, list[Node]]] = {}

        def walk(node):
            for n in node.children():
                if n.slot is not None:  # line breaks and images have none
                    by.setdefault(id(n.slot), (n.slot, []))[1].append(n)
                walk(n)

        walk(tree)
        for slot, nodes in by.values():
            text = own_text(nodes)
            slot.pages += 1
            slot.size += len(text)
            slot.texts[text] += 1

    def constant(self, slot: Slot) -> bool:
        """Have REPEATS different pages, and a share SHARE of those with this slot, one text there?"""
        if not slot.pages:
            return False
        return slot.texts.most_common(1)[0][1] >= max(REPEATS, SHARE * slot.pages)

    def weight(self, slot: Slot) -> int:
        """Varying text in a slot and below."""
        return 0 if slot.out else (0 if self.constant(slot) else slot.size) + sum(map(self.weight, slot.below))

    def content(self) -> Slot:
        """The slot of the article: down from the root while one slot below has most of the varying text.

        Tags and names decide between what is then possible: the best role among slots with a share ROLE of the varying text."""
        whole = self.weight(self.root)
        found: list[tuple[int, int, int, Slot]] = []

        def named(slot):
            if slot.out:
                return
            tag, _, names = slot.label.partition(" ")
            if role(tag, names) < 9 and (w := self.weight(slot)) >= ROLE * whole:
                found.append((role(tag, names), -w, len(found), slot))
            for s in slot.below:
                named(s)

        named(self.root)
        if found:
            return min(found)[3]
        slot = self.root
        while True:
            heavy = max(slot.below, key=self.weight, default=None)
            if heavy is None or not whole or self.weight(heavy) < HEAVY * self.weight(slot) or heavy.label.split(" ")[0] in ("p", *_HEADINGS):
                return slot
            slot = heavy

    def extract(self, tree: Node, content: Slot) -> str:
        """Blocks of the content slot of an aligned page, joined by newlines.

        Slots whose text the template repeats are left out, but for headings, unless they make up most of the page's content: then the page is a
        copy of others, and its text is its article all the same."""
        inside = self._nodes(tree, content) or self._own(tree) or [tree]
        dropped = [n for top in inside for n in self._template(top)]
        length = lambda nodes: sum(len(own_text([n])) + length(n.children()) for n in nodes)
        gone = {id(n) for n in dropped if n.tag not in _HEADINGS} if 2 * length(dropped) < length(inside) else set()
        blocks: list[list[str]] = [[]]

        def walk(node):
            for x in node.items:
                if isinstance(x, str):
                    blocks[-1].append(x)
                    continue
                block = x.tag in BLOCK
                if block:
                    blocks.append([])
                if not (is_out(x) or id(x) in gone or self.named_out(x)):
                    walk(x)
                if block:
                    blocks.append([])

        for top in inside:
            walk(top)
            blocks.append([])
        texts = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(t for t in texts if t)

    def named_out(self, node: Node) -> bool:
        """Is a block of small weight called something that is no part of an article? Never a heading, nor anything in a sentence."""
        if node.tag not in BLOCK or node.tag in ("p", "pre", "body", "html", *_HEADINGS) or not set(node.names.split()) & _OUT_NAMES or has(node, "h1"):
            return False
        return node.slot is None or 2 * self.weight(node.slot) < self.weight(self.root)

    def _nodes(self, tree: Node, slot: Slot) -> list[Node]:
        """The page's nodes of a slot."""
        if slot is self.root:
            return [tree]
        return [x for n in tree.children() for x in ([n] if n.slot is slot else self._nodes(n, slot))]

    def _own(self, tree: Node) -> list[Node]:
        """Nodes of the best role on a page that is unlike its host's others."""
        found: list[tuple[int, Node]] = []

        def named(node):
            for x in node.children():
                if not is_out(x):
                    if role(x.tag, x.names) < 9:
                        found.append((role(x.tag, x.names), x))
                    named(x)

        named(tree)
        best = min((f[0] for f in found), default=9)
        nodes, out = [x for rank, x in found if rank == best], []
        for x in nodes:
            up = x.parent
            while up is not None and not any(up is y for y in nodes):
                up = up.parent
            if up is None:
                out.append(x)
        return out

    def _template(self, node: Node) -> list[Node]:
        """The topmost nodes below with a text that the template repeats and nothing that varies."""
        out = []
        for x in node.children():
            if x.slot is not None and x.tag in BLOCK and not self._varies(x.slot) and self._repeats(x.slot):
                out.append(x)
            else:
                out += self._template(x)
        return out

    def _varies(self, slot: Slot) -> bool:
        return slot.size > 0 and not self.constant(slot) or any(map(self._varies, slot.below))

    def _repeats(self, slot: Slot) -> bool:
        return slot.size > 0 and self.constant(slot) or any(map(self._repeats, slot.below))


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host, by the wrapper that all of them induce.

    Pages are aligned one by one. From the aligned pages' varying text comes a first content slot; pages whose text there is the
    same are copies, of which one counts when the template's constant texts are told from those that vary."""
    trees = [parse(p or "") for p in pages]
    wrapper = Wrapper()
    for t in trees:
        wrapper.add(t)
    seen: set[str | None] = set()
    for p, t in zip(pages, trees, strict=True):
        if p not in seen:
            wrapper.note(t)
            seen.add(p)
    content, articles, once = wrapper.content(), set(), []
    for t in trees:
        text = "\n".join(own_text([n]) for top in wrapper._nodes(t, content) for n in _all(top))
        if text not in articles:
            articles.add(text)
            once.append(t)
    _clear(wrapper.root)
    for t in once:
        wrapper.note(t)
    content = wrapper.content()
    return [wrapper.extract(t, content) for t in trees]


def _all(node: Node):
    yield node
    for n in node.children():
        yield from _all(n)


def _clear(slot: Slot) -> None:
    slot.texts, slot.pages, slot.size = Counter(), 0, 0
    for s in slot.below:
        _clear(s)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars.

    Pages of a host are aligned by simple tree matching into a template. The content slot holds most of the text that varies
    between pages; of several that could, tag and names choose. Inside it, blocks whose text is the same on most pages with
    different articles are the template's and go; so do elements that are no part of an article (menus, footers, asides,
    forms), and small blocks named as adverts, notices or comments, which vary from page to page as an article does. A page
    most of whose content repeats is a copy and keeps its text. Each wrapper comes from PAGES to 2 * PAGES pages of a host, or
    all; larger hosts are dealt by a hash of the page.
    Defined results: null or empty html gives empty text; pages with a null url or without a host are one host; repeated
    rows give equal rows; an empty table gives no rows; other columns are ignored. A line break ends a block, as it does on
    the screen."""
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    d = d.withColumn("host", host)
    groups = d.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > PAGES).select("host", F.ceil(F.col("n") / PAGES).cast("int").alias("groups"))
    groups = materialize(groups, "hosts")  # written, so its size is known when the join is planned: no hint to broadcast
    d = d.join(groups, "host", "left")
    d = d.withColumn("group", F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("groups"))).cast("int"))

    def packed(batches):
        for b in batches:
            html = [None if h is None else zlib.compress(h.encode(), 1) for h in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(html, pa.binary())], names=["host", "group", "page_id", "url", "html"])

    # Pages cross the exchange compressed: markup as text takes more than twice the room of its Parquet file.
    d = d.select("host", "group", F.col("page_id").cast("string"), "url", "html")  # pandas has no null among integers
    d = d.mapInArrow(packed, "host string, group int, page_id string, url string, html binary")
    d = d.repartition("host", "group").sortWithinPartitions("host", "group", "page_id")

    def run(frames):
        held: list = []
        for f in frames:
            for key, part in f.groupby(["host", "group"], sort=False, dropna=False):
                if held and held[0] != key:
                    yield told(held[1])
                    held = []
                f = pd.concat([held[1], part]) if held else part
                while len(f) >= 2 * PAGES:
                    yield told(f[:PAGES])
                    f = f[PAGES:]
                held = [key, f]
        if held:
            yield told(held[1])

    def told(f):
        texts = extract_group([zlib.decompress(h).decode() if h is not None else None for h in f["html"]])
        return pd.DataFrame({"page_id": f["page_id"].to_numpy(), "url": f["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return d.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
