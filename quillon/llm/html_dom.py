"""A small tolerant HTML parser: tags, classes and text, with implied end tags."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Levels of elements that a tree keeps.
DEPTH = 150
RAW = "script|style|noscript|template|iframe|textarea|svg|object|canvas|select|title"
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element in the first set ends when one of the second begins, up to an element of the third.
_ENDS = [
    (frozenset(["p"]), BLOCK - frozenset(["br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"]), frozenset("article aside body button div footer header main nav section td th table li blockquote".split())),
    (frozenset(["li"]), frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", "tbody"]), frozenset(["table"])),
    (frozenset(["tr"]), frozenset(["tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    (frozenset(["option"]), frozenset(["option"]), frozenset(["select"])),
    (frozenset(["head"]), frozenset(["body"]), frozenset()),
]
_STARTS = {tag: [(ends, stop) for ends, starts, stop in _ENDS if tag in starts] for tag in {t for _, s, _ in _ENDS for t in s}}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-hidden|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\bhidden\b""", re.I)


class Node:
    __slots__ = ("tag", "names", "parent", "items", "slot", "depth")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent, self.items, self.slot = tag, names, parent, [], None
        self.depth = parent.depth + 1 if parent is not None else 0

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def decode(text: str) -> str:
    """Character references to characters."""
    n = text.count("&")
    if not n:
        return text
    if text.count("&amp;") == n:
        return text.replace("&amp;", "&")
    return html.unescape(text)


def parse(source: str) -> Node:
    """The tree of elements; items of a node are nodes and text, in order. Raw elements and comments are left out.

    Elements nested deeper than DEPTH are put side by side, with their text in order."""
    root = top = Node("#root", "", None)
    at, flat = 0, 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            top.items.append(decode(source[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] and flat and tag not in VOID:
            flat -= 1
            if tag in BLOCK:
                top.items.append(Node("br", "", top))
            continue
        if m["end"]:
            node = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        for ends, stop in _STARTS.get(tag, ()):
            node = top
            while node.parent is not None and node.tag not in ends and node.tag not in stop:
                node = node.parent
            if node.tag in ends:
                top = node.parent
        attrs, names = m["attrs"], ""
        if attrs:
            found = []
            for a in _ATTR.finditer(attrs):
                name, value = (a[1] or "hidden").lower(), (a[2] or "").strip("\"'").lower()
                if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    found.append("hidden")
                elif name in ("class", "id", "role", "itemprop"):
                    found += value.split()
            names = " ".join(found)
        node = Node(tag, names, top)
        top.items.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            if top.depth < DEPTH:
                top = node
            else:
                flat += 1
    if at < len(source):
        top.items.append(decode(source[at:]))
    return root
