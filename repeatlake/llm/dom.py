"""A small, forgiving reader of HTML into a tree of elements and text.

It follows what browsers do where that matters for text: scripts and styles are
raw, void elements have no content, a new paragraph or list item closes the one
before, an end tag closes the nearest open element of its name, and what is left
open is closed at the end. The open elements stand on a stack, and of each name
the places where it is open are known, so nothing is searched for and work is
linear in the page's length, however deep it nests.
"""

from __future__ import annotations

import html
import re

#: Element names with a meaning of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption".split())
P_SCOPE = ("p", "td", "th", "table", "button", "object", "body")
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
PAIRS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=|\"|')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element: ``parts`` are its children and texts in page order."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)}


class Open:
    """The stack of open elements, with the places of each name and of all blocks on it."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> tuple[int, str]:
        """Where the innermost open element of one of ``tags`` stands (0 if there is none), and its name."""
        return max(((self.places[t][-1], t) for t in tags if self.places.get(t)), default=(0, ""))

    def close(self, place: int) -> None:
        """Ends the element at ``place`` and all inside it; each is taken off once."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def parse(page: str) -> Node:
    """The page's root; the text of raw elements is left out."""
    root = Node("#root", "")
    opened, at, end = Open(root), 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            opened.stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            opened.stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            place, _ = opened.last((tag,))
            # the end of an inline element closes no block
            if place and (tag in BLOCK or not opened.blocks or place > opened.blocks[-1]):
                opened.close(place)
            continue
        if tag in CLOSES_P:
            place, found = opened.last(P_SCOPE)
            if found == "p":
                opened.close(place)
        if tag in SAME:
            same = PAIRS.get(tag, (tag,))
            place, found = opened.last((*same, *SAME[tag]))
            if found in same:
                opened.close(place)
        node = Node(tag, m[3] or "")
        opened.stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            opened.push(node)
    return root


SPACE = re.compile(r"\s+")


def fold(text: str) -> str:
    """White space folded, trimmed."""
    return SPACE.sub(" ", text).strip()


def tidy(text: str) -> str:
    """Character references decoded, white space folded, trimmed."""
    return fold(html.unescape(text))
