"""A lenient reader of HTML: elements and texts as a tree.

Never fails: unknown end tags are ignored, what is open at the end is closed, a tag that the text cuts
off is dropped. Character references are decoded.
"""

from __future__ import annotations

from collections import Counter
import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that an opening tag of the key closes, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that close an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_SCOPE = frozenset("table td th button html body article section aside div main nav header footer form".split())

_ASIDE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")


class Node:
    """An element; ``children`` holds elements and decoded strings in page order."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag = tag
        self.attributes = attributes
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Attributes:
    """Reads the attributes of tags. A value without its closing quote ends like one without quotes."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # quotes of which there are no more

    def read(self, at: int) -> tuple[dict[str, str], int] | None:
        """The attributes from ``at`` on and where the tag ends; None where the page ends before it does."""
        page, found = self.page, {}
        while True:
            at = _GAP.match(page, at).end()
            if at == len(page):
                return None
            if page[at] == ">":
                return found, at + 1
            name = _NAME.match(page, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                value, at = self._value(at)
            found.setdefault(name[0].lower(), html.unescape(value))

    def _value(self, at: int) -> tuple[str, int]:
        quote = self.page[at : at + 1]
        if quote in ("'", '"') and quote not in self.gone:
            stop = self.page.find(quote, at + 1)
            if stop >= 0:
                return self.page[at + 1 : stop], stop + 1
            self.gone.add(quote)
        stop = _BARE.match(self.page, at).end()
        return self.page[at:stop].lstrip("'\""), stop


def parse(page: str | None) -> Node:
    """The tree below a root without a tag."""
    root = Node("", {})
    stack = [root]
    opened: Counter[str] = Counter()
    page = page or ""
    reader = _Attributes(page)
    at = 0

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text))

    def drop(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    def close(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                lowest = depth
                while lowest > 1 and stack[lowest - 1].tag in tags and stack[lowest - 1].tag not in barrier:
                    lowest -= 1
                drop(lowest)
                return
            if stack[depth].tag in barrier:
                return

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if aside := _ASIDE.match(page, start):
            say(page[at:start])
            at = aside.end()
            continue
        found = _TAG.match(page, start)
        if not found:
            say(page[at : start + 1])
            at = start + 1
            continue
        say(page[at:start])
        slash, name = found.groups()
        if (rest := reader.read(found.end())) is None:
            break
        attributes, at = rest
        tag = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    drop(depth)
                    break
            continue
        if tag in BLOCKS:
            close({"p"}, _SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : stop.start() if stop else len(page)]
            if body:
                node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = stop.end() if stop else len(page)
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root
