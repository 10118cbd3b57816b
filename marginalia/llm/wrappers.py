"""Main text of web pages by wrapper induction.

Pages of a host come from the same program. The block elements of a page outside of its articles form its
layout, runs of equal siblings as one; the different layouts of a host are merged into the host's
template tree by simple tree matching, which pairs children with equal labels in order. Every page of the
host is then aligned with the template, and its blocks are counted by the slot that they fall into: text
that nearly all pages with the slot have alike is template, varying text is content. The wrapper of a
host, its template tree and the constant texts of its slots, is applied to every page of the host: all text stays but
those blocks and menus, forms and the like. Inside an article or main element nothing is template, however
many pages have it alike.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import xxhash

from marginalia.llm.dom import BLOCKS, Node, parse
from marginalia.llm.storage import cut
from marginalia.llm.text import or_empty

#: A text is template when this share of the different pages that have its slot have it there, and so many at least.
SHARE = 0.9
LEAST_PAGES = 3
#: Layouts of a host are merged in so many parts first.
PARTS = 64
#: Rows gathered before they are handed on.
BATCH_ROWS = 1 << 16
#: Elements nested deeper are not aligned; their text is read like any other.
MOST_DEPTH = 100

# Elements and words of class, id and role that are not content.
SKIPPED_TAGS = frozenset(
    "nav aside footer form button select option input textarea script style noscript template iframe object "
    "svg canvas head dialog menu noembed noframes audio video datalist".split()
)
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments reply replies disqus pagination pager toolbar widget search "
    "contentinfo complementary skip copyright legal".split()
)
#: Elements that a page names as its content: nothing inside them is template.
CONTENT_TAGS = frozenset(("article", "main"))
_NEVER_SKIPPED = frozenset(("", "html", "body", "main", "article", "h1"))
_BLOCKS = BLOCKS | frozenset("li dt dd tr td th caption legend body html option tbody thead tfoot".split())
# Words that say nothing beside one of the skipped words, as in share-buttons or ad-box.
NEUTRAL_WORDS = frozenset(
    "area articles bar block blocks blog body bottom box btn button buttons center col column container content "
    "count email field form google group holder icon icons inline inner item items js latest layer left link "
    "links list main message module more news outer page panel popular post posts primary reader readers right row "
    "secondary section site slot sticky text thread top unit user users visitor widget wrap wrapper yes zone".split()
)
# Words that turn the meaning of a skipped word, as in no-sidebar or entry-header.
TURNING_WORDS = frozenset(
    "article disabled enabled entry has have hidden no non not off on policy shown single story title with without work works".split()
)
#: Elements of running text: inside an article their names decide nothing.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption em strong b i span code".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_boilerplate(said: str, content: bool) -> bool:
    """Whether a class, id or role has a skipped word: inside an article beside neutral words only, elsewhere
    beside none that turns its meaning."""
    words = {word.lower() for word in _WORDS.findall(said)}
    if SKIPPED_WORDS.isdisjoint(words):
        return False
    return words <= SKIPPED_WORDS | NEUTRAL_WORDS if content else TURNING_WORDS.isdisjoint(words)


def measure(root: Node) -> tuple[frozenset[int], dict[int, int]]:
    """The elements (by id) that hold an article, main or h1 element, and the length of the text of each element."""
    holders: set[int] = set()
    sizes: dict[int, int] = {}
    stack: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while stack:
        node, parent, done = stack.pop()
        if not done:
            sizes[id(node)] = sum(len(c) for c in node.children if isinstance(c, str)) if node.tag not in SKIPPED_TAGS else 0
            stack.append((node, parent, True))
            stack.extend((child, node, False) for child in node.elements() if node.tag not in SKIPPED_TAGS)
        elif parent is not None:
            sizes[id(parent)] += sizes[id(node)]
            if id(node) in holders or node.tag in CONTENT_TAGS or node.tag == "h1":
                holders.add(id(parent))
    return frozenset(holders), sizes


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(node.elements())


class Page:
    """A parsed page, and what of it is no content."""

    def __init__(self, html: str | None):
        self.root = parse(html)
        self.holders, self.sizes = measure(self.root)
        # Of a page that names its content, names elsewhere can be taken at their word.
        named = any(node.tag in CONTENT_TAGS for node in walk(self.root))
        self.most = float("inf") if named else self.sizes[id(self.root)] / 2

    def is_skipped(self, node: Node, article: bool, content: bool) -> bool:
        """Whether an element is a menu, header, footer, sidebar, notice, advert, form, script or comments.

        Names decide for no element that holds an article, main or h1 element, for none that holds most of the
        text of a page without article and main, and for no running text inside one of these."""
        if node.tag in SKIPPED_TAGS or node.tag == "header" and not article:
            return True
        if node.tag in _NEVER_SKIPPED or not node.attributes:
            return False
        if "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true":
            return True
        said = [*node.attributes.get("class", "").split(), node.attributes.get("id", ""), node.attributes.get("role", "")]
        if not any(_names_boilerplate(name, content) for name in said):
            return False
        most = self.sizes[id(node)] > self.most
        return not (id(node) in self.holders or most or content and node.tag in PROSE)

    def blocks(self) -> Iterator[tuple[Node, str, bool]]:
        """(element, text, whether it is inside an article or main element) of all blocks that hold text,
        in page order.

        White space inside a block is one space. A line break element is white space.
        """
        held: list[str] = []
        # (item, the block around it, inside article, inside article or main, whether a block ends)
        stack: list[tuple[Node | str | None, Node, bool, bool, bool]] = [
            (child, self.root, False, False, False) for child in reversed(self.root.children)
        ]
        owner, content = self.root, False

        def flush() -> str:
            text = " ".join("".join(held).split(None))
            held.clear()
            return text

        while stack:
            item, at, article, main, closing = stack.pop()
            if closing:
                if text := flush():
                    yield owner, text, content
                owner, content = at, main
            elif isinstance(item, str):
                held.append(item)
            elif item.tag == "br" or item.tag == "img":
                held.append(" ")
            elif not self.is_skipped(item, article, main):
                inside = main or item.tag in CONTENT_TAGS
                if item.tag in _BLOCKS:
                    if text := flush():
                        yield owner, text, content
                    stack.append((None, at, article, main, True))
                    owner = at = item
                    content = inside
                below = article or item.tag == "article"
                stack.extend((child, at, below, inside, False) for child in reversed(item.children))
            elif item.tag in _BLOCKS:
                if text := flush():
                    yield owner, text, content
        if text := flush():
            yield owner, text, content

    def layout(self) -> Tree:
        """Block elements outside of articles. Neighbours of equal shape are one node."""
        return self._tree(self.root, 0)

    def _tree(self, node: Node, depth: int) -> Tree:
        tree = Tree(label(node), [], [node])
        if node.tag not in CONTENT_TAGS and depth < MOST_DEPTH:
            for child in node.elements():
                if child.tag in _BLOCKS and not self.is_skipped(child, False, False):
                    below = self._tree(child, depth + 1)
                    if tree.children and tree.children[-1].shape() == below.shape():
                        tree.children[-1].add(below)
                    else:
                        tree.children.append(below)
        return tree


def label(node: Node) -> str:
    """Tag and first class, without digits."""
    first = node.attributes.get("class", "").split()[:1]
    return node.tag + ("." + re.sub(r"\d+", "", first[0]) if first else "")


class Tree:
    """A node of a layout or template: its label, its children, and the elements of a page that it stands for."""

    __slots__ = ("label", "children", "nodes", "_shape")

    def __init__(self, label: str, children: list[Tree], nodes: list[Node] | None = None):
        self.label, self.children, self.nodes, self._shape = label, children, nodes or [], None

    def shape(self) -> str:
        """A hash of the labels of the tree; children must not change afterwards."""
        if self._shape is None:
            below = ",".join(c.shape() for c in self.children)
            self._shape = xxhash.xxh3_128_hexdigest(f"{self.label}({below})")
        return self._shape

    def add(self, same: Tree) -> None:
        """Take in the elements of a tree of the same shape."""
        self.nodes += same.nodes
        for mine, other in zip(self.children, same.children):
            mine.add(other)

    def plain(self) -> list:
        return [self.label, [c.plain() for c in self.children]]

    @staticmethod
    def of(plain: list) -> Tree:
        return Tree(plain[0], [Tree.of(c) for c in plain[1]])


def match_score(a: Tree, b: Tree, known: dict) -> int:
    """Simple tree matching: nodes in the largest order-preserving match of two trees with equal roots."""
    if a.label != b.label:
        return 0
    found = known.get((id(a), id(b)))
    if found is None:
        found = known[id(a), id(b)] = 1 + _match_table(a, b, known)[-1][-1]
    return found


def _match_table(a: Tree, b: Tree, known: dict) -> list[list[int]]:
    table = [[0] * (len(b.children) + 1)]
    for x in a.children:
        above, row = table[-1], [0]
        for j, y in enumerate(b.children):
            best = max(above[j + 1], row[j])
            if x.label == y.label:
                best = max(best, above[j] + match_score(x, y, known))
            row.append(best)
        table.append(row)
    return table


def align(a: Tree, b: Tree, known: dict) -> list[tuple[Tree | None, Tree | None]]:
    """The children of two matching nodes in order, paired along the best match; None where one has no partner."""
    table = _match_table(a, b, known)
    i, j, pairs = len(a.children), len(b.children), []
    while i or j:
        x, y = a.children[i - 1] if i else None, b.children[j - 1] if j else None
        if x and y and x.label == y.label and table[i][j] == table[i - 1][j - 1] + match_score(x, y, known):
            pairs.append((x, y))
            i, j = i - 1, j - 1
        elif x and (not y or table[i][j] == table[i - 1][j]):
            pairs.append((x, None))
            i -= 1
        else:
            pairs.append((None, y))
            j -= 1
    return pairs[::-1]


def merge(template: Tree, layout: Tree, known: dict | None = None) -> Tree:
    """A template with all nodes of both, those that match as one."""
    known = {} if known is None else known
    children = [
        merge(x, y, known) if x and y else (x or y) for x, y in align(template, layout, known)
    ]
    return Tree(template.label, children)


def merged(layouts: Iterable[str]) -> str:
    """The template of layouts, all as JSON. They are taken in order, so that reruns agree."""
    template = Tree("", [])
    for layout in sorted(set(layouts)):
        template = merge(template, Tree.of(json.loads(layout)))
    return json.dumps(template.plain(), separators=(",", ":"))


def slots(template: Tree, layout: Tree) -> dict[int, int]:
    """Element of a page (by id) to the number of its node in the template, in the order of a walk."""
    found: dict[int, int] = {}
    known: dict = {}
    number = 0

    def visit(node: Tree, matched: Tree | None) -> None:
        nonlocal number
        if matched is not None:
            found.update((id(n), number) for n in matched.nodes)
        number += 1
        partner = {id(x): y for x, y in align(node, matched, known) if x} if matched is not None else {}
        for child in node.children:
            visit(child, partner.get(id(child)))

    visit(template, layout)
    return found


def slot_texts(page: Page, template: Tree) -> list[tuple[str | None, str]]:
    """(slot and text as a key, or None inside articles and beside the template; text) of the blocks of a page."""
    place = slots(template, page.layout())
    return [
        (None if inside or id(owner) not in place else block_key(place[id(owner)], text), text)
        for owner, text, inside in page.blocks()
    ]


def block_key(slot: int, text: str) -> str:
    return f"{slot}:{xxhash.xxh64_hexdigest(text.encode())}"


def induce(pages: list[str]) -> str | None:
    """The wrapper of a host as JSON, from pages that differ; None for a single page."""
    if len(pages) < 2:
        return None
    parsed = [Page(page) for page in pages]
    plain = merged(json.dumps(page.layout().plain()) for page in parsed)
    template = Tree.of(json.loads(plain))
    keys = [{key for key, _ in slot_texts(page, template) if key} for page in parsed]
    texts = Counter(key for page in keys for key in page)
    had = Counter(slot for page in keys for slot in {key.split(":")[0] for key in page})
    constants = [key for key, n in sorted(texts.items()) if n >= max(LEAST_PAGES, SHARE * had[key.split(":")[0]])]
    return json.dumps({"template": plain, "constants": constants})


@lru_cache(maxsize=64)
def _wrapper(wrapper: str) -> tuple[Tree, frozenset[str]]:
    told = json.loads(wrapper)
    return Tree.of(json.loads(told["template"])), frozenset(told["constants"])


def main_text(html: str | None, wrapper: str | None) -> str:
    """Blocks of the page outside of menus and the like, one per line, without the constant ones of the
    wrapper that are outside of article and main. A page of which nothing is left that way is read without a wrapper."""
    if not html:
        return ""
    page = Page(html)
    if not wrapper:
        return "\n".join(text for _, text, _ in page.blocks())
    template, constants = _wrapper(wrapper)
    found = slot_texts(page, template)
    return "\n".join([text for key, text in found if key not in constants] or [text for _, text in found])


def host_of(url: str) -> Column:
    """Host of a URL, A-Z lower-cased; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return F.when(host != "", host)


def _hosted(pages: DataFrame, url: str, html: str) -> DataFrame:
    found = pages.select(host_of(url).alias("__host"), F.col(html).alias("__html"))
    return found.filter("__host is not null and __html != ''")


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, template): the merged layouts of the pages that have text outside of articles."""

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(html.as_py())
                if any(not inside for _, _, inside in page.blocks()):
                    rows.add((host, json.dumps(page.layout().plain(), separators=(",", ":"))))
            yield _record_batch(sorted(rows), pa.schema([("__host", pa.string()), ("layout", pa.string())]))

    def template(group: pa.Table) -> pa.Table:
        return pa.table({"__host": group.column("__host")[:1], "layout": [merged(group.column("layout").to_pylist())]})

    schema = "__host string, layout string"
    different = _hosted(pages, url, html).mapInArrow(layouts, schema).distinct()
    parts = different.groupBy("__host", F.pmod(F.xxhash64("layout"), F.lit(PARTS))).applyInArrow(template, schema)
    whole = parts.groupBy("__host").applyInArrow(template, schema)
    return cut(whole.withColumnRenamed("layout", "template"), "page-templates")


def _page_blocks(pages: DataFrame, templates: DataFrame, url: str, html: str) -> DataFrame:
    """(host, page, slot, block): a row for each slot of the template that holds text on the page, with a
    null block, and one for each text there. ``page`` is a hash of the html, so repeated pages give
    repeated rows."""
    kinds = pa.schema([("__host", pa.string()), ("__page", pa.int64()), ("__slot", pa.int64()), ("__block", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, html, plain in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = html.as_py()
                digest = xxhash.xxh64_intdigest(text.encode()) - (1 << 63)
                keys = {key for key, _ in slot_texts(Page(text), _template(plain.as_py())) if key}
                rows += ((host, digest, slot, None) for slot in {int(key.split(":")[0]) for key in keys})
                rows += ((host, digest, int(key.split(":")[0]), key) for key in keys)
                if len(rows) > BATCH_ROWS:
                    yield _record_batch(rows, kinds)
                    rows = []
            yield _record_batch(rows, kinds)

    found = _hosted(pages, url, html).join(templates, "__host").select("__host", "__html", "template")
    return found.mapInArrow(run, "__host string, __page long, __slot long, __block string")


@lru_cache(maxsize=64)
def _template(plain: str) -> Tree:
    return Tree.of(json.loads(plain))


def _record_batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) of hosts with constant blocks, from counts over all different pages of the host.

    A slot has few constant texts, as each is on nearly all of its pages; so a wrapper grows with the
    host's template and not with its pages."""
    templates = host_templates(pages, url, html)
    different = _page_blocks(pages, templates, url, html).distinct()
    counted = different.groupBy("__host", "__slot", "__block").count().filter(F.col("count") >= LEAST_PAGES)
    counts = cut(counted, "page-blocks")
    had = counts.filter("__block is null").select("__host", "__slot", F.col("count").alias("__had"))
    constant = (
        counts.filter("__block is not null")
        .join(had, ["__host", "__slot"])
        .filter(F.col("count") >= SHARE * F.col("__had"))
        .groupBy("__host")
        .agg(F.sort_array(F.collect_list("__block")).alias("constants"))
    )
    return constant.join(templates, "__host").select(
        "__host", F.to_json(F.struct("template", "constants")).alias("wrapper")
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url and text, the main text of the whole html.

    Null or empty html gives an empty text. Pages without a host, and hosts with one or two pages, are read
    by their elements alone. Repeated rows give repeated rows and count once in a wrapper; an
    empty table gives no rows; other columns are not read.
    """
    wrappers = cut(host_wrappers(pages, url, html), "page-wrappers")
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), or_empty(html).alias("__html"))
    joined = rows.withColumn("__page_host", host_of("__url")).join(
        wrappers, F.col("__page_host") == F.col("__host"), "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), w.as_py()) for h, w in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, url, "text"]
            )

    kind = pages.schema[key].dataType.simpleString()
    return joined.select("__key", "__url", "__html", "wrapper").mapInArrow(
        run, f"`{key}` {kind}, `{url}` string, text string"
    )
