"""Main text of web pages by tree scoring, whole pages in Arrow batches.

A page is parsed into a tree without the parts that never hold an article: scripts, forms, menus, and
elements whose class or id names them. Names that may as well belong to an article (``related-work``,
``form``) only count against containers, and only where links or little else stand in them. Every
paragraph passes points for its length and commas to its parent, and half of them to its grandparent;
the points of a container are discounted by the share of its text that stands in links.

The best container is kept with its siblings, and so on up the tree: siblings that score well, and such
of whatever tag that have text of which little stands in links: lists, tables, short blocks, bare text
(what is inline between two blocks counts as one). Beside an ``article`` or ``main``, and in the body of
a page above other containers, containers and bare text must score well to stay, while headings,
paragraphs, lists and tables need only be text. The blocks, in page order, are the text.

Defined cases: a null or empty page, and one without text, give an empty text; character references
are decoded; an element that is not closed ends where its parent or the next block of its kind
begins; repeated rows stay; no rows give no rows; other columns are kept, except ``main_text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option iframe object "
    "svg canvas audio video menu dialog map".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption h1 h2 h3 h4 h5 h6 summary caption th".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article main header ul ol dl table thead tbody tfoot tr figure details center address hr fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What ends an element that has no end tag: the next start tag of one of these.
ENDED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
    **{h: BLOCKS - {"hr"} for h in HEADINGS},
}
HOLDERS = frozenset("article section main div body td th ul ol dl table".split())
# Parts of a page by the name of their class or id; of a name such as "comment-list-2" every word counts.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|popup|modal|cookies?\w*|consent\w*|gdpr|notices?|alert|"
    r"newsletter\w*|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|pag(?:er|ination)|skip|sidebar\w*|aside|widget\w*|"
    r"recommend\w*|trending|sharing|social\w*|comment\w*|disqus\w*|repl(?:y|ies)\w*|respond\w*|reactions|"
    r"footer\w*|masthead|toolbar|copyright|disclaimer|outbrain|taboola|hidden)(?=$|[\s_-])",
    re.I,
)
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:side|related|share\w*|foot|legal|form|search|tags|discussion)(?=$|[\s_-])", re.I)
FEW_LETTERS = 100  # a container with a doubtful name and fewer letters is no part of the article
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|text|story|blog)(?=$|[\s_-])", re.I)
LINKS = 0.25  # text with a larger share of links is no text of an article
PLAIN = PARAGRAPHS | frozenset("ul ol dl table figure address".split())
UNLIKELY_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert note".split()
)


class Node:
    __slots__ = ("tag", "parent", "children", "points", "n_text", "n_link", "dropped", "likely", "doubtful")

    def __init__(self, tag: str, parent: Node | None, attrs: dict):
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.n_text, self.n_link = 0.0, 0, 0
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        self.likely = tag in ("article", "main") or bool(LIKELY.search(names))
        spared = tag in ("html", "body", "article", "main") or tag in HEADINGS
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        named = not spared and (bool(UNLIKELY.search(names)) or attrs.get("role") in UNLIKELY_ROLES)
        self.dropped = tag in NEVER or hidden or named
        self.doubtful = tag in BLOCKS and tag not in PARAGRAPHS and not spared and bool(DOUBTFUL.search(names))


class Tree(HTMLParser):
    """Builds the tree; repairs end tags that are missing or do not match."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, {})

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.root is not self.at and tag == "html":
            return
        if tag in BLOCKS:
            node = self.at
            while node is not None and node.tag not in HOLDERS:
                if tag in ENDED_BY.get(node.tag, ()):
                    self.at = node.parent or self.root
                    break
                node = node.parent
        elif tag == "a":
            self._end("a", BLOCKS)
        if tag in ("td", "th", "tr", "li", "dd", "dt") and self.at.tag in ENDED_BY and tag in ENDED_BY[self.at.tag]:
            self.at = self.at.parent or self.root
        if tag == "br":
            self.at.children.append(" ")
            return
        node = Node(tag, self.at, dict(attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in BLOCKS:
            self.at = self.at.parent or self.root

    def _end(self, tag, stop=frozenset()):
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            # An inline end tag does not reach through a block.
            self._end(tag, frozenset() if tag in BLOCKS or tag in NEVER else BLOCKS)

    def handle_data(self, data):
        self.at.children.append(data)


def _kept(node: Node) -> list:
    """Children without dropped elements; a page header keeps only what an article's own header may."""
    return [c for c in node.children if isinstance(c, str) or not c.dropped]


def _walk(root: Node) -> list[Node]:
    """Kept elements, parents before children, without recursion."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        for child in _kept(node):
            if not isinstance(child, str):
                inside = child
                if child.tag == "header":
                    while inside is not None and inside.tag not in ("article", "main"):
                        inside = inside.parent
                    if inside is None:
                        child.dropped = True
                        continue
                stack.append(child)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Letters of text and of linked text below each node."""
    for node in reversed(nodes):
        node.n_text += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.n_link = node.n_text
        if node.parent is not None:
            node.parent.n_text += node.n_text
            node.parent.n_link += node.n_link


def _drop_doubtful(nodes: list[Node]) -> list[Node]:
    """Take out containers with a doubtful name that are links or hardly any text; what is left, measured again."""
    doubtful = [n for n in nodes if n.doubtful and (n.n_text < FEW_LETTERS or _link_density(n) >= LINKS)]
    if not doubtful:
        return nodes
    for node in doubtful:
        node.dropped = True
    for node in nodes:
        node.n_text = node.n_link = 0
    left = _walk(nodes[0])
    _measure(left)
    return left


def _link_density(node: Node) -> float:
    return node.n_link / node.n_text if node.n_text else 0.0


def _texts(node: Node) -> Iterator[str]:
    """Blocks of text below a node, in page order: white space is one space, empty ones are left out."""
    parts: list[str] = []
    stack: list = [iter(_kept(node))]
    ends: list[bool] = [True]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop() and parts:
                if text := " ".join("".join(parts).split()):
                    yield text
                parts = []
        elif isinstance(child, str):
            parts.append(child)
        else:
            block = child.tag in BLOCKS
            if block and parts:
                if text := " ".join("".join(parts).split()):
                    yield text
                parts = []
            stack.append(iter(_kept(child)))
            ends.append(block)


def _commas(node: Node) -> int:
    return sum(text.count(",") + text.count("，") + text.count("、") for text in _texts(node))


def main_text(page: str | None) -> str:
    """The article of a page; blocks are joined by an empty line."""
    if not page:
        return ""
    tree = Tree()
    tree.feed(page)
    tree.close()
    nodes = _walk(tree.root)
    _measure(nodes)
    nodes = _drop_doubtful(nodes)
    containers: dict[int, Node] = {}
    for node in nodes:
        own = node.tag not in PARAGRAPHS and any(isinstance(c, str) and len(c.split()) > 10 for c in node.children)
        if (node.tag in PARAGRAPHS or own) and node.n_text:
            points = (1 + _commas(node) + min(node.n_text / 100, 3)) * (1 - _link_density(node))
            holder, share = (node if own else node.parent), 1.0
            while holder is not None and share >= 0.5:
                # Lists and tables hand the points of their items on: they are part of a container.
                if holder.tag in HOLDERS and holder.tag not in ("ul", "ol", "dl", "table", "td", "th"):
                    if id(holder) not in containers:
                        holder.points += (25 if holder.likely else 0) if holder.tag != "body" else 0
                    holder.points += points * share
                    containers[id(holder)] = holder
                    share /= 2
                holder = holder.parent
    if not containers:
        return "\n\n".join(_texts(tree.root))
    score = {k: n.points * (1 - _link_density(n)) for k, n in containers.items()}
    best = max(containers.values(), key=lambda n: score[id(n)])
    limit, top = max(10.0, 0.2 * score[id(best)]), best
    while top.parent is not None and top.tag != "body":
        # Inside the container that scored best its siblings only need to be text.
        strict = top.tag in ("article", "main") or (top is not best and top.parent.tag == "body")
        kept: list = []
        for _, run in groupby(_kept(top.parent), lambda c: id(c) if not isinstance(c, str) and c.tag in BLOCKS else 0):
            run = list(run)
            n_text = sum(len("".join(c.split())) if isinstance(c, str) else c.n_text for c in run)
            n_link = sum(c.n_link for c in run if not isinstance(c, str))
            text = n_link < LINKS * n_text and (not strict or (not isinstance(run[0], str) and run[0].tag in PLAIN))
            if run[0] is top or score.get(id(run[0]), 0.0) >= limit or text:
                kept.extend(run)
            else:
                # What stands before and after is not one block.
                kept.append(Node("div", None, {}))
        top.parent.children = kept
        top = top.parent
    return "\n\n".join(_texts(top))


def extract_main(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Add ``out``: the main text of each page. One pass without a shuffle."""

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    return pages.withColumn(out, extracted(F.col(html)))
