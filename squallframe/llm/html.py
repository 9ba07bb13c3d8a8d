"""Main text of web pages by composite text density of DOM nodes."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import table

# Element names of HTML and usual names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NEVER_TEXT = set("head script style noscript template svg math canvas object embed iframe audio video map nav aside footer form button select textarea input datalist dialog menu xmp noembed noframes".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
OTHER_PARTS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager masthead header topbar toolbar footer colophon copyright "
    "sidebar sidebars aside widget widgets related recommended recommendations share sharing social "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "form hidden".split()
)
COMMENT_PARTS = set("comment comments commentlist disqus respond reply replies".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What share of a page's text outside of links an element must hold to be kept although its name says another part: one that
#: a whole class or id names, and one that only a part of such a word names.
NAMED, PARTLY_NAMED = 0.9, 0.5
KEPT_ROOTS = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "p"}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


class Node:
    """An element: pieces are texts and child nodes in page order; the sums are of its whole subtree."""

    __slots__ = ("chars", "density", "doubt", "dropped", "link_chars", "link_tags", "name", "parent", "pieces", "spread", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, doubt: float = 0.0, name: str = ""):
        self.tag, self.parent, self.pieces, self.dropped, self.doubt, self.name = tag, parent, [], dropped, doubt, name
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.spread = 0.0

    def inside(self, *tags: str) -> bool:
        at = self
        while at is not None and at.tag not in tags:
            at = at.parent
        return at is not None


def words_of(named: str) -> tuple[set[str], set[str]]:
    """The words of classes and ids, and the parts of those words."""
    return set(named.split()), set(re.split(r"[^a-z0-9]+", named))


def other_part(tag: str, rest: str, parent: Node) -> tuple[float, str]:
    """The share of the page's text that an element must hold to be kept: 0 for most, over 1 for one that is no part of an
    article by its element's name, role or being hidden, and in between for one that its class or id names so; and its class and id."""
    if tag in NEVER_TEXT or tag == "header" and not parent.inside("article", "main"):
        return 2.0, ""
    if "=" not in rest and "hidden" not in rest:
        return 0.0, ""
    attributes = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "").lower()):
        return 2.0, ""
    if attributes.get("role", "").strip().lower() in OTHER_ROLES:
        return 2.0, ""
    if tag in KEPT_ROOTS:
        return 0.0, ""
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    words, parts = words_of(named)
    if words & (OTHER_PARTS | COMMENT_PARTS):
        return NAMED, named
    return (PARTLY_NAMED, named) if parts & (OTHER_PARTS | COMMENT_PARTS) else (0.0, named)


def parse(page: str) -> Node:
    """The tree of a page; a tag that is missing its end is closed as browsers do in the common cases."""
    root = at = Node("html", None)
    place, raw_end = 0, None
    while True:
        m = TAG.search(page, place)
        text = page[place : m.start() if m else len(page)]
        if text and not at.dropped:
            at.pieces.append(text)
        if not m:
            return root
        place = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not at.dropped:
                at.pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"] or m["end2"]:
            up = at
            while up is not None and up.tag != name:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if name in ("html", "body") and at.inside("body") or name == "html":
            continue
        if name in ENDS_P or name in SIBLINGS:
            ends, holders = SIBLINGS.get(name, {"p"}), HOLDERS.get(name, BLOCKS - {"p"})
            up = at
            while up is not None and up.tag not in ends and up.tag not in holders:
                up = up.parent
            if up is not None and up.tag in ends:
                at = up.parent
        if at.tag == "head" and name == "body":
            at = at.parent
        rest = m["rest"] or m["rest2"] or ""
        share, named = (2.0, "") if at.dropped else other_part(name, rest, at)
        node = Node(name, at, share > 1, share, named)
        at.pieces.append(node)
        if name in RAW:
            raw_end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, place)
            place = raw_end.end() if raw_end else len(page)
        elif name not in VOID and not rest.endswith("/"):
            at = node


def in_post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.pieces if isinstance(x, Node)]
    return order[::-1]


def plain_chars(text: str) -> int:
    return sum(map(len, entities.unescape(text).split()))


def elements(node: Node) -> list[Node]:
    return [x for x in node.pieces if isinstance(x, Node) and not x.dropped]


def holds_comments(node: Node) -> bool:
    """Whether an element named for comments holds them: no heading of the first two ranks, article or main element is in it,
    and parts of one element and name, at least two, hold half of its text; or it is such a part, one of several in its parent."""
    if not words_of(node.name)[1] & COMMENT_PARTS:
        return False
    stack = elements(node)
    while stack:
        at = stack.pop()
        if at.tag in ("h1", "h2", "article", "main"):
            return False
        stack += elements(at)
    held = node
    while len(children := elements(held)) == 1:
        held = children[0]
    alike: dict[tuple, list[int]] = {}
    for x in children:
        first = re.sub(r"[-_]?\d+$", "", x.name.split()[0]) if x.name.strip() else ""
        if first or x.tag == "li":
            alike.setdefault((x.tag, first), []).append(x.chars)
    if any(len(c) > 1 and 2 * sum(c) >= node.chars for c in alike.values()):
        return True
    return node.parent is not None and sum(x.tag == node.tag and bool(words_of(x.name)[1] & COMMENT_PARTS) for x in elements(node.parent)) > 1


def drop_named(root: Node) -> None:
    """Drop the elements that their names say are other parts, but for those that hold most of the page's plain text.

    chars are those of the texts outside of links here. Parts of one element and name in one parent are judged by what they hold together, and
    comments go whatever they hold; a dropped element's subtree is dropped with it.
    """
    for node in in_post_order(root):
        if not node.dropped and node.tag != "a":
            node.chars = sum(plain_chars(x) if isinstance(x, str) else x.chars for x in node.pieces)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        children = elements(node)
        together: dict[tuple, int] = {}
        for x in children:
            together[x.tag, x.name] = together.get((x.tag, x.name), 0) + x.chars
        doubted = [x for x in children if x.doubt and (together[x.tag, x.name] < x.doubt * max(root.chars, 1) or holds_comments(x))]
        for x in doubted:
            x.dropped = True
        stack += children


def weigh(root: Node) -> list[Node]:
    """Set the sums, densities and density sums of all nodes that may hold text; they are returned, root last."""
    nodes = [n for n in in_post_order(root) if not n.dropped]
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for piece in node.pieces:
            if isinstance(piece, str):
                node.chars += plain_chars(piece)
            elif not piece.dropped:
                node.chars += piece.chars
                node.tags += piece.tags + 1
                node.link_chars += piece.link_chars
                node.link_tags += piece.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    page_share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + page_share * c + math.e)
        weight = math.log(max(c, 1) / max(lc, 1) * t / max(lt, 1)) / math.log(base) if base > 1 else 1.0
        # without links both logarithms are of little; the density is then that of characters a tag
        node.density = c / t * (weight if lt else 1.0)
    for node in nodes:
        node.spread = sum(x.density for x in node.pieces if isinstance(x, Node) and not x.dropped)
    return nodes


def link_list(node: Node) -> bool:
    return node.tag in BLOCKS and node.link_tags >= 2 and node.link_chars >= 0.9 * node.chars


def article_nodes(root: Node) -> set[int]:
    """Ids of the nodes whose whole subtrees are the article.

    The node with the largest sum of its children's densities is its core, or the article or main element around
    that. The least density on the way from the core to the body is the threshold: outside of the core, the highest nodes
    that aren't on this way and reach it belong to the article too. Where an element on the way, below the body, has a heading or
    paragraph of its own beside the core, it is the article's, and its short blocks (title, byline, last paragraph) need no density;
    of the body's own elements, the titles before the core don't either.
    """
    nodes = weigh(root)
    if not root.chars:
        return set()
    # an element whose text stands in it directly counts as its own only child
    own = lambda n: max(n.spread, n.density if any(isinstance(x, str) and x.strip() for x in n.pieces) else 0.0)
    core = max(reversed(nodes), key=own)
    up = core
    while up is not None:
        if up.tag in ("article", "main"):
            core = up
        up = up.parent
    while core.tag not in BLOCKS and core.parent is not None:
        core = core.parent
    way, least, up = set(), core.density, core.parent
    while up is not None:
        way.add(id(up))
        if up.tag not in ("html",):
            least = min(least, up.density)
        up = up.parent
    chosen, stack = {id(core)}, [root]
    while stack:
        node = stack.pop()
        children, before = elements(node), True
        whole = node.tag not in ("html", "body") and 2 * core.chars >= node.chars and any(x.tag in HEADINGS or x.tag == "p" for x in children if id(x) not in way and x is not core)
        for piece in children:
            if id(piece) in way or piece is core:
                before = False
                stack += [piece] * (piece is not core)
            elif piece.chars and not link_list(piece):
                title = before and piece.tag in ("h1", "h2") and not piece.link_chars
                if title or piece.tag in BLOCKS and (whole or piece.density >= least) or whole and piece.link_chars < piece.chars:
                    chosen.add(id(piece))
    return chosen


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space in them and between them as one space."""
    if not page:
        return ""
    root = parse(page)
    drop_named(root)
    chosen = article_nodes(root)
    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        if run:
            blocks.append(" ".join(entities.unescape("".join(run)).split()))
            run.clear()

    stack: list[tuple] = [(root, False, False)]  # a node's pieces follow it; (None, ..) ends a block
    while stack:
        piece, inside, _ = stack.pop()
        if piece is None:
            end_block()
        elif isinstance(piece, str):
            if inside:
                run.append(piece)
        elif not piece.dropped:
            whole = inside or id(piece) in chosen
            if whole and inside and link_list(piece) and not piece.inside("article", "main"):
                end_block()
                continue
            block = piece.tag in BLOCKS
            if block:
                end_block()
                stack.append((None, False, False))
            stack += [(x, whole, False) for x in reversed(piece.pieces)]
    end_block()
    return " ".join(x for x in blocks if x)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: id_col, url_col, text and n_chars.

    Ties: of elements with the same largest sum of densities the outermost is taken, of several such the last in page order.

    Edge cases: null and empty html, and pages without text in an article, give an empty text; very long pages are
    read whole; broken markup is read as far as it goes; repeated rows give the same text; an empty table gives no
    rows; null ids and urls are kept; other columns are ignored, whatever their names.
    """
    chosen = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["__id", "__url", "text", "n_chars"])

    kind = chosen.schema["__id"].dataType.simpleString()
    return chosen.mapInArrow(texts, f"__id {kind}, __url string, text string, n_chars long").withColumnsRenamed({"__id": id_col, "__url": url_col})


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
