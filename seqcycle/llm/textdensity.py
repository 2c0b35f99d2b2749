"""Main text of web pages by composite text density.

A page becomes a tree without what is never text of an article (scripts, styles, navigation, footers, asides, controls, hidden parts). For every other node, C, LC are the characters of its text and of its links' texts
(white space apart), T and LT its tags and link tags, at least 1 each. Its composite density is
C/T * log(C*T / (LC*LT)) to the base ln(C/nLC * LC + LCb/Cb * C + e), nLC = C - LC (at least 1) and b the body: characters per tag,
adjusted for links. A node's density sum is that of its children and of its own text. Among the nodes that hold text themselves (words, paragraphs, headings, lists, tables, not
boxes alone), the one with the largest sum is the core of the article. Tags and names are evidence on that sum: within a form, a page header, or a box whose class or id names it a
menu, sidebar, notice, advert and the like it counts a quarter, within one named as comments, adverts or related pages a tenth, within an ``article`` or ``main`` half as much again. The outermost ``article``
around the core, else the outermost ``main``, is the core in its place.

The threshold is the lowest density on the path from the core to the body. Along that path, siblings join the core if
they are main headings, or reach the threshold and are text themselves (paragraphs, lists, quotations, tables), or reach it, are at least half
as dense as the core and hold mostly such text. What stands on the path is never cut, whatever its name. Elsewhere forms, page headers and boxes named as above are left out,
but inside the core a named one (comments and adverts apart) only where it holds less than a quarter of the core's text outside links, and one named as related pages only
unless it is prose with less than a quarter of its characters in links. Inside an article, a paragraph or a phrase named as a comment is the author's, and so is the footer of a quotation or figure.
Of a compound name the last part counts, box-like words apart: ``cookie-notice`` and ``notice-bar`` are notices, ``notice-board`` is none.

The text is that of the chosen nodes in page order: character references decoded, white space inside a block made one
space, blocks trimmed and joined by one line feed. Nothing else is dropped.

Defined results: null and empty pages, and pages without text, give an empty text of 0 characters. Malformed markup is read
as far as it goes: an end tag without a start is ignored, a start without an end is closed by its parent, ``<`` before
anything but a tag is text. Repeated rows give equal results; null ids and urls pass through; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S
)
#: One attribute from where it starts: a name, and a value in quotes or up to white space. Consumed in turn, so that no value is searched for names.
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")

# Tags of the markup language by what they do here.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
_TEXTUAL = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "figcaption"}
_DROPPED = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "button", "select", "textarea", "input", "iframe",
    "svg", "canvas", "object", "embed", "audio", "video", "map", "dialog", "menu", "title", "noembed", "noframes", "search", "datalist",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id names that tell what is no article; of these, the firm ones hold long text, too, that is none; box-like words.
_PAGES = {"related", "recommended", "recommendations", "teaser", "teasers"}
_FIRM = _PAGES | {
    "comment", "comments", "commentlist", "respond", "replies", "disqus", "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adbox",
    "adslot", "sponsor", "sponsors", "sponsored",
}
#: Elements that are a remark of the author's if their class says comment; readers' are boxes and items of lists.
_REMARKS = {"p", "span", "code", "pre", "em", "i", "b", "small", "samp", "q"}
_NAMES = _FIRM | {
    "banner", "banners", "promo", "promos", "promotion", "promotions", "promoted", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "side",
    "footer", "footers", "header", "headers", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "alerts", "popup", "popups", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "widget", "widgets", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "paywall",
}
_BOXES = {
    "area", "bar", "block", "bottom", "box", "column", "container", "content", "items", "left", "inner", "link", "links", "list", "message", "panel", "posts", "right", "row", "section",
    "slot", "text", "top", "unit", "wrap", "wrapper",
}
#: What a sum counts within soft boxes, firm ones, articles.
_WEIGHTS = {0: 1.0, 1: 0.25, 2: 0.1, 3: 0.1}
_ARTICLE = 1.5
#: A start tag closes open elements of these kinds, up to an element that bounds them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
_P_STAYS = {"button", "td", "th", "caption", "object", "html", "table", "template"}


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "soft", "named", "chars", "link_chars", "prose", "tags", "link_tags", "density", "total", "weight")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, soft: int = 0, named: bool = False):
        self.tag, self.parent, self.cut, self.soft, self.named = tag, parent, cut, soft, named
        self.parts: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, from what follows its name; of several of one name, the first."""
    found: dict[str, str] = {}
    at = 0
    while at < len(text):
        m = _ATTRIBUTE.match(text, at)
        if m[1]:
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        at = max(m.end(), at + 1)
    return found


def _never(tag: str, found: dict[str, str]) -> bool:
    """Whether an element holds no text of an article in any case."""
    if tag in _DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def _named(tag: str, found: dict[str, str], inside_article: bool) -> int:
    """0, or 1 if a class or id names the element as no part of an article, 2 if firmly so, 3 if as other pages."""
    most = 0
    for word in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[_-]+|\d+", word) if p]
        while len(parts) > 1 and parts[-1] in _BOXES:
            parts.pop()
        if parts and parts[-1] in _NAMES and parts[0] not in ("has", "with", "no", "without", "is", "hide"):
            if inside_article and (parts[-1] in ("header", "headers", "masthead") or word == "comment" and tag in _REMARKS):
                continue
            most = max(most, 3 if parts[-1] in _PAGES else 2 if parts[-1] in _FIRM else 1)
    return most


def parse(page: str) -> Node:
    """The tree of a page; its root stands for the document."""
    root = Node("#root", None)
    stack, at, articles = [root], 0, 0
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            stack[-1].parts.append(entities.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    articles -= sum(x.tag in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        kinds, bounds = _CLOSES.get(tag, (None, None))
        if kinds is None and tag in _BLOCK:
            kinds, bounds = {"p"}, _P_STAYS
        if kinds:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in kinds:
                    articles -= sum(x.tag in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        found = _attributes(attributes) if attributes else {}
        named = _named(tag, found, articles > 0) if found and tag not in ("html", "body", "main") else 0
        boxed = tag in ("form", "fieldset") or found.get("role", "").lower() == "form" or (tag == "header" and not articles)
        quoted = tag == "footer" and any(x.tag in ("blockquote", "figure") for x in stack)  # who said it
        node = Node(tag, stack[-1], not quoted and _never(tag, found), max(named, int(boxed)), bool(named) and not boxed)
        stack[-1].parts.append(node)
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.cut = True
            at = close.end() if close else size
            continue
        stack.append(node)
        articles += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Counts of every node that is not cut, children before parents; returned in that order."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [p for p in node.parts if isinstance(p, Node) and not p.cut]
    order.reverse()
    for node in order:
        chars = link_chars = tags = link_tags = prose = 0
        for p in node.parts:
            if isinstance(p, str):
                chars += sum(map(len, p.split()))
            elif not p.cut:
                chars, link_chars, prose = chars + p.chars, link_chars + p.link_chars, prose + p.prose
                tags, link_tags = tags + p.tags + 1, link_tags + p.link_tags + (p.tag == "a")
        node.chars, node.link_chars, node.tags, node.link_tags = chars, chars if node.tag == "a" else link_chars, tags, link_tags
        node.prose = chars if node.tag in _TEXTUAL else prose
    return order


def _density(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Composite density of one node; ``share`` is the body's share of characters in links."""
    if not chars:
        return 0.0
    lc, t, lt = max(link_chars, 1), max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * lc + share * chars + math.e)  # over 1, as lc is at least 1
    return chars / t * max(math.log(chars / lc * t / lt), 0.0) / math.log(base)


def _densities(order: list[Node], body: Node) -> None:
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, share)
        own = sum(sum(map(len, p.split())) for p in node.parts if isinstance(p, str))  # text of its own counts as a child
        node.total = _density(own, 0, 1, 0, share) + sum(p.density for p in node.parts if isinstance(p, Node) and not p.cut)
    for node in reversed(order):
        node.weight = (node.parent.weight if node.parent is not None else 1.0) * _WEIGHTS[node.soft] * (_ARTICLE if node.tag in ("article", "main") else 1.0)


def _menu(node: Node) -> bool:
    """A list or box that is little but links."""
    return node.link_tags >= 3 and node.link_chars * 2 > node.chars


def _part(node: Node) -> bool:
    """Whether a node is a part of a text rather than a holder of one: a paragraph, a list or table's row or cell of plain text, an inline element."""
    if node.tag in ("td", "th", "li", "dd", "blockquote", "figure", "center"):
        return not any(isinstance(p, Node) and p.tag in _BLOCK for p in node.parts)
    return node.tag not in _BLOCK or node.tag in _TEXTUAL or node.tag in ("tr", "tbody", "thead", "tfoot", "dt", "caption", "summary", "hgroup")


def _holds(node: Node) -> bool:
    """Whether a node holds text itself, not boxes alone."""
    if _part(node):
        return False
    return any(p.strip() if isinstance(p, str) else not p.cut and p.chars and _part(p) for p in node.parts)


def _chosen(root: Node) -> list[Node]:
    """The nodes that make up the article; what is soft outside them, or small inside them, stays marked."""
    order = _measure(root)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    if not body.chars:
        body = root
    _densities(order, body)
    core = max((n for n in reversed(order) if n.chars and _holds(n)), key=lambda n: (n.total * n.weight, n.chars), default=body)  # the outermost of equal ones
    path = _path(core, body)
    whole = next((n for tag in ("article", "main") for n in reversed(path) if n.tag == tag), None)
    if whole is not None:
        for node in path[: path.index(whole)]:
            node.soft = 0
        core, path = whole, _path(whole, body)
    for node in path:
        node.soft = 0
    threshold = min(n.density for n in path)
    chosen = {id(core): core}
    for node, parent in zip(path, path[1:], strict=False):
        for p in parent.parts:
            if not isinstance(p, Node) or p is node or p.cut or p.soft or not p.chars or _menu(p):
                continue
            heading = p.tag in ("h1", "h2", "h3")  # a heading beside the core is short, hence thin, and belongs to it
            box = p.tag in ("div", "section", "article") and p.density * 2 >= core.density and p.prose * 2 >= p.chars
            if heading or (p.density >= threshold and (p.tag in _TEXTUAL or box)):
                chosen[id(p)] = p
    waiting = list(chosen.values())
    while waiting:
        node = waiting.pop()
        if node.soft == 1 and node.named and 4 * (node.chars - node.link_chars) > core.chars - core.link_chars:
            node.soft = 0
        if node.soft == 3 and 4 * node.link_chars < node.chars and 2 * node.prose >= node.chars:  # prose about related things, not links to other pages
            node.soft = 0
        if not node.soft:
            waiting += [p for p in node.parts if isinstance(p, Node) and not p.cut]
    return list(chosen.values())


def _path(node: Node, body: Node) -> list[Node]:
    path = [node]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    return path


def main_text(page: str | None) -> str:
    """The article of a whole page."""
    if not page:
        return ""
    root = parse(page)
    wanted = {id(n) for n in _chosen(root)}
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    waiting: list[tuple[Node | str | None, bool]] = [(root, False)]  # None: the end of a block
    while waiting:
        node, inside = waiting.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                run.append(node)
        elif not node.cut and not node.soft:
            inside = inside or id(node) in wanted
            if node.tag == "br":
                run.append(" ")
            if node.tag in _BLOCK or id(node) in wanted:
                flush()
                waiting.append((None, inside))
            waiting += [(p, inside) for p in reversed(node.parts)]
        elif node.tag in _BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            found = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
