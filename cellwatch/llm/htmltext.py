"""Main text of HTML pages by tree scoring.

A page is read into a tree of elements; what never belongs to an article (scripts,
navigation, forms, and elements that are named or marked as menus, adverts, notices,
comments and the like) is left out.  Paragraphs pass points for their length and their
commas to their ancestors: all to the parent, half to the grandparent, a third and so
on beyond.  Points are discounted by the part of an element's text that is in links.
The best element, or the article element around it, is the container.  Kept with it are
siblings that score well, plain paragraphs, headings, lists, tables and quotations that are not mostly
links, and divisions (not other articles) with a paragraph of their own and few links.  A page whose whole text
stands in an article or main element named like something else is read without its names.

The text has one line per block, in page order: character references decoded, white
space inside a block (``<br>`` too) one space, blocks without text left out.

Defined results: a null or empty html, and a page without any text, give an empty text;
markup that never ends is read as far as it makes sense; repeated rows give a row each;
pages of any length are read whole; of elements with equal scores the first is best.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cellwatch.llm.shared import slices

#: Paragraphs with fewer characters pass no points.
LEAST_CHARACTERS = 25
#: Ancestors that a paragraph passes points to.
LEVELS = 5
#: A sibling is kept from this part of the best score on.
SIBLING_PART = 0.2
SIBLING_LEAST = 10.0

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that go with an article's paragraphs.
SUPPORT = frozenset("ul ol dl table figure details".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: An element's start ends an open element of these, up to an element of the second list.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Never part of an article.
LEFT_OUT = frozenset(
    "script style noscript template iframe object embed canvas svg math nav footer aside form button select textarea input "
    "datalist dialog menu title head audio video map search fieldset noembed noframes xmp".split())
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Parts of class names and ids.
_NAMES = re.compile(
    r"^(?:ads?|adverts?|advertis\w*|adsense|adslot|banners?|promos?|promotions?|promoted|sponsor\w*|side-?bars?|menus?|nav|navbar|"
    r"navigation|topnav|breadcrumbs?|cookies?|consent|gdpr|notices?|notifications?|alerts?|newsletter|subscribe|subscription|signup|"
    r"login|social|share|sharing|shares|comments?|commentlist|disqus|respond|replies|reply|related|recommended|recommendations?|"
    r"popups?|modal|overlay|footer|header|masthead|toolbar|widgets?|pager|pagination|skip|outbrain|taboola|copyright|disclaimer|"
    r"sharebar|tags|hidden|noprint)$")
_CONTENT = frozenset("article content post entry story main body text entry-content post-content article-content article-body".split())
_SIDES = re.compile(r"^(?:has|with|no|without|is|not)$")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_COMMAS = re.compile("[,،，、]")


class Element:
    """An element with its children: elements and texts."""

    __slots__ = ("tag", "parent", "children", "out", "score", "length", "linked", "article_level")

    def __init__(self, tag: str, parent: Element | None, out: bool = False):
        self.tag, self.parent, self.out = tag, parent, out
        self.children: list[Element | str] = []
        self.score, self.length, self.linked = 0.0, 0, 0
        if parent is not None:
            parent.children.append(self)


def _left_out(tag: str, raw: str, in_article: bool, trusted: frozenset = frozenset()) -> bool:
    """Whether an element is no part of a main text; elements of the tags ``trusted`` are not judged by their names."""
    if tag in LEFT_OUT:
        return True
    if tag == "header" and not in_article:
        return True
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").strip().lower() in LEFT_OUT_ROLES:
        return True
    if tag in ("html", "body") or tag in trusted or "articlebody" in found.get("itemprop", "").lower():
        return False
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    content = not _CONTENT.isdisjoint(names)
    for name in names:
        parts = [p for p in re.split(r"[-_:]+", name) if p]
        if not parts or _SIDES.match(parts[0]) or content and len(parts) > 1:
            continue
        # The first or the last part says what an element is: ad-slot, main-menu, but not article-header-text.
        if _NAMES.match(parts[0]) or _NAMES.match(parts[-1]) or _NAMES.match("-".join(parts)):
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "header", "p") and parts[-1] == "header":
                continue  # a heading of the article
            return True
    return False


def parse(page: str, trusted: frozenset = frozenset()) -> Element:
    """The page's tree, texts decoded; see ``_left_out`` for ``trusted``."""
    root = Element("html", None)
    here, at, size = root, 0, len(page)
    depth: dict[str, int] = {}  # open elements by tag, so that no search goes up in vain

    def leave(node: Element) -> None:
        """Close ``node`` and what is open in it."""
        nonlocal here
        while here is not node.parent:
            depth[here.tag] -= 1
            here = here.parent

    def close(tags: set[str], within: set[str]) -> None:
        if not any(depth.get(t) for t in tags):
            return
        node = here
        while node is not root and node.tag not in within:
            if node.tag in tags:
                leave(node)
                return
            node = node.parent

    def text(raw: str) -> None:
        if raw and not here.out:
            here.children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        token = _TOKEN.match(page, start)
        if token is None:
            text(page[at:start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = token.end()
        if token[2] is None:
            if token[0].startswith("<![CDATA["):
                text(token[0][9:-3] if token[0].endswith("]]>") else token[0][9:])
            continue
        tag = token[2].lower()
        if token[1]:
            node = here if depth.get(tag) else root
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag not in BLOCK:
                    node = root
                    break
                node = node.parent
            if node is not root:
                leave(node)
            elif tag == "br":
                text(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body" and here.tag == "head":
                leave(here)
            continue
        if here.tag == "head" and tag in BLOCK:
            leave(here)
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"td", "th", "table", "button", "object", "caption"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and here.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            leave(here)
        if tag == "br":
            text(" ")
            continue
        node = Element(tag, here, here.out or _left_out(tag, token[3], bool(depth.get("article")), trusted))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.end())
            at = size if at < 0 else at + 1
            continue
        if token[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        here = node
        depth[tag] = depth.get(tag, 0) + 1
    return root


def _measure(root: Element) -> list[Element]:
    """Set lengths of text and of linked text; elements in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.out:
            continue
        order.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if not isinstance(c, str) and not c.out]
        node.length = own + sum(c.length for c in inner)
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in inner)
    return order


def _density(node: Element) -> float:
    return node.linked / node.length if node.length else 0.0


def _is_paragraph(node: Element) -> bool:
    if node.tag in ("p", "pre", "td", "blockquote", "dd"):
        return True
    # A division that holds text itself stands for a paragraph.
    return node.tag in ("div", "section", "article", "main", "html", "li") and any(
        isinstance(c, str) and len(c.strip()) >= LEAST_CHARACTERS for c in node.children)


def _plain(node: Element) -> str:
    parts, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.out:
            todo.extend(reversed(item.children))
    return " ".join("".join(parts).split())


def _score(order: list[Element]) -> None:
    for node in order:
        if not _is_paragraph(node) or node.length < LEAST_CHARACTERS:
            continue
        if node.tag in ("p", "pre", "td"):
            commas, length = len(_COMMAS.findall(_plain(node))), node.length
        else:
            own = [c for c in node.children if isinstance(c, str)]
            commas, length = sum(len(_COMMAS.findall(c)) for c in own), sum(len(c.strip()) for c in own)
            if length < LEAST_CHARACTERS:
                continue
        points = 1.0 + commas + min(length / 100.0, 3.0)
        above, level = node.parent if node.tag in ("p", "pre", "td", "li") else node, 1
        while above is not None and level <= LEVELS:
            above.score += points / level
            above, level = above.parent, level + 1
    for node in order:
        node.score *= 1.0 - _density(node)


def _has_paragraph(node: Element) -> bool:
    """Whether an ordinary paragraph stands in the element."""
    todo = [node]
    while todo:
        item = todo.pop()
        if item.out:
            continue
        if _is_paragraph(item) and item.length >= LEAST_CHARACTERS:
            return True
        todo.extend(c for c in item.children if not isinstance(c, str))
    return False


def _container(order: list[Element]) -> list[Element]:
    """The best element, or the article around it, and the siblings that go with it."""
    best = max(order, key=lambda n: n.score)
    if best.score <= 0:
        named = [n for n in order if n.tag in ("article", "main")]
        return [max(named, key=lambda n: n.length)] if named else [order[0]]
    node = best
    while node is not None and node.tag != "article":
        node = node.parent
    if node is not None:
        best = node
    if best.parent is None:
        return [best]
    kept = []
    least = max(SIBLING_LEAST, best.score * SIBLING_PART)
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.out:
            continue
        density = _density(sibling)
        if sibling is best or sibling.score >= least:
            kept.append(sibling)
        elif sibling.tag in ("p", "pre", "blockquote") and sibling.length and (
                density < 0.25 if sibling.length > 80 else density == 0.0 and bool(re.search(r"[.!?。！？]\W*$", _plain(sibling)))):
            kept.append(sibling)
        elif sibling.tag in HEADINGS and density < 0.25:
            kept.append(sibling)
        elif sibling.tag in SUPPORT and sibling.length and density < 0.5:
            kept.append(sibling)
        elif sibling.tag in ("div", "section") and sibling.length >= LEAST_CHARACTERS and density < 0.25 and _has_paragraph(sibling):
            kept.append(sibling)
    return kept


def _blocks(nodes: list[Element]) -> list[str]:
    lines: list[str] = []
    parts: list[str] = []

    def end() -> None:
        line = " ".join("".join(parts).split())
        if line:
            lines.append(line)
        parts.clear()

    todo: list = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.out:
            if item.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return lines


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = _measure(parse(page))
    if not order or not order[0].length:
        # Everything stood in an article or main element with a name of something else.
        order = _measure(parse(page, frozenset(("article", "main"))))
    if not order or not order[0].length:
        return ""
    _score(order)
    return "\n".join(_blocks(_container(order)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``; columns of these names are replaced."""
    pages = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars")])
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, html)):
            texts = [main_text(p) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema.names)

    return pages.mapInArrow(work, schema)
