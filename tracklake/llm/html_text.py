"""HTML extraction by layout: a tree with implied tags and visibility, rendered as the text that a page shows.

Markup becomes a tree (omitted end tags are implied, stray ones ignored, raw-text elements skipped to their end);
the tree is walked with an explicit stack, so depth is not bounded by recursion. Hidden parts are left out: head,
scripts, styles, templates, comments, ``hidden``, ``display:none``, ``visibility:hidden`` (but for what is visible
again inside). All other text is emitted, formulas and drawings' labels too: white space collapses (not in ``pre``),
blocks stand on lines of their own, paragraphs, headings, lists and tables with a blank line around, list items with a
bullet or number and indent, table cells in aligned columns, cells over several rows or columns in their places.

Each page is one row's work in an Arrow batch. Tags are read by one linear scan. A cell is padded by ``PAD`` characters
at most, so the text, and with it memory, is bounded by a multiple of the longest page.

Defined results: null or empty markup gives an empty text; text without tags is kept as a line; repeated rows get
equal results; ids may be null or repeat; other columns of the input, whatever their names, aren't looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
#: The last two rows stand in formulas and drawings.
HIDDEN = frozenset(
    "head script style title noscript template iframe noframes datalist audio video canvas object "
    "annotation annotation-xml maction-hidden "
    "defs metadata desc symbol clippath mask pattern marker lineargradient radialgradient".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu hr xmp".split())
#: ``text`` is a drawing's label.
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav search section summary tr td th thead tbody tfoot caption option optgroup select text".split())
#: An opening tag ends these open elements (inside the nearest of the third set).
_CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "select", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "text"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_SCOPE = frozenset("table td th caption button object template html".split())
_INSIDE_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: Most characters that a cell, or the empty cells before it in a line, are padded by.
PAD = 240

_TOKEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/][^>]*>)")
#: The rest of a tag. A value in quotes after ``=`` may hold ``>``; nothing is read twice, but for one open quote a kind.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|["'])?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NUMBER = re.compile(r"-?[0-9]{1,9}")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value ('' if it has none), or None."""
        if self.attributes and name in self.attributes.lower():
            for key, value in _ATTRIBUTE.findall(self.attributes):
                if key.lower() == name:
                    return html.unescape(value.strip("\"'"))
        return None

    def number(self, name: str) -> int | None:
        value = (self.get(name) or "").strip()
        return int(value) if _NUMBER.fullmatch(value) else None

    @property
    def displayed(self) -> bool:
        if self.tag in HIDDEN or (self.tag == "dialog" and self.get("open") is None):
            return False
        return not self.attributes or (self.get("hidden") is None and not _NO_DISPLAY.search(self.get("style") or ""))

    def visible(self, inherited: bool) -> bool:
        found = _VISIBILITY.search(self.get("style") or "") if self.attributes else None
        return inherited if found is None else found[1].lower() == "visible"


def parse(markup: str) -> Node:
    root = Node("#root")
    stack, at = [root], 0

    open_: Counter[str] = Counter()  # open elements by tag, so that a deep page isn't searched for what isn't open

    def cut(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(kinds: set[str] | frozenset[str], within: set[str] | frozenset[str], outermost: bool = False) -> None:
        """Ends the nearest (or the outermost) open element of the kinds inside the nearest of ``within``."""
        if not any(open_[x] for x in kinds):
            return
        low = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in kinds:
                low = k
                if not outermost:
                    break
            if stack[k].tag in within:
                break
        if low is not None:
            cut(low)

    while (m := _TOKEN.search(markup, at)) is not None:
        tag, rest = m[2], None
        if tag is not None and (rest := _REST.match(markup, m.end())) is None:
            break  # no tag ends any more
        if m.start() > at:
            stack[-1].children.append(markup[at : m.start()])
        at = m.end()
        if rest is None:
            if m[0] == "<!--":
                end = markup.find("-->", at)
                at = end + 3 if end >= 0 else len(markup)
            continue
        attributes, at, tag = markup[at : rest.end() - 1].strip(), rest.end(), tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            bound = frozenset({"table"}) if tag in _INSIDE_TABLE - {"table"} else frozenset() if tag in {"html", "body", "table"} else _SCOPE - {tag}
            close({tag}, bound)
            continue
        if tag in _CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag], outermost=True)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            cut(len(stack) - 1)
        if tag not in HIDDEN and tag not in {"base", "link", "meta"} and any(x.tag == "head" for x in stack[1:3]):
            close({"head"}, frozenset())
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(markup, at)
            if tag in {"textarea", "xmp"}:
                node.children.append(markup[at : end.start() if end else len(markup)])
            at = end.end() if end else len(markup)
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK - {"text"}):
            stack.append(node)
            open_[tag] += 1
    if at < len(markup):
        stack[-1].children.append(markup[at:].partition("<!--")[0])
    return root


class Page:
    """Text under construction: lines with indents, and how many line ends must come before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.indent, self.marker, self.open = 0, "", "", False

    def break_(self, n: int) -> None:
        if self.parts:
            self.breaks = max(self.breaks, n)
        self.open = False

    def line(self) -> None:
        """A forced line end."""
        self.breaks += 1
        self.open = False

    def text(self, text: str) -> None:
        if not self.open:
            text = text.lstrip(" ")
        elif self.parts[-1].endswith(" ") and text.startswith(" "):
            text = text[1:]
        if not text:
            return
        self._begin()
        self.parts.append(text)

    def _begin(self) -> None:
        if self.open:
            return
        if self.parts:
            self.parts[-1] = self.parts[-1].rstrip(" ")
            self.parts.append("\n" * self.breaks)
        self.breaks, self.open = 0, True
        if self.marker:
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker)
            self.marker = ""
        elif self.indent:
            self.parts.append(self.indent)

    def kept_text(self, text: str) -> None:
        """Text whose white space counts."""
        for k, line in enumerate(text.expandtabs(8).replace("\r\n", "\n").split("\n")):
            if k:
                self.line()
            if line:
                self._begin()
                self.parts.append(line)

    def result(self) -> str:
        return "".join(self.parts).strip("\n").rstrip()


#: A cell: its text, columns and rows.
Cell = tuple[str, int, int]


def _placed(rows: list[list[Cell]]) -> list[list[tuple[int, str, int]]]:
    """(first column, text, columns) of each row's cells, beside those that reach down from rows above."""
    out, down = [], []  # ``down``: (first column, end column, end row) in order of columns
    for number, row in enumerate(rows):
        down = [d for d in down if d[2] > number]
        at, k, line, new = 0, 0, [], []
        for text, columns, height in row:
            while k < len(down) and down[k][0] < at + 1:
                at, k = max(at, down[k][1]), k + 1
            line.append((at, text, columns))
            if height > 1:
                new.append((at, at + columns, number + height))
            at += columns
        down = sorted(down + new)
        out.append(line)
    return out


def _aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: columns as wide as their widest cell of one column, up to ``PAD``."""
    placed = _placed(rows)
    width: dict[int, int] = {}
    for row in placed:
        for at, text, columns in row:
            if columns == 1:
                width[at] = min(PAD, max(width.get(at, 0), *(len(x) for x in text.split("\n"))))
    known = sorted(width)
    total = [0, *accumulate(width[c] + 2 for c in known)]

    def span(a: int, b: int) -> int:
        """Characters of the columns from a to b, with the gaps between and behind them."""
        return min(PAD, total[bisect.bisect_left(known, b)] - total[bisect.bisect_left(known, a)])

    out = []
    for row in placed:
        cells = [(at, text.split("\n"), columns) for at, text, columns in row]
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line, end, blank = "", 0, 0
            for at, lines, columns in cells:
                if at > end:
                    line += " " * min(span(end, at), PAD - blank)
                    blank = min(PAD, blank + span(end, at))
                shown = lines[k] if k < len(lines) else ""
                room = max(span(at, at + columns), len(shown) + 2)
                if shown:
                    line, blank = line + shown + " " * (room - len(shown)), 0
                else:
                    line, blank = line + " " * min(room, PAD - blank), min(PAD, blank + room)
                end = at + columns
            out.append(line.rstrip())
    return out


def _cell(text: str, node: Node) -> Cell:
    columns, height = node.number("colspan"), node.number("rowspan")
    # no height: down to the table's end
    return text, min(columns, 1000) if columns and columns > 0 else 1, 65534 if height == 0 else min(height, 65534) if height and height > 0 else 1


def _first_number(node: Node) -> tuple[int, int]:
    """Of an ordered list: the first item's number and the step."""
    start, down = node.number("start"), node.get("reversed") is not None
    if start is None:
        start = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if down else 1
    return start, -1 if down else 1


def render(root: Node) -> str:
    page = Page()
    pages: list[Page] = []
    tables: list[list[list[Cell]]] = []
    lists: list[tuple[int, int] | None] = []
    shown = [True]
    kept = 0
    todo: list[tuple[bool, Node | str]] = [(True, root)]
    while todo:
        enter, node = todo.pop()
        if isinstance(node, str):
            text = html.unescape(node)
            if not shown[-1]:
                continue
            if kept:
                page.kept_text(text)
            else:
                page.text(_WHITE.sub(" ", text))
            continue
        tag = node.tag
        if enter:
            if not node.displayed:
                continue
            if tag == "br":
                page.line()
                continue
            if tag in BLOCK:
                page.break_(2 if tag in SPACED and not (tag in {"ul", "ol", "menu"} and lists) else 1)
            shown.append(node.visible(shown[-1]))
            if tag in {"ul", "ol", "menu"}:
                lists.append(_first_number(node) if tag == "ol" else None)
            elif tag == "li":
                marker = "- "
                if lists and lists[-1] is not None:
                    given = node.number("value")
                    number, step = lists[-1] if given is None else (given, lists[-1][1])
                    marker, lists[-1] = f"{number}. ", (number + step, step)
                page.indent, page.marker = page.indent + " " * len(marker), marker
                node.attributes = str(len(marker))
            elif tag in {"blockquote", "dd"}:
                page.indent += "  "
            elif tag in {"pre", "textarea", "xmp"}:
                kept += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in {"td", "th"} and tables:
                pages.append(page)
                page = Page()
            todo.append((False, node))
            children = node.children
            if tag == "mfrac":  # a fraction's two parts
                parts = [x for x in children if isinstance(x, Node)]
                children = [parts[0], "/", *parts[1:]] if len(parts) > 1 else children
            todo.extend((True, x) for x in reversed(children))
            continue
        shown.pop()
        if tag in {"ul", "ol", "menu"}:
            lists.pop()
        elif tag == "li":
            page.indent = page.indent[: len(page.indent) - int(node.attributes)]
            page.marker = ""
        elif tag in {"blockquote", "dd"}:
            page.indent = page.indent[:-2]
        elif tag in {"pre", "textarea", "xmp"}:
            kept -= 1
        elif tag in {"td", "th"} and tables:
            cell, page = page.result(), pages.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(_cell(cell, node))
        elif tag == "table":
            for line in _aligned(tables.pop()):
                page.break_(1)
                page.kept_text(line)
        if tag in BLOCK:
            page.break_(2 if tag in SPACED and not (tag in {"ul", "ol", "menu"} and lists) else 1)
    return page.result()


def visible_text(markup: str | None) -> str:
    return render(parse(markup)) if markup else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Id, text, n_chars of each page."""
    source = pages.select(pages[id_col], pages[html_col].alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                shown = [visible_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown, pa.string()), pa.array([len(x) for x in shown], pa.int64())], [id_col, "text", "n_chars"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string, n_chars long")
