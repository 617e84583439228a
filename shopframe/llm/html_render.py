"""Layout-aware text of HTML pages.

A tree builder applies the implied tags of HTML (closing p, li, dt, dd, option and table parts, opening tbody and tr,
void and raw-text elements, stray end tags). Text inside svg and math is shown but for their descriptions,
definitions and annotations; a cell that spans rows keeps its columns in the rows below. A renderer walks the tree, leaves out what is not displayed (head, script,
style, template and the like, hidden, display:none, visibility:hidden, closed details and dialogs) and writes all other
text: white space collapsed outside pre, blocks on lines of their own, paragraphs and headings apart by an empty line,
list items with their bullet or number and indented, table cells aligned in columns.

Defined results: a null page gives a null text, an empty or wholly hidden one an empty text; an unclosed comment or tag
hides the rest, as in browsers; elements nested deeper than MAX_DEPTH become siblings (their text stays, and what is not shown there stays hidden),
cells longer than MAX_ALIGNED do not widen their column, lists and
tables nested deeper than MAX_LAYOUT are plain blocks; repeated rows, empty tables and extra columns pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

MAX_DEPTH = 400
MAX_LAYOUT = 60
# Cells longer than this do not widen their column.
MAX_ALIGNED = 48

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set("head script style template title iframe noembed noframes noscript object datalist audio video canvas "
             "map col colgroup param source track meta link base rp desc metadata defs annotation annotation-xml".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre "
            "search section summary table tbody td textarea tfoot th thead tr ul xmp caption".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul xmp".split())
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption option optgroup legend textarea".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "menu", "dir"}
TABLE_PARTS = {"tbody", "thead", "tfoot"}
SCOPE = {"html", "table", "td", "th", "caption", "template", "object", "button"}
KEEPS_SPACE = {"pre", "textarea", "xmp"}

START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANK = " \t\n\r\f"


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.attributes = {} if not attributes.strip(" /") else {
            name.lower(): html.unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(attributes)}
        self.children: list = []

    def hidden(self) -> bool:
        if self.tag in HIDDEN:
            return True
        a = self.attributes
        return bool(a) and ("hidden" in a or self.tag == "input" and a.get("type", "").lower() == "hidden"
                            or "style" in a and UNSEEN.search(a["style"]) is not None
                            or self.tag == "dialog" and "open" not in a) or self.tag == "dialog" and not a


class TreeBuilder:
    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.flat: list[str] = []  # tags of elements beyond MAX_DEPTH, whose children are their siblings

    def _find(self, tags, stop=SCOPE) -> int:
        """Place in the stack of the innermost open element of ``tags``, or 0 if one of ``stop`` comes first."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def _close(self, tags, stop=SCOPE) -> None:
        if at := self._find(tags, stop):
            del self.open[at:]

    def _push(self, tag: str, attributes: str = "") -> None:
        element = Element(tag, attributes)
        self.open[-1].children.append(element)
        if tag in VOID:
            return
        if len(self.open) < MAX_DEPTH or tag in RAW or element.hidden() and not self.open[-1].hidden():
            self.open.append(element)  # what is not shown is opened at any depth, so that it hides its content
        else:
            self.flat.append(tag)

    def text(self, data: str) -> None:
        if data:
            self.open[-1].children.append(data)

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body", "head") and (tag == "html" or self._find({tag}, ())):
            return
        if tag == "body" or self.open[-1].tag == "head" and tag not in HIDDEN:
            self._close({"head"}, ())
        if tag in CLOSES_P:
            self._close({"p"})
        if tag == "li":
            self._close({"li"}, SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, SCOPE | {"dl"})
        elif tag == "option":
            self._close({"option"}, SCOPE | {"select", "optgroup", "datalist"})
        elif tag == "optgroup":
            self._close({"optgroup"}, SCOPE | {"select"})
        elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag in TABLE_PARTS or tag in ("caption", "colgroup"):
            self._to_table()
        elif tag == "tr":
            self._to_table(TABLE_PARTS)
            if self.open[-1].tag == "table":
                self._push("tbody")
        elif tag in ("td", "th"):
            self._to_table({"tr"} | TABLE_PARTS)
            if self.open[-1].tag == "table":
                self._push("tbody")
            if self.open[-1].tag in TABLE_PARTS:
                self._push("tr")
        self._push(tag, attributes)

    def _to_table(self, parts=()) -> None:
        """Close all inside the innermost table, or inside the innermost of its ``parts``."""
        at = self._find({"table", *parts}, {"html", "template"})
        if at:
            del self.open[at + 1:]

    def end(self, tag: str) -> None:
        if self.flat and tag in self.flat:  # all that was opened inside it is closed as well
            while self.flat.pop() != tag:
                pass
        elif tag == "br":
            self._push("br")
        elif tag == "p" and not self._find({"p"}):
            self._push("p")
            self._close({"p"})
        elif tag in HEADINGS:
            self._close(HEADINGS)
        elif tag not in ("html", "body"):
            self._close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", *TABLE_PARTS) else {"html"})


def parse(page: str) -> Element:
    tree = TreeBuilder()
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            data = page[at:mark]
            tree.text(html.unescape(data) if "&" in data else data)
        if mark == size:
            break
        sign = page[mark + 1:mark + 2]
        if sign == "!" or sign == "?" or sign == "/" and not page[mark + 2:mark + 3].isalpha():
            comment = page.startswith("<!--", mark)
            if sign == "/" and mark + 2 >= size:
                tree.text("</")
            end = page.find("-->" if comment else ">", mark + 2)
            at = size if end < 0 else end + (3 if comment else 1)
        elif sign == "/":
            end = page.find(">", mark)
            if end < 0:
                break
            name = page[mark + 2:end].split(None, 1)
            tree.end(name[0].rstrip("/").lower())
            at = end + 1
        elif sign.isascii() and sign.isalpha():
            found = START.match(page, mark)
            if found is None:  # an attribute value that is never closed
                end = page.find(">", mark)
                if end < 0:
                    break
                tag, attributes, at = re.split(r"[\s/>]", page[mark + 1:end + 1], maxsplit=1)[0], "", end + 1
            else:
                tag, attributes, at = found[1], found[2], found.end()
            tag = tag.lower()
            tree.start(tag, attributes)
            if tag in RAW and tree.open[-1].tag == tag:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                end = close.start() if close else size
                data = page[at:end]
                tree.text(html.unescape(data) if tag in ("textarea", "title") else data)
                tree.open.pop()
                at = size if close is None else page.find(">", end) + 1 or size
        else:
            tree.text("<")
            at = mark + 1
    return tree.root


class Lines:
    """Lines of text under construction; white space collapses unless ``keep``."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = False

    def write(self, data: str, keep: bool) -> None:
        if keep:
            first, *more = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._add(first)
            for line in more:
                self.newline(True)
                self._add(line)
            return
        words = data.split()
        if not words:
            self.space = self.space or bool(data)
            return
        lead = self.space or data[0].isspace()
        self._add((" " if lead and self.now else "") + " ".join(words))
        self.space = data[-1].isspace()

    def _add(self, data: str) -> None:
        if data:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.now.append(data)

    def newline(self, always: bool = False) -> None:
        if self.now or always:
            self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap = self.gap or spaced

    def put(self, lines: list[str]) -> None:
        self.newline()
        for line in lines:
            if line:
                self._add(line)
                self.newline()
            elif self.lines and self.lines[-1]:
                self.lines.append("")

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def flow(children: list, depth: int = 0, keep: bool = False) -> list[str]:
    """Rendered lines of a run of nodes."""
    out = Lines()
    todo: list = [(c, keep) for c in reversed(children)]
    while todo:
        node, keep = todo.pop()
        if isinstance(node, str):
            out.write(node, keep)
            continue
        if isinstance(node, bool):  # the end of a block
            out.block(node)
            continue
        tag = node.tag
        if node.hidden():
            continue
        if tag == "br":
            out.newline(True)
            continue
        spaced = tag in SPACED and not (tag in LISTS and depth)
        if tag in BLOCK:
            out.block(spaced)
        if tag in LISTS and depth < MAX_LAYOUT:
            out.put(_list(node, depth + 1))
        elif tag == "table" and depth < MAX_LAYOUT:
            out.put(_table(node, depth + 1))
        else:
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Element) and c.tag == "summary"]
            if tag == "input" and node.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                children = [" ", node.attributes.get("value", ""), " "]
            if tag in BLOCK:
                todo.append((spaced, keep))
            inner = keep or tag in KEEPS_SPACE
            if tag == "pre" and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            todo.extend((c, inner) for c in reversed(children))
            if tag in ("td", "th") and depth >= MAX_LAYOUT:
                out.write(" ", False)
            continue
        if tag in BLOCK:
            out.block(spaced)
    return out.done()


def _list(node: Element, depth: int) -> list[str]:
    number = node.attributes.get("start", "1")
    number = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number) else 1
    lines: list[str] = []
    loose: list = []

    def rest():
        lines.extend(flow(loose, depth))
        loose.clear()

    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose.append(child)
            continue
        rest()
        if child.hidden():
            continue
        value = child.attributes.get("value", "")
        if re.fullmatch(r"-?[0-9]{1,9}", value):
            number = int(value)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        inside = flow(child.children, depth)
        if inside:
            lines.append(mark + inside[0])
            lines.extend(" " * len(mark) + line if line else "" for line in inside[1:])
    rest()
    return lines


def _span(cell: Element, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1")
    return min(int(value), most) if re.fullmatch(r"[1-9][0-9]{0,8}", value) else 1


def _table(node: Element, depth: int) -> list[str]:
    above: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of the cells of each row
    taken: dict[int, int] = {}  # column: rows for which a cell above still fills it
    todo = list(reversed(node.children))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            above.extend(flow([part], depth))
        elif part.hidden():
            continue
        elif part.tag in TABLE_PARTS:
            todo.extend(reversed(part.children))
        elif part.tag == "tr":
            row, column, below = [], 0, {}
            for cell in part.children:
                span = down = 1
                if isinstance(cell, Element) and cell.tag in ("td", "th"):
                    if cell.hidden():
                        continue
                    span, down = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
                    lines = flow(cell.children, depth)
                elif not (lines := flow([cell], depth)):
                    continue
                while taken.get(column):
                    column += 1
                row.append((column, span, lines))
                below.update(dict.fromkeys(range(column, column + span), down - 1))
                column += span
            taken = {c: n for c, n in {**{c: n - 1 for c, n in taken.items()}, **below}.items() if n > 0}
            rows.append(row)
        else:
            above.extend(flow([part], depth))
    widths: dict[int, int] = {}
    for row in rows:
        for column, span, cell in row:
            wide = max(map(len, cell), default=0)
            if span == 1 and wide <= MAX_ALIGNED:
                widths[column] = max(widths.get(column, 0), wide)
    lines = above
    for row in rows:
        for i in range(max((len(cell) for *_, cell in row), default=0)):
            line, next_column = [], 0
            for column, span, cell in row:
                if column > next_column:  # filled from above
                    line.append(" " * (sum(widths.get(c, 0) + 2 for c in range(next_column, column)) - 2))
                room = sum(widths.get(c, 0) + 2 for c in range(column, column + span)) - 2
                line.append((cell[i] if i < len(cell) else "").ljust(room))
                next_column = column + span
            lines.append("  ".join(line).rstrip())
    return lines


def visible_text(page: str) -> str:
    return "\n".join(flow([parse(page)]))


def with_visible_text(pages: DataFrame, html_col: str = "html", out: str = "visible_text") -> DataFrame:
    """``pages`` with the rendered text of ``html_col`` as column ``out`` (in place of a column of that name)."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if p is None else visible_text(p) for p in batch], dtype=object)

    return pages.withColumn(out, render(F.col(html_col)))
