"""Layout-aware HTML rendering: the visible text of a page, as a reader sees it.

The tree builder implies missing tags. Rendering walks the tree once, with a stack and not recursion: blocks start on a new line, those with a margin
after a blank line; lists are marked and indented; a table cell keeps its lines (blocks, lists, preformatted text, tables), each padded to aligned
columns, whatever it spans; white space collapses but in preformatted text. Not visible are head, scripts, styles, templates, embedded documents and media, elements with ``hidden`` or ``display:none``,
text under ``visibility:hidden`` (but for descendants that are ``visibility:visible`` again), closed dialogs, closed details but for their summary, hidden inputs, annotations in math, and titles,
descriptions and definitions in svg; everything else is emitted, wherever it stands on the page, and so is what an object holds in place of what it would load.

Cases: a null page renders as null, an empty one as the empty text, an empty table as an empty one; repeated rows are each rendered; broken markup is read as far as it goes (an open tag, comment or quote
ends with the page); tables nested deeper than ``TABLE_DEPTH`` are rendered as blocks; parts of a fraction, cells of a
math table and texts of an svg are parted by a space, and what an svg repeats by ``use`` is not repeated; extra columns pass through, but for one named like the output.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslake.functions.htmltree import Node, build
from corpuslake.llm.common import map_added, need

# Classes of elements by their usual display.
INVISIBLE = frozenset("head title script style template noscript iframe embed audio video canvas datalist noframes noembed param source track".split())
#: Parts of math and svg that aren't rendered where they stand.
UNSEEN = {"math": frozenset("annotation annotation-xml".split()), "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker".split())}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu dir table figure fieldset hr details xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot td th".split()
)
TABLE_DEPTH = 6
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def hidden(x: Node) -> bool:
    if x.tag in INVISIBLE or "hidden" in x.attrs or x.tag == "dialog" and "open" not in x.attrs or x.tag == "input" and x.attrs.get("type", "").lower() == "hidden":
        return True
    if x.foreign and x.tag in UNSEEN[x.foreign]:
        return True
    if x.parent is not None and x.parent.tag == "details" and "open" not in x.parent.attrs and x.tag != "summary":
        return True
    style = x.attrs.get("style")
    return bool(style and _HIDDEN.search(style))


def shown(x: Node, above: bool) -> bool:
    """Whether text of an element is visible, given whether its parent's is."""
    style = x.attrs.get("style")
    said = _VISIBILITY.findall(style) if style else None
    return said[-1].lower() == "visible" if said else above


def parted(x: Node) -> bool:
    """Whether an element of math or svg stands apart from what is beside it."""
    return bool(x.foreign) and (x.tag in ("mtd", "text") or x.parent is not None and x.parent.tag == "mfrac")


def width(s: str) -> int:
    """Columns that a text takes."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines so far, the line at hand, and how much space is due before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.due, self.space, self.indent, self.marker = 0, False, 0, ""

    def say(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if flat.startswith(" "):
            self.space = self.space or bool(self.line)
            flat = flat[1:]
        if not flat:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = flat.endswith(" ")
        self.line.append(flat.rstrip(" ") if self.space else flat)

    def end(self, gap: int) -> None:
        """Finish the line at hand; leave at least gap - 1 blank lines before the next."""
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False
        self.due = max(self.due, gap)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * (self.due - 1)
        self.lines.append(" " * max(0, self.indent - len(self.marker)) + self.marker + line if self.marker else " " * self.indent + line)
        self.due, self.marker = 1, ""


def _number(value: str | None, default: int) -> int:
    try:
        return int(value or "")
    except ValueError:
        return default


def _rows(table: Node) -> list[Node]:
    """Rows of a table itself, headers first and footers last."""
    groups: dict[str, list[Node]] = {"caption": [], "thead": [], "": [], "tfoot": []}
    stack = [(c, "") for c in reversed(table.children)]
    while stack:
        x, group = stack.pop()
        if isinstance(x, str):
            if x.strip():
                groups[group].append(Node("tr", {}, table))
                groups[group][-1].children.append(x)
        elif hidden(x) or x.tag in ("colgroup", "col"):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            stack += [(c, x.tag if x.tag in groups else "") for c in reversed(x.children)]
        elif x.tag == "caption":
            groups["caption"].append(x)
        elif x.tag == "tr":
            groups[group].append(x)
        else:
            groups[group].append(Node("tr", {}, table))
            groups[group][-1].children.append(x)
    return [*groups["caption"], *groups["thead"], *groups[""], *groups["tfoot"]]


def _table(page: Page, table: Node, depth: int, seen: bool) -> None:
    grid: list[list[tuple[list[str], int]]] = []  # of each cell its lines and how many columns it spans
    taken: dict[int, int] = {}  # columns that cells of earlier rows still take, and for how many rows
    for row in _rows(table):
        group = row.parent if row.parent is not None and row.parent is not table else None
        visible = shown(row, shown(group, seen) if group is not None else seen)
        if row.tag == "caption":
            for line in _render(row, depth + 1, visible):
                page.put(line)
            continue
        cells, column = [], 0
        own: dict[int, int] = {}
        for c in row.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                lines, span, down = [_SPACE.sub(" ", c).strip()] if visible else [], 1, 1
            elif hidden(c):
                continue
            else:
                if c.tag not in ("td", "th"):  # the root of a rendering has no display of its own
                    cell = Node("td", {}, row)
                    cell.children.append(c)
                    c = cell
                lines = _trimmed(_render(c, depth + 1, shown(c, visible)))
                span, down = max(1, min(1_000, _number(c.attrs.get("colspan"), 1))), max(1, min(65_534, _number(c.attrs.get("rowspan"), 1)))
            while taken.get(column, 0):
                cells.append(([], 1))
                column += 1
            cells.append((lines, span))
            if down > 1:
                own |= {column + k: down for k in range(span)}
            column += span
        taken = {k: v - 1 for k, v in taken.items() if v > 1} | {k: v - 1 for k, v in own.items()}
        grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        at = 0
        for lines, span in cells:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], max(map(width, lines), default=0))
            at += span
    for cells in grid:
        if not any(lines for lines, _ in cells):
            continue
        at, wanted, end = 0, 0, 0
        placed: list[tuple[int, list[str]]] = []  # of each cell with text the column of characters that its lines start at
        for lines, span in cells:
            if lines:
                placed.append((max(wanted, end + 2) if placed else wanted, lines))
                end = placed[-1][0] + max(map(width, lines))
            wanted += sum(widths[at : at + span]) + 2 * span
            at += span
        for k in range(max(len(lines) for _, lines in placed)):
            line = ""
            for start, lines in placed:
                if k < len(lines) and lines[k]:
                    line += " " * (start - width(line)) + lines[k]
            page.put(line)


def _trimmed(lines: list[str]) -> list[str]:
    """Lines without the blank ones at both ends."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [x.rstrip() for x in lines[full[0] : full[-1] + 1]] if full else []


def _render(root: Node, depth: int = 0, seen: bool = True) -> list[str]:
    page = Page()
    lists: list[int | None] = []  # of each open list the next number, or None for bullets
    pre = 0
    stack: list = [(root, False, seen)]  # what comes next, whether it is left then, whether its text is visible
    while stack:
        x, leaving, seen = stack.pop()
        if isinstance(x, str):
            if not seen:
                continue
            if pre:
                first, *rest = x.expandtabs(8).replace("\r\n", "\n").split("\n")
                if first:
                    page.line.append(first)
                for line in rest:
                    page.put("".join(page.line).rstrip())
                    page.line = [line] if line else []
            else:
                page.say(x)
            continue
        tag = x.tag
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > leaving) else 1
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if parted(x):
                page.say(" ")
                continue
            page.end(gap)
            if tag == "li":
                page.indent -= 4 if lists and lists[-1] is not None else 2
                page.marker = ""
            elif tag in ("dd", "blockquote"):
                page.indent -= 4 if tag == "dd" else 2
            elif tag in ("pre", "xmp"):
                pre -= 1
            continue
        if x is not root and hidden(x):
            continue
        if x is not root:
            seen = shown(x, seen)
        if tag == "br":
            if page.line:
                page.end(1)
            else:
                page.due = max(page.due, 2) if page.lines else 0
            continue
        if tag in ("img", "input", "area"):
            if seen and tag == "input" and x.attrs.get("type", "").lower() in ("submit", "button", "reset", "") and x.attrs.get("value"):
                page.say(x.attrs["value"])
            continue
        if tag == "table" and depth < TABLE_DEPTH and x is not root:
            page.end(2)
            _table(page, x, depth, seen)
            page.due = 2
            continue
        if parted(x) and x is not root:
            page.say(" ")
            stack.append((x, True, seen))
        elif tag in BLOCK and x is not root:
            page.end(gap)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(_number(x.attrs.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                number = lists[-1] if lists else None
                if number is not None:
                    number = _number(x.attrs.get("value"), number)
                    lists[-1] = number + 1
                page.marker = "- " if number is None else f"{number}. "
                page.indent += 2 if number is None else 4
            elif tag in ("dd", "blockquote"):
                page.indent += 4 if tag == "dd" else 2
            elif tag in ("pre", "xmp"):
                pre += 1
                if x.children and isinstance(x.children[0], str) and x.children[0].startswith("\n"):
                    x.children[0] = x.children[0][1:]
            if tag != "hr":
                stack.append((x, True, seen))
        closed = tag == "details" and "open" not in x.attrs
        stack += [(c, False, seen) for c in reversed(x.children) if not (closed and isinstance(c, str))]
    page.end(1)
    return page.lines


def render(source: str) -> str:
    return "\n".join(x.rstrip() for x in _render(build(source))).strip("\n")


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Append ``out string``: the rendered page."""
    need(df, html)
    return map_added(df, [html], f"`{out}` string", lambda c: [pa.array([None if x is None else render(x) for x in c.to_pylist()], pa.string())])
