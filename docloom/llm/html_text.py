"""Operator 7: visible text of web pages, laid out.

A tolerant tokenizer feeds a tree builder that opens and closes elements where
HTML implies it (paragraphs, list items, definition lists, table parts); the
builder drives a renderer that keeps block spacing, list markers with
indentation, preformatted text, and table cells aligned over spanned columns and
rows. Left out are elements that aren't displayed, with all inside them (scripts,
styles, templates, the head, form and media fallbacks, elements hidden by
attribute or style), and text that isn't visible by style, but not what is made
visible again inside it. The places of open elements are kept by name, so an
element is opened and closed in constant time, however deep the page is.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import lean

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas svg datalist noframes noembed title select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main menu nav search section summary tr caption thead tbody tfoot optgroup option".split())
ENDS_P = BLOCK - frozenset("html body dd dt li tr caption thead tbody tfoot option optgroup legend summary figcaption".split()) | frozenset(("dd", "dt", "li"))
LISTED = frozenset(["li", "dt", "dd"])
# an item's end is implied by the next one unless another block is in between
BETWEEN = BLOCK - LISTED - frozenset(["address", "div", "p"])
CLOSES = {  # an opening element ends these, up to the given borders
    "li": (frozenset(["li"]), BETWEEN),
    "dt": (frozenset(["dt", "dd"]), BETWEEN),
    "dd": (frozenset(["dt", "dd"]), BETWEEN),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{x: (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])) for x in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
}
WALLS = frozenset(["table", "td", "th", "caption", "template", "html"])  # a block's end tag doesn't reach over these
WALLS_OF = {"li": WALLS | frozenset(["ul", "ol", "menu"]), "tr": frozenset(["table"]), "thead": frozenset(["table"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"]), "table": frozenset(), "html": frozenset(), "body": frozenset()}
SPECIAL = BLOCK | WALLS | HIDDEN  # and any other's doesn't reach over these

TAG = re.compile(r"""<(?:!--(?:.*?(?:-->|\Z))|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|/?[A-Za-z][^>]*>|[!?/][^>]*>)""", re.S)
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
INDENTED = 32  # lists in lists that are indented further
COLUMNS, ROWS = 1000, 65_534  # fixed values: the most that a cell may span, by the HTML standard
GAP = re.compile(r"[ \t\n\r\f]+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def _is_hidden(name: str, attrs: dict[str, str]) -> bool:
    if name in HIDDEN or "hidden" in attrs or (name == "input" and attrs.get("type", "").lower() == "hidden") or (name == "dialog" and "open" not in attrs):
        return True
    style = attrs.get("style")
    return bool(style and NO_DISPLAY.search(style))


class _Flow:
    """Lines of the page or of one table cell."""

    __slots__ = ("lines", "now", "space", "blank")

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False

    def put(self, text: str, indent: str) -> None:
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            if indent:
                self.now.append(indent)
            self.space = False
        if self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(text)

    def end_line(self, spaced: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False
        self.blank |= spaced


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class _Page:
    """Open elements and the text so far."""

    def __init__(self):
        self.stack: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of each name
        self.special: list[int] = []  # depths of those that an inline element doesn't reach over
        self.flows = [_Flow()]
        self.tables: list[list[list[tuple[_Flow, int, int]]]] = []
        self.lists: list[list] = []  # [next number or None, marker of an item that has no text yet]
        self.marked: list[list] = []  # those of the lists that have such a marker
        self.hidden_at: int | None = None  # depth of the outermost element that isn't displayed
        self.visible = [(-1, True)]  # depths at which visibility changes, and to what
        self.pre = 0

    def _last(self, *names: str) -> int:
        """Depth of the innermost open element of these names."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _indent(self) -> str:
        if not self.lists:
            return ""
        marker = self.lists[-1][1]
        for one in self.marked:
            one[1] = ""
        self.marked.clear()
        return "  " * (min(len(self.lists), INDENTED) - 1) + (marker or "  ")

    def text(self, raw: str) -> None:
        if self.hidden_at is not None or not raw or not self.visible[-1][1]:
            return
        flow, text = self.flows[-1], html.unescape(raw) if "&" in raw else raw
        if self.pre:
            for i, line in enumerate(text.split("\n")):
                if i:
                    if flow.now:
                        flow.end_line()
                    else:
                        flow.lines.append("")
                if line:
                    flow.put(line.rstrip("\r"), "" if flow.now else self._indent())
            return
        words = GAP.sub(" ", text)
        if words == " ":
            flow.space = flow.space or bool(flow.now)
            return
        if not words:
            return
        if words[0] == " ":
            flow.space = flow.space or bool(flow.now)
            words = words[1:]
        trailing = words.endswith(" ")
        flow.put(words.rstrip(" "), "" if flow.now else self._indent())
        flow.space = trailing

    def open(self, name: str, attrs: dict[str, str]) -> None:
        if name in ENDS_P:
            self._close_up_to("p", WALLS)
        if name in CLOSES:
            ended, borders = CLOSES[name]
            while (at := self._last(*ended)) > self._last(*borders):
                self._pop_to(at)
        if name in ("td", "th") and self.tables and self._last("tr") <= self._last("table"):
            self.open("tr", {})
        if name == "br":
            if self.hidden_at is None:
                flow = self.flows[-1]
                if flow.now:
                    flow.end_line()
                elif flow.lines and flow.lines[-1]:
                    flow.lines.append("")
            return
        if name in VOID:
            if name == "hr" and self.hidden_at is None:
                self.flows[-1].end_line(True)
            return
        self.at[name].append(len(self.stack))
        if name in SPECIAL:
            self.special.append(len(self.stack))
        self.stack.append(name)
        if self.hidden_at is not None:
            return
        if _is_hidden(name, attrs):
            self.hidden_at = len(self.stack) - 1
            return
        if shown := VISIBILITY.search(attrs.get("style", "")):
            self.visible.append((len(self.stack) - 1, shown[1].lower() == "visible"))
        flow = self.flows[-1]
        if name in BLOCK:
            flow.end_line(name in SPACED and not (name in ("ul", "ol") and self.lists))
        if name in ("ul", "ol", "menu"):
            start = attrs.get("start", "1")
            self.lists.append([int(start) if start.lstrip("-").isdigit() else 1, ""] if name == "ol" else [None, ""])
        elif name == "li":
            if not self.lists:
                flow.end_line()
            else:
                top = self.lists[-1]
                top[1] = "- " if top[0] is None else f"{top[0]}. "
                self.marked.append(top)
                if top[0] is not None:
                    top[0] += 1
        elif name in ("pre", "textarea"):
            self.pre += 1
        elif name == "table":
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            cell = _Flow()
            self.tables[-1][-1].append((cell, _span(attrs, "colspan", COLUMNS), _span(attrs, "rowspan", ROWS)))
            self.flows.append(cell)
        elif name == "q":
            flow.put('"', self._indent() if not flow.now else "")

    def _close_up_to(self, name: str, walls: frozenset[str]) -> None:
        at = self._last(name)
        if at >= 0 and self._last(*(walls - {name})) < at:
            self._pop_to(at)

    def close(self, name: str) -> None:
        if name == "br":
            self.open("br", {})
        elif name == "p" and not self.at.get("p"):
            self.open("p", {})
            self._pop_to(len(self.stack) - 1)
        elif name in SPECIAL:
            self._close_up_to(name, WALLS_OF.get(name, WALLS))
        elif name not in VOID and self.at.get(name) and (not self.special or self.special[-1] < self.at[name][-1]):
            self._pop_to(self.at[name][-1])

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            name = self.stack.pop()
            self.at[name].pop()
            if name in SPECIAL:
                self.special.pop()
            if self.hidden_at is not None:
                if len(self.stack) == self.hidden_at:
                    self.hidden_at = None
                continue
            if self.visible[-1][0] == len(self.stack):
                self.visible.pop()
            if name in ("td", "th") and self.tables and len(self.flows) > 1:
                self.flows.pop().end_line()
                continue
            flow = self.flows[-1]
            if name == "table" and self.tables:
                self._lay_out(self.tables.pop())
            if name == "q":
                flow.put('"', "")
            if name in BLOCK:
                flow.end_line(name in SPACED and not (name in ("ul", "ol") and len(self.lists) > 1))
            if name in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
            elif name in ("pre", "textarea"):
                self.pre -= 1

    def _lay_out(self, rows: list[list[tuple[_Flow, int, int]]]) -> None:
        """Cells in a grid of the columns at which cells begin; a cell fills the columns and rows that it spans."""
        placed: list[list[tuple[int, int, str]]] = []  # first column, the one after the last, text
        above: list[tuple[int, int, int]] = []  # columns taken by cells of the rows above, and for how many rows more
        for row in rows:
            here, taken, column = [], iter(above), 0
            wall = next(taken, None)
            for cell, across, down in row:
                while wall and wall[0] < column + 1:
                    column, wall = max(column, wall[1]), next(taken, None)
                here.append((column, column + across, " ".join(x for x in cell.lines if x), down))
                column += across
            above = sorted([(a, b, n - 1) for a, b, n in above if n > 1] + [(a, b, down - 1) for a, b, _, down in here if down > 1])
            placed.append([x[:3] for x in here])
        placed = [row for row in placed if any(x[2] for x in row)]
        begins = sorted({x[0] for row in placed for x in row})
        index = {c: i for i, c in enumerate(begins)}
        widths = [0] * len(begins)
        wide: list[tuple[int, int, int]] = []
        for row in placed:
            for a, b, text in row:
                first, after = index[a], bisect_left(begins, b)
                if after == first + 1:
                    widths[first] = max(widths[first], _width(text))
                else:
                    wide.append((first, after, _width(text)))
        for first, after, width in wide:  # what a spanning cell needs more is given to its last column
            widths[after - 1] += max(0, width - sum(widths[first:after]) - 3 * (after - first - 1))
        flow = self.flows[-1]
        flow.end_line(True)
        for row in placed:
            line, column = [], 0
            for a, b, text in row:
                first, after = index[a], bisect_left(begins, b)
                line += [" " * w for w in widths[column:first]]
                line.append(text + " " * (sum(widths[first:after]) + 3 * (after - first - 1) - _width(text)))
                column = after
            flow.put(" | ".join(line).rstrip(" "), self._indent())
            flow.end_line()
        flow.blank = True

    def done(self) -> str:
        self._pop_to(0)
        self.flows[0].end_line()
        return "\n".join(self.flows[0].lines).strip("\n")


def render(source: str | None) -> str:
    """Visible text of a page; empty for null."""
    if not source:
        return ""
    page, at, n = _Page(), 0, len(source)
    for_tag = TAG.search
    while at < n:
        m = for_tag(source, at)
        if m is None:
            page.text(source[at:])
            break
        if m.start() > at:
            page.text(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            page.close(name)
            continue
        raw = m["attrs"]
        page.open(name, _attributes(raw))
        if name in RAW:
            m = RAW_END[name].search(source, at)
            end = m.start() if m else n
            if name in ("textarea", "title"):
                page.text(source[at:end])
            at = end
        elif raw.endswith("/") and page.stack and page.stack[-1] == name and name in ("svg", "path", "circle", "rect", "use"):
            page._pop_to(len(page.stack) - 1)
    return page.done()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), pa.array([render(x.as_py()) for x in rows.column("html")], pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) for each row of pages (page_id, html).

    Null or empty html, or a page with nothing visible: an empty text. Unclosed
    and misnested markup is rendered as far as it goes; a stray `<` is text.
    Lists in more than INDENTED lists are indented as those. Null page_id and
    repeated rows are kept. An empty table gives an empty result. Other columns
    are ignored.
    """
    return lean(pages).select("page_id", "html").mapInArrow(_render, "page_id long, text string")
