"""Layout-aware rendering of HTML to plain text.

A tokenizer cuts the source into tags, text, comments and raw-text elements; a tree builder adds implied end tags
(paragraphs, list items, table parts, options, definitions) and ignores stray ones; visibility rules drop elements
that a browser wouldn't show; the renderer lays out blocks, lists and tables:

* block elements start on a line of their own, paragraphs, headings, lists and tables with an empty line around them;
* white space is collapsed as in a browser, kept in ``pre`` and ``textarea``; ``br`` breaks the line;
* list items get ``- `` or their number, nested lists are indented by two more columns, up to ``MOST_INDENT``;
* table cells are padded to the width of their column (a spanning cell to its columns together).

Everything that is visible is emitted: navigation and advertisements too, text of drawings and formulas, what stands in
for objects, and parts that are made visible again inside ones that aren't.  Defined cases: null and empty html give an
empty text; broken markup is read as far as it goes (an unclosed tag at the end is text); repeated rows are rows of
their own; an empty table gives no rows; further columns of the input are ignored; pages are never cut, and
nesting may have any depth.
"""

from __future__ import annotations

import html as _html
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas annotation annotation-xml datalist title meta link base param source track area".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure hr xmp".split())
#: A start tag of the key ends open elements of the set, up to a boundary of the second set.
_BLOCKS_END_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp".split()
)
_SCOPE = frozenset("html body table td th caption button object template".split())
_CELLS = frozenset("td th".split())
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset(["p"]), _SCOPE) for t in _BLOCKS_END_P},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir html body table td th".split())),
    "dd": (frozenset(["dd", "dt", "p"]), frozenset("dl html body table td th".split())),
    "dt": (frozenset(["dd", "dt", "p"]), frozenset("dl html body table td th".split())),
    "td": (frozenset(["td", "th", "p", "li"]), frozenset("tr table html".split())),
    "th": (frozenset(["td", "th", "p", "li"]), frozenset("tr table html".split())),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset("tbody thead tfoot table html".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
    **{t: (frozenset("tr td th tbody thead tfoot caption colgroup".split()), frozenset("table html".split())) for t in ("tbody", "thead", "tfoot")},
}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("title meta link base script style template noscript".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a start tag; nothing is tried twice.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SHOWN = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible", re.I)
#: Of a drawing these may hold text; titles, descriptions and definitions aren't drawn.
_DRAWN = frozenset("svg g a switch".split())
_WRITTEN = frozenset("text foreignobject".split())
#: Columns of indentation; deeper parts are indented as much.
MOST_INDENT = 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        v = value[1:-1] if value[:1] in ("'", '"') else value
        out.setdefault(name.lower(), _html.unescape(v) if "&" in v else v)
    return out


class Open(list):
    """The open elements, and for each tag where it is open, so that looking for one doesn't walk over the others."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, i: int) -> None:
        """Close element ``i`` and all in it."""
        for node in self[i:]:
            self.at[node.tag].pop()
        del self[i:]

    def last(self, tags) -> int:
        """The innermost place where one of ``tags`` is open, or 0."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def first_after(self, tags, least: int) -> int | None:
        """The outermost place beyond ``least`` where one of ``tags`` is open."""
        found = [p[k] for t in tags if (p := self.at.get(t)) and (k := bisect_right(p, least)) < len(p)]
        return min(found, default=None)


def build(source: str) -> Node:
    """Element tree of a page; text nodes are strings.  One pass: work grows with the length of the page."""
    root = Node("#root")
    stack = Open(root)

    def text(s: str) -> None:
        if not s:
            return
        top = stack[-1]
        if top.tag == "head" and not s.isspace():  # text ends the head
            stack.cut(len(stack) - 1)
            top = stack[-1]
        top.children.append(_html.unescape(s) if "&" in s else s)

    at = scan = 0
    lower, raw_ends, last, unclosed = None, {}, source.rfind(">"), -1
    while at < len(source):
        lt = source.find("<", scan)
        if lt < 0:
            text(source[at:])
            break
        follows = source[lt + 1 : lt + 2]
        if source.startswith("<!--", lt):
            text(source[at:lt])
            end = source.find("-->", lt + 4)
            at = scan = len(source) if end < 0 else end + 3
        elif source.startswith("<![CDATA[", lt):
            text(source[at:lt])
            end = source.find("]]>", lt + 9)
            end = len(source) if end < 0 else end
            text(source[lt + 9 : end].replace("&", "&amp;"))
            at = scan = end + 3
        elif lt > last:  # nothing closes a tag from here on
            scan = lt + 1
        elif follows in ("!", "?"):
            text(source[at:lt])
            at = scan = source.find(">", lt) + 1
        elif follows == "/" and (m := _NAME.match(source, lt + 2)):
            text(source[at:lt])
            at = scan = source.find(">", m.end()) + 1 or len(source)
            _end(stack, m[0].lower())
        elif follows != "/" and (m := _NAME.match(source, lt + 1)):
            text(source[at:lt])
            tag, rest = m[0].lower(), None
            if lt > unclosed:
                rest = _REST.match(source, m.end())
            if rest:
                inside, at = rest[1], rest.end()
            else:  # a quote that nothing closes: the tag ends at the next bracket, and so do those before that quote
                end = source.find(">", m.end())
                unclosed = max(unclosed, source.rfind('"'), source.rfind("'")) if unclosed < 0 else unclosed
                inside, at = (source[m.end() : end], end + 1) if end >= 0 else ("", len(source))
            _start(stack, tag, attributes(inside) if inside and not inside.isspace() else {})
            if tag in RAW:
                if lower is None:
                    lower = source.lower() if source.isascii() else "".join(c.lower() if c.isascii() else c for c in source)
                if raw_ends.get(tag, at) < len(source):  # not known to have no end
                    end = lower.find(f"</{tag}", at)
                    raw_ends[tag] = end = len(source) if end < 0 else end
                else:
                    end = len(source)
                body = source[at:end]
                stack[-1].children.append(_html.unescape(body) if tag in ("textarea", "title") and "&" in body else body)
                stack.cut(len(stack) - 1)
                close = source.find(">", end)
                at = len(source) if close < 0 else close + 1
            scan = at
        else:
            scan = lt + 1
    return root


def _start(stack: Open, tag: str, attrs: dict[str, str]) -> None:
    if stack[-1].tag == "head" and tag not in _IN_HEAD:
        stack.cut(len(stack) - 1)
    ends, limit = ENDS.get(tag, (None, None))
    if ends:
        # close up to the outermost open element that this tag ends, within the innermost boundary
        cut = stack.first_after(ends, stack.last(limit - ends))
        if cut is not None:
            stack.cut(cut)
    if tag in _HEADING and stack[-1].tag in _HEADING:
        stack.cut(len(stack) - 1)
    parent = stack[-1]
    # parts of tables that the source left out
    if tag in _CELLS and parent.tag in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr")
        parent.children.append(row)
        stack.push(row)
        parent = row
    node = Node(tag, attrs)
    parent.children.append(node)
    if tag not in VOID:
        stack.push(node)


_TABLE_ENDS = frozenset("table tr td th tbody thead tfoot body html".split())


def _end(stack: Open, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    i = stack.last([tag])
    # a stray end tag doesn't leave its cell
    stray = i > 0 and tag not in _TABLE_ENDS and stack.last(("table", "td", "th")) > i
    if i and not stray:
        stack.cut(i)
    elif tag == "p" and not stray:
        stack[-1].children.append(Node("p"))


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN:
        return False
    if not a:
        return True
    if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _INVISIBLE.search(a["style"]))


class Frame:
    """An indented part: ``mark`` stands before its first line, as many spaces before the others."""

    __slots__ = ("start", "mark", "gap", "outer")

    def __init__(self, start: int, mark: str, gap: int):
        self.start, self.mark, self.gap = start, mark, gap
        self.outer: str | None = None  # the indentation around it, once its first line is out


class Lines:
    """Output lines with collapsed white space, block spacing and indented parts, in one pass."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is open
        self.space = False
        self.gap = 0  # empty lines asked for before the next text
        self.frames: list[Frame] = []
        self.waiting = 0  # how many of the last frames have no line yet
        self.indent = ""

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.parts)
            return
        if not words:
            return
        self._open()
        if (self.space or words[0] == " ") and self.parts and self.parts[-1][-1] != " ":
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words.strip(" "))

    def raw(self, s: str) -> None:
        for k, p in enumerate(s.split("\n")):
            if k:
                self._put("".join(self.parts))
                self.parts = []
            if p := p.rstrip("\r"):
                self._open()
                self.parts.append(p)

    def _begun(self) -> bool:
        """Whether the part that is open has a line."""
        return not self.waiting and len(self.lines) > (self.frames[-1].start if self.frames else 0)

    def _open(self) -> None:
        if self.parts:
            return
        if self.waiting:  # what the outermost part without a line was to be set off by
            first = self.frames[-self.waiting]
            parent = self.frames[-self.waiting - 1].start if len(self.frames) > self.waiting else 0
            self._empty_lines(first.gap, parent)
            first.gap = 0
        elif self.gap:
            self._empty_lines(self.gap, self.frames[-1].start if self.frames else 0)
        self.gap = 0

    def _empty_lines(self, n: int, start: int) -> None:
        have = 0
        if len(self.lines) > start:
            while have < n and have < len(self.lines) - start and not self.lines[-1 - have]:
                have += 1
            self.lines += [""] * (n - have)

    def _put(self, s: str, always: bool = False) -> None:
        s = s.rstrip(" ")
        if not s and not always:
            if not self.waiting:
                self.lines.append("")
            return
        if not self.waiting:
            self.lines.append(self.indent + s)
            return
        marks = [f.mark for f in self.frames[-self.waiting :]]
        self.lines.append(self.indent + "".join(marks) + s)
        for f in self.frames[-self.waiting :]:
            f.outer = self.indent
            if len(self.indent) < MOST_INDENT:
                self.indent += " " * len(f.mark)
        self.waiting = 0

    def end_line(self) -> None:
        if self.parts:
            self._put("".join(self.parts))
        self.parts, self.space = [], False

    def br(self) -> None:
        if self.parts:
            self.end_line()
        elif self._begun() and not self.gap:
            self.lines.append("")

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def push(self, mark: str) -> None:
        """From here on lines stand behind ``mark``."""
        self.end_line()
        self.frames.append(Frame(len(self.lines), mark, self.gap))
        self.waiting += 1
        self.gap = 0

    def pop(self, always: bool = False) -> None:
        """End of what ``push`` began; ``always``: a part without lines shows its mark."""
        self.end_line()
        if self.waiting and always:
            self._open()
            self._put("", True)
        frame = self.frames.pop()
        if self.waiting:
            self.waiting -= 1
            self.gap = frame.gap
            return
        while len(self.lines) > frame.start and not self.lines[-1]:
            self.lines.pop()
        self.indent, self.gap = frame.outer or "", 0

    def add(self, lines: list[str]) -> None:
        self.end_line()
        for s in lines:
            self._open()
            self._put(s)

    def done(self) -> list[str]:
        self.end_line()
        out = [s.rstrip(" ") for s in self.lines]
        first = next((k for k, s in enumerate(out) if s), len(out))
        while out and not out[-1]:
            out.pop()
        return out[first:]


def _lay(node: Node, out: Lines, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif visible(child):
            _element(child, out, depth)
        else:
            _revealed(child, out, depth)


def _revealed(node: Node, out: Lines, depth: int) -> None:
    """Descendants of an invisible element, still in the flow, that are made visible again."""
    todo = [node]
    while todo:
        n = todo.pop()
        style = n.attrs.get("style", "")
        if n is not node and _SHOWN.search(style) and visible(n):
            _element(n, out, depth)
        elif n.tag not in HIDDEN and "hidden" not in n.attrs and not _GONE.search(style) and (n is not node or _INVISIBLE.search(style)):
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def _drawing(node: Node, out: Lines, depth: int) -> None:
    """The text of a drawing, each piece on its own."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in _WRITTEN:
            out.space = out.space or bool(out.parts)
            _lay(n, out, depth)
            out.space = out.space or bool(out.parts)
        elif n.tag in _DRAWN:
            todo += [c for c in reversed(n.children) if isinstance(c, Node) and visible(c)]


def _flat(node: Node, depth: int) -> list[str]:
    inner = Lines()
    _lay(node, inner, depth)
    return inner.done()


def _element(node: Node, out: Lines, depth: int) -> None:
    tag = node.tag
    if tag == "br":
        out.br()
    elif tag == "svg":
        _drawing(node, out, depth)
    elif tag == "hr":
        out.block(1)
    elif tag in ("pre", "textarea", "xmp", "listing"):
        out.block(1)
        body = _raw(node)
        out.raw(body.removeprefix("\n"))
        out.block(1)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.block(0 if depth else 1)
        _list(node, out, depth)
        out.block(0 if depth else 1)
    elif tag == "table":
        out.block(1)
        _table(node, out, depth)
        out.block(1)
    elif tag == "img":
        if node.attrs.get("alt", "").strip():
            out.text(node.attrs["alt"])
    elif tag == "input":
        kind = node.attrs.get("type", "text").lower()
        if kind not in ("checkbox", "radio", "password", "image", "file") and node.attrs.get("value"):
            out.text(" " + node.attrs["value"] + " ")
    elif tag == "details" and "open" not in node.attrs:
        out.block(0)
        for child in node.children:  # closed: only its summary shows
            if isinstance(child, Node) and child.tag == "summary" and visible(child):
                _lay(child, out, depth)
        out.block(0)
    elif tag == "dd":
        out.block(0)
        out.push("  ")
        _lay(node, out, depth)
        out.pop()
    elif tag == "blockquote":
        out.block(1)
        out.push("  ")
        _lay(node, out, depth)
        out.pop()
        out.block(1)
    elif tag in BLOCK:
        gap = 1 if tag in SPACED else 0
        out.block(gap)
        _lay(node, out, depth)
        out.block(gap)
    else:
        _lay(node, out, depth)


def _raw(node: Node) -> str:
    out, todo = [], node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif visible(c):
            todo += c.children[::-1]
    return "".join(out)


def _list(node: Node, out: Lines, depth: int) -> None:
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif not visible(child):
            continue
        elif child.tag == "li":
            value = child.attrs.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                number = int(value)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.push(mark)
            _lay(child, out, depth + 1)
            out.pop(always=True)
        else:
            _element(child, out, depth + 1)


def _span(cell: Node, name: str) -> int:
    v = cell.attrs.get(name, "1").strip()
    return min(max(int(v), 1), 1000) if re.fullmatch(r"\d{1,6}", v) else 1


def _table(node: Node, out: Lines, depth: int) -> None:
    rows: list[list[Node]] = []

    def gather(n: Node) -> None:
        for child in n.children:
            if isinstance(child, str):
                if not child.isspace():
                    out.text(child)  # text outside of cells comes before the table
            elif not visible(child):
                continue
            elif child.tag == "tr":
                rows.append([c for c in child.children if isinstance(c, Node) and c.tag in _CELLS and visible(c)])
                for c in child.children:
                    if isinstance(c, str) and not c.isspace():
                        out.text(c)
                    elif isinstance(c, Node) and c.tag not in _CELLS and visible(c):
                        _element(c, out, depth)
            elif child.tag in ("tbody", "thead", "tfoot"):
                gather(child)
            elif child.tag not in ("col", "colgroup"):
                _element(child, out, depth)
                out.end_line()

    gather(node)
    out.end_line()
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row (first column, columns, lines)
    held: list[tuple[int, int, int]] = []  # (first column, end, first free row) of cells from rows above, by column
    for r, cells in enumerate(rows):
        held = [x for x in held if x[2] > r]
        placed, new, c, k = [], [], 0, 0
        for cell in cells:
            while k < len(held) and held[k][0] <= c:
                c = max(c, held[k][1])
                k += 1
            wide, high = _span(cell, "colspan"), min(_span(cell, "rowspan"), len(rows) - r)
            if high > 1:
                new.append((c, c + wide, r + high))
            placed.append((c, wide, _flat(cell, depth)))
            c += wide
        if new:
            held = sorted(held + new)
        grid.append(placed)
    columns = max((c + wide for placed in grid for c, wide, _ in placed), default=0)
    width = np.zeros(columns + 1, np.int64)
    for placed in grid:
        for c, wide, lines in placed:
            if wide == 1:
                width[c] = max(width[c], *map(len, lines or [""]))
    for placed in grid:  # a spanning cell widens its last column if it must
        for c, wide, lines in placed:
            if wide > 1 and lines:
                own = width[c : c + wide]
                more = max(map(len, lines)) - int(own.sum()) - 2 * int((own[:-1] > 0).sum())  # empty columns take no room
                if more > 0:
                    width[c + wide - 1] += more
    left = np.cumsum(np.where(width > 0, width + 2, 0)) - np.where(width > 0, width + 2, 0)
    for placed in grid:
        for k in range(max((len(x[2]) for x in placed), default=0)):
            line = ""
            for c, _, lines in placed:
                if k < len(lines) and lines[k]:
                    line = line.ljust(int(left[c])) + lines[k]
            out.add([line])


def render(source: str) -> str:
    """All visible text of a page, laid out."""
    # at most two elements a tag and four calls a level; they take no C stack
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * source.count("<") + 1000))
    out = Lines()
    _lay(build(source), out, 0)
    return "\n".join(out.done())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        page, source = b.column("page_id"), b.column("html")
        for lo in range(0, b.num_rows, 500):
            texts = [render(x.as_py() or "") for x in source.slice(lo, 500)]
            yield pa.RecordBatch.from_arrays([page.slice(lo, 500), pa.array(texts, pa.string())], names=["page_id", "text"])


def render_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_render, "page_id long, text string")


def op4_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
