"""HTML to text, rendered by layout.

A tree is built with implied end tags (paragraphs, list items, definitions, table parts, options), void elements, and
end tags that close up to their partner or are ignored. What a browser shows is emitted, all of it: not heads, scripts,
styles, templates, comments, and elements that are hidden by attribute or inline style. Blocks stand on lines of their
own, with blank lines where margins would be; white space collapses outside ``pre``; list items get bullets or numbers,
indented by depth; table cells are padded to the width of their column, with spans over columns and rows counted.
Rules of style sheets are not applied. Drawings show the text elements in them, a line each, formulas their characters in order, button inputs their values.

Null and empty pages give an empty text; broken markup never fails; trees may be of any depth (only white space is
bounded: lines are indented by at most ``INDENT``, or nested lists would take space quadratic in the page), in linear
time but for tables within tables, whose lines are laid out once a level; rows repeat freely; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDENT = 600
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript datalist audio video canvas iframe object".split())
#: What is not shown inside of drawings and formulas.
UNSEEN = {"svg": frozenset("defs desc metadata symbol clippath mask marker pattern".split()), "math": frozenset(("annotation", "annotation-xml"))}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
#: Open elements that a start tag ends, and the elements that shield what is outside of them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
}
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


#: A tag: names, and values after ``=``. A quote elsewhere is part of a name; no group is tried twice, so time is linear.
_TAG = re.compile(r"""</?[a-zA-Z][^\s/>]*+(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}


class TreeBuilder:
    """Tags, text and character references of a page, in time linear in its length, to a tree."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a tag are

    def feed(self, page: str) -> None:
        at = 0
        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            nxt = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                self._text(page[at:lt])
                if end < 0:
                    return
                at = end + 3
            elif nxt in ("!", "?") or (nxt == "/" and not page[lt + 2 : lt + 3].isalpha()):
                self._text(page[at:lt])
                end = page.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            elif nxt and (nxt == "/" or (nxt.isascii() and nxt.isalpha())) and _NAME.match(page, lt):
                self._text(page[at:lt])
                close = page.find(">", lt)
                if close < 0:
                    return  # a tag that never ends shows nothing
                whole = _TAG.match(page, lt)
                at = self._tag(page, lt, whole.end() if whole else close + 1)
            else:
                self._text(page[at : lt + 1])
                at = lt + 1

    def _tag(self, page: str, lt: int, end: int) -> int:
        name = _NAME.match(page, lt)
        tag = name[1].lower()
        if page[lt + 1] == "/":
            self.handle_endtag("#text" if tag == "text" and self.places.get("#text") else tag)
            return end
        attrs: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(page, name.end(), max(name.end(), end - 1)):
            attrs.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
        foreign = next((t for t in UNSEEN if self.places.get(t)), "svg" if tag == "svg" else "math" if tag == "math" else "")
        if foreign and tag in BLOCK and not any(self.places.get(t) for t in ("foreignobject", "desc", "annotation-xml")):
            self._close(set(UNSEEN), set())  # blocks end drawings and formulas
        elif foreign and tag not in VOID and tag not in BLOCK and page[end - 2] == "/":
            return end  # ``<path/>`` holds nothing
        if foreign and tag in UNSEEN[foreign]:
            attrs["hidden"] = ""
        self.handle_starttag("#text" if foreign == "svg" and tag == "text" else tag, attrs)
        if tag in RAW:
            stop = RAW[tag].search(page, end)
            inner = page[end : stop.start() if stop else len(page)]
            self._text(inner, tag in ("title", "textarea"))
            return stop.start() if stop else len(page)
        return end

    def _text(self, data: str, refs: bool = True) -> None:
        if data:
            self.handle_data(unescape(data) if refs and "&" in data else data)

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def _close(self, tags: set[str], shields: set[str]) -> None:
        shield = self._last(shields)
        while (at := self._last(tags)) > shield:
            self._cut(at)

    def handle_starttag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag not in IN_HEAD and tag != "html" and any(n.tag == "head" for n in self.open[:3]):
            self._close({"head"}, set())
        if tag in BLOCK:
            self._close({"p"}, {"td", "th", "table", "li", "button", "div", "section", "article", "blockquote"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in ("html", "body") and self.places.get(tag):
            return
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", {})
        at = self._last({tag})
        if at and (tag in ("body", "html") or at >= self._last({"table"})):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        if any(n.tag == "head" for n in self.open[:3]) and self.open[-1].tag in ("head", "html") and data.strip():
            self._close({"head"}, set())
        self.open[-1].children.append(data)


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return True
    if node.tag == "input" and (node.attrs.get("type") or "").strip().lower() not in ("submit", "reset", "button"):
        return True
    if node.tag == "dialog" and "open" not in node.attrs:
        return True
    return bool(_GONE.search(node.attrs.get("style") or ""))


class Layout:
    """Lines of text in the making."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.blank, self.pending, self.indent, self.mark = "", 0, False, "", ""

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *more = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in more:
                self.line(True)
                self._add(line)
            return
        words = [w for w in _SPACES.split(data) if w]
        if not words:
            self.pending = self.pending or bool(data and self.now)
            return
        lead = (self.pending or data[0] in " \t\n\r\f") and bool(self.now) and not self.now.endswith(" ")
        self._add((" " if lead else "") + " ".join(words))
        self.pending = data[-1] in " \t\n\r\f"

    def _add(self, piece: str) -> None:
        if piece and not self.now and self.blank:
            if self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
        self.now += piece

    def line(self, even_empty: bool = False) -> None:
        if self.now.strip() or even_empty:
            lead = self.indent
            if self.mark:
                lead = self.indent[: max(0, len(self.indent) - len(self.mark))] + self.mark
                self.mark = ""
            self.lines.append((lead + self.now).rstrip())
        self.now, self.pending = "", False

    def gap(self, blank: int) -> None:
        self.line()
        self.blank = max(self.blank, blank)

    def finish(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


#: A step of rendering: it yields the steps that it waits for, so that no depth of the tree is too much for Python's stack.
Step = Iterator["Step"]


def _run(step: Step) -> None:
    stack = [step]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, out: Layout, kept: bool, depth: int) -> Step:
    for child in node.children:
        if isinstance(child, str):
            out.text(child, kept)
        elif not hidden(child):
            yield _element(child, out, kept, depth)


def _element(node: Node, out: Layout, kept: bool, depth: int) -> Step:
    tag = node.tag
    if tag == "br":
        out.line(True)
    elif tag == "hr":
        out.gap(0)
        out.text("----", False)
        out.gap(0)
    elif tag == "img":
        out.text(node.attrs.get("alt") or "", False)
    elif tag == "input":
        out.text(node.attrs.get("value") or "", False)
    elif tag == "#text":
        out.gap(0)
        yield _render(node, out, kept, depth)
        out.gap(0)
    elif tag == "wbr":
        return
    elif tag == "table":
        out.gap(1)
        lines: list[str] = []
        yield _table(node, lines)
        for line in lines:
            out.text(line, True)
            out.line(True)
        out.gap(1)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.gap(1 if depth == 0 else 0)
        n = int(node.attrs.get("start") or 1) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start") or "1") else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and not hidden(child):
                mark = f"{n}. " if tag == "ol" else "- "
                n += 1
                out.gap(0)
                before, out.indent, out.mark = out.indent, (out.indent + " " * len(mark))[:INDENT], mark
                yield _render(child, out, kept, depth + 1)
                out.gap(0)
                out.indent, out.mark = before, ""
            elif isinstance(child, str):
                out.text(child, kept)
            elif not hidden(child):
                yield _element(child, out, kept, depth + 1)
        out.gap(1 if depth == 0 else 0)
    elif tag in BLOCK:
        out.gap(1 if tag in SPACED else 0)
        before = out.indent
        if tag in ("blockquote", "dd"):
            out.indent = (out.indent + "    ")[:INDENT]
        yield _render(node, out, kept or tag == "pre", depth)
        out.gap(1 if tag in SPACED else 0)
        out.indent = before
    else:
        yield _render(node, out, kept or tag == "textarea", depth)


def _number(cell: Node, name: str) -> int:
    found = cell.attrs.get(name) or ""
    return int(found) if re.fullmatch("[0-9]{1,5}", found) else 1


def _table(node: Node, out: list[str]) -> Step:
    """Adds the lines of a table to ``out``: rows of cells, each padded to its column's width."""
    rows: list[list[tuple[list[str], int]]] = []
    lead, tail = [], []
    held: list[tuple[int, int, int]] = []  # columns that cells of rows above take, and the row where that ends

    def collect(part: Node) -> Step:
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    lead.append(" ".join(child.split()))
            elif hidden(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                held.clear()
                yield collect(child)
                held.clear()
            elif child.tag == "tr":
                cells, stray, coming, at, k = [], [], [], 0, 0
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        if not hidden(cell):
                            inner = Layout()
                            yield _render(cell, inner, False, 0)
                            free = at
                            while k < len(held) and held[k][0] <= free:
                                free = max(free, held[k][1])
                                k += 1
                            if free > at:
                                cells.append(([""], free - at))
                            span, down = min(1000, max(1, _number(cell, "colspan"))), _number(cell, "rowspan")
                            cells.append((inner.finish().split("\n"), span))
                            at = free + span
                            if down != 1:
                                coming.append((free, at, len(rows) + down if down else 1 << 60))
                    else:
                        stray.append(cell)
                held[:] = sorted(h for h in [*held, *coming] if h[2] > len(rows) + 1)
                rest = Node("#stray", {})
                rest.children = stray
                yield _inner(rest, lead)
                rows.append(cells)
            else:
                rest = Node("#stray", {})
                rest.children = [child]
                yield _inner(rest, tail if child.tag == "tfoot" else lead)

    yield collect(node)
    width: dict[int, int] = {}
    for cells in rows:
        at = 0
        for lines, span in cells:
            if span == 1:
                width[at] = max(width.get(at, 0), *(len(x) for x in lines))
            at += span
    wide = [(span, at, max(len(x) for x in lines)) for cells in rows for at, (lines, span) in zip(accumulate((c[1] for c in cells), initial=0), cells) if span > 1]
    for span, at, need in sorted(wide):  # a wide cell that does not fit widens the last of its columns
        room = sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
        if need > room:
            width[at + span - 1] = width.get(at + span - 1, 0) + need - room
    out += lead
    for cells in rows:
        for k in range(max((len(lines) for lines, _ in cells), default=0)):
            at, pieces = 0, []
            for lines, span in cells:
                room = sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                pieces.append((lines[k] if k < len(lines) else "").ljust(room))
                at += span
            out.append("  ".join(pieces).rstrip())
    out += tail


def _inner(node: Node, out: list[str]) -> Step:
    inner = Layout()
    yield _render(node, inner, False, 0)
    text = inner.finish()
    out += text.split("\n") if text else []


def visible_text(html: str | None) -> str:
    builder = TreeBuilder()
    builder.feed(html or "")
    out = Layout()
    _run(_render(builder.root, out, False, 0))
    return out.finish()


def extract_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([visible_text(p) for p in pages], dtype="object")

    return run(html)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select("page_id", extract_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
