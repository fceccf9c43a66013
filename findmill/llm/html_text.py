"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findmill.llm.common import small_batches

# Fixed values of HTML: element classes and which start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title meta link object audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote hr figure fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre search section table ul".split())
#: start tag: (open elements it ends, elements at which the search stops)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Start tags that leave a head open; any other one, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Start tags that end an open svg, parts of an svg that are not drawn where they stand, and those that hold text.
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split())
SVG_UNSEEN = frozenset("clippath defs desc lineargradient marker mask metadata pattern radialgradient symbol".split())
SVG_TEXT = frozenset("foreignobject text".split())
#: An end tag does not reach over these.
WALLS = frozenset("table td th caption html template".split())

#: Elements deeper than this become siblings; cells wider than this do not widen their column.
DEPTH, COLUMN = 512, 40

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<close>>|\Z)"
    r"|<(?P<open>/?[A-Za-z])[^>]*>?|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def build_tree(html: str) -> Node:
    """Element tree of a page; elements that HTML lets authors leave open are closed where it says so."""
    root = Node("#root")
    stack = [root]

    def close(tags: set[str] | frozenset[str], stops) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                return
            if stack[k].tag in tags:
                del stack[k:]
                # a cell, its row and its section may all have to end
                return close(tags, stops)

    def leave_head() -> None:
        while stack[-1].tag == "head":
            stack.pop()

    def say(text: str) -> None:
        if stack[-1].tag == "head" and not text.isspace():
            leave_head()
        stack[-1].children.append(text)

    at, n, drawn = 0, len(html), False
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            say(unescape(html[at:]))
            break
        if m.start() > at:
            say(unescape(html[at:m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                leave_head()
                stack[-1].children.append(Node("br"))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                        break
            continue
        if tag not in IN_HEAD:
            leave_head()
        if drawn and tag in ENDS_SVG:
            close({"svg"}, {"foreignobject", "desc"})
        drawn = drawn or tag == "svg"
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "li", "div", "table", "button", "object"})
        node = Node(tag, _attributes(m["attrs"]))
        stack[-1].children.append(node)
        if tag in RAW and not (drawn and m["attrs"].rstrip().endswith("/") and any(e.tag == "svg" for e in stack)):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            text = html[at:end.start() if end else n]
            node.children.append(unescape(text.removeprefix("\n")) if tag in ("textarea", "title") else text)
            at = n if not end else (html.find(">", end.end()) + 1 or n)
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/") or tag in BLOCK and tag != "hr":
            if len(stack) < DEPTH:
                stack.append(node)
    return root


def _visible(node: Node) -> bool:
    a = node.attrs
    return node.tag not in HIDDEN and "hidden" not in a and not (node.tag == "input" and a.get("type", "").lower() == "hidden") and not _UNSEEN.search(a.get("style", "")) and not (node.tag == "dialog" and "open" not in a)


class _Lines:
    """Text under construction: lines, the gap owed before the next one, and the indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._add(first)
            for part in rest:
                self.flush(force=True)
                self._add(part)
            return
        s = _SPACE.sub(" ", s)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        self._add(s)

    def _add(self, s: str) -> None:
        if s:
            self.line.append(s)

    def flush(self, force: bool = False) -> None:
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s or force:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.lines.append((self.indent[:len(self.indent) - len(self.marker)] + self.marker + s) if self.marker else self.indent + s if s else "")
            self.gap, self.marker = 0, ""

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def _cells(table: Node):
    """(caption nodes, rows of (text, span)) of a table; cells of nested tables stay in theirs."""
    captions, rows, work = [], [], list(reversed(table.children))
    loose: list = []
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif not _visible(x):
            continue
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag == "tr":
            row = []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if _visible(c):
                        span = c.attrs.get("colspan", "1")
                        row.append((" ".join(render(c).split()), min(int(span), 1000) if span.isdigit() and int(span) else 1))
                elif isinstance(c, Node) or c.strip():
                    loose.append(c)
            rows.append(row)
        elif x.tag in ("tbody", "thead", "tfoot"):
            work.extend(reversed(x.children))
        elif x.tag not in ("colgroup", "col"):
            loose.append(x)
    return captions, loose, [r for r in rows if any(t for t, _ in r)]


def _table(out: _Lines, node: Node) -> None:
    captions, loose, rows = _cells(node)
    for extra in (*loose, *captions):
        _walk(out, [extra], False)
        out.block(1)
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1 and len(text) <= COLUMN:
                widths[at] = max(widths.get(at, 0), len(text))
            at += span
    for row in rows:
        at, parts = 0, []
        for text, span in row:
            parts.append(text.ljust(sum(widths.get(k, 0) for k in range(at, at + span)) + 3 * (span - 1)))
            at += span
        out.line = [" | ".join(parts)]
        out.flush()


def _svg(out: _Lines, node: Node, keep: bool) -> None:
    """Text of a drawing; characters outside its text elements are not drawn."""
    for x in node.children:
        if isinstance(x, str) or not _visible(x) or x.tag in SVG_UNSEEN:
            continue
        if x.tag in SVG_TEXT:
            out.block(1)
            _walk(out, x.children, keep)
            out.block(1)
        else:
            _svg(out, x, keep)


def _walk(out: _Lines, children: list, keep: bool) -> None:
    for x in children:
        if isinstance(x, str):
            out.text(x, keep)
            continue
        if not _visible(x):
            continue
        tag = x.tag
        if tag == "br":
            out.flush(force=True)
            continue
        if tag == "hr":
            out.block(2)
            continue
        if tag == "svg":
            _svg(out, x, keep)
            continue
        if tag not in BLOCK:
            _walk(out, x.children, keep or tag == "textarea")
            continue
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and out.indent) else 1
        out.block(gap)
        if tag == "table":
            _table(out, x)
        elif tag in ("ul", "ol", "menu"):
            number = int(x.attrs["start"]) if x.attrs.get("start", "").isdigit() and len(x.attrs["start"]) < 10 else 1
            for c in x.children:
                if isinstance(c, Node) and c.tag == "li" and _visible(c):
                    before, marker = out.indent, f"{number}. " if tag == "ol" else "- "
                    out.block(1)
                    out.indent, out.marker = before + " " * len(marker), marker
                    _walk(out, c.children, keep)
                    out.flush()
                    out.indent, out.marker = before, ""
                    number += 1
                else:
                    _walk(out, [c], keep)
        elif tag in ("option", "optgroup") and x.attrs.get("label"):
            # an option's label is shown in place of its text, a group's above its options
            out.text(x.attrs["label"], keep)
            if tag == "optgroup":
                out.block(1)
                _walk(out, x.children, keep)
        elif tag in ("blockquote", "dd"):
            before = out.indent
            out.indent += "  "
            _walk(out, x.children, keep)
            out.flush()
            out.indent = before
        elif tag == "details" and "open" not in x.attrs:
            _walk(out, [c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1], keep)
        else:
            _walk(out, x.children, keep or tag == "pre")
        out.block(gap)


def render(node: Node) -> str:
    out = _Lines()
    _walk(out, node.children, False)
    out.flush()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def visible_text(html: str) -> str:
    """Laid-out visible text of a page, without blank lines at its ends."""
    return render(build_tree(html)).strip("\n")


@F.pandas_udf(T.StringType())
def _text_of(pages: pd.Series) -> pd.Series:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    return pd.Series([visible_text(h) for h in pages], dtype=object)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html column (a column of that name is replaced).

    A null or empty page has the text ''. Repeated rows are rendered each for itself, no rows give no rows.
    """
    small_batches(pages.sparkSession)
    return pages.withColumn("text", _text_of(F.coalesce(F.col(column), F.lit("")))).drop(column)
