"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a renderer for blocks, lists and tables.

Tokens go to a tree builder that knows void elements, raw-text elements, tags that close others (p, li, dt/dd, option, table parts, headings) and implied
rows of tables; text, and tags that a head cannot hold, end an open head; end tags without a start are dropped.  Hidden are script, style, template and their like, elements with the hidden attribute or
aria-hidden="true", inline display:none or visibility:hidden, and hidden inputs.  All other text is visible and is emitted, white space collapsed except in pre and textarea.

Rendering: block elements stand on lines of their own, paragraphs, headings, lists, tables and the like with an empty line between; list items get "- " or their number
and hang below it by nesting; table cells are padded to their column's width and joined by " | " (a colspan counts for 50 columns at most); br breaks lines; hr is "---"; images show their alt text; quotes are
led by "> ".

Null html gives null text; empty html, or html without visible text, gives "".  Repeated rows are rendered each for itself.  Trees are built and rendered with explicit stacks,
at any depth.  Only indentation is bounded: list items, quotes and dd nested more than `DEPTH` deep lead their first line, but not the lines after it, as lines would else grow with the
depth.  Work is row by row, without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist iframe noembed noframes object embed audio video canvas svg math param source track area base col colgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr article section fieldset form details".split())
BLOCK = SPACED | frozenset("html body div header footer main nav aside address li dt dd figcaption legend summary tr caption thead tbody tfoot td th center option select textarea dialog hgroup search".split())
#: a start tag closes these when they are open, up to the tags that bound it
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)), "rp": (("rt", "rp"), ("ruby",)), "rt": (("rt", "rp"), ("ruby",)),
}
ENDS_P = SPACED | frozenset("div header footer main nav aside address center figcaption li dt dd summary".split())
BARRIER = frozenset("table td th caption button object template body html".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DEPTH = 200
#: what an open head can hold; other tags and text end it
OF_HEAD = frozenset("title meta link style script base basefont bgsound template noscript noframes head html".split())
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
BETWEEN, NAME, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def _sent(found: Iterator, at: int):
    """The next token from `at` on."""
    try:
        return found.send(at)
    except StopIteration:
        return None


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """Tags and comments (with an empty name): begin, end, name, whether it is an end tag, attributes.  The receiver may send where to go on.

    One pass: every search either ends the page or is where the next one starts.  Quotes delimit a value only where it begins, and where they are closed."""
    n, at = len(source), 0
    last = {c: source.rfind(c) for c in "\"'"}
    while (k := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), k):
            comment = source.startswith("<!--", k)
            end = source.find("-->" if comment else ">", k + (4 if comment else 2))
            end = n if end < 0 else end + (3 if comment else 1)
            yield k, end, "", False, {}
            at = end
            continue
        if not (m := TAG.match(source, k)):
            at = k + 1
            continue
        attrs, at = {}, m.end()
        while (at := BETWEEN.match(source, at).end()) < n and source[at] != ">":
            name = NAME.match(source, at)
            value, at = "", name.end()
            if eq := EQUALS.match(source, at):
                at = eq.end()
                if at < n and (c := source[at]) in last and at < last[c]:
                    value, at = source[at + 1 : (end := source.find(c, at + 1))], end + 1
                else:
                    value, at = (bare := BARE.match(source, at))[0], bare.end()
            attrs[name[0].lower()] = html.unescape(value)
        at = min(at + 1, n)
        at = (yield k, at, m[2].lower(), bool(m[1]), attrs) or at


def tree(source: str) -> Node:
    root = Node("html", {})
    stack, places = [root], {"html": [0]}  # places: where in the stack each tag is open

    def last(names: Iterable[str]) -> int:
        """The place of the nearest open one of names; 0 for none."""
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def cut_at(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def close(names: tuple[str, ...] | frozenset, bounds: tuple[str, ...] | frozenset) -> None:
        """Ends the outermost of names that is open inside the nearest bound."""
        if not any(places.get(n) for n in names):
            return
        bound = last(bounds)
        cuts = [p[k] for n in names if (p := places.get(n)) and (k := bisect_right(p, bound)) < len(p)]
        if cuts:
            cut_at(min(cuts))

    def enter(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip():
            cut_at(len(stack) - 1)
        stack[-1].kids.append(html.unescape(s))

    at, end, found, skip = 0, len(source), tokens(source), None
    while token := next(found, None) if skip is None else _sent(found, skip):
        begin, after, tag, ends, attrs = token
        skip = None
        if begin > at:
            text(source[at:begin])
        at = after
        if not tag:
            continue
        if ends:  # an end tag: to the nearest open one, not out of a table cell
            k = last(HEADING if tag in HEADING else (tag,))
            if k and (tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") or k >= last(("td", "th", "caption"))):
                cut_at(k)
            if tag == "br":
                enter("br", {})
            continue
        if tag in ("html", "body") and places.get(tag):
            close(("head",), ())
            continue
        if stack[-1].tag == "head" and tag not in OF_HEAD:
            cut_at(len(stack) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close(("p",), BARRIER)
        if tag in HEADING and stack[-1].tag in HEADING:
            cut_at(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            enter("tr", {})
        enter(tag, attrs)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            close_at = source.find(">", stop.end()) + 1 if stop else 0
            raw = source[at : stop.start() if close_at else end]
            stack[-1].kids.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = skip = close_at or end
            cut_at(len(stack) - 1)
    if at < end:
        text(source[at:])
    return root


def hidden(n: Node) -> bool:
    a = n.attrs
    return n.tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or n.tag == "input" and a.get("type", "").lower() == "hidden" or n.tag == "dialog" and "open" not in a or "style" in a and bool(UNSHOWN.search(a["style"]))


class Lead:
    """What leads the lines of a list item or quote: the first one and the others."""

    __slots__ = ("blank", "every", "filled", "first", "level", "opened", "owed", "rest")

    def __init__(self, first: str, rest: str, outer: Lead | None):
        self.level = (outer.level if outer else 0) + bool(rest)
        self.first, self.rest = first, rest if self.level <= DEPTH else ""
        self.every = (outer.every if outer else "") + self.rest
        self.owed = self.blank = 0  # empty lines owed before the next, and empty ones that count if a next one comes
        self.filled = self.opened = False  # has lines, has lines that are not empty


class Page:
    """Lines, and what leads them.  Those up to `live` have opened and owe nothing: a line need not look at them."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.leads = [Lead("", "", None)]
        self.live = -1
        self.line = ""
        self.space = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.line += first
            for part in rest:
                self.end(keep=True)
                self.line = part
            return
        words = s.split()
        if not words:
            self.space = self.space or bool(s)
            return
        lead = (self.space or s[0].isspace()) and self.line and not self.line.endswith(" ")
        self.line += (" " if lead else "") + " ".join(words)
        self.space = s[-1].isspace()

    def end(self, keep: bool = False) -> None:
        """Ends the line; an empty one counts only where keep says so."""
        line, self.line, self.space = self.line.rstrip(), "", False
        if line:
            self.emit(line)
        elif keep:
            top = self.leads[-1]
            top.blank += 1 + (top.owed if top.filled else 0)
            top.owed, top.filled = 0, True
            self.live = min(self.live, len(self.leads) - 2)

    def emit(self, line: str) -> None:
        blank, parts = 0, []
        for k in range(len(self.leads) - 1, self.live, -1):
            x = self.leads[k]
            blank += x.blank + (x.owed if x.filled else 0)
            parts.append(x.rest if x.opened or blank else x.first)
            x.owed, x.blank, x.filled, x.opened = 0, 0, True, True
        if self.live >= 0:
            parts.append(self.leads[self.live].every)
        self.live = len(self.leads) - 1
        self.lines += [""] * blank
        self.lines.append("".join(reversed(parts)) + line)

    def gap(self, n: int) -> None:
        self.end()
        top = self.leads[-1]
        if n > top.owed:
            top.owed = n
            self.live = min(self.live, len(self.leads) - 2)

    def enter(self, first: str, rest: str) -> None:
        self.end()
        self.leads.append(Lead(first, rest, self.leads[-1]))

    def leave(self) -> None:
        self.end()
        self.leads.pop()
        self.live = min(self.live, len(self.leads) - 1)


def grid(n: Node) -> tuple[list[Node | str], list[Node]]:
    """Captions and rows, without those of inner tables."""
    captions, rows, todo = [], [], n.kids[::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            if k.strip():
                captions.append(k)
        elif hidden(k):
            continue
        elif k.tag == "tr":
            rows.append(k)
        elif k.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(k.kids)
        else:
            captions.append(k)
    return captions, rows


def cells_of(row: Node) -> Generator[Node, list[str], list[str]]:
    """The row's cell texts; asks for the lines of its cells."""
    cells = []
    for c in row.kids:
        if isinstance(c, Node) and not hidden(c):
            lines = yield c
            cells.append(" ".join(x.strip() for x in lines if x) if c.tag in ("td", "th") else " ".join(lines))
            span = c.attrs.get("colspan", "")
            cells += [""] * (min(int(span), 50) - 1 if span.isdigit() else 0)
        elif isinstance(c, str) and c.strip():
            cells.append(" ".join(c.split()))
    return cells


def render(top: Node) -> list[str]:
    """Visible lines below top.  Table cells that walks ask for are rendered from a stack."""
    walks, lines = [walk(top)], None
    while walks:
        try:
            cell, lines = walks[-1].send(lines), None
            walks.append(walk(cell))
        except StopIteration as e:
            walks.pop()
            lines = e.value
    return lines


class Open:
    """An element that is being rendered: kids that are left, the next item's number, and what its end does."""

    __slots__ = ("gap", "kids", "leads", "number", "pre", "rows", "tag")

    def __init__(self, n: Node, pre: bool, *, kids: list | None = None, gap: int = -1, leads: bool = False, rows: list[Node] | None = None):
        self.tag, self.kids, self.pre, self.gap, self.leads, self.rows = n.tag, iter(n.kids if kids is None else kids), pre, gap, leads, rows
        self.number = int(s) if (s := n.attrs.get("start", "1")).lstrip("-").isdigit() and len(s) < 10 else 1


def walk(first: Node) -> Generator[Node, list[str], list[str]]:
    """The visible lines below first; asks for the lines of table cells."""
    page, todo = Page(), [Open(first, False)]
    while todo:
        top = todo[-1]
        pre, k = top.pre, next(top.kids, None)
        if k is None:
            todo.pop()
            if top.leads:
                page.leave()
            if top.rows is not None:
                rows = []
                for r in top.rows:
                    cells = yield from cells_of(r)
                    if any(cells):
                        rows.append(cells)
                width = [max((len(r[j]) for r in rows if j < len(r)), default=0) for j in range(max(map(len, rows), default=0))]
                for r in rows:
                    page.line = " | ".join(c.ljust(w) for c, w in zip(r, width, strict=False)).rstrip()
                    page.end(keep=True)
            if top.gap >= 0:
                page.gap(top.gap)
            continue
        if top.rows is not None:  # a table's captions
            if isinstance(k, str):
                page.end()
                page.line = " ".join(k.split())
                page.end(keep=True)
            else:
                page.enter("", "")
                todo.append(Open(k, False, leads=True))
            continue
        if isinstance(k, str):
            page.text(k, pre)
            continue
        if hidden(k):
            continue
        tag = k.tag
        if tag == "br":
            page.end(keep=True)
        elif tag == "hr":
            page.gap(1)
            page.line = "---"
            page.gap(1)
        elif tag == "img":
            page.text(k.attrs.get("alt", ""), pre)
        elif tag == "input":
            page.text(" " + k.attrs.get("value", "") + " ", pre)
        elif tag == "table":
            page.gap(1)
            captions, rows = grid(k)
            todo.append(Open(k, False, kids=captions, gap=1, rows=rows))
        elif tag == "li":
            ordered = top.tag == "ol"
            lead = f"{top.number}. " if ordered else "- "
            top.number += ordered
            page.enter(lead, " " * len(lead))
            todo.append(Open(k, pre, leads=True))
        elif tag in ("blockquote", "dd"):
            n, lead = (1, "> ") if tag == "blockquote" else (0, "    ")
            page.gap(n)
            page.enter(lead, lead)
            todo.append(Open(k, pre, gap=n, leads=True))
        elif tag in BLOCK:
            inner = tag in ("ul", "ol", "dl") and top.tag == "li"  # a list within an item stands close
            n = 1 if tag in SPACED and not inner else 0
            page.gap(n)
            todo.append(Open(k, pre or tag in ("pre", "textarea"), gap=n))
        else:
            todo.append(Open(k, pre))
    page.end()
    return page.lines


def page_text(source: str | None) -> str | None:
    return None if source is None else "\n".join(render(tree(source)))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """The input row (without its html) as struct __row, with text, n_lines and n_chars beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(1)
            for lo in range(0, len(source), 200):
                texts = [page_text(s) for s in source.slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 200), pa.array(texts, pa.string()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=["__row", "text", "n_lines", "n_chars"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("__row"), F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = T.StructType([rows.schema["__row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("__row.page_id", "text", "n_lines", "n_chars")
