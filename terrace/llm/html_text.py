"""Visible text of HTML pages: a tree builder with implied tags, and a layout-aware renderer.

The builder opens and closes elements that authors leave out. The renderer skips
what a browser does not show and lays out the rest: blocks on their own lines,
paragraphs apart, lists with markers and indents, table cells in aligned columns,
preformatted text as it is. Both use explicit stacks, so depth costs no recursion.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import settings, table_of

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
UNESCAPED = set("textarea title".split())
HIDDEN = set("head script style template noscript iframe noembed noframes title datalist audio video canvas object select rp param desc defs symbol metadata clippath mask marker pattern filter lineargradient radialgradient annotation annotation-xml".split())
APART = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table hr fieldset figure menu".split())
BLOCK = APART | set("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = (BLOCK - set("body html li dd dt tr caption thead tbody tfoot option optgroup legend".split())) | {"li", "dd", "dt"}
# An opening tag closes these open elements, up to a barrier.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption", "colgroup"}, {"table"}), "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = set("base link meta title style script template noscript".split())
CELLS = {"td", "th"}
# Elements that hold only parts of a table; what else comes there goes before the table.
INNER = {"thead", "tbody", "tfoot", "tr", "colgroup"}
PARTS = INNER | CELLS | {"caption", "col"}
KEPT = PARTS | {"script", "style", "template"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(\s*+=\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
SPACE = re.compile(r"[ \t\n\r\f]{2,}+|[\t\n\r\f]")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)


class TreeBuilder:
    """Elements of one page; broken markup gives some tree, never an error."""

    def __init__(self, source: str):
        self.source = source
        self.root = Element("#root", {})
        self.stack = [self.root]
        self.unclosed: set[str] = set()
        self.drawing: tuple[int, Element | None] = (0, None)  # place in the stack of the last outer svg or math

    def build(self) -> Element:
        source, at, n = self.source, 0, len(self.source)
        while at < n:
            tag = source.find("<", at)
            if tag < 0:
                self.text(source[at:])
                break
            if tag > at:
                self.text(source[at:tag])
            at = self.markup(tag)
        return self.root

    def markup(self, at: int) -> int:
        """Read what starts with the ``<`` at ``at``; the place behind it."""
        source = self.source
        following = source[at + 1:at + 2]
        if following == "!" or following == "?":
            if source.startswith("<!--", at):
                if source.startswith((">", "->"), at + 4):
                    return source.index(">", at) + 1
                end = source.find("-->", at + 4)
                return end + 3 if end >= 0 else len(source)
            end = source.find(">", at)
            return end + 1 if end >= 0 else len(source)
        closing = following == "/"
        name = NAME.match(source, at + 1 + closing)
        if not name:
            if closing and source[at + 2:at + 3]:
                end = source.find(">", at)
                return end + 1 if end >= 0 else len(source)
            self.text("<")
            return at + 1
        tag = name.group().lower()
        end, attributes = self.attributes(name.end())
        if end < 0:
            return len(source)
        if closing:
            self.close(tag)
            return end
        empty = source[end - 2] == "/" and self.drawn()
        depth = len(self.stack)
        self.open(tag, attributes)
        if empty:
            del self.stack[depth:]
            return end
        return self.raw(tag, end) if tag in RAW or tag in UNESCAPED else end

    def attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """(place behind the tag, attributes); -1 where the tag has no end."""
        source = self.source
        if source[at:at + 1] == ">":
            return at + 1, {}
        found: dict[str, str] = {}
        while part := ATTRIBUTE.match(source, at):
            at = part.end()
            value = ""
            if part.group(2):
                quote = source[at:at + 1]
                end = source.find(quote, at + 1) if quote and quote in "\"'" and quote not in self.unclosed else -1
                if end >= 0:
                    value, at = source[at + 1:end], end + 1
                else:
                    if quote and quote in "\"'":
                        self.unclosed.add(quote)
                    bare = BARE.match(source, at)
                    value, at = bare.group(), bare.end()
            found.setdefault(part.group(1).lower(), html.unescape(value) if "&" in value else value)
        end = source.find(">", at)
        return (end + 1 if end >= 0 else -1), found

    def raw(self, tag: str, at: int) -> int:
        end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(self.source, at)
        stop = end.start() if end else len(self.source)
        content = self.source[at:stop]
        if content:
            self.stack[-1].children.append(html.unescape(content) if tag in UNESCAPED else content)
        return stop

    def text(self, content: str) -> None:
        top = self.stack[-1].tag
        if top in ("table", "thead", "tbody", "tfoot", "tr", "colgroup") and not content.strip(" \t\n\r\f"):
            return
        if top in ("#root", "html", "head") and content.strip(" \t\n\r\f"):
            self.body()
        if top in ("svg", "g"):
            return  # only text elements show
        self.place(html.unescape(content) if "&" in content else content)

    def drawn(self) -> bool:
        """Whether an svg or math is open."""
        at, element = self.drawing
        return element is not None and at < len(self.stack) and self.stack[at] is element

    def table_at(self) -> int:
        """Place of the table whose rows, but no cell, are open at the top; 0 if none."""
        i = len(self.stack) - 1
        while self.stack[i].tag in INNER:
            i -= 1
        return i if self.stack[i].tag == "table" else 0

    def place(self, child: Element | str) -> None:
        """Append to the open element, or before the table where a table holds no such child."""
        table = self.table_at()
        if table and (isinstance(child, str) or child.tag not in KEPT):
            self.stack[table - 1].children.insert(-1, child)  # an open table is the last child
        else:
            self.stack[-1].children.append(child)

    def back_to_table(self) -> None:
        """Close what was moved before the table and is still open."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in CELLS or tag in ("caption", "template"):
                return
            if tag == "table" or tag in INNER:
                top, self.stack = self.stack[i + 1:], self.stack[:i + 1]
                if not self.table_at():
                    self.stack += top
                return

    def push(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        element = Element(tag, attributes or {})
        self.place(element)
        if tag not in VOID:
            if tag in ("svg", "math") and not self.drawn():
                self.drawing = len(self.stack), element
            self.stack.append(element)

    def body(self) -> None:
        """Open html and body where the page does not."""
        if self.stack[-1].tag == "head":
            self.stack.pop()
        if len(self.stack) == 1:
            self.push("html")
        if not any(e.tag == "body" for e in self.stack):
            self.push("body")

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body", "head") and any(e.tag == tag for e in self.stack):
            return
        top = self.stack[-1].tag
        if top in ("#root", "html", "head"):
            if tag in HEAD_ONLY and top != "head":
                if top == "#root":
                    self.push("html")
                self.push("head")
            elif tag == "head" and top == "#root":
                self.push("html")
            elif tag == "body":
                if top == "head":
                    self.stack.pop()
                if len(self.stack) == 1:
                    self.push("html")
            elif tag not in HEAD_ONLY and tag not in ("html", "head", "frameset"):
                self.body()
        if tag in PARTS or tag == "table":
            self.back_to_table()
        if tag == "form" and self.table_at():
            return  # no container there
        if tag == "table" and self.table_at():
            self.close("table")
        if tag in CLOSES_P:
            self.end_of({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in IMPLIED_END:
            self.end_of(*IMPLIED_END[tag])
        if tag in CELLS | {"tr"}:
            place = self.stack[-1].tag
            if place == "table":
                self.push("tbody")
            if tag in CELLS and self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self.push("tr")
        self.push(tag, attributes)

    def end_of(self, tags: set[str], barrier: set[str]) -> None:
        """Close the outermost open element of ``tags`` inside the nearest barrier."""
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in barrier or self.stack[i].tag == "template":
                break
            if self.stack[i].tag in tags:
                found = i
        if found:
            del self.stack[found:]

    def close(self, tag: str) -> None:
        if tag == "br":
            return self.push("br")
        if tag in ("body", "html"):
            return None  # what follows still belongs to the body
        barrier = set() if tag == "table" else {"table"} if tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"table", "td", "th", "caption"}
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return None
            if self.stack[i].tag in barrier:
                break
        if tag == "p":
            self.open("p", {})
            self.stack.pop()
        return None


def visible(element: Element) -> bool:
    a = element.attributes
    if element.tag in HIDDEN:
        return False
    if not a:
        return True
    if "hidden" in a or element.tag == "dialog" and "open" not in a or element.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and UNSEEN.search(a["style"]))


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: collapsed blanks, pending breaks, indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a collapsed blank waits
        self.apart = 0  # line breaks that wait
        self.indent = ""
        self.marker = ""
        self.saved: list[str] = []  # indents of the enclosing blocks

    def words(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        core = text.strip(" ")
        if not core:
            self.blank = self.blank or bool(text) and bool(self.line)
            return
        self.settle()
        if self.line and (self.blank or text[0] == " "):
            self.line.append(" ")
        self.line.append(core)
        self.blank = text[-1] == " "

    def exact(self, text: str) -> None:
        parts = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, part in enumerate(parts):
            if i:
                self.settle()
                self.flush()
            if part:
                self.settle()
                self.line.append(part)

    def settle(self) -> None:
        """Carry out the breaks that wait, as text follows."""
        if self.apart:
            self.flush_if_any()
            if self.lines and self.apart > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.apart = 0

    def flush_if_any(self) -> None:
        if self.line:
            self.flush()

    def flush(self) -> None:
        text = "".join(self.line).rstrip(" ")
        if text and self.marker:
            head, self.marker = self.marker, ""
            self.lines.append(self.indent[:len(self.indent) - len(head)] + head + text)
        else:
            self.lines.append(self.indent + text if text else "")
        self.line, self.blank = [], False

    def brk(self, n: int) -> None:
        self.apart = max(self.apart, n)
        self.flush_if_any()
        self.blank = False

    def text(self) -> str:
        self.flush_if_any()
        return "\n".join(self.lines).strip("\n").replace("\xa0", " ")


def _rows_of(table: Element) -> tuple[list[Element], list[Element]]:
    """(captions, rows) of a table, rows of its sections included."""
    captions, rows, heads, feet = [], [], [], []
    for child in table.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr":
            rows.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            part = [r for r in child.children if not isinstance(r, str) and r.tag == "tr" and visible(r)]
            (heads if child.tag == "thead" else feet if child.tag == "tfoot" else rows).extend(part)
    return captions, heads + rows + feet


def _number(text: str | None, least: int) -> int:
    return max(least, min(int(text), 1000)) if text and text.strip().isascii() and text.strip().isdigit() else least


def render(root: Element) -> str:
    """Text of a tree. Nested tables are laid out innermost first, as text of their cells."""
    page = Page()
    # (what, element or text, state): tables and cells render into pages of their own
    work: list[tuple] = [("in", root, False)]
    lists: list[list] = []
    pages: list[tuple] = []
    while work:
        step, item, pre = work.pop()
        if step == "page":
            pages.append((page, lists))
            page, lists = Page(), []
        elif step == "text":
            page.exact(item) if pre else page.words(item)
        elif step == "break":
            page.brk(item)
        elif step == "out":
            tag = item.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                page.brk(1)
                page.marker = ""
                page.indent = page.saved.pop()
            page.brk(2 if tag in APART and not (lists and tag in ("ul", "ol", "menu")) else 1)
        elif step == "cell":
            cell_page, page, lists = page, *pages.pop()
            item.append(cell_page.text())
        elif step == "table":
            captions, grid = item
            for caption in captions:
                page.brk(1)
                for line in caption[0].split("\n"):
                    page.exact(line)
                    page.brk(1)
            lines: list[list[str]] = []
            widths: list[int] = []
            for row in grid:
                flat: list[str] = []
                for text, span in row:
                    flat += [" ".join(text[0].split())] + [""] * (span - 1)
                lines.append(flat)
                for i, text in enumerate(flat):
                    widths += [0] * (i + 1 - len(widths))
                    if not (i < len(flat) - 1 and flat[i + 1] == "" and text and row and any(s > 1 for _, s in row)):
                        widths[i] = max(widths[i], width(text))
            for flat in lines:
                if any(flat):
                    page.settle()
                    page.exact("  ".join(t + " " * (widths[i] - width(t)) for i, t in enumerate(flat)).rstrip())
                    page.brk(1)
            page.brk(2)
        elif isinstance(item, str):
            page.exact(item) if pre else page.words(item)
        elif visible(item):
            tag = item.tag
            if tag == "br":
                page.settle()
                page.flush()
                continue
            if tag == "wbr" or tag in VOID and tag != "hr":
                continue
            if tag == "table":
                page.brk(2)
                captions, rows = _rows_of(item)
                caption_texts: list[list[str]] = [[] for _ in captions]
                grid = [[([], _number(c.attributes.get("colspan"), 1), c) for c in r.children if not isinstance(c, str) and c.tag in CELLS and visible(c)] for r in rows]
                work.append(("table", (caption_texts, [[(t, s) for t, s, _ in row] for row in grid]), pre))
                for target, element in [*((t, e) for t, e in zip(caption_texts, captions, strict=True)), *((t, e) for row in grid for t, _, e in row)][::-1]:
                    work.append(("cell", target, pre))
                    work.extend(("in", child, False) for child in reversed(element.children))
                    work.append(("page", None, pre))
                continue
            pre = pre or tag in ("pre", "textarea", "xmp", "listing")
            block = tag in BLOCK
            if block:
                page.brk(2 if tag in APART and not (lists and tag in ("ul", "ol", "menu")) else 1)
                work.append(("out", item, pre))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, _number(item.attributes.get("start"), 1) - 1])
            elif tag in ("li", "dd", "blockquote"):
                page.saved.append(page.indent)
                if tag == "li":
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] = _number(item.attributes.get("value"), lists[-1][1] + 1)
                        head = f"{lists[-1][1]}. "
                    else:
                        head = "- "
                    page.indent += " " * len(head)
                    page.marker = head
                else:
                    page.indent += "    " if tag == "dd" else "> "
            elif tag == "q":
                page.words('"')
            children = item.children
            if tag == "details" and "open" not in item.attributes:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"]
            if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            if tag == "q":
                work.append(("text", '"', pre))
            work.extend(("in", child, pre) for child in reversed(children))
    return page.text()


def visible_text(source: str) -> str:
    """Everything a reader sees on the page, laid out as plain text."""
    return render(TreeBuilder(source.replace("\x00", "")).build())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_lines) of every row of ``pages``.

    A null or empty html gives an empty text; repeated rows and null page_ids are
    kept; an empty table gives no rows; other columns are ignored. Broken markup
    gives the text a browser-like reading finds.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64())])
    settings(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, size = [], 0, 0
            for k, source in enumerate(batch.column(2)):
                rows.append(visible_text(source.as_py()))
                size += len(rows[-1])
                if size >= 8 << 20 or k + 1 == batch.num_rows:
                    yield table_of({"page_id": batch.column(0).slice(first, len(rows)), "url": batch.column(1).slice(first, len(rows)), "text": rows, "n_lines": [t.count("\n") + 1 if t else 0 for t in rows]}, schema)
                    rows, first, size = [], k + 1, 0

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_lines long")
