"""Layout-aware text of HTML pages.

`parse` builds a tree: it closes what a start tag implies (paragraphs, list
items, table parts), ignores end tags that match nothing, and reads raw text
elements to their end tag. `render` walks the tree without recursion and emits
what a reader would see: blocks on lines of their own with a blank line where
they have margins, list items with bullets or numbers, preformatted text as it
stands, and tables with aligned cells.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import map_batches

# Fixed values of HTML: which elements are empty, raw, hidden, blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist meta link base param".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr caption figcaption details summary "
    "center legend option optgroup thead tbody tfoot search hgroup dialog".split())
CLOSES_P = (BLOCK - frozenset("html body li dt dd tr caption option optgroup thead tbody tfoot legend summary".split())) | {"li", "dt", "dd"}
#: A start tag: the open elements it ends, and those at which the search stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template"})
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Columns are aligned by cells of at most this width.
WIDEST = 60
#: Fixed value: HTML's limit of a colspan.
COLUMNS = 1000

_markup = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|([A-Za-z][^\s/>]*)((?:[^>\"']++|(?<==)\"[^\"]*+\"|(?<==)'[^']*+'|(?<== )\"[^\"]*+\"|[\"'])*+)(?:>|\Z))", re.S)
_attribute = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_number = re.compile(r"&#0*([0-9]{8,}|(?<=0)[0-9]+);?")
_white = re.compile(r"[ \t\n\f\r]+")
_unseen = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond all code points become U+FFFD, however long."""
    return html.unescape(_number.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", text) if "&#" in text else text)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        for m in _attribute.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None


def parse(page: str) -> Node:
    """The tree of a page; its root has the tag ''."""
    root = Node("")
    stack = [root]
    opened: Counter[str] = Counter()  # so that deep pages are not searched for what is not open

    def cut(start: int) -> None:
        for node in stack[start:]:
            opened[node.tag] -= 1
        del stack[start:]

    def pop_to(tags, stops) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i)
                if not tags & {"tr", "tbody", "thead", "tfoot"}:
                    return
            elif stack[i].tag in stops:
                return

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag == "head" and not piece.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    at, size = 0, len(page)
    for_raw: re.Match | None
    while at < size:
        m = _markup.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag == "table" and tag not in ("html", "body"):
                        break
        elif m[2]:
            tag = m[2].lower()
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                cut(len(stack) - 1)
            if tag in CLOSES_P:
                pop_to({"p"}, SCOPE)
            if tag in IMPLIED:
                pop_to(*IMPLIED[tag])
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                cut(len(stack) - 1)
            node = Node(tag, m[3])
            stack[-1].children.append(node)
            if tag in VOID:
                continue
            if tag in RAW:
                for_raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                body = page[at:for_raw.start() if for_raw else size]
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = for_raw.end() if for_raw else size
            elif tag == "plaintext":
                node.children.append(page[at:])
                break
            else:
                stack.append(node)
                opened[tag] += 1
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs:
        return node.tag != "dialog"
    low = node.attrs.lower()
    if "hidden" in low and (node.get("hidden") is not None or node.tag == "input"):
        return False
    if "style" in low and _unseen.search(node.get("style") or ""):
        return False
    return node.tag != "dialog" or node.get("open") is not None


class Page:
    """Collects lines; white space of running text collapses, margins between blocks too."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.margin = False
        self.prefix = ""

    def words(self, piece: str) -> None:
        flat = _white.sub(" ", piece)
        if flat[:1] == " ":
            self.space, flat = True, flat[1:]
        if not flat:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = flat[-1:] == " "
        self.line.append(flat[:-1] if self.space else flat)

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            lead, self.prefix = self.prefix, " " * len(self.prefix)
            self.lines.append((lead + "".join(self.line)).rstrip(" "))
        self.line, self.space = [], False

    def raw(self, piece: str) -> None:
        first, *rest = piece.replace("\r\n", "\n").split("\n")
        self.line += [first] if first else []
        for line in rest:
            self.end_line(always=True)
            self.line = [line] if line else []


def table_lines(rows: list[list[str]]) -> list[str]:
    """Rows of cells with every column padded to its widest cell, though not beyond `WIDEST`."""
    width: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(width):
                width.append(0)
            if len(cell) <= WIDEST:
                width[i] = max(width[i], len(cell))
    return ["  ".join(cell.ljust(w) for cell, w in zip(row, width, strict=False)).rstrip(" ") for row in rows]


def spans(node: Node) -> int:
    value = (node.get("colspan") or "1") if "colspan" in node.attrs.lower() else "1"
    digits = value.lstrip("0") if value.isascii() and value.isdigit() else "1"
    return min(int(digits[:5] or "1"), COLUMNS)


def render(root: Node) -> str:
    """Visible text of a tree."""
    out = Page()
    lists: list[list] = []  # kind and next number of open lists
    tables: list[dict] = []
    pre = 0
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if pre:
                out.raw(node)
            elif not (tables and tables[-1]["cell"] is None and node.isspace()):
                out.words(node)
            continue
        if isinstance(node, tuple):  # a list item ends
            out.end_line()
            out.prefix = node[1] if not node[1].strip() else " " * len(node[1])
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                out.end_line(always=True)
                continue
            if tag in BLOCK:
                out.end_line()
                if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                    out.margin = True
            if tag in ("ul", "ol", "menu"):
                start = node.get("start") if node.attrs else None
                lists.append([tag, int(start) if start and re.fullmatch(r"-?[0-9]{1,9}", start) else 1, out.prefix])
            elif tag == "li":
                held = lists[-1] if lists else ["ul", 1, out.prefix]
                lead = " " * len(held[2]) if not held[2].strip() else held[2]
                todo.append((("li", out.prefix), True))
                out.prefix = lead + (f"{held[1]}. " if held[0] == "ol" else "- ")
                held[1] += 1
                todo.extend((c, False) for c in reversed(node.children))
                continue
            elif tag == "pre":
                pre += 1
                if node.children and isinstance(node.children[0], str) and node.children[0][:1] == "\n":
                    node.children[0] = node.children[0][1:]
            elif tag == "table":
                tables.append({"rows": [], "cell": None, "out": out})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1]["cell"] = out
                out = Page()
            elif tag == "hr":
                continue
            if node.children or tag not in VOID:
                todo.append((node, True))
                todo.extend((c, False) for c in reversed(node.children))
            continue
        if tag in BLOCK:
            out.end_line()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            out.margin = out.margin or not lists
        elif tag == "pre":
            pre -= 1
            out.margin = True
        elif tag in ("td", "th") and tables and tables[-1]["cell"] is not None:
            out.end_line()
            tables[-1]["rows"][-1] += [" ".join(filter(None, map(str.strip, out.lines)))] + [""] * (spans(node) - 1)
            out, tables[-1]["cell"] = tables[-1]["cell"], None
        elif tag == "table" and tables:
            done = tables.pop()
            out.end_line()
            for line in table_lines([r for r in done["rows"] if any(r)]):
                out.line = [line]
                out.end_line()
            out.margin = True
        elif tag in SPACED:
            out.margin = True
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    A null or empty html gives an empty text; null ids and repeated rows stay.
    Whole pages are read, one at a time: no shuffle.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(parse(page.as_py() or "")) for page in batch["html"]]
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, each, "page_id long, url string, text string, n_chars long")
