"""Visible text of HTML pages, laid out: block spacing, list markers, preformatted text and aligned table cells.

A tokenizer in one pass feeds a tree builder that knows void elements, raw-text elements and implied end tags (a
paragraph ends where a block begins, an item at the next item of its list, a cell or row at the next one); end
tags without a start are ignored, elements left open end with their parent; in SVG and MathML a tag may end itself.
The renderer walks the tree without recursion and leaves out what is not displayed: head, script, style, template and
the like, what SVG and MathML define but do not draw, fallbacks of media, elements with the hidden attribute or an
inline style of display none (aria-hidden is displayed, and kept). Visibility is inherited: text is left out where the
nearest inline style that sets it says hidden or collapse. Style sheets are not applied.

White space collapses except in pre and textarea. Blocks stand on lines of their own; paragraphs, headings, lists
at the outer level, tables, quotes and pre have an empty line around. Items have `- ` or their number, indented by
the depth of the list. A table row is a line (more if a cell has more), and each column begins at the same place in all
rows, two blanks after the one before. Columns are as wide as their widest cell, but COLUMN at most: after a longer
cell the row goes on at its next column on a new line. Cells that span rows or columns keep their places free.

Null and empty pages give an empty text. Text without tags is text. Rows pass through one by one, repeated or not,
with their extra columns; columns named as the results are replaced. Any length and depth is rendered whole.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_or_empty

#: Characters of a column that other cells are moved right for.
COLUMN = 60

# fixed values: elements of the HTML standard by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NOT_SHOWN = frozenset("head script style template title meta link base noembed noframes iframe datalist audio video canvas param source track area".split())
# fixed values: what SVG and MathML hold but do not draw
NOT_SHOWN |= frozenset("defs symbol desc metadata clippath lineargradient radialgradient marker mask pattern filter annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = frozenset("p blockquote figure pre table dl ul ol menu fieldset".split()) | HEADINGS
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li listing main nav option optgroup search section select summary tbody td tfoot th thead tr caption svg text foreignobject".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul dd dt".split()) | HEADINGS
#: start tag -> the elements it ends, and those beyond which it does not look
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
BARRIER = frozenset("table td th caption html body button object template".split())

MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = next((m[k] for k in (2, 3, 4) if m[k] is not None), "")
        out.setdefault(m[1].lower(), entities.unescape(value))
    return out


def parse(page: str) -> Node:
    """The tree: a Node's children are Nodes and strings."""
    root = here = Node("", {}, None)
    open_tags: dict[str, int] = {}
    at, end = 0, len(page)

    def close_to(node):
        nonlocal here
        while here is not node.parent:
            open_tags[here.tag] -= 1
            here = here.parent

    def find(tags, stop):
        if not any(open_tags.get(t) for t in tags):
            return None
        node, found = here, None
        while node is not root and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        return found

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            here.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            here.children.append(m["cdata"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                here.children.append(Node("br", {}, here))
            elif open_tags.get(tag):
                if tag in ("table", "html", "body"):
                    stop = frozenset()
                elif tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                    stop = frozenset(("table",))
                else:
                    stop = BARRIER
                node = here
                while node is not root and node.tag != tag and node.tag not in stop:
                    node = node.parent
                if node.tag == tag and node is not root:
                    close_to(node)
            continue
        if tag in CLOSES_P:
            p = find({"p"}, BARRIER)
            if p is not None:
                close_to(p)
        if tag in IMPLIED:
            node = find(*IMPLIED[tag])
            if node is not None:
                close_to(node)
        raw = m["attrs"]
        node = Node(tag, attributes(raw) if raw and not raw.isspace() else {}, here)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            body = page[at : close.start() if close else end]
            node.children.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            at = close.end() if close else end
            continue
        if raw.endswith("/") and (tag in ("svg", "math") or open_tags.get("svg") or open_tags.get("math")):
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        here = node
    return root


def styles(node: Node) -> dict[str, str]:
    """display and visibility of an inline style; of several the last."""
    return {m[1].lower(): m[2].lower() for m in STYLE.finditer(node.attrs["style"])} if "style" in node.attrs else {}


def shown(node: Node) -> bool:
    if node.tag in NOT_SHOWN or (node.attrs and ("hidden" in node.attrs or styles(node).get("display") == "none")):
        return False
    return not (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


class Box:
    """Lines under way: a flow of blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.marker = ""

    def inline(self, text: str):
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        if self.parts:
            if self.space or text[0].isspace():
                self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.space = text[-1].isspace()

    def exact(self, text: str):
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.end_line(force=True)
            self.parts.append(line)

    def end_line(self, force=False):
        if self.parts or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.marker + "".join(self.parts)).rstrip())
            if self.marker:
                self.marker = " " * len(self.marker)
        self.parts, self.space = [], False

    def block(self, lines: list[str]):
        self.end_line()
        for line in lines:
            self.parts = [line]
            self.end_line(force=True)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """rows: of each cell its lines and how many columns and rows it spans."""
    widths: list[int] = []
    taken: dict[int, int] = {}  # column -> rows in which a cell from above still stands there
    placed: list[list[tuple[list[str], int]]] = []
    for row in rows:
        own, column, below = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, span, depth in row:
            while column in taken:
                column += 1
            own.append((lines, column))
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = max(widths[column], min(COLUMN, max(map(len, lines), default=0)))
            if depth > 1:
                below |= dict.fromkeys(range(column, column + span), depth - 1)
            column += span
        taken = below
        placed.append(own)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2 * (width > 0))
    out = []
    for own in placed:
        for k in range(max((len(lines) for lines, _ in own), default=0)):
            text = ""
            for lines, column in own:
                cell = lines[k] if k < len(lines) else ""
                if not cell:
                    continue
                if text and len(text) + 2 > starts[column]:
                    out.append(text.rstrip())
                    text = ""
                text = text.ljust(starts[column]) + cell
            out.append(text.rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1")
    return min(most, int(value)) if re.fullmatch(r"\d{1,5}", value) else 1


def render(root: Node) -> str:
    box = Box()
    boxes: list[Box] = []
    lists: list[list] = []  # [ordered, next number]
    tables: list[list] = []  # rows
    pre = 0
    visible = [True]
    stack: list[tuple] = [(child, False) for child in reversed(root.children)]
    while stack:
        node, leaving = stack.pop()
        if type(node) is str:
            if not visible[-1]:
                pass
            elif pre:
                box.exact(node)
            else:
                box.inline(node)
            continue
        if node is None:
            visible.pop()
            continue
        tag = node.tag
        if not leaving:
            if not shown(node):
                continue
            if tag == "br":
                box.end_line(force=True)
                continue
            if tag in VOID:
                if tag == "hr":
                    box.end_line()
                    box.gap = True
                continue
            if tag in BLOCK:
                box.end_line()
                if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and lists):
                    box.gap = True
            if tag in ("ul", "menu", "dir"):
                lists.append([False, 0, box.marker])
            elif tag == "ol":
                start = node.attrs.get("start", "1")
                lists.append([True, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, box.marker])
            elif tag == "li":
                own = lists[-1] if lists else [False, 0, box.marker]
                if own[0]:
                    value = node.attrs.get("value", "")
                    own[1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else own[1]
                    mark = f"{own[1]}. "
                    own[1] += 1
                else:
                    mark = "- "
                box.marker = " " * len(own[2]) + mark
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                boxes.append(box)
                lists.append([False, 0, ""])
                box = Box()
            elif tag in ("pre", "listing", "textarea", "xmp"):
                pre += 1
            own = styles(node).get("visibility") if node.attrs else None
            if own in ("visible", "hidden", "collapse"):
                visible.append(own == "visible")
                stack.append((None, True))
            stack.append((node, True))
            stack.extend((child, False) for child in reversed(node.children))
            continue
        if tag in ("td", "th") and tables:
            lines = box.finish()
            box = boxes.pop()
            lists.pop()
            if not tables[-1]:
                tables[-1].append([])
            # limits of the HTML standard; 0 rows are all that follow
            tables[-1][-1].append((lines, max(1, _span(node, "colspan", 1000)), _span(node, "rowspan", 65534) or 65534))
            continue
        if tag == "table":
            box.block(table_lines(tables.pop()))
        elif tag in ("pre", "listing", "textarea", "xmp"):
            pre -= 1
        if tag in BLOCK:
            box.end_line()
            if tag == "li":
                box.marker = lists[-1][2] if lists else ""
            elif tag in ("ul", "ol", "menu", "dir") and lists:
                box.marker = lists.pop()[2]
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and lists):
                box.gap = True
    for outer in reversed(boxes):  # never left open: the stack closes all
        outer.block(box.finish())
        box = outer
    return "\n".join(box.finish()).strip("\n")


def page_text(page: str) -> str:
    return render(parse(page))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of pages without html, with text and n_chars."""
    bounded_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name.lower() not in (html.lower(), "text", "n_chars")]
    base = pages.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty(html).alias("_page"))

    def run(batches):
        for batch in batches:
            at = batch.num_columns - 1
            texts = [page_text(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    return base.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
