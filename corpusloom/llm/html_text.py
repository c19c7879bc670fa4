"""Layout-aware rendering of HTML: the visible text of a page, laid out as blocks, lists and tables.

A scanner feeds a tree builder that closes elements which end tags may leave open
(paragraphs, list items, table parts, options) and ignores end tags that match nothing. The
renderer walks the tree once: elements that don't show (scripts, styles, ``hidden``,
``display:none``, ``aria-hidden``) are left out, blocks start lines and keep their spacing,
options and texts of a picture have lines of their own, lists get bullets or numbers and an
indent by depth (up to MOST_INDENT levels), preformatted text keeps its white space, and the
cells of a table are padded to their columns, spans of columns and rows included.

Time and output are linear in the page: a table's padding goes up to PADDING times its own
text and separators. Where cells of all lengths would need more, columns are as wide as the
longest lengths that keep to it (longer cells are whole, but not aligned), and where spans alone
would need more, cells are side by side without padding. No width or number of columns is fixed.

Defined results: a null html is an empty text; a page without tags is its own text with
references resolved; tags that never end are closed at the end of the page; where a tag has
no end because of its quotes, quotes don't count from there on; a long page is
rendered whole, a page being in memory at a time; repeated rows are rendered as rows; an
empty table gives an empty result; a column called text is replaced, others are kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrow_text import small_batches, with_columns

#: What may follow an attribute's name; quotes count only right after the sign.
VALUE = r"""\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?+"""
START = re.compile(r"<!--|</?[A-Za-z]|<[!?/]")
TAG = re.compile(rf"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[\s/]++|=?[^\s/>=]++(?:{VALUE})?+|=)*+)>")
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>[^>]*+)>")
ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:{VALUE})?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas".split())
#: Not shown inside pictures and formulas.
FOREIGN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure".split())
#: An opening tag closes the nearest open element of the first set, unless one of the second is nearer.
CELLS, ROWS, PARTS = {"td", "th"}, {"tr"}, {"tbody", "thead", "tfoot"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "tr": (ROWS, {"table"}),
    "tbody": (PARTS | ROWS, {"table"}),
    "thead": (PARTS | ROWS, {"table"}),
    "tfoot": (PARTS | ROWS, {"table"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption"}
HEAD_ONLY = frozenset("head title meta link base style script noscript template".split())
#: Only for these is it asked what they are in.
MAYBE_FOREIGN = RAW | {"text"} | frozenset.union(*FOREIGN.values())
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Bounds of the layout, see above.
PADDING, MOST_INDENT = 8, 20
#: The largest spans that the standard knows.
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("block", "children", "label", "name", "shown", "spans", "start")

    def __init__(self, name: str, shown: bool = True, start: int = 1, label: str = "", spans: tuple[int, int] = (1, 1)) -> None:
        self.name, self.shown, self.start, self.label, self.spans, self.children = name, shown, start, label, spans, []
        self.block = name in BLOCKS or name in {"option", "optgroup"}


def element(name: str, attributes: str) -> Node:
    """A node that knows whether it shows."""
    if name in NEVER_SHOWN:
        return Node(name, False)
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return Node(name)
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDING_STYLE.search(found.get("style", "")) is not None
    hidden |= name == "input" and found.get("type", "").lower() == "hidden"
    start = found.get("start", "")
    spans = tuple(int(x) if re.fullmatch(r"[1-9]\d{0,4}", x := found.get(k, "").strip()) else 1 for k in ("colspan", "rowspan")) if name in CELLS else (1, 1)
    return Node(name, not hidden, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, found.get("label", "") if name in {"option", "optgroup"} else "", spans)


class Open:
    """The open elements, and where each name is among them."""

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.push(root)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().name].pop()

    def nearest(self, names) -> int:
        """The place of the innermost open element with one of the names; 0 (the root's) where there is none."""
        return max((found[-1] for name in names if (found := self.places.get(name))), default=0)

    def close(self, names, barriers) -> None:
        """Close the innermost element of ``names`` with all in it, unless one of ``barriers`` is nearer."""
        at = self.nearest(names)
        if at and at >= self.nearest(barriers):
            while len(self.nodes) > at:
                self.pop()


def pieces_of(page: str):
    """Texts as strings, and tags as matches; whoever takes a tag may send back from where to go on."""
    at, size, tag = 0, len(page), TAG
    while at < size:
        found = START.search(page, at)
        if not found:
            yield page[at:]
            return
        begin, kind = found.start(), found.group()
        if kind == "<!--":
            end = page.find("-->", begin + 4)
            upto, token = size if end < 0 else end + 3, None
        elif kind in {"<!", "<?", "</"}:
            end = page.find(">", begin)
            upto, token = size if end < 0 else end + 1, None
        else:
            token = tag.match(page, begin)
            if not token and tag is TAG:  # ran into the end of the page
                tag = PLAIN_TAG
                token = tag.match(page, begin)
            if not token:  # no sign ends a tag from here on
                yield page[at:]
                return
            upto = token.end()
        if begin > at:
            yield page[at:begin]
        at = upto
        if token:
            at = (yield token) or at


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = Open(root)
    source = pieces_of(page)
    go_on = None
    while True:
        try:
            token = source.send(go_on)
        except StopIteration:
            return root
        go_on = None
        top = stack.nodes[-1]
        if isinstance(token, str):
            if top.name == "head" and token.strip():
                stack.pop()
                top = stack.nodes[-1]
            top.children.append(html.unescape(token))
            continue
        name = token["name"].lower()
        if token["end"]:
            if name == "p" and not stack.places.get("p"):
                top.children.append(Node("p"))
            elif name not in VOID:
                stack.close((name,), () if name in {"table", "body", "html"} else ("table",))
            continue
        if name == "html":
            continue
        if top.name == "head" and name not in HEAD_ONLY:
            stack.pop()
        if name in ENDS_PARAGRAPH:
            stack.close(("p",), ("table", "td", "th", "li", "div", "button"))
        if name == "optgroup":
            stack.close(("option",), ("select",))
        if name in IMPLIED:
            stack.close(*IMPLIED[name])
        node = element(name, token["attributes"])
        stack.nodes[-1].children.append(node)
        within = stack.nodes[stack.nearest(FOREIGN)].name if name in MAYBE_FOREIGN else None
        if within in FOREIGN:
            node.shown &= name not in FOREIGN[within]
            node.block |= within == "svg" and name == "text"  # each has a place of its own
        ended = token["attributes"].endswith("/")
        if name in RAW and not (within in FOREIGN and ended):
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, token.end())
            inside = page[token.end() : end.start() if end else len(page)]
            if node.shown and name in {"textarea", "xmp"}:
                node.children.append(html.unescape(inside) if name == "textarea" else inside)
            go_on = end.end() if end else len(page)
        elif name not in VOID and not ended or name in BLOCKS - {"hr"}:
            stack.push(node)


class Lines:
    """Text laid out so far: white space collapses inside a line, blocks end lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.first = ""  # a bullet or number that waits for its item's first line
        self.hang = ""  # the indent of an item's other lines

    def line(self, text: str) -> None:
        self.lines.append((self.first or self.hang) + text)
        self.first = ""

    def put(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.parts or self.parts[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.parts.append(text)

    def end(self, blank: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line:
            self.line(line)
        if blank and self.lines and self.lines[-1]:
            self.lines.append("")

    def text(self) -> str:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def render(node: Node, out: Lines, in_cell: bool = False) -> None:
    """Lay out a node's children with a work list, however deep; a table inside a cell is laid out as blocks."""
    work: list = [(node, None)]
    state = [(0, False)]
    numbers: list[int | None] = []
    while work:
        node, leave = work.pop()
        if leave is not None:
            leave()
            continue
        if isinstance(node, str):
            if state[-1][1]:
                for i, line in enumerate(node.replace("\r\n", "\n").split("\n")):
                    if i:
                        out.line("".join(out.parts).rstrip())
                        out.parts = []
                    out.parts.append(line)
            else:
                out.put(node)
            continue
        if not node.shown:
            continue
        name = node.name
        if name == "br":
            if out.parts:
                out.end()
            else:
                out.lines.append("")
        elif name == "hr":
            out.end(True)
        elif name == "table" and not in_cell:
            out.end(True)
            for line in table_lines(node):
                out.line(line)
            out.end(True)
        else:
            block, spaced = node.block, name in SPACED and not (name in {"ul", "ol"} and numbers)
            if block:
                out.end(spaced)
            level, kept = state[-1]
            if name in {"ul", "ol", "menu"}:
                numbers.append(node.start if name == "ol" else None)
                state.append((level + 1, kept))
            elif name in {"pre", "xmp"}:
                state.append((level, True))
            hang = out.hang
            if name == "li":
                indent = "  " * min(max(0, level - 1), MOST_INDENT)
                number = numbers[-1] if numbers else None
                out.first = f"{indent}- " if number is None else f"{indent}{number}. "
                out.hang = " " * len(out.first)
                if number is not None:
                    numbers[-1] = number + 1
            elif name == "dd":
                out.first = out.hang = "  "

            def leave(name=name, block=block, spaced=spaced, hang=hang) -> None:
                if block:
                    out.end(spaced)
                if name in {"ul", "ol", "menu"}:
                    numbers.pop()
                    state.pop()
                elif name in {"pre", "xmp"}:
                    state.pop()
                elif name in {"li", "dd"}:
                    out.first, out.hang = "", hang

            work.append((node, leave))
            if node.label:
                out.put(node.label)
            if node.label and name == "option":
                continue  # the label shows in the text's place
            if node.label:
                out.end()
            work.extend((child, None) for child in reversed(node.children))


def table_lines(table: Node) -> list[str]:
    """Text beside the rows, then a line for each row; a cell's own blocks become one line."""
    before: list[str] = []
    rows: list[list[tuple[str, int, int]]] = []
    open_ = list(reversed(table.children))
    while open_:
        node = open_.pop()
        if isinstance(node, str):
            if node.strip():
                before.append(SPACE.sub(" ", node).strip())
        elif not node.shown or node.name in {"col", "colgroup"}:
            continue
        elif node.name == "tr":
            cells = [(flat(c), *c.spans) for c in node.children if isinstance(c, Node) and c.shown]
            before.extend(SPACE.sub(" ", c).strip() for c in node.children if cells and isinstance(c, str) and c.strip())
            rows.append(cells or [(flat(node), 1, 1)])
        elif node.name in PARTS:
            open_.extend(reversed(node.children))
        elif node.name in CELLS:
            rows.append([(flat(node), *node.spans)])
        else:
            before.append(flat(node))
    return [x for x in before if x] + aligned_rows(rows)


Placed = tuple[int, int, str]  # first column, columns and text of a cell


def placed_rows(rows: list[list[tuple[str, int, int]]], room: int) -> list[list[Placed]] | None:
    """Cells in the columns that cells from above leave to them, an empty one below each of those.

    None where that takes more than ``room`` steps over cells from above, so the time and
    the number of empty cells are bounded.
    """
    grid: list[list[Placed]] = []
    above: list[tuple[int, int, int]] = []  # first column, columns and last row of cells that reach below their row, by column
    first_end = 0  # the first of those last rows
    for y, row in enumerate(rows):
        placed: list[Placed] = []
        own: list[tuple[int, int, int]] = []
        at, i = 0, 0
        for text, columns, below in row:
            while i < len(above) and above[i][0] <= at:
                end = above[i][0] + above[i][1]
                if end > at:
                    placed.append((at, end - at, ""))
                    at = end
                i += 1
                room -= 1
            if room < 0:
                return None
            columns, below = min(columns, MOST_COLSPAN), min(below, MOST_ROWSPAN)
            placed.append((at, columns, text))
            if below > 1:
                own.append((at, columns, y + below - 1))
            at += columns
        grid.append(placed)
        if own or above and first_end <= y:
            room -= len(above)
            above = sorted([a for a in above if a[2] > y] + own)
            first_end = min((a[2] for a in above), default=0)
    return grid


def padded(cells: list[list[tuple[int, int, int]]], columns: int, widest: int) -> list[list[int]]:
    """The spaces that each cell (first column, column after it, length) lacks to its columns' width.

    A column is as wide as its longest cell of at most ``widest`` characters that is in it alone.
    """
    widths = [0] * columns
    for row in cells:
        for a, b, n in row:
            if b == a + 1 and widths[a] < n <= widest:
                widths[a] = n
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 3)
    return [[max(0, starts[b] - starts[a] - 3 - n) for a, b, n in row] for row in cells]


def aligned_rows(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of rows of (text, columns, rows) whose cells begin where their columns do; rows without text go."""
    room = PADDING * sum(len(text) + 3 for row in rows for text, _, _ in row)
    grid = placed_rows(rows, room // 2)
    if grid is None:
        return [" | ".join(t for t, _, _ in r) for r in rows if any(t for t, _, _ in r)]
    grid = [row for row in grid if any(text for _, _, text in row)]
    # only columns where some cell begins or ends matter
    edges = sorted({x for row in grid for at, columns, _ in row for x in (at, at + columns)})
    place = {x: i for i, x in enumerate(edges)}
    cells = [[(place[at], place[at + columns], len(text)) for at, columns, text in row] for row in grid]
    lengths = sorted({n for row in cells for _, _, n in row})
    low, high = 0, len(lengths) - 1
    lacking: list[list[int]] = []
    middle = high  # padding grows with the width: the largest that keeps to the room, the full one first
    while low <= high:
        tried = padded(cells, len(edges), lengths[middle])
        if sum(sum(row[:-1]) for row in tried) <= room:
            low, lacking = middle + 1, tried
        else:
            high = middle - 1
        middle = (low + high) // 2
    if not lacking:
        return [" | ".join(t for _, _, t in row).rstrip() for row in grid]
    return [" | ".join([t + " " * n for (_, _, t), n in zip(row[:-1], spaces[:-1], strict=True)] + [row[-1][2]]).rstrip() for row, spaces in zip(grid, lacking, strict=True)]


def flat(node: Node) -> str:
    """A node's visible text as one line."""
    out = Lines()
    render(node, out, True)
    return SPACE.sub(" ", out.text()).strip()


def visible_text(page: str | None) -> str:
    out = Lines()
    render(build(page or ""), out)
    return re.sub(r"\n{3,}", "\n\n", out.text()).strip("\n")


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """All columns and the visible text of each page; one batch of pages is in memory at a time."""
    place = pages.columns.index(column)

    def run(batches):
        for batch in small_batches(batches, place, 4_000_000):
            yield with_columns(batch, {into: pa.array([visible_text(x) for x in batch.column(place).to_pylist()], pa.string())})

    kept = [f for f in pages.schema.fields if f.name != into]
    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
