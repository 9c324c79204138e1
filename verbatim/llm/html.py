"""HTML extraction: a tree with implied tags, visibility rules, and a layout of all visible text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: HTML's elements by how they are laid out and closed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noframes iframe object audio video canvas svg math datalist select textarea option optgroup map area base link meta param source track".split())
RAW = frozenset("script style noscript noframes iframe template textarea title xmp".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure fieldset hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option section summary caption tbody thead tfoot tr".split())
#: A start tag closes these open elements, but not beyond those of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that an end tag or an implied end does not reach through.
SCOPE = frozenset("table td th caption html template".split())
#: End tags that reach through those all the same.
FAR_ENDS = frozenset("table tr tbody thead tfoot body html".split())
#: Tables inside more than so many others are laid out with each cell on lines of its own, not in columns.
ALIGNED_LEVELS = 32
#: Columns begin within so many characters of a line; cells further on follow each other two spaces apart.
WIDEST = 1000

# A quote opens a value only directly after "="; elsewhere, in unquoted values and without a second one it is an ordinary character.
_NAMED = r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^ \t\n\r\f>]++))?+)?+"
_ATTRIBUTE = re.compile(_NAMED)
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_NAMED})*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)")
_FILL = re.compile(r"[ \t\n\r\f/]*+")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_START = re.compile(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", re.IGNORECASE)
_SPAN = re.compile(r"\b(colspan|rowspan)\s*=\s*[\"']?\s*(\d{1,5})", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.IGNORECASE) for tag in RAW}


class Element:
    """`gone` elements take no part; text of elements that are not `seen` (visibility) is left out."""

    __slots__ = ("children", "columns", "gone", "level", "lines", "rows", "seen", "start", "tag")

    def __init__(self, tag: str, seen: bool = True, children: list | None = None):
        self.tag, self.seen, self.gone = tag, seen, False
        self.children: list[Element | str] = [] if children is None else children
        self.start, self.columns, self.rows, self.level = 1, 1, 1, 0
        self.lines: list[str] | None = None


class Tags:
    """The tags of a page in order: (start, end, slash, name, attributes), or no name for comments and the like.

    A tag that has no end before the page's is text. After the first such tag the attributes are read
    one by one, and places from where no end is reached are remembered, so the time stays linear.
    """

    def __init__(self, html: str):
        self.html, self.last, self.dead, self.slow = html, html.rfind(">"), set(), False

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, "", None, ""
            if at > self.last:  # only a comment that never ends may follow
                at = html.find("<!--", at)
                return None if at < 0 else (at, len(html), "", None, "")
            after = html[at + 1 : at + 2]
            if after in ("!", "?") or after == "/" and not html[at + 2 : at + 3].isalpha():
                return at, html.find(">", at) + 1, "", None, ""
            if m := self._slowly(at) if self.slow else self._quickly(at):
                return m
            at += 1
        return None

    def _quickly(self, at: int):
        m = _TAG.match(self.html, at)
        if m:
            return at, m.end(), m[1], m[2].lower(), m[3]
        self.slow = _NAME.match(self.html, at) is not None
        return None

    def _slowly(self, at: int):
        html, m = self.html, _NAME.match(self.html, at)
        if m is None:
            return None
        passed, here = [], m.end()
        while True:
            here = _FILL.match(html, here).end()
            if here >= len(html) or here in self.dead:
                self.dead.update(passed)
                return None
            if html[here] == ">":
                return at, here + 1, m[1], m[2].lower(), html[m.end() : here]
            passed.append(here)
            here = _ATTRIBUTE.match(html, here).end()


class Tree:
    """Open elements, and by tag the places of those among them."""

    def __init__(self):
        self.stack, self.places, self.tables = [Element("html")], {}, []

    def at(self, tag: str) -> int:
        """Place of the innermost open element of that tag, else 0."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def open(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        for element in self.stack[k:]:
            self.places[element.tag].pop()
        del self.stack[k:]

    def put(self, tag: str, seen: bool | None = None) -> Element:
        parent = self.stack[-1]
        element = Element(tag, parent.seen if seen is None else seen)
        parent.children.append(element)
        if tag == "table":
            element.level = len(self.places.get("table", ()))
            self.tables.append(element)
        return element

    def imply(self, tag: str) -> None:
        """The ends that a start tag implies, and the row that a cell needs."""
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            edge = max(map(self.at, bound))
            if tag in ("li", "dt", "dd", "td", "th"):  # the innermost only
                k = max(map(self.at, closed))
            else:
                k = min((own[n] for own in map(self.places.get, closed) if own and (n := bisect_right(own, edge)) < len(own)), default=0)
            if k > edge:
                self.cut(k)
        if tag in BLOCK and tag not in ("html", "body"):
            k = self.at("p")
            if k > max(map(self.at, SCOPE)):
                self.cut(k)
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.open(self.put("tr"))

    def close(self, tag: str) -> None:
        k = self.at(tag)
        if k and (tag in FAR_ENDS or k >= max(map(self.at, SCOPE))):
            self.cut(k)
        elif tag == "br" and not k:
            self.put("br")


def parse(html: str) -> Tree:
    """The tree of a page; end tags that are left out or too many are supplied or passed over."""
    tree, tags, at, end = Tree(), Tags(html), 0, len(html)
    while at < end:
        found = tags.next(at)
        begin = end if found is None else found[0]
        if begin > at:
            tree.stack[-1].children.append(unescape(html[at:begin]))
        if found is None:
            break
        _, at, slash, tag, attributes = found
        if tag is None or tag == "html" and not slash:
            continue
        if slash:
            tree.close(tag)
            continue
        tree.imply(tag)
        gone, seen = _hides(tag, attributes)
        element = tree.put(tag, seen)
        element.gone = gone or tag in HIDDEN
        if tag == "ol" and (m := _START.search(attributes)):
            element.start = int(m[1])
        elif tag in ("td", "th"):
            for name, n in _SPAN.findall(attributes):
                if name.lower() == "colspan":
                    element.columns = min(max(int(n), 1), 1000)
                else:
                    element.rows = int(n) or end  # 0: to the end of the table
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            if tag == "xmp":  # shown as it stands, without tags or references
                element.children.append(html[at : close.start() if close else end])
            at = (html.find(">", close.start()) + 1 or end) if close else end
        elif tag not in VOID:  # a slash closes no element but the void ones
            tree.open(element)
    return tree


def _hides(tag: str, attributes: str) -> tuple[bool, bool | None]:
    """Whether the element takes no part, and the visibility that it sets for what is in it, if it does."""
    gone, seen, opened = False, None, False
    for m in _ATTRIBUTE.finditer(attributes) if attributes and attributes != "/" else ():
        name = m[1].lower()
        if name == "hidden":
            gone = True
        elif name == "open":
            opened = True
        elif name == "style":
            for what, value in _STYLE.findall(unescape(m[2] or m[3] or m[4] or "")):  # the last one holds
                if what.lower() == "visibility":
                    seen = value.lower() not in ("hidden", "collapse") if value.lower() != "inherit" else None
                else:
                    gone = value.lower() == "none"
    return gone or tag == "dialog" and not opened, seen


class Page:
    """Lines under construction; `gap` is how many line ends must stand before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""
        self.tight = 0  # without blank lines while above 0

    def break_to(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, 1 if self.tight else gap)

    def flush(self) -> None:
        if self.line:
            text = "".join(self.line).rstrip(" ")
            self.line, self.space = [], False
            if text:
                if self.lines:
                    self.lines += [""] * (self.gap - 1)
                self.gap = 1
                self.lines.append(text)
        self.space = False

    def _head(self) -> None:
        if not self.line:
            self.line.append(self.mark or self.indent)
            if self.mark:
                self.mark = ""

    def text(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line)
            return
        fresh = not self.line
        self._head()
        if not fresh and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def literal(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self.end_line()
            if part:
                self._head()
                self.line.append(part)

    def end_line(self) -> None:
        if self.line:
            self.flush()
        elif self.lines and not self.tight:
            self.gap += 1

    def result(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def render(root: Element) -> str:
    """The text below an element; tables that are laid out in columns have their lines already."""
    page = Page()
    # an open element: its children, itself, whether spaces count, the next number of a list, and what its end restores
    stack = [[iter(root.children), root, False, root.start, None]]
    while stack:
        frame = stack[-1]
        children, node, pre, number, after = frame
        child = next(children, None)
        if child is None:
            stack.pop()
            if after is not None:
                gap, indent, tight = after
                page.tight = tight
                page.break_to(gap)
                if indent is not None:
                    page.indent = indent
                if node.tag == "li":
                    page.mark = ""
            continue
        if isinstance(child, str):
            if node.seen:
                (page.literal if pre else page.text)(child)
            continue
        tag = child.tag
        if child.gone:
            continue
        if tag == "br":
            page.end_line()
        elif tag == "table":
            page.break_to(2)
            if child.lines is None:  # one cell under the other
                stack.append([iter([*_stacked(child)]), child, False, 1, (2, None, page.tight)])
                page.tight += 1
            else:
                for line in child.lines:
                    page.literal(line)
                    page.flush()
                page.break_to(2)
        elif tag == "li":
            page.break_to(1)
            bullet = f"{number}. " if node.tag == "ol" else "- "
            frame[3] += 1
            stack.append([iter(child.children), child, pre, child.start, (1, page.indent, page.tight)])
            page.mark = page.indent + bullet
            page.indent += " " * len(bullet)
        elif tag in BLOCK:
            gap = 2 if tag in PARAGRAPH and not (tag in ("ul", "ol") and page.indent) else 1
            page.break_to(gap)
            stack.append([iter(child.children), child, pre or tag in ("pre", "xmp"), child.start, (gap, page.indent, page.tight)])
            if tag in ("blockquote", "dd"):
                page.indent += "  "
        else:
            stack.append([iter(child.children), child, pre, child.start, None])
    return page.result()


def _rows(table: Element) -> Iterator[tuple[Element, list[Element] | None]]:
    """Boxes of a table that are lines of their own, and rows with their cells; text beside cells stands above the row, as browsers show it."""
    stack = [(iter(table.children), table)]
    while stack:
        children, node = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            if child.strip():
                yield Element("div", node.seen, [child]), None
        elif child.gone or child.tag == "col":
            continue
        elif child.tag == "tr":
            for c in child.children:
                if isinstance(c, str) and c.strip():
                    yield Element("div", child.seen, [c]), None
            yield child, [c for c in child.children if isinstance(c, Element) and not c.gone]
        elif child.tag in ("tbody", "thead", "tfoot", "colgroup"):
            stack.append((iter(child.children), child))
        else:
            yield Element("div", child.seen, child.children if child.tag == "caption" else [child]), None


def _stacked(table: Element) -> Iterator[Element]:
    for box, cells in _rows(table):
        if cells is None:
            yield box
        else:
            yield from (Element("div", c.seen, c.children) for c in cells)


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring columns that are held equally long become one span."""
    out: list[tuple[int, int, int]] = []
    for start, stop, last in spans:
        if out and out[-1][1] == start and out[-1][2] == last:
            out[-1] = (out[-1][0], stop, last)
        else:
            out.append((start, stop, last))
    return out


def _lay_out(table: Element) -> None:
    """Lines of a table with several cells in a row: columns begin at one place, cells of several lines or rows keep theirs."""
    rows = list(_rows(table))
    if table.level > ALIGNED_LEVELS or not any(cells and len(cells) > 1 for _, cells in rows):
        return
    held: list[tuple[int, int, int]] = []  # columns from, to, and the last row for which cells from above hold them
    grid: list[list[tuple[int, int, list[str]]] | str] = []
    for box, cells in rows:
        if cells is None:
            grid.append(render(box))
            continue
        line, column, k, row, below = [], 0, 0, len(grid), []
        for c in cells:
            while k < len(held) and held[k][0] <= column:
                column = max(column, held[k][1])
                k += 1
            line.append((column, column + c.columns, render(c).split("\n")))
            if c.rows > 1:
                below.append((column, column + c.columns, row + c.rows - 1))
            column += c.columns
        grid.append(line)
        if below or any(last == row for _, _, last in held):
            held = _joined(sorted([x for x in held if x[2] > row] + below))
    starts = sorted({start for line in grid if not isinstance(line, str) for start, _, _ in line})
    ends: dict[int, list[tuple[int, int]]] = {}  # first column behind a cell: where the cell begins, how wide it is
    for line in grid:
        for start, stop, cell in line if not isinstance(line, str) and len(line) > 1 else ():
            if (k := bisect_left(starts, stop)) < len(starts):
                ends.setdefault(starts[k], []).append((start, max(map(len, cell))))
    place, here = {}, 0
    for start in starts:
        for before, width in ends.get(start, ()):
            here = max(here, place[before] + width + 2)
        place[start] = min(here, WIDEST)
    table.lines = []
    for line in grid:
        if isinstance(line, str):
            table.lines += filter(None, line.split("\n"))
            continue
        for n in range(max((len(cell) for _, _, cell in line), default=0)):
            text = ""
            for start, _, cell in line:
                if n < len(cell) and cell[n]:
                    text = text.ljust(place[start] if len(text) + 2 <= place[start] or not text else len(text) + 2) + cell[n]
            if text.rstrip():
                table.lines.append(text.rstrip())


def extract(html: str | None) -> str:
    """All visible text of a page; null and blank pages give empty text."""
    if not html:
        return ""
    tree = parse(html)
    for table in reversed(tree.tables):  # inner ones first
        _lay_out(table)
    return render(tree.stack[0])


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Per row: the id and `text`, the visible text laid out in lines.

    Where each block starts and ends stays to be seen: paragraphs, headings, lists and tables stand
    apart by a blank line, other blocks by a line end, list items have a bullet or number and indent,
    cells are aligned by column, preformatted text keeps its spaces. Hidden is what HTML never shows
    (head, scripts, styles, templates, form choices), the hidden attribute, style display none, and
    visibility hidden, unless an element inside is visible again. Cells that span columns or rows keep
    the others in their places. Defined results: null or empty pages give empty text; tags left open,
    unknown or nested however deep lose no text (only tables inside more than ALIGNED_LEVELS others
    are not laid out in columns); a tag without its end is text; time grows in proportion to a page's
    length; an empty table gives an empty result; repeated rows get the same result each; other
    columns, whatever their names, are ignored. One narrow pass, no shuffle.
    """
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())], [id_column, "text"])

    source = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).cast("string").alias("html"))
    return source.mapInArrow(work, f"{id_column} long, text string")
