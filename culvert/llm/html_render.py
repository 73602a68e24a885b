"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text rendering of what is left.

Every page is parsed into a tree the way browsers mend it (end tags that may be left out, raw-text elements, tables
that close what is open in them), hidden elements are dropped, and the rest is laid out as text: blocks on lines of
their own, blank lines around paragraphs, markers and indents of lists, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from culvert.llm.common import added, append, arrow_map, table

# fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas datalist title".split())
UNSEEN_SVG = frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CLOSES_P | frozenset("html body tr thead tbody tfoot caption option optgroup legend".split())
SPACED = HEADINGS | frozenset("p ul ol dl dir menu table blockquote pre figure fieldset hr address".split())
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
PARTS = CELLS | SECTIONS | {"tr", "col", "colgroup"}
#: a start tag ends open elements of the second set, looked for up to the nearest element of the third
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{s: ({*SECTIONS, "caption", "colgroup"}, {"table"}) for s in SECTIONS},
}
#: closing or implying never reaches out of these
WALLS = frozenset("table td th caption html template".split())

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\f\r]+")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?")
DISPLAY = re.compile(r"(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
#: elements deeper than this become siblings, as in browsers; spans are at most what the HTML standard allows
MAX_DEPTH, MAX_ACROSS, MAX_DOWN = 200, 1000, 65534
#: a column is padded to its widest line if that adds at most so many times the table's own text, else to its lines of up to NARROW
PADDING, NARROW = 16, 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class Tags:
    """The tags, comments and declarations of a page.

    A ``>`` in quotes does not end a tag, unless the quotes are never closed; then the first ``>`` does. A ``<`` behind which no ``>`` comes is
    text. The page is read forward once: that a scan from a certain quote finds no end is remembered, not found out again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.doomed = page, page.rfind(">"), set()

    def following(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first one from ``at`` on: begin, end, "/" of an end tag, name (empty if it is no tag), attributes."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if (m := COMMENT.match(page, at)) is not None:
                return at, m.end(), "", "", ""
            if (m := NAME.match(page, at)) is not None and self.last >= m.end():
                end = self.closed(m.end())
                return at, end + 1, m[1], m[2], page[m.end() : end]
            at += 1
        return None

    def closed(self, begin: int) -> int:
        """Where the tag ends whose name ends at ``begin``."""
        k, met = begin, []
        while (found := SPECIAL.search(self.page, k)) is not None:
            k = found.start()
            if found[0] == ">":
                return k
            if k in self.doomed:
                break
            met.append(k)
            if (k := self.page.find(found[0], k + 1) + 1) == 0:
                break
        self.doomed.update(met)
        return self.page.find(">", begin)


class Builder:
    """The tree of a page, and its style sheets."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.stack, self.styles = [self.root], []
        at, found = 0, Tags(page)
        while (token := found.following(at)) is not None:
            begin, after, closing, tag, rest = token
            self.text(page[at:begin])
            at = after
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self.end(tag)
                continue
            self.start(tag, attributes(rest) if rest and rest.strip("/ \n\t") else {})
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                inside = page[at : end.start() if end else len(page)]
                if tag == "style":
                    self.styles.append(inside)
                elif tag in ("textarea", "title"):
                    self.stack[-1].children.append(html.unescape(inside))
                self.end(tag)
                at = end.end() if end else len(page)
        self.text(page[at:])

    def text(self, text: str) -> None:
        if text:
            if self.stack[-1].tag == "head" and text.strip():
                self.stack.pop()
            self.stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def close(self, tags, stop) -> None:
        """Ends the innermost open element of ``tags`` and all inside it, if one is open this side of ``stop``."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                del self.stack[k:]
                return
            if tag in stop:
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            self.close({"head"}, ())
            if tag == "html" or any(n.tag == "body" for n in self.stack):
                for name, value in attrs.items():
                    self.root.attrs.setdefault(name, value)
                return
        elif self.stack[-1].tag == "head" and tag not in HEAD:
            self.stack.pop()
        if tag in CLOSES_P:
            self.close({"p"}, WALLS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
            if tag == "tr" or tag in SECTIONS:
                self.close({"tr"}, {"table"})
            if tag in SECTIONS:
                self.close(SECTIONS, {"table"})
        if tag in CELLS and self.stack[-1].tag in SECTIONS | {"table"}:
            self.push(Node("tr", {}))
        self.push(Node(tag, attrs))
        if tag in VOID:
            self.stack.pop()

    def push(self, node: Node) -> None:
        if len(self.stack) >= MAX_DEPTH:
            self.stack.pop()
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not any(n.tag == "p" for n in self.stack):
            self.stack[-1].children.append(Node("p", {}))
        elif tag not in ("html", "body"):
            self.close({tag}, () if tag in ("table", "template") else {"table"} if tag in CELLS | SECTIONS | {"tr", "caption"} else WALLS)


def on_screen(condition: str) -> bool:
    """Whether a rule group applies to a screen of unknown size: conditions on features do not."""
    for query in condition.lower().split(","):
        words = query.split()
        negated = words[:1] == ["not"]
        words = words[1:] if words[:1] in (["not"], ["only"]) else words
        if len(words) == 1 and "(" not in query and (words[0] in ("all", "screen")) != negated:
            return True
    return False


def css_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that apply to a screen, in order; one forward scan, groups may be nested."""
    sheet, at, open_blocks = CSS_COMMENT.sub(" ", sheet), 0, []
    for m in re.finditer(r"[{};]", sheet):
        inside = sheet[at : m.start()].strip()
        if m[0] == "{":
            group = inside.lower()
            applies = not open_blocks or open_blocks[-1][1]
            if group.startswith("@media"):
                applies = applies and on_screen(inside[6:])
            elif group.startswith("@"):
                applies = applies and group.startswith("@layer")
            open_blocks.append((inside, applies, []))
        elif open_blocks:
            if inside:
                open_blocks[-1][2].append(inside)
            if m[0] == "}":
                selectors, applies, body = open_blocks.pop()
                if applies and not selectors.startswith("@"):
                    yield selectors, ";".join(body)
        at = m.end()


def declared(body: str) -> Iterator[tuple[str, bool, bool]]:
    """(property, important, whether it hides) of the declarations that matter here."""
    for part in body.split(";"):
        if (m := DISPLAY.match(part.strip())) is not None:
            yield m[1].lower(), bool(m[3]), m[2].lower() in ("none", "hidden", "collapse")


def style_rules(styles: list[str]) -> dict[tuple[str, str], list]:
    """What simple selectors say of display and visibility: (element, .class or #id), an empty part for any, to ranked values."""
    found: dict[tuple[str, str], list] = {}
    order = 0
    for sheet in styles:
        for selectors, body in css_rules(sheet):
            for prop, important, hides in declared(body):
                for s in selectors.split(","):
                    order += 1
                    if (m := SIMPLE.fullmatch(s.strip())) and s.strip():
                        weight = ((m[2] or "").startswith("#"), (m[2] or "").startswith("."), bool(m[1]))
                        found.setdefault(((m[1] or "").lower(), m[2] or ""), []).append((prop, (important, False, weight, order), hides))
    return found


def shown(node: Node, rules: dict[tuple[str, str], list], visible: bool) -> tuple[bool, bool]:
    """Whether a node is displayed, and whether its own text is visible, by the cascade; visibility is inherited."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False, False
    best: dict[str, tuple] = {}
    if rules:
        names = ["", *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if "id" in a else [])]
        for key in ((tag, name) for tag in ("", node.tag) for name in names):
            for prop, rank, hides in rules.get(key, ()):
                if prop not in best or best[prop][0] < rank:
                    best[prop] = (rank, hides)
    if a and "style" in a:
        for k, (prop, important, hides) in enumerate(declared(CSS_COMMENT.sub(" ", a["style"]))):
            rank = (important, True, (False, False, False), k)
            if prop not in best or best[prop][0] < rank:
                best[prop] = (rank, hides)
    absent = "hidden" in a or node.tag == "dialog" and "open" not in a
    return not best.get("display", (None, absent))[1], not best.get("visibility", (None, not visible))[1]


def prune(root: Node, rules: dict[tuple[str, str], list]) -> None:
    """Takes out of a tree what is not displayed, and the strings that are not visible."""
    displayed, visible = shown(root, rules, True)
    left = [(root, visible, False)]
    if not displayed:
        root.children, left = [], []
    while left:
        node, visible, drawing = left.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                if visible:
                    kept.append(child)
                continue
            displayed, inner = shown(child, rules, visible)
            if not displayed or drawing and child.tag in UNSEEN_SVG:
                continue
            kept.extend((" ", child, " ") if drawing and child.tag == "text" else (child,))
            left.append((child, inner, drawing or child.tag == "svg"))
        node.children = kept


class Page:
    """Lines of text under construction."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], [], 0, False
        self.indent: list[str] = []
        self.marker = ""

    def block(self, gap: int) -> None:
        """Ends the line; ``gap`` of 2 asks for a blank line before what follows."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.gap = [], 0
        self.space, self.gap = False, max(self.gap, gap)

    def put(self, text: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            inner = "".join(self.indent)
            self.line.append(inner[: len(inner) - len(self.marker)] + self.marker if self.marker else inner)
            self.marker = ""
        self.line.append(text)

    def text(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        if words.startswith(" ") or self.space:
            words = words.lstrip(" ")
            if self.line and words:
                self.line.append(" ")
            self.space = self.space or bool(self.line)
        if words:
            self.space = words.endswith(" ")
            self.put(words.rstrip(" ") if self.space else words)

    def break_line(self) -> None:
        if self.line:
            self.block(0)
        else:
            self.gap = max(self.gap, 2 if self.lines else 0)

    def done(self) -> list[str]:
        self.block(0)
        return self.lines

    def render(self, node: Node, pre: bool = False) -> None:
        for child in node.children:
            if isinstance(child, str):
                if pre:
                    for k, line in enumerate(child.split("\n")):
                        if k:
                            self.block(0) if self.line else self.lines.append("")
                        if line:
                            self.put(line)
                else:
                    self.text(child)
            else:
                self.element(child, pre)

    def element(self, node: Node, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            self.break_line()
        elif tag == "table":
            self.block(2)
            for line in table_lines(node):
                self.put(line)
                self.block(0)
            self.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list_of(node, tag == "ol")
        elif tag == "li":
            self.item(node, "- ")
        elif tag == "select":
            options = [n for n in walk(node) if n.tag == "option"]
            for option in [n for n in options if "selected" in n.attrs] or options[:1]:
                self.render(option)
        elif tag == "details" and "open" not in node.attrs:
            for child in node.children:
                if not isinstance(child, str) and child.tag == "summary":
                    self.element(child, pre)
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            self.block(gap)
            deep = tag in ("blockquote", "dd")
            if deep:
                self.indent.append("  ")
            self.render(node, pre or tag == "pre")
            if deep:
                self.block(0)
                self.indent.pop()
            self.block(gap)
        else:
            self.render(node, pre)

    def item(self, node: Node, marker: str) -> None:
        self.block(1)
        self.indent.append(" " * len(marker))
        self.marker = marker
        self.render(node)
        self.block(1)
        self.marker = ""
        self.indent.pop()

    def list_of(self, node: Node, ordered: bool) -> None:
        nested = bool(self.indent)
        self.block(1 if nested else 2)
        items = [c for c in node.children if not isinstance(c, str) and c.tag == "li"]
        step = -1 if "reversed" in node.attrs else 1
        number = whole(node.attrs.get("start"), len(items) if step < 0 else 1)
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif child.tag == "li":
                number = whole(child.attrs.get("value"), number)
                self.item(child, f"{number}. " if ordered else "- ")
                number += step
            else:
                self.element(child, False)
        self.block(1 if nested else 2)


def whole(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"[+-]?\d{1,9}", text.strip()) else default


def walk(node: Node) -> Iterator[Node]:
    for child in node.children:
        if not isinstance(child, str):
            yield child
            yield from walk(child)


def has_cells(node: Node) -> bool:
    """Whether rows or cells of the table around stand in an element."""
    left = [node]
    while left:
        for child in left.pop().children:
            if not isinstance(child, str) and child.tag != "table":
                if child.tag == "tr" or child.tag in CELLS or child.tag in SECTIONS:
                    return True
                left.append(child)
    return False


def table_lines(node: Node) -> list[str]:
    """A table as lines: its caption, then rows with their cells in columns."""
    rows, stray = {"thead": [], "": [], "tfoot": []}, []

    def collect(part: Node, group: str, row: list[Node] | None) -> None:
        for child in part.children:
            if isinstance(child, str):
                stray.append(child)
                continue
            if child.tag not in PARTS and not has_cells(child):
                stray.append(child)
                continue
            stray.append(" ")  # parts of the table stand between the strings around them
            if child.tag in CELLS:
                if row is None:  # a cell without a row begins one
                    rows[group].append(row := [])
                row.append(child)
            elif child.tag == "tr":
                rows[group].append(own := [])
                collect(child, group, own)
                row = None
            elif child.tag in SECTIONS:
                collect(child, "" if child.tag == "tbody" else child.tag, None)
                row = None
            else:
                collect(child, group, row)  # columns, a form or another wrapper around cells or rows
            stray.append(" ")

    collect(node, "", None)
    # what stands in a table outside its cells goes before it
    loose = Page()
    for child in stray:
        if isinstance(child, str):
            loose.text(child)
        else:
            loose.element(child, False)
    lines, widths, narrow, laid, taken = loose.done(), {}, {}, [], {}
    for cells in [*rows["thead"], *rows[""], *rows["tfoot"]]:
        at, row = 0, []
        for cell in cells:
            while taken.get(at, 0) > 0:
                at += 1
            page = Page()
            page.render(cell)
            text = page.done()
            across = min(MAX_ACROSS, max(1, whole(cell.attrs.get("colspan"), 1)))
            down = min(MAX_DOWN, max(1, whole(cell.attrs.get("rowspan"), 1)))
            row.append((at, text))
            if across == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, text), default=0))
                narrow[at] = max(narrow.get(at, 0), max((len(x) for x in text if len(x) <= NARROW), default=0))
            for k in range(at, at + across):
                taken[k] = down
            at += across
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        laid.append(row)
    height = sum(max((len(text) for _, text in row), default=0) for row in laid)
    own = sum(len(line) for row in laid for _, text in row for line in text)
    widths = {k: w if w * height <= PADDING * own + NARROW * height else narrow[k] for k, w in widths.items()}
    begins, at = {}, 0
    for k in range(max(widths, default=-1) + 1):
        begins[k] = at
        at += widths.get(k, 0) + (2 if widths.get(k, 0) else 0)
    for row in laid:
        for k in range(max((len(text) for _, text in row), default=0)):
            line = ""
            for column, text in row:
                if k < len(text) and text[k]:
                    line = line.ljust(begins.get(column, at))
                    line += ("  " if line and not line.endswith("  ") else "") + text[k]
            lines.append(line.rstrip(" "))
    return lines


def render(page: str) -> str:
    """All visible text of a page, laid out."""
    tree = Builder(page)
    prune(tree.root, style_rules(tree.styles))
    out = Page()
    out.render(tree.root)
    return "\n".join(out.done())


def _rendered(batches: Iterator[pa.RecordBatch], html_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield append(batch.select([n for k, n in enumerate(batch.schema.names) if k != html_at]), text=pa.array([render(p or "") for p in batch.column(html_at).to_pylist()], pa.string()))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``text`` instead of their markup.

    Null and empty pages give an empty text. Rows are independent, so repeats, ties and empty tables need no rule; a
    column named text is replaced.
    """
    base = pages.drop("text") if html_col != "text" else pages
    kept = base.drop(html_col)
    return arrow_map(base, partial(_rendered, html_at=base.columns.index(html_col)), added(kept, "text string") if kept.columns else "text string")


def op7_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
