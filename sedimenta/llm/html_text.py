"""Layout-aware text of HTML pages.

A tree builder supplies the tags that HTML implies (a `p`, list item, cell or row ends where the next begins), a visibility pass drops
what a browser doesn't show, by attributes, styles and the simple selectors of style sheets (of formulas and drawings it keeps the text shown, of inputs the values
of buttons, of images what stands for them), and a renderer writes the rest: blank lines between blocks, list markers with indents, and
table cells in aligned columns, also where cells span rows and columns. All steps run on explicit stacks, so deep nesting is no danger.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sedimenta.llm.rows import tidy

SCHEMA = "page_id long, text string, n_chars long, n_blocks int, n_list_items int, n_tables int"
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)
    |</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)
    |<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|["'=])*+)(?:>|\Z)
    |(?P<text><|[^<]+)""",
    re.S | re.X,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
NO_CONTENT = re.compile(r"content-visibility\s*:\s*hidden", re.I)
# Fixed values of the HTML standard: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes audio video canvas datalist progress meter rp".split())
MARGIN = frozenset("p blockquote dl fieldset figure form h1 h2 h3 h4 h5 h6 hr ol pre table ul".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = (BLOCK - frozenset("body html caption optgroup option tbody td tfoot th thead tr legend".split())) - {"p"} | {"p"}
#: An element that ends when one of these begins, unless a boundary stands between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Of a drawing the elements whose text a browser draws or looks into; of a formula those whose text it doesn't show.
SVG_SHOWN, SVG_TEXT = frozenset("svg g a switch text tspan textpath foreignobject".split()), frozenset("text tspan textpath".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: Where HTML goes on inside these, and the tags that end them elsewhere.
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var br".split())
BUTTONS = frozenset("submit reset button".split())
#: Inputs that show the text in them, or else their placeholder; an unknown kind is a text.
UNWRITTEN = frozenset("hidden checkbox radio file range color password image submit reset button".split())
#: The captions of buttons that have no value of their own.
CAPTIONS = {"submit": "Submit", "reset": "Reset"}
SCOPE = frozenset("table td th caption html template object".split())


#: Where a rule hides, shows or says nothing: display, and visibility.
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree of a page; text is kept as strings among the children."""
    root = Node("html", {})
    stack, at, match = [root], 0, TOKEN.match
    open_tags: dict[str, list[int]] = {"html": [0]}  # where in the stack the open elements of each tag are

    def pop() -> None:
        open_tags[stack.pop().tag].pop()

    def innermost(tags: frozenset[str] | set[str], but: frozenset[str] | set[str] = frozenset()) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((open_tags[t][-1] for t in tags if t not in but and open_tags.get(t)), default=0)

    def close(tags: set[str], bounds: frozenset[str] | set[str]) -> None:
        """Ends the outermost open element of these tags inside the nearest boundary."""
        if not any(open_tags.get(t) for t in tags):
            return
        bound = innermost(bounds, tags)
        found = min((places[k] for t in tags if (places := open_tags.get(t)) and (k := bisect_right(places, bound)) < len(places)), default=0)
        while found and len(stack) > found:
            pop()

    def start(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            open_tags.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def foreign() -> bool:
        """Inside a drawing or formula, where no HTML goes on."""
        if open_tags.get("svg") or open_tags.get("math"):
            return innermost({"svg", "math"}) > innermost(HTML_INSIDE)
        return False

    while at < len(source):
        m = match(source, at)
        at = m.end()
        if m["text"]:
            stack[-1].children.append(entities.unescape(m["text"]) if "&" in m["text"] else m["text"])
            continue
        if tag := (m["start"] or "").lower():
            attrs = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(m["attrs"])} if m["attrs"].strip(" /\n\t") else {}
            if tag in ("html", "body"):
                if tag == "body":
                    close({"head"}, frozenset())
                    start(tag, attrs) if not open_tags.get("body") else None
                continue
            if tag not in ("title", "meta", "link", "base", "script", "style", "template", "noscript") and open_tags.get("head"):
                close({"head"}, frozenset())  # the body begins, whether its tag is there or not
            if tag in BREAKOUT and foreign():
                close({"svg", "math"}, HTML_INSIDE)
            elif m["attrs"].endswith("/") and (tag in ("svg", "math") or foreign()):
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                close({"p"}, SCOPE)
            if tag in ENDED_BY:
                close(*ENDED_BY[tag])
            if tag in ("td", "th") and open_tags.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                start("tr", {})
            if tag in RAW or tag in ("textarea", "title"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                inner = source[at : end.start() if end else len(source)]
                at = end.end() if end else len(source)
                node = Node(tag, attrs)
                node.children.append(inner if tag in RAW else entities.unescape(inner))
                stack[-1].children.append(node)
            else:
                start(tag, attrs)
        elif tag := (m["end"] or "").lower():
            if tag == "br":
                start("br", {})
            elif tag == "p" and not open_tags.get("p"):
                start("p", {})
                pop()
            elif open_tags.get(tag) and tag not in ("html", "body"):
                last = open_tags[tag][-1]
                if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption") or last > innermost(SCOPE, {tag}):
                    while len(stack) > last:
                        pop()
    return root


class Flow:
    """Lines of a block of text: white space collapses, margins collapse, indents and list markers stand before the lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.indents, self.marker, self.blocks = 0, [], "", 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.flush(True)
                self.now.append(line)
            return
        s = SPACE.sub(" ", s)
        if not self.now or self.now[-1].endswith((" ", "\n")):
            s = s.removeprefix(" ")
        if s:
            self.now.append(s)

    def flush(self, always: bool = False, pre: bool = False) -> None:
        line = "".join(self.now)
        line = line.rstrip(" \t\n\r\f") if not pre else line.rstrip("\n")
        self.now = []
        if line or self.marker and always:
            self.blocks += 1
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            indent = "".join(self.indents)
            if self.marker:
                indent, self.marker = indent[: len(indent) - len(self.marker)] + self.marker, ""
            self.lines.append((indent + line).rstrip())
        elif always and self.lines:
            self.lines.append("")

    def block(self, margin: bool) -> None:
        if self.now:
            self.flush()
        self.gap = max(self.gap, int(margin))

    def rendered(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def style_rules(root: Node) -> list[tuple[str, frozenset[str], frozenset[str], str]]:
    """(tag or '', classes, ids, declarations) of the page's style sheets, in their order, for rules that can hide. Only selectors of one element count - its
    tag, classes and id; @media and other blocks are passed over."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            sheet = re.sub(r"/\*.*?\*/", "", "".join(x for x in node.children if isinstance(x, str)), flags=re.S)
            sheet = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", "", sheet)
            for selectors, body in RULE.findall(sheet):
                if "display" in body or "visibility" in body:
                    for selector in selectors.split(","):
                        if (m := SELECTOR.match(selector.strip())) and m[0]:
                            names = re.findall(r"[.#][\w-]+", m[2])
                            out.append(((m[1] or "").lower().replace("*", ""), frozenset(n[1:] for n in names if n[0] == "."), frozenset(n[1:] for n in names if n[0] == "#"), body))
        else:
            todo += [x for x in reversed(node.children) if not isinstance(x, str)]
    return sorted(out, key=lambda r: (len(r[2]), len(r[1]), bool(r[0])))


def styled(tag: str, attrs: dict[str, str], rules: list[tuple[str, frozenset[str], frozenset[str], str]]) -> str:
    """The declarations that hold for an element, the strongest last: those of rules, and its own."""
    if not rules:
        return attrs.get("style", "")
    classes, own = frozenset(attrs.get("class", "").split()), {attrs.get("id", "")}
    return ";".join([body for t, c, i, body in rules if (not t or t == tag) and c <= classes and i <= own] + [attrs.get("style", "")])


DISPLAY, VISIBILITY = (re.compile(rf"(?:^|[;\s]){name}\s*:\s*([a-z-]+)", re.I) for name in ("display", "visibility"))


def width(s: str) -> int:
    """Columns of a terminal or a fixed-width page: wide characters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def filled(s: str, to: int) -> str:
    return s + " " * (to - width(s))


def number(s: str, default: int, most: int = 10**9) -> int:
    try:
        return max(-most, min(most, int(s)))
    except ValueError:
        return default


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Rows of (lines, colspan, rowspan) as rows of (column, lines, colspan): a cell begins in the first column that no cell of a row above still spans."""
    out, held = [], {}  # column -> rows that it is still taken in
    for row in rows:
        col, now, fresh = 0, [], {}
        for lines, span, down in row:
            while held.get(col):
                col += 1
            now.append((col, lines, span))
            if down > 1:
                fresh |= {c: down for c in range(col, col + span)}
            col += span
        held = {c: n - 1 for c, n in (held | fresh).items() if n > 1}
        out.append(now)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]], widest: int = 80) -> list[str]:
    """Rows of (lines, colspan, rowspan) with their columns aligned; a cell wider than `widest` is kept whole but moves only its own row."""
    widths: list[int] = []
    at = placed(rows)
    for row in at:
        for col, lines, span in row:
            widths += [0] * (col + 1 - len(widths))
            if span == 1:
                widths[col] = max(widths[col], min(widest, max(map(width, lines), default=0)))
    for row in at:
        for col, lines, span in row:
            if span > 1:  # what a wide cell lacks goes to the last of its columns
                widths += [0] * (col + min(span, 1000) - len(widths))
                lack = min(widest, max(map(width, lines), default=0)) - sum(widths[col : col + span]) - 2 * (span - 1)
                widths[col + span - 1] += max(0, lack)
    edges = [0]
    for w in widths:
        edges.append(edges[-1] + w + 2)
    out = []
    for row in at:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for col, lines, _ in row:
                edge = edges[min(col, len(edges) - 1)]
                line = filled(line, max(edge, width(line) + 2 if line else edge)) + (lines[k] if k < len(lines) else "")
            out.append(line.rstrip())
    return out


def chosen(select: Node) -> list[Node]:
    """What a closed drop-down list shows: the last option marked as selected, or else the first that isn't disabled."""
    options, todo = [], list(reversed(select.children))
    while todo:
        node = todo.pop()
        if not isinstance(node, str):
            options += [node] * (node.tag == "option")
            todo += reversed(node.children)
    return [o for o in options if "selected" in o.attrs][-1:] or [o for o in options if "disabled" not in o.attrs][:1]


def render(root: Node) -> tuple[str, int, int, int]:
    """The visible text, and the numbers of text lines, list items and tables."""
    flows, tables, lists, items, blocks, n_tables = [Flow()], [], [], 0, 0, 0
    rules = style_rules(root)
    todo: list[tuple] = [("in", root, False, False, "")]
    while todo:
        step, node, hidden, pre, space = todo.pop()  # space: svg, svg text or math inside one of these
        flow = flows[-1]
        if isinstance(node, str):
            if not hidden and space != "svg":
                flow.text(node, pre)
            continue
        tag, attrs = node.tag, node.attrs
        if step == "out":
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.block(not lists)
            elif tag == "li":
                flow.flush(bool(flow.marker))
                flow.marker = ""
                flow.indents.pop()
            elif tag in ("blockquote", "dd"):
                flow.block(tag == "blockquote")
                flow.indents.pop()
            elif tag == "pre":
                flow.flush(pre=True)
                flow.gap = 1
            elif tag in ("td", "th") and tables:
                lines = flow.rendered()
                blocks += flow.blocks
                flows.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, max(1, number(attrs.get("colspan", "1"), 1, 1000)), max(1, number(attrs.get("rowspan", "1"), 1, 65534))))
            elif tag == "table":
                flow.block(True)
                for line in table_lines(tables.pop()):
                    flow.now.append(line)
                    flow.flush(True)
                flow.gap = 1
            elif tag == "q":
                flow.text("”", True)
            elif tag == "text":
                flow.text(" ", False)
            elif tag in BLOCK:
                flow.block(tag in MARGIN)
            continue
        style = styled(tag, attrs, rules)
        shown = found[-1].lower() if style and (found := DISPLAY.findall(style)) else ""
        if tag in UNSEEN or not shown and ("hidden" in attrs and attrs["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in attrs):
            continue
        if style:
            if shown == "none" or NO_CONTENT.search(style):
                continue
            if found := VISIBILITY.findall(style):
                hidden = found[-1].lower() in ("hidden", "collapse") or hidden and found[-1].lower() != "visible"
        if tag == "br":
            flow.flush(True)
            continue
        if tag == "input":
            kind = attrs.get("type", "").strip().lower()
            caption = attrs.get("value", CAPTIONS.get(kind, "")) if kind in BUTTONS else attrs.get("alt", "") if kind == "image" else ""
            if kind not in UNWRITTEN:
                caption = attrs.get("value") or attrs.get("placeholder", "")
            if caption.strip() and not hidden:
                flow.text(f" {caption} ", False)
            continue
        if tag == "img":  # what a browser shows where the picture isn't
            if attrs.get("alt", "").strip() and not hidden:
                flow.text(attrs["alt"], False)
            continue
        if tag == "math":
            space = "math"
        elif space == "math" and tag in MATH_UNSEEN:
            continue
        elif tag == "svg":
            space = "svg"
        elif space.startswith("svg"):
            if tag not in SVG_SHOWN or attrs.get("display", "").strip() == "none":
                continue
            if shown := attrs.get("visibility", "").strip():
                hidden = shown in ("hidden", "collapse")
            space = "" if tag == "foreignobject" else "svg text" if tag in SVG_TEXT else space
            if tag == "text":
                flow.text(" ", False)
        children = node.children
        if tag == "details" and "open" not in attrs:
            children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
        if tag == "textarea" and not "".join(x for x in children if isinstance(x, str)).strip():
            children = [attrs.get("placeholder", "")]
        if tag == "select" and "multiple" not in attrs and number(attrs.get("size", "1"), 1) <= 1:
            children = chosen(node)
        if tag in ("ul", "ol", "menu", "dir"):
            flow.block(not lists)
            lists.append([number(attrs.get("start", ""), 1), tag == "ol"])
        elif tag == "li":
            flow.block(False)
            count, ordered = lists[-1] if lists else (0, False)
            count = number(attrs.get("value", ""), count)
            mark = f"{count}. " if ordered else "- "
            if lists:
                lists[-1][0] = count + 1
            flow.marker = "" if hidden else mark
            flow.indents.append(" " * len(mark))
            items += not hidden
        elif tag in ("blockquote", "dd"):
            flow.block(tag == "blockquote")
            flow.indents.append("  ")
        elif tag == "table":
            flow.block(True)
            tables.append([])
            n_tables += 1
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            flows.append(Flow())
        elif tag == "caption" and tables:
            flow.block(True)
        elif tag == "q":
            flow.text("“", True)
        elif tag == "hr":
            flow.block(True)
        elif tag in BLOCK:
            flow.block(tag in MARGIN)
        pre = pre or tag in ("pre", "textarea", "listing")
        if tag in BLOCK or tag == "q" or tag == "text" and space == "svg text":
            todo.append(("out", node, hidden, pre, space))
        todo += [("in", child, hidden, pre, space) for child in reversed(children)]
    lines = flows[0].rendered()
    return "\n".join(lines), blocks + flows[0].blocks, items, n_tables


def render_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per row: page_id, text (what a reader sees), its length, and the numbers of text lines, list items and tables.

    Null and empty pages, and pages with nothing to see, give an empty text. Very long pages are rendered whole in one pass. Repeated rows
    each give a row, a null key stays null, and other columns are ignored. Broken markup is read as browsers do: nothing is raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            rows = [render(parse(page.as_py() or "")) for page in batch.column(1)]
            text, blocks, items, tables = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *(pa.array(x, pa.int32()) for x in (blocks, items, tables))],
                names=["page_id", "text", "n_chars", "n_blocks", "n_list_items", "n_tables"],
            )

    return pages.select(pages[key].cast("long").alias("page_id"), pages[html].cast("string").alias("html")).mapInArrow(run, SCHEMA)
