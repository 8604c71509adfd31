"""HTML extraction by layout-aware rendering.

A tolerant tree builder (implied end tags, table scopes, raw text elements) and visibility rules (elements that
are never shown, hidden attributes, inline styles and simple style sheet selectors) give a tree of what is
visible. The renderer writes all of it as text: paragraphs apart, list items with markers and indents, table
cells in aligned columns, preformatted text as it stands. Pages are independent, so there is no shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm._shared import clash_free, lean, small_batches
from lanternfish.sources import tables

OUT = ("title", "rendered", "n_blocks")
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
AT_RULE = re.compile(r"@([\w-]+)([^{};]*)([{;])")
BRACE = re.compile(r"[{}]")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*?)((?:[.#][\w-]+)*)")
#: Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe title meta link datalist object audio video canvas map area base param source track rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure fieldset hr article section".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "optgroup", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: A start tag first closes an open element of these names, unless one of the fences is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
CELL_SCOPE = frozenset(("td", "th", "caption", "table", "template"))
P_SCOPE = CELL_SCOPE | {"button", "object", "marquee"}
#: Deeper elements become siblings; columns are aligned up to this width.
DEPTH, COLUMN = 150, 60
SPAN_MOST = 1000


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return out


def parse(page: str) -> Node:
    """The tree of a page; never raises on broken markup."""
    root = Node("html", {})
    stack = [root]
    at, end = 0, len(page)

    def add_text(text: str) -> None:
        if text:
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)

    def close(names, fences=()) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return True
            if stack[k].tag in fences:
                return False
        return False

    def open_(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if len(stack) < DEPTH:
            stack.append(node)
        return node

    last = page.rfind(">")
    while at < end:
        if at > last:  # no tag ends from here on; a comment may still begin
            end = page.find("<!--", at) % (end + 1)
            break
        m = TAG.search(page, at)
        if not m:
            break
        add_text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag == "p" and not close({"p"}, P_SCOPE):
                stack[-1].kids.append(Node("p", {}))
            elif tag in ("html", "body"):
                continue
            elif re.fullmatch("h[1-6]", tag):
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, CELL_SCOPE)
            elif tag == "table":
                close({tag}, {"template"})
            elif tag != "p":
                close({tag}, {"table", "template"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else CELL_SCOPE - {tag})
            continue
        attrs = _attributes(rest) if rest.strip(" \t\n\r\f/") else {}
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            for n in stack:
                if n.tag == tag:
                    n.attrs = attrs | n.attrs
            continue
        if tag in ENDS_P or tag == "table":
            close({"p"}, P_SCOPE)
        if tag in IMPLIED:
            names, fences = IMPLIED[tag]
            while close(names, fences | {"template"}):
                pass
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_("tr", {})
        node = Node(tag, attrs)
        if tag in VOID or rest.endswith("/") and tag in ("path", "rect", "circle", "use"):
            stack[-1].kids.append(node)
            continue
        if tag in RAW:
            stack[-1].kids.append(node)
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : stop.start() if stop else end]
            node.kids.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            at = stop.end() if stop else end
            continue
        open_(tag, attrs)
    add_text(page[at:end])
    return root


def _style(text: str) -> tuple[bool | None, bool | None]:
    """(displayed, visible) by style declarations, None if unsaid; the last of each counts, an important one before all."""
    if not text:
        return None, None
    told: dict[str, tuple[bool, bool]] = {}
    for name, value in re.findall(r"(?:^|;)(display|visibility):([^;]*)", re.sub(r"\s+", "", text.lower())):
        important = value.endswith("!important")
        if important or not told.get(name, (False, False))[0]:
            value = value.removesuffix("!important")
            told[name] = (important, value != "none" if name == "display" else value == "visible")
    return tuple(told[n][1] if n in told else None for n in ("display", "visibility"))


def _media_rules(css: str) -> str:
    """css with the rules of at-blocks that hold on a screen in place of the blocks; the other blocks are left out."""
    out, at = [], 0
    while (m := AT_RULE.search(css, at)) is not None:
        out.append(css[at : m.start()])
        at = m.end()
        if m[3] == ";":
            continue
        depth, begin = 1, at
        while depth and (brace := BRACE.search(css, at)) is not None:
            depth += 1 if brace[0] == "{" else -1
            at = brace.end()
        if depth:
            at = len(css)
        kind, query = m[1].lower(), m[2].lower()
        screen = kind == "media" and not re.search(r"\b(?:print|speech|not)\b", query) and not re.search(r"\([^)]*\)", query)
        if screen or kind in ("layer", "supports"):
            out.append(_media_rules(css[begin : at - 1]))
    out.append(css[at:])
    return "".join(out)


def _sheet(root: Node) -> list[tuple]:
    """(specificity, place, name, id, classes, rule) of rules that tell display or visibility, by weight.

    Selectors are names, .classes and #ids and what they make up together (p.a#b); those with other parts, or
    that look at more than one element, are left alone.
    """
    out: list[tuple] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            css = re.sub(r"/\*.*?\*/", "", "".join(k for k in node.kids if isinstance(k, str)), flags=re.S)
            for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", _media_rules(css)):
                rule = _style(body)
                if rule != (None, None):
                    for s in selectors.split(","):
                        if m := SELECTOR.fullmatch(s.strip()):
                            parts = re.findall(r"[.#][\w-]+", m[2])
                            ids, classes = ([p[1:] for p in parts if p[0] == mark] for mark in "#.")
                            name = m[1].lower() if m[1] not in ("", "*") else ""
                            out.append(((len(ids), len(classes), bool(name)), len(out), name, ids, classes, rule))
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return sorted(out, key=lambda r: r[:2])


class Renderer:
    def __init__(self, sheet: list):
        self.sheet, self.blocks = sheet, 0

    def hidden(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """(leave the element out, whether its text is visible)."""
        a = node.attrs
        if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
            return True, False
        if not a and not self.sheet:
            return False, visible
        shown: bool | None = None
        for _, _, name, ids, classes, rule in self.sheet:
            if (not name or name == node.tag) and all(i == a.get("id") for i in ids) and all(c in a.get("class", "").split() for c in classes):
                shown, visible = shown if rule[0] is None else rule[0], visible if rule[1] is None else rule[1]
        own = _style(a.get("style", ""))
        shown, visible = shown if own[0] is None else own[0], visible if own[1] is None else own[1]
        return (True, False) if shown is False else (False, visible)

    def lines(self, node: Node, visible: bool = True, pre: bool = False) -> list[str]:
        """The element's content as lines; an empty one stands for a paragraph's space."""
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            if run:
                text = "".join(run)
                run.clear()
                if pre:
                    out.extend(text.split("\n"))
                    return
                for part in text.split("\0"):
                    part = " ".join(part.split())
                    if part or "\0" in text:
                        out.append(part)
                while out and "\0" in text and not out[-1]:
                    out.pop()

        def space() -> None:
            if out and out[-1]:
                out.append("")

        def put(lines: list[str], apart: bool) -> None:
            flush()
            while lines and not lines[0].strip():
                lines.pop(0)
            while lines and not lines[-1].strip():
                lines.pop()
            if lines:
                self.blocks += 1
                if apart:
                    space()
                out.extend(lines)
                if apart:
                    out.append("")

        def visit(parent: Node, visible: bool) -> None:
            number = int(parent.attrs.get("start", "1")) if re.fullmatch(r"-?\d{1,9}", parent.attrs.get("start", "1")) else 1
            summary = parent.tag == "details" and "open" not in parent.attrs
            for kid in parent.kids:
                if isinstance(kid, str):
                    if visible and not summary:
                        run.append(kid if pre else kid.replace("\0", ""))
                    continue
                tag = kid.tag
                gone, seen = self.hidden(kid, visible)
                if gone or summary and tag != "summary":
                    continue
                if tag == "br":
                    run.append("\n" if pre else "\0")
                elif tag == "wbr" or tag == "img":
                    continue
                elif tag == "hr":
                    flush()
                    space()
                elif tag == "input":
                    if seen and kid.attrs.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "image", "range", "color"):
                        run.append(f" {kid.attrs.get('value', '')} ")
                elif tag == "select":
                    options = [k for k in _walk(kid) if k.tag == "option"]
                    chosen = [k for k in options if "selected" in k.attrs] or options[:1]
                    if seen:
                        run.append(" " + " ".join(" ".join(self.lines(k)) for k in chosen) + " ")
                elif tag == "table":
                    put(self.table(kid, seen), True)
                elif tag in ("pre", "textarea", "xmp"):
                    put(self.lines(kid, seen, True), True)
                elif tag == "li":
                    value = kid.attrs.get("value", "")
                    number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                    mark = f"{number}. " if parent.tag == "ol" else "- "
                    number += 1
                    own = self.lines(kid, seen, pre)
                    while own and not own[-1]:
                        own.pop()
                    own = [x for i, x in enumerate(own) if x or i and own[i - 1]]
                    put([(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(own)], False)
                elif tag in ("dd", "blockquote"):
                    put(["  " + x if x else x for x in self.lines(kid, seen, pre)], tag in SPACED)
                elif tag in ("ul", "ol", "menu", "dir") and parent.tag == "li":
                    put(self.lines(kid, seen, pre), False)
                elif tag in BLOCKS or tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                    put(self.lines(kid, seen, pre), tag in SPACED)
                else:
                    visit(kid, seen)

        visit(node, visible)
        flush()
        return out

    def table(self, node: Node, visible: bool) -> list[str]:
        """Rows of cells in aligned columns; captions above."""
        head: list[str] = []
        rows: list[list[tuple[list[str], int, int]]] = []

        def collect(parent: Node, visible: bool) -> None:
            for kid in parent.kids:
                if isinstance(kid, str):
                    if visible and kid.strip():
                        head.append(" ".join(kid.split()))
                    continue
                gone, seen = self.hidden(kid, visible)
                if gone:
                    continue
                if kid.tag == "tr":
                    cells = []
                    for c in kid.kids:
                        if isinstance(c, str):
                            if seen and c.strip():
                                head.append(" ".join(c.split()))
                            continue
                        off, shown = self.hidden(c, seen)
                        if not off:
                            span = [int(v) if (v := c.attrs.get(s, "1")).isdecimal() and 0 < int(v[:9]) else 1 for s in ("colspan", "rowspan")]
                            cells.append(([x for x in self.lines(c, shown) if x], min(span[0], SPAN_MOST), min(span[1], SPAN_MOST)))
                    rows.append(cells)
                elif kid.tag in ("tbody", "thead", "tfoot"):
                    collect(kid, seen)
                elif kid.tag not in ("colgroup", "col"):
                    head.extend(self.lines(kid, seen))

        collect(node, visible)
        busy: dict[int, int] = {}  # by column the first row that no cell from above reaches into
        placed: list[list[tuple[int, list[str], int]]] = []
        width: dict[int, int] = {}
        for r, cells in enumerate(rows):
            line, col = [], 0
            for text, wide, high in cells:
                while busy.get(col, 0) > r:
                    col += 1
                line.append((col, text, wide))
                if high > 1:
                    for c in range(col, col + wide):
                        busy[c] = r + high
                if wide == 1:
                    width[col] = max(width.get(col, 0), min(COLUMN, max(map(len, text), default=0)))
                col += wide
            placed.append(line)
        for col, text, wide in sorted((c for line in placed for c in line if c[2] > 1), key=lambda c: c[2]):
            need = min(COLUMN, max(map(len, text), default=0))
            have = sum(width[c] + 2 for c in range(col, col + wide) if width.get(c, 0)) - 2
            if have < need:  # a cell over columns that are too narrow widens the last of them
                width[col + wide - 1] = width.get(col + wide - 1, 0) + need - max(have, 0) - (2 if have > 0 and not width.get(col + wide - 1, 0) else 0)
        start, total = {}, 0
        for c in range(max(width, default=-1) + 1):
            start[c] = total
            total += width.get(c, 0) + 2 if width.get(c, 0) else 0
        out = list(head)
        for line in placed:
            for k in range(max((len(t) for _, t, _ in line), default=0)):
                text = ""
                for col, cell, _ in line:
                    if k < len(cell):
                        at = start.get(col, total)
                        text = text.ljust(at) if len(text) < at or not text else text + "  "
                        text += cell[k]
                out.append(text.rstrip())
        return out


def _walk(node: Node):
    for k in node.kids:
        if isinstance(k, Node):
            yield k
            yield from _walk(k)


def render(page: str | None) -> tuple[str | None, str, int]:
    """(title or None, visible text, number of blocks) of a page; a null or blank page gives (None, '', 0)."""
    if not page or not page.strip():
        return None, "", 0
    root = parse(page)
    title = next((" ".join("".join(k for k in n.kids if isinstance(k, str)).split()) for n in _walk(root) if n.tag == "title"), None)
    renderer = Renderer(_sheet(root))
    gone, visible = renderer.hidden(root, True)
    lines = [] if gone else renderer.lines(root, visible)
    out: list[str] = []
    for line in lines:
        line = line.rstrip()
        if line or out and out[-1]:
            out.append(line)
    return title, "\n".join(out).strip("\n"), renderer.blocks


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Rows of df with title (null if there is none), rendered (all visible text) and n_blocks.

    A null or empty page gives '' and no blocks. Styles hide by the last rule of the greatest weight; conditional
    media and selectors over several elements are left alone. Markup without end, of any depth or length is rendered as far
    as browsers do. Repeated rows each give a row. Columns of df named like an output column are replaced. An
    empty table gives no rows.
    """
    small_batches(df.sparkSession)
    df = clash_free(df, *OUT)
    width = len(df.columns)
    names = [f"c{k}" for k in range(width)] + list(OUT)

    def run(batches):
        for batch in batches:
            low = 0
            pages = batch.column(width)
            while low < batch.num_rows:  # a part at a time, so that long pages don't pile up
                part = batch.slice(low, 200)
                done = [render(p) for p in pages.slice(low, 200).to_pylist()]
                cols = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], names=names)
                low += 200

    schema = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(df.columns))
    source = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)), F.col(f"`{html}`").alias("b_html"))
    out = source.mapInArrow(lean(run), ", ".join(x for x in (schema, "title string, rendered string, n_blocks long") if x))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)), *OUT)


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(tables.read(spark, f"{sf_dir}/pages.parquet", "page_id", "html"))
    return out.select("page_id", "title", F.col("rendered").alias("text"), "n_blocks")
