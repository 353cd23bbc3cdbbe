"""HTML extraction: a tree with implied tags, rendered as the text that a reader sees.

The markup is cut into tags and text, a tree is built in which missing end tags
(paragraphs, list items, table parts, options, ...) are implied, invisible parts
are left out, and the rest is laid out: blocks on lines of their own, with a
blank line around paragraphs, headings, lists and tables; list items behind a
bullet or number, indented by depth; table cells in aligned columns, with the
blocks, lists and tables within them; preformatted text as it is. All visible
text is emitted, navigation and footers included.

Invisible are elements that are never shown, hidden ones (by attribute, inline
style, or a rule of a style element whose selector is a tag, class or id or a tag
with one of those; what a print or other at-rule says isn't applied) and what a
closed details element holds besides its summary. `visibility: visible` shows
parts of a hidden parent again, as in browsers.

Null and empty pages give an empty text. Broken markup never fails: stray end
tags are ignored, what is open at the end is closed, a tag that never ends takes
the rest of the page, as in browsers. Time and space are linear in the page, of any
length and nesting; for that, indents stop at INDENT columns, tables within more
than NESTED others and cells spanning rows beside SPANNING such cells are laid out
as plain cells, and cells wider than WIDE don't widen their column. No text is
lost by these. Repeated rows give repeated results; rows with null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .lexing import chunks

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<(?![A-Za-z/])|</(?![A-Za-z])", re.S)
#: The same for what follows a quote that is never closed: quotes don't count.
_UNQUOTED = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<(?![A-Za-z/])|</(?![A-Za-z])", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)", re.I)
_SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*)?([.#][\w-]+)?\Z")
#: Numbers of character references that are too long to stand for a character, or have many leading zeros.
_LONG_NUMBER, _ZEROS = re.compile(r"&#0*[1-9][0-9]{7,};?"), re.compile(r"&#0{7,}(?=[0-9])")

#: Bounds of the layout (see above): columns of indent, width of a column, tables around a table, cells spanning rows at once.
INDENT, WIDE, NESTED, SPANNING = 64, 80, 6, 500
#: Fixed values of the HTML standard: the most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are never seen.
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object svg math audio video canvas datalist meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
#: Blocks with a blank line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu dir".split())
_CLOSES_P = (BLOCK - frozenset("body html li dd dt option optgroup legend caption tbody tfoot thead tr".split()))
#: A start tag ends those open elements, up to the given boundary.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: End tags don't reach beyond these.
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"table", "td", "th"}}


class Node:
    """An element: its tag, attributes, and children, which are nodes or texts."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class Tree(Node):
    """The root of a page, with what its style elements say: (selector, property) to value."""

    __slots__ = ("rules",)

    def __init__(self):
        super().__init__("#root")
        self.rules: dict[tuple[str, str], str] = {}


def _plain(text: str) -> str:
    """The text with its character references replaced."""
    if "&" not in text:
        return text
    return entities.unescape(_LONG_NUMBER.sub("\N{REPLACEMENT CHARACTER}", _ZEROS.sub("&#", text)) if "&#" in text else text)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), _plain(value.strip("\"'")) if value else "")
    return out


def _declared(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _DECLARED.findall(style)}


def _ruled(style: str, rules: dict[tuple[str, str], str]) -> None:
    """Adds a style element's rules on what is shown; at-rules and their blocks are passed over."""
    depth, prelude, aside = 0, "", False
    for part in re.split(r"([{}])", re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S)):
        if part == "{":
            depth += 1
        elif part == "}":
            depth = max(0, depth - 1)
            aside = aside and depth > 0
        elif depth == 0:
            prelude = part.rsplit(";", 1)[-1].strip()
            aside = prelude.startswith("@")
        elif depth == 1 and not aside and (said := _declared(part)):
            for selector in prelude.split(","):
                if (m := _SELECTOR.match(selector.strip())) and m[0]:
                    rules.update({((m[1] or "").lower() + (m[2] or ""), k): v for k, v in said.items()})


def parse(markup: str) -> Tree:
    """The tree of the markup, under a root without a tag of its own."""
    root = Tree()
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where the stack has each tag

    def push(node):
        places.setdefault(node.tag, []).append(len(stack))
        stack[-1].children.append(node)
        stack.append(node)

    def pop():
        places[stack.pop().tag].pop()

    def close(tags, boundary):
        """Ends the outermost of the open tags that lies within the boundary."""
        least = max((places[b][-1] for b in boundary if places.get(b)), default=0)
        found = min((p[k] for t in tags if (p := places.get(t)) and (k := bisect_right(p, least)) < len(p)), default=0)
        while found and len(stack) > found:
            pop()

    at, end, token = 0, len(markup), _TOKEN
    while at < end:
        m = token.match(markup, at)
        if m is None:  # no end of this tag
            if token is _TOKEN:
                token = _UNQUOTED
                continue
            break
        at = m.end()
        if not m[2]:
            if m[0][:1] != "<" or m[0] == "<":
                stack[-1].children.append(m[0])
            continue
        ending, tag = m[1], m[2].lower()
        if ending:
            if tag in ("p", "br") and not places.get(tag):
                stack[-1].children.append(Node(tag))  # as browsers do
            elif tag not in ("html", "body") and places.get(tag):
                if tag in _SCOPE:
                    close({tag}, _SCOPE[tag])
                else:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        raw = m[3] or ""
        if tag in _CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body":
            close({"head"}, ())
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(tag, _attributes(raw) if raw.strip(" /") else None)
        if tag in VOID:
            stack[-1].children.append(node)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
            body, at = (markup[at : stop.start()], stop.end()) if stop else (markup[at:], end)
            if tag == "style":
                _ruled(body, root.rules)
            node.children.append(body)
            stack[-1].children.append(node)
            continue
        push(node)
    return root


def shown(node: Node, rules: dict[tuple[str, str], str]) -> dict[str, str]:
    """Display and visibility of the element, where the markup says something about them."""
    a, said = node.attributes, {}
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        said["display"] = "none"
    if rules:
        names = [f".{c}" for c in a.get("class", "").split()] + [f"#{a.get('id', '')}"]
        for selector in (node.tag, *names, *(node.tag + n for n in names)):
            for k in ("display", "visibility"):
                if (selector, k) in rules and node.tag not in UNSEEN:
                    said[k] = rules[selector, k]
    if "style" in a:
        inline = _declared(a["style"])
        said |= inline if node.tag not in UNSEEN else {}
    return said


class _Page:
    """Lines being laid out; a gap is the number of line ends that the next text needs before it."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.fresh, self.indent, self.mark = 0, False, True, "", ""

    def block(self, gap: int):
        self.gap, self.space = max(self.gap, gap), False

    def line(self):
        self.gap, self.space = self.gap + 1 if not self.fresh or self.gap else self.gap, False

    def _begin(self):
        if self.out and self.gap:
            self.out.append("\n" * min(self.gap, 2))
        if self.gap or not self.out:
            self.out.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark, self.space = "", False
        self.gap, self.fresh = 0, False

    def text(self, raw: str):
        parts = _SPACE.sub(" ", raw)
        if not parts:
            return
        body = parts.strip(" ")
        if not body:
            self.space = self.space or bool(self.out)
            return
        if parts[0] == " ":
            self.space = True
        self._begin()
        self.out.append(" " + body if self.space else body)
        self.space = parts[-1] == " "

    def verbatim(self, raw: str):
        lines = raw.expandtabs(8).split("\n")
        for i, line in enumerate(lines):
            if i:
                self.line()
            if line.strip():
                self._begin()
                self.out.append(line.rstrip())


def _wide(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class _Grid:
    """A table being laid out: rows of (column, lines of a cell, whether it spans columns)."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str], bool]]] = []
        self.spans: list[list[int]] = []  # first column, end, rows left, of cells that reach into the next rows
        self.at = 0

    def row(self):
        self.rows.append([])
        self.at = 0
        for s in self.spans:
            s[2] -= 1
        self.spans = sorted(s for s in self.spans if s[2] > 0)

    def cell(self, lines: list[str], columns: int, rows: int):
        if not self.rows:
            self.row()
        for first, end, _ in self.spans:
            if first <= self.at < end:
                self.at = end
        self.rows[-1].append((self.at, lines, columns > 1))
        if rows > 1 and len(self.spans) < SPANNING:
            self.spans.append([self.at, self.at + columns, rows])
        self.at += columns

    def lines(self) -> list[str]:
        """The rows as lines in which columns are aligned; a row takes as many lines as its longest cell."""
        width: dict[int, int] = {}
        for row in self.rows:
            for column, cell, spans in row:
                most = max((w for w in map(_wide, cell) if w <= WIDE), default=0)
                width[column] = max(width.get(column, 0), 0 if spans else most)
        start, at = {}, 0
        for column in sorted(width):
            start[column] = at
            at += width[column] + 2
        out = []
        for row in self.rows:
            for i in range(max((len(c) for _, c, _ in row), default=0)):
                line, size = "", 0
                for column, cell, _ in row:
                    if i < len(cell) and cell[i]:
                        gap = max(min(start[column], MOST_COLUMNS) - size, 2 if size else 0)
                        line, size = line + " " * gap + cell[i], size + gap + _wide(cell[i])
                out.append(line)
        return [line for line in out if line]


def _number(said: str, most: int) -> int:
    """A span as the attribute says it, from 1 to `most`; 0 and what is no number count as 1."""
    said = said.strip(" \t\n\r\f")
    return max(1, min(most, int(said[:9]))) if said[:9].isascii() and said[:9].isdigit() else 1


def render(root: Tree) -> str:
    """The visible text of the tree."""
    pages = [_Page()]
    # each job is a node to enter or a step to take when it is done; an explicit stack, so depth is no limit
    jobs: list = [(root, False, False)]
    lists: list[list] = []
    grids: list[_Grid] = []
    while jobs:
        job, pre, veiled = jobs.pop()
        page = pages[-1]
        if callable(job):
            job()
            continue
        if isinstance(job, str):
            if not veiled:
                page.verbatim(_plain(job)) if pre else page.text(_plain(job))
            continue
        node = job
        said = shown(node, root.rules)
        if said.get("display") == "none":
            continue
        if "visibility" in said:
            veiled = said["visibility"] in ("hidden", "collapse")
        tag = node.tag
        if tag == "br":
            page.line()
            continue
        if tag == "hr":
            page.block(2)
            continue
        if tag == "img" or tag == "input":
            told = node.attributes.get("alt" if tag == "img" else "value", "")
            if told and not veiled and node.attributes.get("type", "").lower() not in ("checkbox", "radio", "password"):
                page.text(f" {told} " if tag == "img" else told)
            continue
        pre = pre or tag in ("pre", "textarea", "xmp")
        children, after = node.children, []
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("td", "th") and grids and len(grids) <= NESTED:
            pages.append(_Page())

            def cell(grid=grids[-1], a=node.attributes):
                text = "".join(pages.pop().out).strip("\n")
                rows = MOST_ROWS if a.get("rowspan", "").strip() == "0" else _number(a.get("rowspan", "1"), MOST_ROWS)
                grid.cell([x.rstrip() for x in text.split("\n") if x.strip()], _number(a.get("colspan", "1"), MOST_COLUMNS), rows)

            after.append(cell)
        elif tag == "tr" and grids and len(grids) <= NESTED:
            grids[-1].row()
        elif tag == "table":
            page.block(2)
            grids.append(_Grid())

            def finished(page=page):
                for line in grids.pop().lines():
                    page.block(1)
                    page._begin()
                    page.out.append(line)
                page.block(2)

            after.append(finished)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            start = node.attributes.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])

            def leave(page=page):
                lists.pop()
                page.block(1 if lists else 2)

            after.append(leave)
        elif tag == "li":
            page.block(1)
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            before = page.indent
            page.indent, page.mark = before[:INDENT] + " " * len(mark), mark

            def outdent(page=page, before=before):
                page.indent, page.mark = before, ""
                page.block(1)

            after.append(outdent)
        elif tag in ("td", "th"):
            page.space = True
        elif tag in BLOCK:
            gap = 2 if tag in APART else 1
            page.block(gap)
            if tag in ("blockquote", "dd"):
                before = page.indent
                page.indent = before[:INDENT] + "  "

                def back(page=page, before=before, gap=gap):
                    page.indent = before
                    page.block(gap)

                after.append(back)
            else:
                after.append(lambda page=page, gap=gap: page.block(gap))
        elif tag == "q" and not veiled:
            page.text("“")
            after.append(lambda page=page: (setattr(page, "space", False), page.text("”")))
        jobs.extend((f, False, False) for f in reversed(after))
        jobs.extend((c, pre, veiled) for c in reversed(children))
    return "".join(pages[0].out).strip("\n")


def extract(markup: str | None) -> str:
    """The visible text of a page."""
    return render(parse(markup)) if markup else ""


def pages_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, text) of every page; one pass, no shuffle."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for part, raw in chunks(batch, "__html"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(x) for x in raw.to_pylist()], pa.string())], [key, "text"])

    return pages.select(F.col(key).cast("long"), F.col(markup).cast("string").alias("__html")).mapInArrow(run, f"{key} bigint, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, with its lines and characters."""
    text = pages_text(table(spark, sf_dir, "pages"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))
