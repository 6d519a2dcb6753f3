"""HTML extraction by layout-aware rendering.

A tokenizer and tree builder (implied end tags, void elements, raw text elements, attribute
and entity decoding) makes a tree of any input; a renderer walks it with visibility rules and
emits all visible text: blocks on lines of their own with blank lines where their margins
would be, list items with markers and indentation, table cells in aligned columns,
preformatted text as it is, of form fields what they show, of drawings and formulas their text.
Nothing is judged by content: all that shows is kept.

Visibility follows attributes, inline styles and the simple selectors (tag, class, id) of style
sheets: what isn't displayed is dropped with all in it, hidden text may hold a part that is visible
again, and closed details show their summary.

Pages stay where they are scanned: one Arrow-batched pass without a shuffle. Trees are built
and walked without recursion; nested lists and quotations are kept as parts with a mark and an
indent and written out once, so time and text grow with the input. Indents stop growing at
MOST_INDENT columns, and tables within MOST_TABLES others show their cells one below another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; the last two decode entities.
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title".split())
#: What may stand in a head; all else, and text, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Within svg and math (marked by FOREIGN among their attributes): what isn't drawn.
FOREIGN, UNDRAWN = "#foreign", frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
#: Signs between the parts of a formula.
SIGNS = {"mfrac": "/", "msup": "^", "msub": "_"}
#: Inputs that show no text, or not their value.
BARE = frozenset("hidden checkbox radio range color file".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul xmp listing optgroup option".split())
#: Blocks with a blank line before and after.
MARGIN = frozenset("article blockquote dl fieldset figure footer h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul aside form".split())
#: Lists; one within another has no margin.
LISTS = ("ul", "ol", "menu", "dir")
#: An element that begins closes an open one of these, up to its scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend summary".split())
_SCOPE = frozenset("table td th caption button object template html".split())
#: Columns of indentation that are written at most; tables around one whose cells are still aligned; most columns and rows of a cell.
MOST_INDENT, MOST_TABLES, MOST_COLUMNS, MOST_ROWS = 80, 12, 1000, 65534
_TAG = re.compile(r"<(?:!--|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)|(?P<bogus>[!?/]))")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?([.#][\w-]+)?", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``at``, the place after the tag, and whether it closes itself."""
    out: dict[str, str] = {}
    while True:
        stop = at
        while stop < len(html) and html[stop] in " \t\n\f\r/":
            stop += 1
        if stop >= len(html):
            return out, len(html), False
        if html[stop] == ">":
            return out, stop + 1, html[stop - 1] == "/"
        m = _ATTR.match(html, at)
        if not m or m.end() == at:
            at = stop + 1
            continue
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        at = m.end()


def parse(html: str) -> Node:
    """The tree of a page. Every input has one; text is decoded."""
    root = Node("#root")
    stack, at, size = [root], 0, len(html)
    count: dict[str, int] = {}

    def text(s: str) -> None:
        if s:
            if stack[-1].name == "head" and s.strip(" \t\n\f\r"):
                pop()
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def pop() -> None:
        count[stack.pop().name] -= 1

    def close(names, scope) -> None:
        """Close the innermost open element of ``names`` that is within ``scope``."""
        if not any(count.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i].name in scope:
                return

    while at < size:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        if not m["name"]:
            if html.startswith("<!--", m.start()):
                stop = m.start() + 4 if html.startswith(("<!-->", "<!--->"), m.start()) else html.find("-->", m.start() + 4)
                at = size if stop < 0 else html.find(">", stop) + 1
            elif m["bogus"] == "/" and (m.end() >= size or html[m.end()] != ">"):
                stop = html.find(">", m.end())
                at = size if stop < 0 else stop + 1
            else:
                stop = html.find(">", m.end())
                at = size if stop < 0 else stop + 1
            continue
        name = m["name"].lower()
        attrs, at, closed = attributes(html, m.end())
        if m["end"]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not count.get("p"):
                stack[-1].children.append(Node("p"))
            elif count.get(name):
                # an inline end tag doesn't reach through a table cell, nor any through a table
                wall = {"table"} if name in BLOCK and name not in ("p", "div") else _SCOPE
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        again = [Node(x.name, x.attrs) for x in stack[i + 1 :] if x.name not in BLOCK and x.name not in HIDDEN and x.name not in ("svg", "math", "select") and FOREIGN not in x.attrs][-8:] if name in BLOCK and name not in ("td", "th", "tr", "table", "body", "html") else []
                        while len(stack) > i:
                            pop()
                        for x in again:  # formatting left open goes on after the block
                            stack[-1].children.append(x)
                            stack.append(x)
                            count[x.name] = count.get(x.name, 0) + 1
                        break
                    if stack[i].name in wall and name not in ("table", "html", "body"):
                        break
            continue
        if name in ("html", "body") and count.get(name):
            continue
        if name == "body" or name in BLOCK and name != "html":
            if count.get("head"):
                close({"head"}, ())
        if name not in HEAD and stack[-1].name == "head":
            pop()
        if count.get("svg") or count.get("math"):
            attrs[FOREIGN] = ""
        if name in CLOSES:
            close(*CLOSES[name])
        elif name in ENDS_P and count.get("p"):
            close({"p"}, _SCOPE)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or closed and FOREIGN in attrs:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end and name != "plaintext" else size
            inner = html[at:stop]
            if inner:
                node.children.append(unescape(inner) if name in ("textarea", "title") else inner)
            at = attributes(html, end.end())[1] if end and name != "plaintext" else size
            continue
        if closed and name in ("svg", "math"):
            continue
        stack.append(node)
        count[name] = count.get(name, 0) + 1
    return root


def sheet(root: Node) -> None:
    """Put what style sheets say of display and visibility into the styles of the elements that their
    simple selectors name. An element's own style comes last and so counts first."""
    css, todo = [], [root]
    while todo:
        x = todo.pop()
        for c in x.children:
            if not isinstance(c, str):
                todo.append(c)
                if c.name == "style" and "media" not in c.attrs:
                    css.extend(t for t in c.children if isinstance(t, str))
    rules: dict[tuple[str, str], str] = {}
    for selectors, body in blocks(re.sub(r"/\*.*?\*/", "", "\n".join(css), flags=re.S)):
        said = "".join(f";{m[0]}" for p in (_NONE, _VISIBILITY, re.compile(r"display\s*:\s*\w+", re.I)) if (m := p.search(body)))
        for one in selectors.split(",") if said else ():
            if (m := _SELECTOR.fullmatch(one.strip())) and m[0]:
                key = (m[1] or "*").lower(), m[2] or ""
                rules[key] = rules.get(key, "") + said
    if not rules:
        return
    todo = [root]
    while todo:
        x = todo.pop()
        names = ["", *(f".{c}" for c in x.attrs.get("class", "").split()), "#" + x.attrs.get("id", "")]
        said = "".join(rules.get((tag, n), "") for n in names for tag in ("*", x.name))
        if said:
            x.attrs["style"] = f"{said};{x.attrs.get('style', '')}"
        todo.extend(c for c in x.children if not isinstance(c, str))


def blocks(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold for every medium."""
    depth, begin, at = 0, 0, 0
    for m in re.finditer(r"[{}]", css):
        if m[0] == "{":
            depth += 1
            if depth == 1:
                selectors, at = css[begin : m.start()].strip(), m.end()
        elif depth:
            depth -= 1
            if not depth:
                begin = m.end()
                if not selectors.startswith("@"):
                    yield selectors.rsplit(";", 1)[-1], css[at : m.start()]


def visible(node: Node) -> bool:
    """Whether a node is displayed at all."""
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a or FOREIGN in a and node.name in UNDRAWN or node.name == "dialog" and "open" not in a:
        return False
    if "style" not in a:
        return True
    last = re.findall(r"display\s*:\s*(\w+)", a["style"], re.I)
    return not last or last[-1].lower() != "none"


def hushed(node: Node, now: bool) -> bool:
    """Whether the text in a node is laid out but not shown; ``now`` is so of its parent."""
    said = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return said[-1].lower() != "visible" if said else now


def content(node: Node) -> str:
    """All text within a node, whatever its layout."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif visible(x):
            todo.extend(reversed(x.children))
    return "".join(out)


def caption(node: Node) -> str:
    """What an input shows: its value, or the placeholder where there is none."""
    a = node.attrs
    kind = a.get("type", "").strip().lower()
    if kind in BARE:
        return ""
    if kind == "image":
        return a.get("alt", "")
    return (a.get("value", "") if kind != "password" else "") or a.get("placeholder", "")


def chosen(node: Node) -> list[str]:
    """The options that a select shows: all in a list box, else the selected or first one."""
    options, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or not visible(x):
            continue
        if x.name == "option":
            options.append(x)
        else:
            todo.extend(reversed(x.children))
    if "multiple" not in node.attrs and not re.fullmatch(r"0*([2-9]|[1-9]\d+)", node.attrs.get("size", "").strip()):
        options = [x for x in options if "selected" in x.attrs][-1:] or [x for x in options if "disabled" not in x.attrs][:1] or options[:1]
    return [x.attrs.get("label") or content(x) for x in options]


def width(s: str) -> int:
    """Columns that a string takes: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Text under construction: lines and parts, the open line, and how many blank lines are due."""

    def __init__(self):
        #: Lines, and parts (mark, indent, Lines), whose first line has the mark and whose others the indent.
        self.lines: list[str | tuple[str, str, Lines]] = []
        self.open: list[str] = []
        self.gap, self.space = 0, False

    def inline(self, s: str) -> None:
        parts = _BLANKS.split(s)
        if not parts[0] and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            if self.space and self.open:
                self.open.append(" ")
            self.open.append(body)
            self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def flush(self) -> None:
        """End the open line."""
        line = "".join(self.open)
        self.open, self.space = [], False
        if line:
            self.put(line)

    def put(self, line: str | tuple[str, str, Lines]) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append(line)

    def add(self, part: Lines, mark: str = "", indent: str = "") -> None:
        part.flush()
        if part.lines:
            self.put((mark, indent, part))

    def margin(self) -> None:
        self.flush()
        if self.lines:
            self.gap = 1

    def flat(self) -> list[str]:
        """All lines, parts written out."""
        self.flush()
        out: list[str] = []
        # lines left of a part, what its next line begins with, and what those after do
        todo = [[iter(self.lines), "", ""]]
        while todo:
            line = next(todo[-1][0], None)
            if line is None:
                todo.pop()
                continue
            _, lead, rest = todo[-1]
            todo[-1][1] = rest
            if isinstance(line, str):
                out.append((lead + line).rstrip() if lead else line)
            else:
                mark, indent, part = line
                todo.append([iter(part.lines), lead + mark, rest + indent if len(rest) < MOST_INDENT else rest])
        return out


class Table:
    """Rows of cells (lines, columns, rows) of a table, and what else it holds, in order."""

    def __init__(self, aligned: bool):
        self.rows: list[list[tuple[Lines, int, int]] | Lines] = []
        self.aligned = aligned

    def into(self, out: Lines) -> None:
        one = not self.aligned or all(isinstance(r, Lines) or len(r) < 2 for r in self.rows)
        block: list[list[tuple[Lines, int, int]]] = []
        for r in [*self.rows, Lines()]:
            if not isinstance(r, Lines) and not one:
                block.append(r)
                continue
            for line in aligned(block):
                out.put(line)
            block = []
            for part in [r] if isinstance(r, Lines) else [c[0] for c in r]:
                out.add(part)


def times(node: Node, name: str, most: int) -> int:
    said = node.attrs.get(name, "1").strip()
    return min(int(said), most) if re.fullmatch(r"0*[1-9]\d{0,8}", said) else 1


def number_of(node: Node, name: str, otherwise: int) -> int:
    said = node.attrs.get(name, "").strip()
    return int(said) if re.fullmatch(r"-?\d{1,9}", said) else otherwise


def render(root: Node) -> str:
    """The visible text of a tree, laid out."""
    #: What is left to do: a node, a part of a table or row, or what follows a node's content.
    todo: list[tuple] = [("node", c) for c in reversed(root.children)]
    outs: list = [Lines()]
    lists: list[list] = []
    pre, tables, hush = 0, 0, False
    while todo:
        what, x, *more = todo.pop()
        out = outs[-1]
        if what == "hush":
            hush = more[0]
            continue
        if what in ("node", "part") and not isinstance(x, str):
            if not visible(x):
                continue
            if (now := hushed(x, hush)) != hush:
                todo.append(("hush", x, hush))
                hush = now
        if what == "part":
            kind = more[0]
            inner = [] if isinstance(x, str) else [c for c in reversed(x.children) if not isinstance(c, str) or c.strip()]
            if isinstance(x, str):
                name = ""
            else:
                name = x.name
            if kind == "table" and name in ("tbody", "thead", "tfoot", "colgroup", "col"):
                todo.extend(("part", c, kind) for c in inner)
            elif kind == "table" and name == "tr":
                outs.append([])
                todo.append(("done", x, pre))
                todo.extend(("part", c, "tr") for c in inner)
            elif kind == "tr" and name in ("td", "th"):
                outs.append(Lines())
                todo.append(("done", x, pre))
                pre = 0
                todo.extend(("node", c) for c in reversed(x.children))
            elif kind == "table" and name in ("td", "th"):  # a cell without its row
                outs.append([])
                todo.append(("done", Node("tr"), pre))
                todo.append(("part", x, "tr"))
            else:  # anything else is shown as a row or cell of its own
                outs.append(Lines())
                todo.append(("loose", x, kind))
                todo.append(("node", x))
            continue
        if what == "loose":
            outs.pop()
            out.flush()
            if out.lines:
                outs[-1].append((out, 1, 1)) if more[0] == "tr" else outs[-1].rows.append(out)
            continue
        if what == "node":
            if isinstance(x, str):
                if hush:
                    if pre or x.strip(" \t\n\f\r") != x:
                        out.space = True
                elif pre:
                    first, *rest = x.split("\n")
                    out.open.append(first)
                    for line in rest:
                        held = "".join(out.open)
                        out.open = []
                        out.put(held)
                        out.open.append(line)
                else:
                    out.inline(x)
                continue
            name = x.name
            if name == "br":
                if out.open:
                    out.flush()
                else:
                    out.space = False
                    if out.lines:
                        out.gap = min(out.gap + 1, 1)
                continue
            if name == "hr":
                out.margin()
                continue
            if name == "wbr":
                continue
            if name in ("img", "input", "select", "textarea"):
                if not hush:
                    field(x, out)
                continue
            if name in SIGNS and FOREIGN in x.attrs:
                parts = [c for c in x.children if not isinstance(c, str)]
                x.children = [c for part in parts for c in (SIGNS[name], part)][1:]
            if FOREIGN in x.attrs and name in ("text", "mtd", "mtr"):
                out.inline(" ")
            if name == "details" and "open" not in x.attrs:
                x.children = [c for c in x.children if not isinstance(c, str) and c.name == "summary"][:1]
            if name in ("table", "tr"):
                if name == "table":
                    out.margin()
                    tables += 1
                outs.append(Table(tables <= MOST_TABLES) if name == "table" else [])
                todo.append(("done", x, pre))
                pre = 0
                # rows and cells are gathered; other content of a table shows between them
                todo.extend(("part", c, name) for c in reversed(x.children) if not isinstance(c, str) or c.strip())
                continue
            if name in ("td", "th", "caption", "li", "dd", "blockquote"):
                out.margin() if name in MARGIN else out.flush()
                outs.append(Lines())
                todo.append(("done", x, pre))
                pre = 0
                todo.extend(("node", c) for c in reversed(x.children))
                continue
            if name in BLOCK:
                out.margin() if name in MARGIN and not (lists and name in LISTS) else out.flush()
            if name in LISTS:
                lists.append([name, number_of(x, "start", 1)])
            if name in ("pre", "listing", "xmp"):
                pre += 1
            if name == "q" and not hush:
                out.inline('"')
            todo.append(("done", x, pre))
            todo.extend(("node", c) for c in reversed(x.children))
            continue
        name = x.name
        if name in ("td", "th", "caption", "li", "dd", "blockquote", "tr", "table"):
            pre = more[0]
            outs.pop()
            over = outs[-1]
            if name in ("td", "th"):
                out.flush()
                over.append((out, times(x, "colspan", MOST_COLUMNS), times(x, "rowspan", MOST_ROWS))) if isinstance(over, list) else over.add(out)
            elif name == "tr":
                if isinstance(over, Table):
                    over.rows.append(out)
                else:
                    for line in aligned([out]):
                        over.put(line)
            elif name == "table":
                tables -= 1
                out.into(over)
                over.margin()
            else:
                mark = {"caption": "", "blockquote": "> "}.get(name, "  ")
                if name == "li":
                    mark = "- "
                    out.flush()
                    if out.lines and lists and lists[-1][0] == "ol":
                        at = lists[-1][1] = number_of(x, "value", lists[-1][1])
                        mark, lists[-1][1] = f"{at}. ", at + 1
                over.add(out, mark, mark if name == "blockquote" else " " * len(mark))
                if name == "blockquote":
                    over.margin()
            continue
        if name == "q" and not hush:
            out.inline('"')
        if FOREIGN in x.attrs and name in ("text", "mtd", "mtr"):
            out.inline(" ")
        if name in ("pre", "listing", "xmp"):
            pre -= 1
            held = "".join(out.open)
            out.open = []
            if held:
                out.put(held)
        if name in LISTS and lists:
            lists.pop()
        if name in BLOCK:
            out.margin() if name in MARGIN and not (lists and name in LISTS) else out.flush()
    return "\n".join(outs[0].flat())


def field(x: Node, out: Lines) -> None:
    """What an image or a form field shows."""
    if x.name == "img":
        if x.attrs.get("alt"):
            out.inline(x.attrs["alt"])
    elif x.name == "input":
        out.inline(caption(x))
    elif x.name == "select":
        shown = chosen(x)
        for s in shown:
            out.inline(s)
            if len(shown) > 1:
                out.flush()
    else:
        rows = (content(x).removeprefix("\n") or x.attrs.get("placeholder", "")).split("\n")
        if len(rows) > 1:
            out.flush()
            for s in rows:
                out.put(s.rstrip())
        else:
            out.inline(rows[0])


def aligned(rows: list[list[tuple[Lines, int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows) cells as text lines, columns as wide as their widest cell and
    two spaces apart. A cell over several columns widens the last of them where it needs to; one
    over several rows shows in the first of them and keeps its columns free in the others."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # columns that earlier rows hold: first, end, rows left
    for cells in rows:
        at, here, held = 0, [], iter(taken)
        block = next(held, None)
        for lines, columns, down in cells:
            while block and block[0] < at + 1:
                at, block = max(at, block[1]), next(held, None)
            here.append((at, at + columns, lines.flat(), down))
            at += columns
        placed.append([c[:3] for c in here])
        taken = sorted([(a, b, n - 1) for a, b, n in taken if n > 1] + [(a, b, n - 1) for a, b, _, n in here if n > 1])
    # only columns at which a cell begins or ends count; each stands where all cells before it fit
    ends: dict[int, list[tuple[int, int]]] = {}
    for here in placed:
        for a, b, lines in here:
            ends.setdefault(a, [])
            ends.setdefault(b, []).append((a, max(map(width, lines), default=0)))
    place: dict[int, int] = {}
    last = -2
    for e in sorted(ends):
        last = place[e] = max([last + 2, *(place[a] + need + 2 for a, need in ends[e])])
    out = []
    for here in placed:
        rows_ = [[] for _ in range(max((len(lines) for *_, lines in here), default=0))]
        for a, _, lines in here:
            for k, line in enumerate(lines):
                if line:
                    rows_[k].append((place[a], line))
        for row in rows_:
            line, used = [], 0
            for at, s in row:
                line.append(" " * (at - used) + s)
                used = at + width(s)
            out.append("".join(line).rstrip())
    return out


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    if "<style" in html or "<STYLE" in html:
        sheet(root)
    return render(root)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """All rows of ``df`` with ``text``, the visible text of the page; null and empty pages give
    empty text, an empty table an empty result; long pages are read whole. An input column ``text``
    is replaced; equal pages give equal texts."""
    df = without(df, "text")

    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([html_to_text(h) for h in b], dtype=object)

    return df.withColumn("text", shown(F.col(html)))


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")
