"""A parser of Org text: one document in, its element rows out, in pre-order.

It works line by line for structure and by one scan of alternatives for inline
objects, never fails, and falls back to paragraphs.  State that depends on order
(anchors, inherited tags and properties, affiliated names) stays in here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

HEADLINE = re.compile(r"^(\*+)[ \t]+(.*?)[ \t]*$|^(\*+)$")
TAGS = re.compile(r"[ \t]+(:[\w@#%:]+:)[ \t]*$")
PRIORITY = re.compile(r"^\[#([A-Za-z]|\d{1,2})\][ \t]*")
PLANNING = re.compile(r"\b(SCHEDULED|DEADLINE|CLOSED):[ \t]*([<\[][^>\]\n]*[>\]](?:--[<\[][^>\]\n]*[>\]])?)")
PROPERTY = re.compile(r"^[ \t]*:([^\s:][^\s]*?)(\+?):(?:[ \t]+(.*?))?[ \t]*$")
DRAWER = re.compile(r"^[ \t]*:([\w-]+):[ \t]*$")
BEGIN = re.compile(r"^[ \t]*#\+begin(?:_(\S+)|(:))(?:[ \t]+(.*?))?[ \t]*$", re.I)
KEYWORD = re.compile(r"^[ \t]*#\+(\S+?)(?:\[[^\]]*\])?:(?:[ \t]*(.*?))?[ \t]*$")
ITEM = re.compile(r"^([ \t]*)([-+]|(?:\d+|[A-Za-z])[.)]|[ \t]\*)(?:[ \t]+(.*)|$)")
CHECKBOX = re.compile(r"^(?:\[@\S+\][ \t]+)?\[([ Xx-])\][ \t]+")
CLOCK = re.compile(r"^[ \t]*CLOCK:[ \t]*(.*?)[ \t]*$")
FOOTNOTE = re.compile(r"^\[fn:([\w-]+)\][ \t]*(.*)$")
RULE = re.compile(r"^[ \t]*-{5,}[ \t]*$")
LATEX = re.compile(r"^[ \t]*\\begin\{([A-Za-z0-9*]+)\}")
TODO_LINE = re.compile(r"^[ \t]*#\+(?:TODO|SEQ_TODO|TYP_TODO):[ \t]*(.*)$", re.I | re.M)
STAMP = r"\d{4}-\d{2}-\d{2}[^>\]\n]*"
OBJECT = re.compile(
    rf"""(?P<link>\[\[(?P<path>[^\[\]]+)\](?:\[(?P<desc>[^\[\]]+)\])?\])|(?P<radio>(?:<<<)[^<>\n]+(?:>>>))|(?P<target><<[^<>\n]+>>)|(?P<stamp><{STAMP}>(?:--<{STAMP}>)?|\[{STAMP}\](?:--\[{STAMP}\])?|<%%\([^\n]*?\)>)
    |(?P<macro>\{{\{{\{{[A-Za-z][\w-]*(?:\([^}}]*\))?\}}\}}\}})|(?P<cite>\[cite(?:/[\w/-]+)?:[^\]]+\])|(?P<fn>\[fn:[\w-]*(?::[^\]]*)?\])|(?P<cookie>\[\d*/\d*\]|\[\d*%\])|(?P<snippet>@@[\w-]+:.*?@@)
    |(?P<src>\bsrc_\w+(?:\[[^\]]*\])?\{{[^}}\n]*\}})|(?P<call>\bcall_[^\s(\[]+(?:\[[^\]]*\])?\([^)\n]*\)(?:\[[^\]]*\])?)|(?P<angle><[A-Za-z][\w+.-]*:[^<>\n]+>)|(?P<plain>\b(?:https?|ftp|mailto|file|id|doi):[^\s<>()\[\]]+[^\s<>()\[\].,;:!?])
    |(?P<frag>\\\(.*?\\\)|\\\[.*?\\\]|\$\$.+?\$\$)|(?P<break>\\\\[ \t]*$)|(?P<entity>\\[A-Za-z]+(?:\{{\}})?)
    |(?<=[^\s^_])(?P<super>\^(?:\{{[^{{}}\n]*\}}|[+-]?\w+))|(?<=[^\s^_])(?P<sub>_\{{[^{{}}\n]*\}}|(?<![A-Za-z0-9]\w)_\d+\b)
    |(?<![\w])(?P<mark>(?P<m>[*/_+=~])(?=\S)(?P<inner>(?:(?!(?P=m)).)*?\S|\S)(?P=m))(?![\w])""",
    re.X | re.M,
)
#: What each alternative of OBJECT has one of.
MAY_HOLD_OBJECT = re.compile(r"[\[<{@\\$^_*/+=~:]")
#: Stars from which on a headline is a task within the text.
INLINE_TASK = "*" * 15
MARKS = {"*": "bold", "/": "italic", "_": "underline", "+": "strike-through", "=": "verbatim", "~": "code"}
NAMES = {"radio": "radio-target", "target": "target", "stamp": "timestamp", "macro": "macro", "cite": "citation", "fn": "footnote-reference", "cookie": "statistics-cookie", "snippet": "export-snippet", "src": "inline-src-block", "call": "inline-babel-call", "angle": "link", "plain": "link", "super": "superscript", "sub": "subscript", "frag": "latex-fragment", "break": "line-break", "entity": "entity"}
#: Blocks whose body holds text only.
VERBATIM_BLOCKS = {"src": "src-block", "example": "example-block", "export": "export-block", "comment": "comment-block"}
OTHER_BLOCKS = {"quote": "quote-block", "center": "center-block", "verse": "verse-block"}
AFFILIATED = {"NAME", "CAPTION", "HEADER", "PLOT", "RESULTS"}


@dataclass
class Row:
    id: int
    parent: Row | None
    category: str
    kind: str
    first: int
    last: int
    start: int
    stop: int
    outline: list[str]
    name: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    inherited: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    level: int = 0

    def ancestors(self) -> list[int]:
        out, at = [], self.parent
        while at:
            out.append(at.id)
            at = at.parent
        return out[::-1]


def todo_keywords(text: str) -> tuple[set[str], set[str]]:
    """Open and done keywords of a file: those of its keyword lines, else TODO and DONE."""
    todo, done = set(), set()
    for m in TODO_LINE.finditer(text):
        left, bar, right = m[1].partition("|")
        names = [re.sub(r"\(.*?\)$", "", w) for w in left.split()]
        ends = [re.sub(r"\(.*?\)$", "", w) for w in right.split()]
        if not bar and names:
            ends = [names.pop()]
        todo |= set(names)
        done |= set(ends)
    return (todo, done) if todo or done else ({"TODO"}, {"DONE"})


class Parser:
    """Rows of one document."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.at: list[int] = [0]
        for line in self.lines:
            self.at.append(self.at[-1] + len(line) + 1)
        self.todo, self.done = todo_keywords(text)
        self.rows: list[Row] = []
        self.names: set[str] = set()
        self.affiliated: dict[str, str] = {}
        wide = [] if text.isascii() else [i for i, c in enumerate(text) if ord(c) > 0x7F]
        self.wide = wide
        self.extra = [0]
        for i in wide:
            self.extra.append(self.extra[-1] + len(text[i].encode("utf-8", "surrogatepass")) - 1)

    def bytes_at(self, i: int) -> int:
        return i + self.extra[bisect_right(self.wide, i - 1)]

    def add(self, parent: Row | None, category: str, kind: str, first: int, last: int, properties: dict | None = None, start: int | None = None, stop: int | None = None) -> Row:
        """A row for lines [first, last)."""
        a = self.at[first] if start is None else start
        b = min(self.at[max(last, first)], len(self.text)) if stop is None else stop
        row = Row(len(self.rows) + 1, parent, category, kind, first, max(last - 1, first), a, b, list(parent.outline) if parent else [], properties={k: v for k, v in (properties or {}).items() if v is not None})
        if self.affiliated and category == "element" and kind != "keyword":
            row.name = self.affiliated.get("NAME")
            row.properties |= {f"attr:{k}": v for k, v in self.affiliated.items() if k != "NAME"}
            self.affiliated = {}
        self.rows.append(row)
        return row

    def parse(self) -> list[Row]:
        n = len(self.lines)
        heads = [i for i in range(n) if self.lines[i].startswith("*") and not self.lines[i].startswith(INLINE_TASK) and HEADLINE.match(self.lines[i])]
        root = self.add(None, "document", "org-data", 0, n)
        self.body(root, 0, heads[0] if heads else n)
        open_: list[Row] = [root]
        # Where each headline's tree ends: the next headline as high or higher.
        ends, waiting = [n] * len(heads), []
        for k, i in enumerate(heads):
            depth = len(self.lines[i]) - len(self.lines[i].lstrip("*"))
            while waiting and waiting[-1][1] >= depth:
                ends[waiting.pop()[0]] = i
            waiting.append((k, depth))
        for k, i in enumerate(heads):
            level = len(self.lines[i]) - len(self.lines[i].lstrip("*"))
            end = heads[k + 1] if k + 1 < len(heads) else n
            while open_[-1].level >= level:
                open_.pop()
            tree_end = ends[k]
            row = self.headline(open_[-1], i, end, tree_end, level)
            open_.append(row)
        return self.rows

    def headline(self, parent: Row, i: int, end: int, tree_end: int, level: int) -> Row:
        m = HEADLINE.match(self.lines[i])
        rest = m[2] or ""
        props: dict[str, str] = {"LEVEL": str(level), "raw": rest}
        word = rest.split(" ", 1)[0]
        if word in self.todo or word in self.done:
            props |= {"TODO": word, "todo-type": "todo" if word in self.todo else "done"}
            rest = rest[len(word) :].lstrip()
        if p := PRIORITY.match(rest):
            props["PRIORITY"] = p[1]
            rest = rest[p.end() :]
        tags: list[str] = []
        if t := TAGS.search(" " + rest):
            tags = [x for x in t[1].split(":") if x]
            rest = (" " + rest)[: t.start()].strip()
        if rest.startswith("COMMENT ") or rest == "COMMENT":
            props["COMMENT"] = "t"
            rest = rest[7:].lstrip()
        at = i + 1
        row = self.add(parent, "section", "headline", i, tree_end, props)
        row.level = level
        if at < end and (found := PLANNING.findall(self.lines[at])) and re.match(r"^[ \t]*(SCHEDULED|DEADLINE|CLOSED):", self.lines[at]):
            row.properties |= dict(found)
            plan = self.add(row, "element", "planning", at, at + 1, dict(found))
            self.objects(plan, self.at[at], self.lines[at])
            at += 1
        row.inherited = dict(parent.inherited)
        if at < end and self.lines[at].strip().upper() == ":PROPERTIES:":
            stop = next((j for j in range(at + 1, end) if self.lines[j].strip().upper() == ":END:"), None)
            if stop is not None:
                drawer = self.add(row, "element", "property-drawer", at, stop + 1)
                for j in range(at + 1, stop):
                    if q := PROPERTY.match(self.lines[j]):
                        key, value = q[1].upper(), q[3] or ""
                        # A key with + extends the value so far.
                        old = row.properties.get(key, row.inherited.get(key)) if q[2] else None
                        row.properties[key] = f"{old} {value}" if old else value
                        row.inherited[key] = row.properties[key]
                        self.add(drawer, "property", "node-property", j, j + 1, {"key": q[1] + q[2], "value": value})
                at = stop + 1
        row.tags = list(dict.fromkeys([*parent.tags, *tags]))
        row.outline = [*parent.outline, rest]
        row.properties |= {"title": rest, "TAGS": ":".join(tags), "ALLTAGS": ":".join(row.tags), "anchor": self.anchor(row.properties.get("CUSTOM_ID") or rest)}
        row.properties |= {f"inherited:{k}": v for k, v in parent.inherited.items() if k not in row.properties}
        self.objects(row, self.at[i] + self.lines[i].find(rest, level) if rest else self.at[i], rest)
        self.body(row, at, end)
        return row

    def anchor(self, text: str) -> str:
        base = re.sub(r"-+", "-", re.sub(r"[^a-z0-9]", "-", text.lower())).strip("-")
        name, k = base, 0
        while name in self.names:
            k += 1
            name = f"{base}-{k}"
        self.names.add(name)
        return name

    def body(self, parent: Row, i: int, end: int) -> None:
        """Elements of lines [i, end)."""
        lines = self.lines
        while i < end:
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            i = self.element(parent, i, end, line)

    def _until(self, i: int, end: int, test) -> int:
        while i < end and test(self.lines[i]):
            i += 1
        return i

    def inline_task(self, parent: Row, i: int, end: int) -> int:
        """A task within the text: a headline of 15 stars or more, with the lines down to its END if it has one; the outline goes on around it."""
        level = len(self.lines[i]) - len(self.lines[i].lstrip("*"))
        rest = self.lines[i][level:].strip()
        props: dict[str, str] = {"LEVEL": str(level)}
        word = rest.split(" ", 1)[0]
        if word in self.todo or word in self.done:
            props |= {"TODO": word, "todo-type": "todo" if word in self.todo else "done"}
            rest = rest[len(word) :].lstrip()
        stop = next((j for j in range(i + 1, end) if self.lines[j].startswith(INLINE_TASK)), None)
        closed = stop is not None and self.lines[stop].lstrip("*").strip().upper() == "END"
        row = self.add(parent, "element", "inlinetask", i, stop + 1 if closed else i + 1, props | {"title": rest})
        self.objects(row, self.at[i] + self.lines[i].find(rest, level) if rest else self.at[i], rest)
        if closed:
            self.body(row, i + 1, stop)
        return stop + 1 if closed else i + 1

    def element(self, parent: Row, i: int, end: int, line: str) -> int:
        strip = line.lstrip()
        if line.startswith(INLINE_TASK) and HEADLINE.match(line):
            return self.inline_task(parent, i, end)
        if m := BEGIN.match(line):
            name = (m[1] or ":").lower()
            stop = next((j for j in range(i + 1, end) if self.lines[j].strip().lower() in (f"#+end_{name}", "#+end:" if name == ":" else "")), None)
            if stop is not None:
                return self.block(parent, i, stop, name, m[3] or "")
        if m := KEYWORD.match(line):
            key = m[1].upper()
            row = self.add(parent, "element" if key == "CALL" else "keyword", "babel-call" if key == "CALL" else "keyword", i, i + 1, {"key": key, "value": m[2] or ""})
            if key in AFFILIATED or key.startswith("ATTR_"):
                self.affiliated[key] = m[2] or ""
            elif key == "FILETAGS" and parent.level == 0:
                parent.tags += [t for t in (m[2] or "").split(":") if t]
            elif key == "PROPERTY" and " " in (m[2] or ""):
                k, v = m[2].split(" ", 1)
                parent.inherited[k.upper()] = v
                parent.properties[k.upper()] = v
            self.objects(row, self.at[i], line) if key in ("CAPTION", "TITLE") else None
            return i + 1
        if m := CLOCK.match(line):
            stamps, _, took = m[1].partition("=>")
            self.add(parent, "element", "clock", i, i + 1, {"value": stamps.strip(), "duration": took.strip() or None})
            return i + 1
        if (m := DRAWER.match(line)) and m[1].upper() != "END":
            stop = next((j for j in range(i + 1, end) if self.lines[j].strip().upper() == ":END:"), None)
            if stop is not None:
                row = self.add(parent, "element", "drawer", i, stop + 1, {"name": m[1]})
                self.body(row, i + 1, stop)
                return stop + 1
        if RULE.match(line):
            self.add(parent, "element", "horizontal-rule", i, i + 1)
            return i + 1
        if strip.startswith("|"):
            return self.table(parent, i, self._until(i, end, lambda x: x.lstrip().startswith("|")))
        if strip.startswith("+-") and re.fullmatch(r"\+[-+]+\+?[ \t]*", strip):
            stop = self._until(i, end, lambda x: x.lstrip()[:1] in ("+", "|"))
            self.add(parent, "element", "table-el", i, stop)
            return stop
        if strip == "#" or strip.startswith("# "):
            stop = self._until(i, end, lambda x: x.strip() == "#" or x.lstrip().startswith("# "))
            self.add(parent, "element", "comment", i, stop)
            return stop
        if strip == ":" or strip.startswith(": "):
            stop = self._until(i, end, lambda x: x.strip() == ":" or x.lstrip().startswith(": "))
            self.add(parent, "element", "fixed-width", i, stop)
            return stop
        if line.startswith("%%("):
            self.add(parent, "element", "diary-sexp", i, i + 1, {"value": line})
            return i + 1
        if m := FOOTNOTE.match(line):
            stop = i + 1
            while stop < end and not FOOTNOTE.match(self.lines[stop]) and (self.lines[stop].strip() or self.lines[stop - 1].strip()):
                stop += 1
            row = self.add(parent, "footnote-entry", "footnote-definition", i, stop, {"label": m[1]})
            self.objects(row, self.at[i] + len(line) - len(m[2]), m[2])
            self.body(row, i + 1, stop)
            return stop
        if m := LATEX.match(line):
            stop = next((j for j in range(i, end) if f"\\end{{{m[1]}}}" in self.lines[j]), None)
            if stop is not None:
                self.add(parent, "element", "latex-environment", i, stop + 1, {"name": m[1]})
                return stop + 1
        if ITEM.match(line):
            return self.list_(parent, i, end)
        stop = i + 1
        while stop < end and self.lines[stop].strip() and not self._starts(self.lines[stop]):
            stop += 1
        row = self.add(parent, "element", "paragraph", i, stop)
        self.objects(row, self.at[i], "\n".join(self.lines[i:stop]))
        return stop

    def _starts(self, line: str) -> bool:
        """Whether a line ends the paragraph before it."""
        strip = line.lstrip()
        return bool(line.startswith(INLINE_TASK) or BEGIN.match(line) or KEYWORD.match(line) or ITEM.match(line) or RULE.match(line) or strip.startswith("|") or DRAWER.match(line) or CLOCK.match(line) or FOOTNOTE.match(line) or strip == "#" or strip.startswith("# ") or strip.startswith(": "))

    def block(self, parent: Row, i: int, stop: int, name: str, args: str) -> int:
        if name in VERBATIM_BLOCKS:
            language, _, rest = args.partition(" ")
            props = {"value": "\n".join(self.lines[i + 1 : stop]), "language": language or None} if name in ("src", "export") else {"value": "\n".join(self.lines[i + 1 : stop])}
            if name == "src":
                props |= {f"header{k.strip()}": v.strip() for k, v in re.findall(r"(:[\w-]+)((?:\s+(?!:[\w-])\S+)*)", rest)}
            self.add(parent, "element", VERBATIM_BLOCKS[name], i, stop + 1, props)
        else:
            kind = "dynamic-block" if name == ":" else OTHER_BLOCKS.get(name, "special-block")
            row = self.add(parent, "element", kind, i, stop + 1, {"name": name if name != ":" else args.split(" ")[0], "args": args or None})
            self.body(row, i + 1, stop)
        return stop + 1

    def table(self, parent: Row, i: int, stop: int) -> int:
        rows = [line.strip() for line in self.lines[i:stop]]
        cells = [[c.strip() for c in r.strip("|").split("|")] for r in rows if not r.startswith("|-")]
        has_rule = any(r.startswith("|-") for r in rows[1:])
        formulas = stop
        while formulas < len(self.lines) and self.lines[formulas].strip().upper().startswith("#+TBLFM:"):
            formulas += 1
        table = self.add(parent, "element", "table", i, formulas, {"rows": str(len(cells)), "columns": str(max(map(len, cells), default=0)), "header": "|".join(cells[0]) if cells and has_rule else None, "formulas": "\n".join(x.strip()[8:].strip() for x in self.lines[stop:formulas]) or None})
        for j in range(i, stop):
            rule = self.lines[j].strip().startswith("|-")
            row = self.add(table, "element", "table-row", j, j + 1, {"type": "rule" if rule else "standard"})
            if not rule:
                for k, c in enumerate(self.lines[j].strip().strip("|").split("|")):
                    self.add(row, "object", "table-cell", j, j + 1, {"column": str(k), "value": c.strip()})
        return formulas

    def list_(self, parent: Row, i: int, end: int) -> int:
        """A plain list: items of one indent, deeper ones inside them."""
        indent = len(ITEM.match(self.lines[i])[1].expandtabs())
        stop, blank = i, 0
        while stop < end:
            line = self.lines[stop]
            if not line.strip():
                blank += 1
                if blank == 2:
                    break
                stop += 1
                continue
            width = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            if width < indent or (width == indent and not ITEM.match(line)):
                break
            blank = 0
            stop += 1
        while stop > i and not self.lines[stop - 1].strip():
            stop -= 1
        first = ITEM.match(self.lines[i])
        ordered = first[2][0].isalnum()
        rows = self.add(parent, "element", "plain-list", i, stop, {"type": "ordered" if ordered else "descriptive" if " :: " in (first[3] or "") else "unordered"})
        heads = [j for j in range(i, stop) if (m := ITEM.match(self.lines[j])) and len(m[1].expandtabs()) == indent]
        for k, j in enumerate(heads):
            last = heads[k + 1] if k + 1 < len(heads) else stop
            m = ITEM.match(self.lines[j])
            body = m[3] or ""
            box = CHECKBOX.match(body)
            text = body[box.end() :] if box else body
            tag, sep, rest = text.partition(" :: ")
            item = self.add(rows, "element", "item", j, last, {"bullet": m[2].strip(), "checkbox": {" ": "off", "-": "trans"}.get(box[1], "on") if box else None, "tag": tag if sep else None, "text": rest if sep else text})
            self.objects(item, self.at[j] + len(self.lines[j]) - len(body), body)
            self.body(item, j + 1, last)
        return stop

    def objects(self, parent: Row, start: int, text: str) -> None:
        """Inline objects of a text that starts at ``start``."""
        if not MAY_HOLD_OBJECT.search(text):
            return
        line = bisect_right(self.at, start) - 1
        for m in OBJECT.finditer(text):
            kind, raw = m.lastgroup, m[0]
            props: dict[str, str | None] = {"value": raw}
            if m["link"]:
                kind, props = "link", {"path": m["path"], "description": m["desc"], "format": "bracket", "search": m["path"].partition("::")[2] or None}
            elif m["mark"]:
                kind, props = MARKS[m["m"]], {"value": m["inner"]}
            else:
                kind = next(k for k in NAMES if m[k])
                if kind in ("angle", "plain"):
                    props = {"path": raw.strip("<>"), "format": kind}
                elif kind in ("radio", "target"):
                    props = {"value": raw.strip("<>")}
                elif kind == "stamp":
                    props |= {"type": "diary" if raw.startswith("<%%") else "active" if raw[0] == "<" else "inactive", "range": "t" if "--" in raw else None, "repeater": (r := re.search(r"(?:\+\+|\.\+|\+)\d+[hdwmy]", raw)) and r[0], "warning": (w := re.search(r" (--?\d+[hdwmy])", raw)) and w[1]}
                elif kind == "macro":
                    props |= {"name": re.match(r"\{\{\{([\w-]+)", raw)[1]}
                elif kind == "fn":
                    props |= {"label": raw[4:-1].partition(":")[0]}
                kind = NAMES[kind]
            at = start + m.start()
            on = line + text.count("\n", 0, m.start())
            category = "object"
            row = self.add(parent, category, kind, on, on + 1, props, at, start + m.end())
            if m["mark"] and m["m"] in "*/_+" and len(raw) < 2000:
                self.objects(row, at + 1, m["inner"])


def records(source_file: str, text: str | None, kinds: frozenset[str] | None = None) -> list[dict]:
    """The rows of a document, or those of some kinds, as dictionaries; offsets are in UTF-8 bytes, lines from 1."""
    p = Parser(text or "")
    return [
        {
            "source_file": source_file, "id": r.id, "parent_id": r.parent.id if r.parent else None, "ancestor_ids": r.ancestors(), "ordinal": r.id, "category": r.category, "kind": r.kind, "affiliated_name": r.name, "outline_path": r.outline,
            "context": r.parent.kind if r.parent else None, "properties": list(r.properties.items()), "line": r.first + 1, "end_line": r.last + 1, "range_start": p.bytes_at(r.start), "range_end": p.bytes_at(r.stop), "source_raw": p.text[r.start : r.stop],
        }
        for r in p.parse()
        if kinds is None or r.kind in kinds
    ]
