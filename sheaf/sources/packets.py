"""What leaves the engine: JSON of elements, search packets, tangle plans, formatted source, exports."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.parser import Row, Parser


def index_json(elements: DataFrame) -> DataFrame:
    """One JSON object for each element."""
    return elements.select("source_file", "id", F.to_json(F.struct("id", "parent_id", "ordinal", "category", "kind", "affiliated_name", "outline_path", "context", "properties")).alias("json"))


def owners(elements: DataFrame, limit: int = 12) -> DataFrame:
    """Facts of each document by kind, and the first documents by path (a top-k, by path, not by counts)."""
    counts = elements.groupBy("source_file", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("source_file").agg(F.sum("n").alias("facts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds")).orderBy("source_file").limit(limit)


def tangle_plan(elements: DataFrame) -> DataFrame:
    """(target, source_file, content): source blocks by the file they are tangled to, in order; nothing is written."""
    to = F.try_element_at("properties", F.lit("header:tangle"))
    rows = elements.where("kind = 'src-block'").where(to.isNotNull() & (to != "no")).withColumn("target", F.when(to == "yes", F.regexp_replace("source_file", r"\.org$", "")).otherwise(to))
    parts = rows.groupBy("target", "source_file").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.try_element_at("properties", F.lit("value")).alias("value")))).alias("blocks"))
    return parts.select("target", "source_file", F.array_join(F.transform("blocks", lambda b: b["value"]), "\n\n").alias("content"))


def formatted(text: str) -> str:
    """Trailing blanks go, table cells line up outside blocks, blank lines at the end go, and the text ends with a line break."""
    lines, out, table, block = text.split("\n"), [], [], False

    def flush() -> None:
        if not table:
            return
        rows = [None if re.match(r"\s*\|-", r) else [c.strip() for c in r.strip().strip("|").split("|")] for r in table]
        n = max((len(r) for r in rows if r), default=1)
        width = [max([1, *(len(r[i]) for r in rows if r and i < len(r))]) for i in range(n)]
        pad = re.match(r"\s*", table[0])[0]
        for r in rows:
            out.append(pad + ("|" + "+".join("-" * (w + 2) for w in width) + "|" if r is None else "| " + " | ".join((r[i] if i < len(r) else "").ljust(width[i]) for i in range(n)) + " |"))
        table.clear()

    for line in lines:
        if re.match(r"\s*#\+begin_", line, re.I):
            block = True
        if not block and line.lstrip().startswith("|"):
            table.append(line.rstrip())
            continue
        flush()
        out.append(line.rstrip())
        if re.match(r"\s*#\+end_", line, re.I):
            block = False
    flush()
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""


_INLINE = {"bold": ("<b>", "</b>"), "italic": ("<i>", "</i>"), "underline": ("<u>", "</u>"), "strike-through": ("<del>", "</del>"), "verbatim": ("<code>", "</code>"), "code": ("<code>", "</code>")}
_MARKDOWN = {"bold": ("**", "**"), "italic": ("*", "*"), "underline": ("", ""), "strike-through": ("~~", "~~"), "verbatim": ("`", "`"), "code": ("`", "`")}


def _spans(p: Parser, kids: dict[int, list[Row]], row: Row, start: int, stop: int, marks: dict, link, escape) -> str:
    """A text range with its inline objects in place."""
    out, at = [], start
    for child in kids.get(row.id, []):
        if child.category != "object" or child.start < at or child.stop > stop:
            continue
        out.append(escape(p.text[at : child.start]))
        if child.kind in marks:
            a, b = marks[child.kind]
            inner = escape(p.text[child.start + 1 : child.stop - 1]) if child.kind in ("code", "verbatim") else _spans(p, kids, child, child.start + 1, child.stop - 1, marks, link, escape)
            out.append(a + inner + b)
        elif child.kind == "link":
            out.append(link(child.properties.get("path", ""), child.properties.get("description")))
        else:
            out.append(escape(p.text[child.start : child.stop]))
        at = child.stop
    return "".join([*out, escape(p.text[at:stop])])


def exported(text: str, to: str) -> str:
    """A document as ``html`` or ``markdown``: headlines, paragraphs, lists, tables, blocks, rules, inline marks and links."""
    p = Parser(text)
    rows = p.parse()
    kids: dict[int, list[Row]] = {}
    for r in rows:
        if r.parent:
            kids.setdefault(r.parent.id, []).append(r)
    web = to == "html"
    escape = html.escape if web else lambda s: s
    marks = _INLINE if web else _MARKDOWN
    link = (lambda path, desc: f'<a href="{html.escape(path)}">{html.escape(desc or path)}</a>') if web else (lambda path, desc: f"[{desc or path}]({path})")

    def inline(row: Row, a: int, b: int) -> str:
        return _spans(p, kids, row, a, b, marks, link, escape)

    def body(row: Row, depth: int) -> list[str]:
        out: list[str] = []
        for r in kids.get(row.id, []):
            out += one(r, depth)
        return out

    def one(r: Row, depth: int) -> list[str]:
        match r.kind:
            case "headline":
                if "COMMENT" in r.properties:
                    return []
                title = escape(r.properties["title"])
                head = f"<h{min(r.level, 6)} id=\"{r.properties['anchor']}\">{title}</h{min(r.level, 6)}>" if web else "#" * min(r.level, 6) + " " + title
                return [head, *body(r, 0)]
            case "paragraph":
                words = inline(r, r.start, r.stop).rstrip("\n")
                return [f"<p>{words}</p>" if web else words]
            case "plain-list":
                tag = "ol" if r.properties["type"] == "ordered" else "ul"
                inner = body(r, depth + 1)
                return [f"<{tag}>", *inner, f"</{tag}>"] if web else ["\n".join(inner)]
            case "item":
                words = escape(r.properties.get("text") or "")
                box = {"on": "[X] ", "off": "[ ] ", "trans": "[-] "}.get(r.properties.get("checkbox") or "", "")
                inner = [x for k in kids.get(r.id, []) if k.category == "element" for x in one(k, depth)]
                return ["<li>" + box + words, *inner, "</li>"] if web else ["  " * (depth - 1) + "- " + box + words, *inner]
            case "table":
                cells = [[c.properties["value"] for c in kids.get(x.id, [])] for x in kids.get(r.id, []) if x.kind == "table-row" and x.properties["type"] != "rule"]
                if web:
                    return ["<table>", *("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in cells), "</table>"]
                lines = ["| " + " | ".join(row) + " |" for row in cells]
                return ["\n".join([lines[0], "|" + " --- |" * len(cells[0]), *lines[1:]])] if lines else []
            case "src-block" | "example-block":
                value, language = r.properties.get("value", ""), r.properties.get("language") or ""
                return [f'<pre class="{html.escape(language)}">{escape(value)}</pre>' if web else f"```{language}\n{value}\n```"]
            case "quote-block":
                inner = body(r, depth)
                return ["<blockquote>", *inner, "</blockquote>"] if web else ["\n".join("> " + x for part in inner for x in part.split("\n"))]
            case "horizontal-rule":
                return ["<hr>" if web else "---"]
            case "fixed-width":
                value = re.sub(r"(?m)^[ \t]*: ?", "", p.text[r.start : r.stop]).rstrip("\n")
                return [f"<pre>{escape(value)}</pre>" if web else f"```\n{value}\n```"]
            case "center-block" | "special-block" | "verse-block":
                return body(r, depth)
        return []

    return ("\n" if web else "\n\n").join(body(rows[0], 0)) + "\n"
