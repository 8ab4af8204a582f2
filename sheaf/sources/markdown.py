"""Markdown documents as element rows: a subset of CommonMark, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.shipping import shipped

SCHEMA = "path string, kind string, source_kind string, structural_selector string, line long, end_line long, fields array<struct<key: string, value: string>>, text string, content string"
_FIELD = pa.struct([("key", pa.string()), ("value", pa.string())])
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("source_kind", pa.string()), ("structural_selector", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("fields", pa.list_(_FIELD)), ("text", pa.string()), ("content", pa.string())])
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
BREAK = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
LINK = re.compile(r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'(].*?[\"')])?\s*\)")
ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def elements(path: str, text: str | None) -> list[dict]:
    """Rows of one file: heading, paragraph, block, table, list, listItem, checklistItem, link, image, frontMatter, thematicBreak."""
    lines = (text or "").split("\n")
    out: list[dict] = []
    numbers: dict[str, int] = {}

    def add(kind: str, source: str, a: int, b: int, words: str, *fields: tuple[str, str]) -> None:
        numbers[kind] = numbers.get(kind, 0) + 1
        out.append({"path": path, "kind": kind, "source_kind": source, "structural_selector": f"md://{path}#{kind}/{numbers[kind]}", "line": a + 1, "end_line": b, "fields": [{"key": k, "value": v} for k, v in fields], "text": words, "content": "\n".join(lines[a:b])})

    def inline(a: int, b: int) -> None:
        for i in range(a, b):
            for m in LINK.finditer(lines[i]):
                add("image" if m[1] else "link", "inline", i, i + 1, m[2], ("path", m[3]))

    i = 0
    if lines[0].strip() == "---" and (stop := next((j for j in range(1, len(lines)) if lines[j].strip() in ("---", "...")), 0)):
        add("frontMatter", "yaml", 0, stop + 1, "\n".join(lines[1:stop]), *((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:stop]) if v))
        i = stop + 1
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := HEADING.match(line):
            add("heading", "atx", i, i + 1, m[2] or "", ("level", str(len(m[1]))))
            inline(i, i + 1)
            i += 1
        elif m := FENCE.match(line):
            stop = next((j for j in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(m[1])}{m[1][0]}*[ \t]*$", lines[j])), len(lines))
            add("block", "code", i, min(stop + 1, len(lines)), "\n".join(lines[i + 1 : stop]), ("language", m[2].strip()))
            i = stop + 1
        elif BREAK.match(line):
            add("thematicBreak", "rule", i, i + 1, "")
            i += 1
        elif "|" in line and i + 1 < len(lines) and ROW.match(lines[i + 1]):
            stop = i + 2
            while stop < len(lines) and "|" in lines[stop]:
                stop += 1
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            add("table", "pipe", i, stop, " ".join(cells), ("columns", str(len(cells))), ("rows", str(stop - i - 2)))
            i = stop
        elif ITEM.match(line):
            stop = i + 1
            while stop < len(lines) and (ITEM.match(lines[stop]) or lines[stop][:1] in (" ", "\t")):
                stop += 1
            add("list", "ordered" if ITEM.match(line)[2][0].isdigit() else "bullet", i, stop, "")
            for j in range(i, stop):
                if m := ITEM.match(lines[j]):
                    box = re.match(r"\[([ xX])\][ \t]+(.*)", m[3] or "")
                    add("checklistItem" if box else "listItem", "item", j, j + 1, box[2] if box else m[3] or "", *([("checked", "true" if box[1] != " " else "false")] if box else []))
            inline(i, stop)
            i = stop
        else:
            stop = i + 1
            while stop < len(lines) and lines[stop].strip() and not (HEADING.match(lines[stop]) or FENCE.match(lines[stop]) or ITEM.match(lines[stop]) or BREAK.match(lines[stop])):
                stop += 1
            under = stop < len(lines) + 1 and stop - i > 1 and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[stop - 1])
            if under:
                add("heading", "setext", i, stop, " ".join(lines[i : stop - 1]), ("level", "1" if "=" in lines[stop - 1] else "2"))
            else:
                add("paragraph", "text", i, stop, " ".join(x.strip() for x in lines[i:stop]))
            inline(i, stop)
            i = stop
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in elements(p, t)]
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[i : i + 4096], schema=_ARROW)


def parse(documents: DataFrame) -> DataFrame:
    """Element rows of (source_file, text)."""
    shipped(documents.sparkSession)
    return documents.select("source_file", "text").mapInArrow(_parse, SCHEMA)
