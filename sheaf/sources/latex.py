"""Export of a document as a LaTeX body: sections, paragraphs, lists, tables, blocks, rules, inline marks and links."""

from __future__ import annotations

import re

from sheaf.sources.packets import _spans
from sheaf.sources.parser import Parser, Row

#: LaTeX's own characters, commands of sections, inline marks, environments of blocks.
SPECIAL = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"}
SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")
MARKS = {"bold": (r"\textbf{", "}"), "italic": (r"\emph{", "}"), "underline": (r"\uline{", "}"), "strike-through": (r"\sout{", "}"), "verbatim": (r"\texttt{", "}"), "code": (r"\texttt{", "}")}
BLOCKS = {"quote-block": "quote", "center-block": "center", "verse-block": "verse"}


def escape(text: str) -> str:
    return "".join(SPECIAL.get(c, c) for c in text)


def _link(path: str, description: str | None) -> str:
    url = path.replace("%", r"\%").replace("#", r"\#")
    return rf"\href{{{url}}}{{{escape(description)}}}" if description else rf"\url{{{url}}}"


def latex(text: str) -> str:
    """The body of a document; COMMENT headlines are left out, text of export blocks for latex is taken as it is."""
    p = Parser(text)
    rows = p.parse()
    kids: dict[int, list[Row]] = {}
    for r in rows:
        if r.parent:
            kids.setdefault(r.parent.id, []).append(r)

    def body(row: Row) -> list[str]:
        return [part for r in kids.get(row.id, []) for part in one(r)]

    def environment(name: str, inner: list[str]) -> str:
        return "\n".join([rf"\begin{{{name}}}", *inner, rf"\end{{{name}}}"])

    def item(r: Row) -> str:
        words = escape(r.properties.get("text") or "")
        tag = f"[{escape(r.properties['tag'])}]" if r.properties.get("tag") else {"on": r"[$\boxtimes$]", "off": r"[$\square$]", "trans": r"[$\boxminus$]"}.get(r.properties.get("checkbox") or "", "")
        return "\n".join([rf"\item{tag} {words}", *(x for k in kids.get(r.id, []) if k.category == "element" for x in one(k))])

    def table(r: Row) -> str:
        lines, width = [], int(r.properties.get("columns") or 1)
        for x in kids.get(r.id, []):
            if x.kind == "table-row":
                lines.append(r"\hline" if x.properties["type"] == "rule" else " & ".join(escape(c.properties["value"]) for c in kids.get(x.id, [])) + r" \\")
        return environment("center", [rf"\begin{{tabular}}{{{'l' * width}}}", *lines, r"\end{tabular}"])

    def one(r: Row) -> list[str]:
        value = r.properties.get("value", "")
        match r.kind:
            case "headline":
                if "COMMENT" in r.properties:
                    return []
                return [rf"\{SECTIONS[min(r.level, len(SECTIONS)) - 1]}{{{escape(r.properties['title'])}}}" + rf"\label{{{r.properties['anchor']}}}", *body(r)]
            case "paragraph":
                return [_spans(p, kids, r, r.start, r.stop, MARKS, _link, escape).rstrip("\n")]
            case "plain-list":
                name = {"ordered": "enumerate", "descriptive": "description"}.get(r.properties["type"], "itemize")
                return [environment(name, [item(k) for k in kids.get(r.id, []) if k.kind == "item"])]
            case "table":
                return [table(r)]
            case "src-block" | "example-block":
                return [environment("verbatim", [value])]
            case "export-block":
                return [value] if (r.properties.get("language") or "").lower() == "latex" else []
            case "latex-environment":
                return [p.text[r.start : r.stop].rstrip("\n")]
            case "fixed-width":
                return [environment("verbatim", [re.sub(r"(?m)^[ \t]*: ?", "", p.text[r.start : r.stop]).rstrip("\n")])]
            case "quote-block" | "center-block" | "verse-block":
                return [environment(BLOCKS[r.kind], body(r))]
            case "horizontal-rule":
                return [r"\noindent\rule{\textwidth}{0.5pt}"]
            case "special-block":
                return [environment(r.properties.get("name") or "center", body(r))]
        return []

    return "\n\n".join(body(rows[0])) + "\n"
