"""Registered queries on the grammar, on element queries and searches, on property schemas and publishing projects.  Each has SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import _register, _table
from sheaf.operators import lint, publishing, records, schemas, search
from sheaf.plans import contract_language
from sheaf.plans import elements as eq
from sheaf.sources import markdown, org, packets

#: Passages, each with the elements and objects it holds.
GRAMMAR: list[tuple[str, dict[str, int]]] = [
    ("- [ ] a\n- [X] b\n  1. c\n\n\n", {"plain-list": 2, "item": 3}),
    ("+---+\n| x |\n+---+\n\n", {"table-el": 1}),
    ("#+begin: clocktable\nx\n#+end:\n", {"dynamic-block": 1}),
    ("# remark\n# more\n\n", {"comment": 1}),
    (": fixed\n: width\n\n", {"fixed-width": 1}),
    ("%%(diary-float t 4 2)\n\n", {"diary-sexp": 1}),
    ("-----\n", {"horizontal-rule": 1}),
    ("\\begin{align}\nx\n\\end{align}\n\n", {"latex-environment": 1}),
    ("[fn:1] note\n\n\n", {"footnote-definition": 1}),
    ("*b* /i/ _u_ +s+ =v= ~c~\n\n", {"bold": 1, "italic": 1, "underline": 1, "strike-through": 1, "verbatim": 1, "code": 1}),
    ("*bold /and italic/ text*\n\n", {"bold": 1, "italic": 1}),
    ("x^{2} and a_{1}\n\n", {"superscript": 1, "subscript": 1}),
    ("http://a.example/x and <https://b.example> and [[https://c.example][d]]\n\n", {"link": 3}),
    ("<2024-01-01 Mon> [2024-01-02 Tue] <2024-01-01 Mon>--<2024-01-03 Wed>\n\n", {"timestamp": 3}),
    ("<<t>> <<<r>>>\n\n", {"target": 1, "radio-target": 1}),
    ("text[fn:1] [cite:@k]\n\n", {"footnote-reference": 1, "citation": 1}),
    ("call_f(1) src_sql{select 1} @@html:<b>@@ {{{m(1)}}}\n\n", {"inline-babel-call": 1, "inline-src-block": 1, "export-snippet": 1, "macro": 1}),
    ("done [1/2] and [50%]\n\n", {"statistics-cookie": 2}),
    ("\\alpha and \\(x\\) end\\\\\n\n", {"entity": 1, "latex-fragment": 1, "line-break": 1}),
    ("| a | b |\n|---+---|\n| 1 | 2 |\n\n", {"table": 1, "table-row": 3, "table-cell": 4}),
    ("#+begin_quote\nq\n#+end_quote\n#+begin_center\nq\n#+end_center\n#+begin_verse\nq\n#+end_verse\n", {"quote-block": 1, "center-block": 1, "verse-block": 1}),
    ("#+begin_example\n*no*\n#+end_example\n#+begin_export html\n*no*\n#+end_export\n#+begin_comment\n*no*\n#+end_comment\n", {"example-block": 1, "export-block": 1, "comment-block": 1}),
    ("#+begin_src sql\n-- *no*\n#+end_src\n#+begin_note\nq\n#+end_note\n", {"src-block": 1, "special-block": 1}),
    (":NOTE:\nx\n:END:\n", {"drawer": 1}),
    ("#+CALL: f()\n", {"babel-call": 1}),
    ("not *bold with space * nor a/b/c nor 2_x\n\n", {}),
    ("* head\nSCHEDULED: [2024-01-01 Mon]\n:PROPERTIES:\n:A: 1\n:B: 2\n:END:\n", {"headline": 1, "planning": 1, "property-drawer": 1, "node-property": 2}),
]
_KINDS = sorted({k for _, has in GRAMMAR for k in has})
_COUNTS = ",".join(f"({i},'{k}',{n})" for i, (_, has) in enumerate(GRAMMAR) for k, n in has.items())


def _grammar(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier with every passage once, and one, chosen by its key, twice."""
    k = F.col("s_suppkey")
    parts = [F.repeat(F.lit(text), F.when(k % len(GRAMMAR) == i, 2).otherwise(1)) for i, (text, _) in enumerate(GRAMMAR)]
    return org.parse(_table(spark, d, "supplier").select(k.cast("string").alias("source_file"), F.concat(*parts).alias("text")))


@_register(f"SELECT s_suppkey AS supplier, kind, sum(CASE WHEN s_suppkey%{len(GRAMMAR)}=i THEN 2*n ELSE n END)::BIGINT AS n FROM supplier, (VALUES {_COUNTS}) t(i, kind, n) GROUP BY ALL")
def grammar_kinds(spark, d):
    """Elements and objects of every kind; stamps of planning lines are left out."""
    rows = _grammar(spark, d).where(F.col("kind").isin(_KINDS) & ~F.col("context").eqNullSafe("planning"))
    return rows.groupBy(F.col("source_file").cast("long").alias("supplier"), "kind").agg(F.count("*").alias("n"))


_BOLD = ",".join(str(i) for i, (_, has) in enumerate(GRAMMAR) if "bold" in has)


@_register(f"SELECT s_suppkey AS supplier, CASE WHEN s_suppkey%{len(GRAMMAR)} IN ({_BOLD}) THEN 3 ELSE 2 END::BIGINT AS marks, 0::BIGINT AS lost FROM supplier")
def grammar_ranges(spark, d):
    """The byte ranges of bold marks are those of their texts, which begin with a star."""
    rows = _grammar(spark, d).where("kind = 'bold'")
    lost = F.count_if(~F.startswith("source_raw", F.lit("*")) | (F.col("range_end") - F.col("range_start") != F.octet_length("source_raw")))
    return rows.groupBy(F.col("source_file").cast("long").alias("supplier")).agg(F.count("*").alias("marks"), lost.alias("lost"))


def _notebook(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier: a named block, calls, an abbreviated link, two headlines, of which one is a task for every third."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("#+LINK: gh https://h.example/%s/x\n* Block "), k, F.lit("\n#+NAME: run\n#+begin_src sql :tangle out.sql\nselect "), k, F.lit("\n#+end_src\n#+CALL: run()\n#+CALL: gone()\nsee [[gh:"), k, F.lit("]] there\n* "),
        F.when(F.col("s_suppkey") % 3 == 0, "TODO ").otherwise(""), F.lit("Rest\n:PROPERTIES:\n:OWNER: nation "), F.col("s_nationkey").cast("string"), F.lit("\n:END:\n"),
    )
    return _table(spark, d, "supplier").select(F.concat(F.lit("notes/"), k, F.lit(".org")).alias("source_file"), text.alias("text"))


def _supplier(path: str = "source_file") -> Column:
    return F.regexp_extract(path, r"(\d+)\.org$", 1).cast("long").alias("supplier")


@_register("""SELECT s_suppkey AS supplier, asked FROM supplier, (VALUES ('name'),('context'),('at'),('summary'),('lines')) t(asked)
 WHERE asked IN ('name','context','at') OR (asked='summary' AND contains(s_suppkey::VARCHAR, '7')) OR (asked='lines' AND s_suppkey=7)""")
def query_leaves(spark, d):
    """Predicates by name, context and part of a property, a relation to ids, and a block of key=value lines."""
    e = org.parse(_notebook(spark, d))
    asked = {
        "name": eq.Query(name="run"), "context": eq.Query(kind="link", context="paragraph"), "at": eq.Query(relations=[("at", [1])]), "summary": eq.Query(kind="src-block", property_contains=[("value", "7")]),
        "lines": contract_language.from_lines("# one block\nkind=src-block\nsummary.value=select 7\nproperty_contains.language=sq\nlimit=2"),
    }
    return reduce(DataFrame.union, (eq.run(e, q).select(_supplier(), F.lit(name).alias("asked")) for name, q in asked.items()))


@_register("SELECT s_suppkey AS supplier, name, resolved FROM supplier, (VALUES ('run', true), ('gone', false)) t(name, resolved)")
def block_references(spark, d):
    return records.source_references(org.parse(_notebook(spark, d))).select(_supplier(), "name", "resolved")


@_register("SELECT s_suppkey AS supplier, 'https://h.example/'||s_suppkey||'/x' AS path FROM supplier")
def link_abbreviations(spark, d):
    return records.links(org.parse(_notebook(spark, d))).select(_supplier(), "path")


@_register("SELECT s_suppkey AS supplier, 'src-block' AS kind, 'run' AS name, 'Block '||s_suppkey AS outline FROM supplier")
def index_rows(spark, d):
    """The JSON of the flat index, read again."""
    rows = packets.index_json(org.parse(_notebook(spark, d)).where("kind = 'src-block'"))
    part = lambda path: F.get_json_object("json", path)
    return rows.select(_supplier(), part("$.kind").alias("kind"), part("$.affiliated_name").alias("name"), part("$.outline_path[0]").alias("outline"))


@_register("""SELECT s_suppkey AS supplier, asked FROM supplier, (VALUES ('task'),('owner'),('toc')) t(asked)
 WHERE (asked='task' AND s_suppkey%3=0) OR (asked='owner' AND contains('nation '||s_nationkey, 'nation 1')) OR asked='toc' AND contains('block '||s_suppkey, 'block 1')""")
def project_search(spark, d):
    """Facts by kind and by a field's value, and documents whose headings hold every term."""
    facts = search.document_elements(org.parse(_notebook(spark, d)))
    tasks = search.query(facts, terms=["REST"], kinds=["task"])
    owned = search.query(facts, kinds=["heading"], fields=["owner=nation 1"])
    toc = search.contents(facts.where("kind = 'heading'"), ["rest", "Block 1"]).where(F.startswith("text", F.lit("Block")))
    return reduce(DataFrame.union, (x.select(_supplier("path"), F.lit(name).alias("asked")) for name, x in (("task", tasks), ("owner", owned), ("toc", toc))))


@_register("SELECT s_suppkey AS supplier, 2::BIGINT AS parsed FROM supplier WHERE contains(s_suppkey||'/'||s_nationkey, '7')")
def prefiltered_scan(spark, d):
    """Documents that can't hold the terms are never parsed."""
    docs = org.prefilter(_notebook(spark, d).withColumn("source_file", F.regexp_replace("source_file", r"\d", "")), ["SELECT", "7"])
    e = org.parse(docs.withColumn("source_file", F.regexp_extract("text", r"select (\d+)", 1)))
    return e.where("kind = 'headline'").groupBy(F.col("source_file").cast("long").alias("supplier")).agg(F.count("*").alias("parsed"))


@_register("SELECT s_suppkey AS supplier, '#+NAME: run'||chr(10)||'#+begin_src sql :tangle out.sql' AS content FROM supplier")
def line_slices(spark, d):
    return search.line_selection(_notebook(spark, d), 3, 4).select(_supplier(), "content")


@_register("SELECT s_suppkey AS supplier, 'Plan '||s_suppkey AS title, s_nationkey::VARCHAR AS nation FROM supplier WHERE s_suppkey%2=0")
def plan_ledgers(spark, d):
    """Ledgers by the name of their file, read without parsing."""
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "a/agent-plan-").otherwise("a/other-"), k, F.lit(".org"))
    docs = _table(spark, d, "supplier").select(name.alias("source_file"), F.concat(F.lit("* Plan "), k, F.lit("\n:PROPERTIES:\n:NATION: "), F.col("s_nationkey").cast("string"), F.lit("\n:END:\n* x\n")).alias("text"))
    return search.plan_ledger(docs).select(_supplier(), "title", F.try_element_at("properties", F.lit("NATION")).alias("nation"))


@_register("SELECT * FROM (VALUES ('both','src-block'),('left','headline'),('left','babel-call')) t(part, kind)")
def sql_set_operations(spark, d):
    """INTERSECT and EXCEPT over the SQL surface."""
    e = org.parse(_notebook(spark, d)).where("kind in ('src-block', 'headline', 'babel-call')")
    return org.sql(org.org_elements(e), "(SELECT 'both' AS part, kind FROM org_elements INTERSECT SELECT 'both', kind FROM org_elements WHERE language = 'sql') UNION ALL (SELECT 'left', kind FROM org_elements EXCEPT SELECT 'left', kind FROM org_elements WHERE language = 'sql')")


@_register("SELECT s_suppkey AS supplier, kind, selector FROM supplier, (VALUES ('heading','heading/1'),('heading','heading/2'),('block','block/1'),('checklistItem','checklistItem/1'),('link','link/1'),('table','table/1'),('thematicBreak','thematicBreak/1'),('frontMatter','frontMatter/1')) t(kind, selector)")
def markdown_selectors(spark, d):
    """Markdown elements are counted by kind within their file."""
    text = "---\ntitle: a\n---\n# One\n\nsee [x](http://a.example)\n\nTwo\n===\n\n- [x] done\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```sql\n# no heading\n```\n\n***\n"
    docs = _table(spark, d, "supplier").select(F.concat(F.lit("notes/"), F.col("s_suppkey").cast("string"), F.lit(".org")).alias("source_file"), F.lit(text).alias("text"))
    rows = markdown.parse(docs).where("kind in ('heading', 'block', 'checklistItem', 'link', 'table', 'thematicBreak', 'frontMatter')")
    return rows.select(_supplier("path"), "kind", F.substring_index("structural_selector", "#", -1).alias("selector"))


# Property schemas.

SCHEMAS = [
    schemas.Schema("task", [schemas.Field("owner", required=True, rule="nonEmpty"), schemas.Field("STATE", rule="oneOf", values=["open", "shut"])], aliases=["file:task.json", "contracts/task.json"], allow_unknown=False),
    schemas.Schema("free", [schemas.Field("OWNER")], aliases=["task"]),
]
#: Drawers: what follows their PROPERTY_SCHEMA, and the findings (kind, property).
DRAWERS: list[tuple[str, tuple[tuple[str, str], ...]]] = [
    ("task\n:OWNER: me", ()),
    ("task\n:STATE: open", (("missingRequiredProperty", "owner"),)),
    ("[[file:task.json][the task]]\n:OWNER: me\n:STATE: gone", (("disallowedValue", "STATE"),)),
    ("{{{schema( task )}}}\n:OWNER:", (("emptyValue", "OWNER"),)),
    ("contracts/task.json\n:owner: me\n:COLOR: red\n:COLOR_ALL: red blue", (("unknownProperty", "COLOR"),)),
    ("free\n:COLOR: red", ()),
    ("lost.json\n:OWNER: me", (("unresolvedReference", "PROPERTY_SCHEMA"),)),
    ("\n:OWNER: me", (("emptyReference", "PROPERTY_SCHEMA"),)),
    ("lost\n:OWNER: me\n:PROPERTY_SCHEMA: free", ()),
]
_REFERENCES = ("contractId", "contractId", "orgFileLink", "macro", "file", "contractId", "file", "empty", "contractId")


def _drawers(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier whose headline names a schema in one of these ways."""
    k = F.col("s_suppkey")
    body = F.element_at(F.array(*(F.lit(text) for text, _ in DRAWERS)), (k % len(DRAWERS) + 1).cast("int"))
    text = F.concat(F.lit("* plain\n:PROPERTIES:\n:STATE: any\n:END:\n* a\n:PROPERTIES:\n:PROPERTY_SCHEMA: "), body, F.lit("\n:END:\n"))
    return org.parse(_table(spark, d, "supplier").select(k.cast("string").alias("source_file"), text.alias("text")))


_FINDINGS = ",".join(f"({i},'{kind}','{key}')" for i, (_, found) in enumerate(DRAWERS) for kind, key in found)


@_register(f"SELECT s_suppkey AS supplier, finding, property FROM supplier JOIN (VALUES {_FINDINGS}) t(i, finding, property) ON s_suppkey%{len(DRAWERS)}=i")
def schema_findings(spark, d):
    return schemas.findings(_drawers(spark, d), SCHEMAS).select(F.col("source_file").cast("long").alias("supplier"), "finding", "property")


@_register(f"SELECT s_suppkey AS supplier, kind AS reference_kind, CASE WHEN i IN (5,8) THEN 'free' WHEN i NOT IN (6,7) THEN 'task' END AS contract FROM supplier JOIN (VALUES {','.join(f'({i},{r!r})' for i, r in enumerate(_REFERENCES))}) t(i, kind) ON s_suppkey%{len(DRAWERS)}=i")
def schema_references(spark, d):
    """The contract that each drawer's reference leads to."""
    return schemas.applications(_drawers(spark, d), SCHEMAS).select(F.col("source_file").cast("long").alias("supplier"), "reference_kind", "contract")


@_register(f"SELECT s_suppkey AS supplier, count(*) AS n FROM supplier JOIN (VALUES {_FINDINGS}) t(i, finding, property) ON s_suppkey%{len(DRAWERS)}=i GROUP BY 1")
def lint_schemas(spark, d):
    found = lint.findings(_drawers(spark, d), ["ORG040"], known_schemas=SCHEMAS)
    return found.groupBy(F.col("source_file").cast("long").alias("supplier")).agg(F.count("*").alias("n"))


# Publishing projects.

PROJECT = publishing.Project("site", "notes", "public/")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier; some have a title, some a file name of their own."""
    k = F.col("s_suppkey")
    text = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("#+TITLE: "), "s_name", F.lit(" \n#+TITLE: later\n"))).otherwise("#+TITLE:\n"), F.when(k % 3 == 0, "#+EXPORT_FILE_NAME: early\n#+EXPORT_FILE_NAME: own.html\n").otherwise(""),
        F.lit('#+INCLUDE: "part.org" :lines "1-2"\n#+SETUPFILE: set.org\n#+BIBLIOGRAPHY: x.bib\n#+MACRO: hi hello $1\n* a\n'),
    )
    return org.parse(_table(spark, d, "supplier").select(F.concat(F.lit("notes/"), k.cast("string"), F.lit(".org")).alias("source_file"), text.alias("text")))


_FILE = "CASE WHEN s_suppkey%3=0 THEN 'own.html' ELSE 'notes/'||s_suppkey||'.html' END"


@_register(f"SELECT s_suppkey AS supplier, {_FILE} AS output_file, CASE WHEN s_suppkey%2=0 THEN s_name END AS title FROM supplier")
def publishing_documents(spark, d):
    return publishing.documents(_pages(spark, d)).select(_supplier(), "output_file", "title")


@_register("SELECT s_suppkey AS supplier, kind, target FROM supplier, (VALUES ('projectRoot','notes'),('include','part.org'),('setupFile','set.org'),('bibliography','x.bib'),('macro','hi')) t(kind, target)")
def publishing_dependencies(spark, d):
    return publishing.dependencies(_pages(spark, d), PROJECT).select(_supplier(), "kind", "target")


@_register(f"SELECT 'public/sitemap.org' AS sitemap, s_suppkey AS supplier, {_FILE} AS output_file, CASE WHEN s_suppkey%2=0 THEN s_name ELSE 'notes/'||s_suppkey||'.org' END AS title FROM supplier")
def publishing_sitemap(spark, d):
    return publishing.sitemap(_pages(spark, d), PROJECT).select("sitemap", _supplier(), "output_file", "title")
