"""Registered queries on generated documents: validation rules, design nodes, column views, agenda views.  Each has SQL for the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import OUTLINE, _parsed, _register, _table
from sheaf.functions import org_text
from sheaf.operators import agenda_views, columns, contracts, lint, lint_progress, lint_sdd, plans, records, traverse
from sheaf.operators.stored import dealt
from sheaf.plans import elements as eq
from sheaf.plans import outline
from sheaf.sources import org


def _drawer(**properties: str) -> str:
    return ":PROPERTIES:\n" + "".join(f":{k}: {v}\n" for k, v in properties.items()) + ":END:\n"


def _uuid(n: int) -> str:
    return f"00000000-0000-0000-0000-{n:012}"


def _node(title: str, kind: str, n: int, **more: str) -> str:
    return f"* {title} :sdd:\n" + _drawer(ID=_uuid(n), SDD_KIND=kind, **more)


def _src(args: str, name: str = "") -> str:
    return (f"#+NAME: {name}\n" if name else "") + f"#+begin_src sql {args}\nselect 1\n#+end_src\n"


_LOG = "* log\n:LOGBOOK:\n- {}\n:END:\n"
#: Of each rule a passage that breaks it, the findings it gives, and one that doesn't.  Passages without a headline come first.
CASES: list[tuple[str, tuple[str, ...], str]] = [
    ("#+SEQ_TODO: OPEN OPEN(o) | SHUT\n", ("ORG009",), "#+SEQ_TODO: OPEN | SHUT\n"),
    ("#+LINK: x\n", ("ORG005",), "#+LINK: x http://a/\n"),
    ("#+LINK: y http://a\n#+LINK: Y http://b\n", ("ORG006",), "#+LINK: y http://a\n"),
    ("#+OPTIONS: H:two e:maybe\n", ("ORG007", "ORG007"), "#+OPTIONS: H:2 e:t toc:nil\n"),
    ("#+MACRO: m a\n#+MACRO: m b\n", ("ORG008",), "#+MACRO: m a\n"),
    ("{{{nope}}}\n\n", ("ORG004",), "{{{m}}}\n\n"),
    ("<<t>> <<t>>\n\n", ("ORG002",), "<<t>>\n\n"),
    ("#+ARCHIVE: ::\n", ("ORG015",), "#+ARCHIVE: have.org::\n"),
    (_src("", "b") + _src("", "B"), ("ORG020",), _src("", "b")),
    ("#+CALL: gone()\n", ("ORG021",), "#+CALL: b()\n"),
    (_src(":var v=lost"), ("ORG021",), _src(":var v=b n=5")),
    (_src(":eval yes"), ("ORG022",), _src(":eval never")),
    (_src(':tangle ""'), ("ORG023",), _src(":tangle a.sql")),
    ("| 1 | 2 |\n#+TBLFM: $1::=3\n\n", ("ORG024", "ORG024"), "| 1 | 2 |\n#+TBLFM: $1=2\n\n"),
    ("| 1 | 2 |\n#+TBLFM: $1=2::$1=3\n\n", ("ORG025",), "| 1 | 2 |\n#+TBLFM: $1=2::$2=3\n\n"),
    ("| 1 | 2 |\n#+TBLFM: $1=$9+@7$1\n\n", ("ORG026", "ORG026"), "| 1 | 2 |\n#+TBLFM: $1=$2+@1$1+remote(t,@9$9)\n\n"),
    (_src(":session s"), ("ORG041",), _src(":session s :eval no")),
    (_src(":cache yes"), ("ORG042",), _src(":cache no")),
    (_src(":results file"), ("ORG043",), _src(":results file :file a.png")),
    ('#+INCLUDE: "gone.org"\n', ("ORG003",), '#+INCLUDE: "have.org"\n'),
    ("[[file:gone.txt][x]]\n\n", ("ORG017",), "[[file:have.txt][x]]\n\n"),
    ("#+ARCHIVE: gone.org::\n", ("ORG018",), "#+ARCHIVE: have.org::\n"),
    ("* [#99] p\n", ("ORG010",), "* [#A] p\n"),
    ("* e\n" + _drawer(EFFORT="soon"), ("ORG011",), "* e\n" + _drawer(EFFORT="1:00")),
    ("* d\n:PROPERTIES:\n:A: 1\n:a: 2\n:END:\n", ("ORG012",), "* d\n:PROPERTIES:\n:A: 1\n:A+: 2\n:END:\n"),
    ("* t\n" + _drawer(EFORT="1:00"), ("ORG013",), "* t\n" + _drawer(EFFORT="1:00")),
    (_LOG.format('State "SHUT" [2020-01-01 Wed]'), ("ORG014",), _LOG.format('State "SHUT" from "OPEN" [2020-01-01 Wed]')),
    (_LOG.format("Refiled on [2020-01-01 Wed] from [[file:gone.org::*x][x]]"), ("ORG017", "ORG019"), _LOG.format("Refiled on [2020-01-01 Wed] from [[file:have.org][x]]")),
    ("* a\n" + _drawer(DIR="d") + "[[attachment:gone.png]]\n", ("ORG016",), "* a\n" + _drawer(DIR="d") + "[[attachment:have.png]]\n"),
    ("* c [0/1]\n- [ ] a\n** OPEN x\n", ("ORG027",), "* c [0/1]\n" + _drawer(COOKIE_DATA="checkbox") + "- [ ] a\n** OPEN x\n"),
    ("* c [1/2]\n- [X] a\n  - [ ] b\n", ("ORG028",), "* c [1/1]\n- [X] a\n  - [ ] b\n"),
    ("* c [50%]\n** SHUT a\n** SHUT b\n", ("ORG028",), "* c [50%]\n** SHUT a\n** OPEN b\n"),
    ("* o\n" + _drawer(ORDERED="t") + "** OPEN a\n** OPEN b\n", ("ORG029",), "* o\n" + _drawer(ORDERED="t") + "** SHUT a\n** OPEN b\n"),
    ("* v\n" + _drawer(C_ALL="red blue", C="green"), ("ORG030",), "* v\n" + _drawer(C_ALL="red blue", C="red")),
    ("* s :sdd:\n" + _drawer(ID="short", SDD_KIND="system", SDD_CONCERN="c"), ("ORG031",), _node("s", "system", 31, SDD_CONCERN="c")),
    (_node("s", "widget", 32, SDD_CONCERN="c"), ("ORG032",), _node("s", "system", 32, SDD_CONCERN="c")),
    (_node("s", "view", 33, SDD_VIEWPOINT="p", SDD_PARENT="[[id:none]]"), ("ORG033",), _node("s", "view", 33, SDD_VIEWPOINT="p", SDD_PARENT=f"[[id:{_uuid(32)}][up]]")),
    (_node("s", "system", 34, SDD_CONCERN="c") + _node("u", "system", 34, SDD_CONCERN="c"), ("ORG002", "ORG034"), _node("s", "system", 34, SDD_CONCERN="c")),
    (_node("s", "system", 35, SDD_CONCERN="c") + "** Requirement: r\n", ("ORG035",), _node("s", "system", 35, SDD_CONCERN="c") + "** Requirement: r\n*** Scenario: x\n"),
    (_node("OPEN s", "system", 36, SDD_CONCERN="c"), ("ORG036",), _node("s", "system", 36, SDD_CONCERN="c")),
    (_node("s", "decision", 37, SDD_PARENT=f"id:{_uuid(32)}"), ("ORG037",), _node("s", "decision", 37, SDD_PARENT=f"id:{_uuid(32)}", SDD_RATIONALE="r")),
    ("* k :crypt:\n-----BEGIN PGP MESSAGE-----\nx\n-----END PGP MESSAGE-----\n", ("ORG038",), "* k :crypt:\nplain\n"),
    ("* k\n" + _drawer(CRYPTKEY="me"), ("ORG039",), "* k :crypt:\n" + _drawer(CRYPTKEY="me")),
]
FILES = ("have.org", "have.txt", "d/have.png")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier, with all passages that break no rule but one that does, chosen by its key."""
    k = F.col("s_suppkey")
    parts = [F.when(k % len(CASES) == i, bad).otherwise(good) for i, (bad, _, good) in enumerate(CASES)]
    return org.parse(dealt(_table(spark, d, "supplier")).select(k.cast("string").alias("source_file"), F.concat(*parts).alias("text")))


_BROKEN = ",".join(f"({i},'{code}')" for i, (_, codes, _) in enumerate(CASES) for code in codes)


@_register(f"SELECT s_suppkey AS supplier, code FROM supplier JOIN (VALUES {_BROKEN}) t(i, code) ON s_suppkey%{len(CASES)}=i")
def lint_rules(spark, d):
    """All validation rules over documents of which each breaks one."""
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    return lint.findings(_cases(spark, d), files=files).select(F.col("source_file").cast("long").alias("supplier"), "code")


@_register(f"SELECT s_suppkey AS supplier, count(*) AS n FROM supplier JOIN (VALUES {_BROKEN}) t(i, code) ON s_suppkey%{len(CASES)}=i WHERE code BETWEEN 'ORG031' AND 'ORG037' GROUP BY 1")
def sdd_issues(spark, d):
    found = lint.findings(_cases(spark, d), [*lint_sdd.CODES])
    return lint_sdd.issue_count(found).select(F.col("source_file").cast("long").alias("supplier"), "n")


@_register(f"SELECT s_suppkey AS supplier, code, s_suppkey||':'||code AS out FROM supplier JOIN (VALUES {_BROKEN}) t(i, code) ON s_suppkey%{len(CASES)}=i WHERE code='ORG022'")
def lint_rendered(spark, d):
    rows = lint.rendered(lint.findings(_cases(spark, d), ["ORG022"]), "json")
    return rows.select(F.get_json_object("out", "$.source_file").cast("long").alias("supplier"), "code", F.concat_ws(":", F.get_json_object("out", "$.source_file"), F.get_json_object("out", "$.code")).alias("out"))


_POSITION = {code: i for i, (_, codes, _) in enumerate(CASES) for code in codes}


@_register(f"SELECT s_suppkey AS supplier, t.id, t.target_id, s_suppkey%{len(CASES)}<>{_POSITION['ORG033']} OR t.id<>'{_uuid(33)}' AS resolved FROM supplier, LATERAL (SELECT '{_uuid(33)}' AS id, CASE WHEN s_suppkey%{len(CASES)}={_POSITION['ORG033']} THEN 'none' ELSE '{_uuid(32)}' END AS target_id UNION ALL SELECT '{_uuid(37)}', '{_uuid(32)}') t")
def sdd_graph(spark, d):
    return lint_sdd.graph(_cases(spark, d)).select(F.col("source_file").cast("long").alias("supplier"), "id", "target_id", "resolved")


@_register(f"SELECT s_suppkey AS supplier, kind, n FROM supplier, LATERAL (SELECT 'orderedProperty' AS kind, 1 AS n UNION ALL SELECT 'openDescendantTodo', CASE WHEN s_suppkey%{len(CASES)}={_POSITION['ORG029']} THEN 2 ELSE 1 END) t")
def dependency_counts(spark, d):
    """What waits for what, of the headline o of each document."""
    e = _cases(spark, d)
    heads = e.where("kind = 'headline'").where(F.try_element_at("properties", F.lit("title")) == "o").select("source_file", "id")
    return lint_progress.dependency_counts(e).join(heads, ["source_file", "id"], "left_semi").select(F.col("source_file").cast("long").alias("supplier"), "kind", "n")


@_register(f"SELECT s_suppkey AS supplier, count(*)::BIGINT AS headlines, sum(boxes)::BIGINT AS boxes, sum(checked)::BIGINT AS checked FROM supplier, (VALUES (1,0),(2,1)) t(boxes, checked) GROUP BY 1")
def checkbox_counts(spark, d):
    """Boxes under headlines, nested lists included: one list under a task, one with a box below another."""
    e = _cases(spark, d)
    heads = e.where("kind = 'headline'").select("source_file", "id")
    rows = lint_progress.box_counts(e).join(heads, ["source_file", "id"], "left_semi")
    return rows.groupBy(F.col("source_file").cast("long").alias("supplier")).agg(F.count("*").alias("headlines"), F.sum("boxes").alias("boxes"), F.sum("checked").alias("checked"))


# Column summaries as text, over the prices of orders by customer, nation and region.


def _column(name: str, op: str, how: str, shown: str, made: str = "") -> None:
    """``how``: the aggregate of a number n; ``shown``: its text; the next level reads its text back by ``made``."""
    made = made or "s::DOUBLE"
    level = lambda n, below: f""", l{n} AS (SELECT x.section_id, {shown.format(a=how)} AS s FROM sections x JOIN (SELECT parent_id, {made} AS n FROM {below}) y ON y.parent_id=x.section_id WHERE x.level={n} GROUP BY 1),
     p{n} AS (SELECT parent_id, s FROM l{n} JOIN sections USING (section_id))"""  # noqa: E731
    first = """, l4 AS (SELECT section_id, parent_id, {v} AS s FROM sections WHERE level=4)""".format(v="effort//60||'min'" if op.startswith(":") else "price::DECIMAL(18,2)::VARCHAR")
    minutes = "(split_part(s,':',1)::BIGINT*60+split_part(s,':',2)::BIGINT)*60"
    sql = OUTLINE + first + level(3, "l4").replace(made, "replace(s,'min','')::BIGINT*60" if op.startswith(":") else made) + level(2, "p3").replace(made, minutes if op.startswith(":") else made) + level(1, "p2").replace(made, minutes if op.startswith(":") else made)
    sql += "SELECT section_id, s AS summary FROM l3 UNION ALL SELECT section_id, s FROM l2 UNION ALL SELECT section_id, s FROM l1"

    def query(spark, d):
        s = outline.sections(spark, d)
        more = F.when(F.col("level") == 4, F.map_concat("properties", F.create_map(F.lit("SPAN"), F.concat(F.floor(F.col("effort_seconds") / 60).cast("string"), F.lit("min"))))).otherwise(F.col("properties"))
        out = columns.summaries(s.withColumn("properties", more), "SPAN" if op.startswith(":") else "PRICE", op)
        return out.where("status = 'computed'").select("section_id", "summary")

    query.__name__ = f"column_{name}"
    _register(sql)(query)


_DECIMALS = "printf('%.2f', {a})"
_CLOCK = "(floor((round({a})+30)/60)::BIGINT//60)||':'||lpad((floor((round({a})+30)/60)::BIGINT%60)::VARCHAR,2,'0')"
for _name, _op, _how, _shown in (("currency", "$", "sum(n)", _DECIMALS), ("duration", ":", "sum(n)", _CLOCK), ("duration_min", ":min", "min(n)", _CLOCK), ("duration_max", ":max", "max(n)", _CLOCK), ("duration_mean", ":mean", "avg(n)", _CLOCK)):
    _column(_name, _op, _how, _shown)


@_register(OUTLINE + "SELECT count(*) AS n, count(*) FILTER (level=3) AS customers FROM sections")
def column_ages(spark, d):
    """Operators that are known and not supported, over every headline that has inputs or none."""
    s = outline.sections(spark, d)
    out = columns.summaries(s, "BALANCE", "@max")
    ok = out.where("summary is null and status in ('unsupported', 'noInputs')")
    return ok.agg(F.count("*").alias("n"), F.count_if(F.col("level") == 3).alias("customers"))


@_register(OUTLINE + "SELECT level, CASE WHEN level=3 THEN 'local' ELSE 'missing' END AS origin, count(*) AS n FROM sections GROUP BY ALL")
def column_cells(spark, d):
    s = outline.sections(spark, d)
    value, origin = columns.cell(s, "BALANCE")
    return s.groupBy("level", origin.alias("origin")).agg(F.count("*").alias("n"))


# Agenda views over the orders, a document for each customer.


def _agenda(spark: SparkSession, d: str) -> DataFrame:
    s = outline.sections(spark, d).where("level = 4")
    return s.withColumns({"source_file": F.col("parent_id").cast("string"), "deadline": F.date_add("scheduled", 30), "category": F.lit(None).cast("string")})


_VIEW = {"start": dt.date(1995, 6, 1), "end": dt.date(1995, 6, 30)}
_ENTRIES = OUTLINE + """, open AS (SELECT * FROM sections WHERE level=4 AND todo<>'DONE'),
 entries AS (SELECT section_id, parent_id, priority, title, 'scheduled' AS kind, greatest(scheduled, DATE '1995-06-01') AS day, CASE WHEN scheduled<DATE '1995-06-01' THEN 'pastDue' ELSE 'onDate' END AS state, 1 AS k FROM open WHERE scheduled<=DATE '1995-06-30'
 UNION ALL SELECT section_id, parent_id, priority, title, 'deadline', greatest(scheduled+30, DATE '1995-06-01'), CASE WHEN scheduled+30<DATE '1995-06-01' THEN 'overdue' ELSE 'due' END, 0 FROM open WHERE scheduled+30<=DATE '1995-06-30')
"""


@_register(_ENTRIES + "SELECT section_id, kind, state, row_number() OVER (PARTITION BY parent_id ORDER BY priority ASC, day DESC, section_id, day, k) AS position, row_number() OVER (PARTITION BY parent_id ORDER BY priority ASC, day DESC, section_id, day, k)>5 AS skipped FROM entries")
def agenda_view(spark, d):
    """Each customer's agenda by priority, then from the last day back, five entries at most let through."""
    view = agenda_views.View(**_VIEW, strategy=(("priority", "up"), ("displayDate", "down"), ("title", "keep")), limit=5)
    return agenda_views.plan(_agenda(spark, d), view).select("section_id", "kind", "state", "position", "skipped")


@_register(_ENTRIES + "SELECT i AS block_index, name AS block_name, section_id, state FROM entries JOIN (VALUES (0,'plans','scheduled'),(1,'ends','deadline')) t(i, name, k2) ON kind=k2")
def agenda_blocks(spark, d):
    views = [agenda_views.View(**_VIEW, deadlines=False, name="plans"), agenda_views.View(**_VIEW, scheduled=False, name="ends")]
    return agenda_views.block_plan(_agenda(spark, d), views).select("block_index", "block_name", "section_id", "state")


@_register(_ENTRIES + """, rows AS (SELECT DISTINCT 'days' AS command, 'agenda' AS kind, section_id, parent_id FROM entries UNION ALL SELECT 'tasks', 'todo', section_id, parent_id FROM open
 UNION ALL SELECT 'dear', 'match', section_id, parent_id FROM sections WHERE level=4 AND priority='A' UNION ALL SELECT 'found', 'search', section_id, parent_id FROM sections WHERE level=4 AND contains(title, '#99'))
 SELECT command, kind, section_id, row_number() OVER (PARTITION BY command, parent_id ORDER BY section_id) AS place, row_number() OVER (PARTITION BY command, parent_id ORDER BY section_id)>3 AS skipped FROM rows""")
def agenda_commands(spark, d):
    wanted = [("days", "agenda", agenda_views.View(**_VIEW)), ("tasks", "todo", None), ("dear", "match", F.col("priority") == "A"), ("found", "search", "order#99")]
    return agenda_views.commands(_agenda(spark, d), wanted, limit=3).select("command", "kind", "section_id", "place", "skipped")


@_register(_ENTRIES + "SELECT decision, severity, count(*) AS n FROM (SELECT CASE WHEN state='onDate' THEN 'scheduled' ELSE state END AS decision, CASE WHEN state='overdue' THEN 'error' WHEN state IN ('due','pastDue') THEN 'warning' ELSE 'info' END AS severity FROM entries) GROUP BY ALL")
def planning_snapshot(spark, d):
    return agenda_views.snapshot(_agenda(spark, d), agenda_views.View(**_VIEW)).groupBy("decision", "severity").agg(F.count("*").alias("n"))


@_register(OUTLINE + "SELECT section_id, 1000*(67-ascii(priority))+CASE WHEN todo<>'DONE' THEN 250 ELSE 0 END AS urgency FROM sections WHERE level=4")
def section_urgency(spark, d):
    s = _agenda(spark, d)
    return s.select("section_id", agenda_views.section_urgency(s).alias("urgency"))


@_register("SELECT 'closed' AS state, count(*) AS n FROM customer UNION ALL SELECT 'background', count(*) FROM customer")
def memory_query(spark, d):
    cards = records.memory_cards(_parsed(spark, d, "headline"))
    return agenda_views.memory(cards, states=("closed", "background", "current"), excluded=("noexport",)).groupBy("state").agg(F.count("*").alias("n"))


@_register("SELECT c_custkey::VARCHAR AS source_file, c_name AS title FROM customer WHERE c_custkey%50=7 AND contains(lower(c_name), 'customer') ORDER BY 1 LIMIT 12")
def memory_found(spark, d):
    cards = records.memory_cards(_parsed(spark, d, "headline"))
    return agenda_views.memory_search(cards, terms=["CUSTOMER"], properties={"ID": "k7"}, root_only=True).select("source_file", "title")


# Plans and small notations.


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier with timers, a feed, radio targets, a choice, a result to replace and attachments."""
    k = F.col("s_suppkey")
    text_ = F.concat(
        F.lit("<<<deep sea>>> <<<sea>>>\n\nThe deep sea and the sea, not seaside.\n* Clocked 0:"), F.format_string("%02d", k % 60), F.lit(":10 :FLAGGED:\n:PROPERTIES:\n:ID: 20240101T120000-"), k, F.lit("\n:END:\n:FEEDSTATUS:\n((\"a\" 1) (\"b\" 2)"), F.when(k % 2 == 0, ")").otherwise(""),
        F.lit("\n:END:\n[[*Clocked 0:"), F.format_string("%02d", k % 60), F.lit(":10]] [[*Lost]]\n#+NAME: choices\n| label | value |\n|---+---|\n| yes | "), k, F.lit(" |\n| no | 0 |\n\n#+NAME: run\n#+begin_src sql\nselect "), k, F.lit("\n#+end_src\n\n#+RESULTS: run\n: old\n"),
    )
    return _table(spark, d, "supplier").select(k.cast("string").alias("source_file"), text_.alias("text"))


@_register("SELECT s_suppkey AS supplier, t.kind, CASE t.kind WHEN 'timer' THEN (s_suppkey%60)*60+10 WHEN 'feed' THEN CASE WHEN s_suppkey%2=0 THEN 2 ELSE -1 END ELSE 0 END AS n FROM supplier, (VALUES ('timer'),('feed'),('flagged')) t(kind)")
def runtime_metadata(spark, d):
    return plans.runtime_metadata(org.parse(_notes(spark, d))).select(F.col("source_file").cast("long").alias("supplier"), "kind", "n")


@_register("SELECT s_suppkey AS supplier, t.* FROM supplier, (VALUES (0::INT,'deep sea'),(1,'sea')) t(\"at\", target)")
def radio_links(spark, d):
    found = plans.radio_links(org.parse(_notes(spark, d)))
    return found.select(F.col("source_file").cast("long").alias("supplier"), "at", "target")


@_register("SELECT s_suppkey AS supplier, path, CASE WHEN path='*Lost' THEN path ELSE substr(path, 2) END AS shown FROM (SELECT s_suppkey, unnest(['*Clocked 0:'||lpad((s_suppkey%60)::VARCHAR,2,'0')||':10', '*Lost']) AS path FROM supplier)")
def link_descriptions(spark, d):
    e = org.parse(_notes(spark, d))
    links = records.links(e, abbreviations=False)
    return plans.link_descriptions(links, records.sections(e)).select(F.col("source_file").cast("long").alias("supplier"), "path", "shown")


@_register("SELECT s_suppkey AS supplier, t.place, t.label, CASE WHEN t.label='yes' THEN s_suppkey::VARCHAR ELSE '0' END AS value FROM supplier, (VALUES (0,'yes'),(1,'no')) t(place, label)")
def choice_tables(spark, d):
    return plans.choices(org.parse(_notes(spark, d))).select(F.col("source_file").cast("long").alias("supplier"), "place", "label", "value")


@_register("SELECT s_suppkey AS supplier, t.name, t.status, CASE WHEN t.status='ready' THEN 'select '||s_suppkey END AS value FROM supplier, (VALUES ('run','ready'),('none','notFound'),('','emptyName')) t(name, status)")
def evaluation_plan(spark, d):
    e = org.parse(_notes(spark, d))
    names = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_file"), F.explode(F.array(F.lit("run"), F.lit("none"), F.lit(""))).alias("name"))
    return plans.evaluation_plan(e, names).select(F.col("source_file").cast("long").alias("supplier"), "name", "status", "value")


@_register("SELECT s_suppkey AS supplier, '#+RESULTS: run' || chr(10) || ': new ' || s_suppkey || chr(10) AS text, length('#+RESULTS: run'||chr(10)||': old'||chr(10))::BIGINT AS replaced FROM supplier")
def result_patch(spark, d):
    docs = _notes(spark, d)
    results = docs.select("source_file", F.lit("run").alias("name"), F.concat(F.lit("new "), "source_file").alias("result"))
    return plans.result_patch(org.parse(docs), results).select(F.col("source_file").cast("long").alias("supplier"), "text", (F.col("stop") - F.col("at")).alias("replaced"))


@_register("SELECT s_suppkey AS supplier, 'data/202401/01T120000-'||s_suppkey AS folder FROM supplier")
def attachment_folders(spark, d):
    return plans.attachment_table(org.parse(_notes(spark, d))).select(F.col("source_file").cast("long").alias("supplier"), "folder")


@_register("SELECT s_suppkey AS supplier, n FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey::VARCHAR) AS i FROM supplier), (VALUES (1)) t(n) WHERE i<=12")
def search_packet(spark, d):
    packet = plans.search_packet(org.parse(_notes(spark, d)).where("kind = 'src-block'"), "SELECT")
    return packet.select(F.col("source_file").cast("long").alias("supplier"), F.get_json_object("json", "$.n").cast("int").alias("n"))


@_register("SELECT s_suppkey AS supplier, 'headline' AS kind, 1 AS blocks FROM supplier")
def elements_json(spark, d):
    rows = plans.elements_json(org.parse(_notes(spark, d)).where("kind in ('headline', 'src-block')"))
    return rows.select(F.col("source_file").cast("long").alias("supplier"), F.get_json_object("json", "$.elements[0].kind").alias("kind"), F.size(F.from_json(F.get_json_object("json", "$.sourceBlocks"), "array<long>")).alias("blocks"))


@_register(OUTLINE + "SELECT s.section_id AS request, CASE WHEN s.section_id%3=0 THEN 'notFound' ELSE 'resolved' END AS status, CASE WHEN s.section_id%3<>0 THEN s.section_id END AS section_id FROM sections s WHERE s.level=3")
def refile_plan(spark, d):
    s = outline.sections(spark, d).where("level <= 3")
    requests = s.where("level = 3").select(F.col("section_id").alias("request"), F.when(F.col("section_id") % 3 == 0, F.array(F.lit("nowhere"))).otherwise(F.col("outline_path")).alias("path"))
    return plans.refile_plan(s, requests).select("request", "status", "section_id")


@_register("SELECT c_custkey AS request, CASE WHEN c_custkey%4=0 THEN 'emptyTitle' ELSE 'ready' END AS status, CASE WHEN c_custkey%4<>0 THEN '** TODO '||c_name||' :'||lower(c_mktsegment)||':'||chr(10)||'balance '||c_nationkey||chr(10) END AS entry FROM customer")
def capture_plan(spark, d):
    c = _table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("request"), F.lit(2).alias("level"), F.lit("TODO").alias("todo"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.array(F.lower("c_mktsegment")).alias("tags"), F.concat(F.lit("balance "), "c_nationkey").alias("body"))
    return plans.capture_plan(rows).select("request", "status", "entry")


@_register("SELECT s_suppkey AS supplier, key, value FROM supplier, LATERAL (SELECT 'TODO' AS key, 'OPEN | SHUT' AS value) t")
def keyword_scan(spark, d):
    docs = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_file"), F.lit("#+todo: OPEN | SHUT\n# + no\n#+begin_src\n#+end_src\n").alias("text"))
    return plans.prescan(docs).select(F.col("source_file").cast("long").alias("supplier"), "key", "value")


@_register("SELECT o_orderkey, make_date(y::INT, month(o_orderdate)::INT, 15) AS day FROM orders, (VALUES (1995),(1996)) t(y) WHERE make_date(y::INT, month(o_orderdate)::INT, 15) BETWEEN DATE '1995-02-01' AND DATE '1996-06-30'")
def diary_dates(spark, d):
    sexp = F.concat(F.lit("%%(diary-date "), F.month("o_orderdate"), F.lit(" 15)"))
    days = org_text.diary_dates(sexp, F.lit(dt.date(1995, 2, 1)), F.lit(dt.date(1996, 6, 30)))
    return _table(spark, d, "orders").select("o_orderkey", F.explode(days).alias("day"))


@_register("SELECT p_partkey, p_size||chr(8212)||p_brand||chr(8211)||chr(8230) AS special, 'a%20'||p_size||'%2F' AS encoded, 'a '||p_size||'/' AS decoded, chr(945) AS alpha, CASE WHEN p_size%2=0 THEN 'right' ELSE 'left' END AS side, p_size::VARCHAR AS title FROM part")
def small_notations(spark, d):
    part = _table(spark, d, "part")
    raw = F.concat(F.lit("a "), "p_size", F.lit("/"))
    side = F.get(org_text.alignments(F.array(F.lit(""), F.when(F.col("p_size") % 2 == 0, "<r5>").otherwise("<l>"))), 1)
    plot = org_text.plot_options(F.concat(F.lit('ind:1 title:"'), "p_size", F.lit('" ind:2')))
    return part.select(
        "p_partkey", org_text.special_strings(F.concat(F.col("p_size").cast("string"), F.lit("---"), "p_brand", F.lit("--..."))).alias("special"), org_text.percent_encoded(raw).alias("encoded"), org_text.percent_decoded(org_text.percent_encoded(raw)).alias("decoded"),
        org_text.entity(F.lit("alpha")).alias("alpha"), side.alias("side"), F.try_element_at(plot, F.lit("title")).alias("title"),
    )


@_register("SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS first, (o_orderdate::DATE+1)::TIMESTAMP AS last FROM orders")
def clock_bounds(spark, d):
    stamp = F.concat(F.lit("<"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" Sun>"))
    a, b = org_text.bounds(stamp, stamp)
    return _table(spark, d, "orders").select("o_orderkey", a.cast("timestamp").alias("first"), b.cast("timestamp").alias("last"))


@_register("SELECT c_custkey AS customer, 'ORG044' AS code FROM customer")
def contract_findings(spark, d):
    """Each customer's document has one source block below its tasks where the contract wants two."""
    top = contracts.Step("top", eq.Query(kind="headline", depth=1), expect=("==", 1))
    blocks = contracts.Step("blocks", eq.Query(kind="src-block"), within=("descendant-of", "top"), expect=(">", 1))
    found = contracts.contract_findings(contracts.evaluate(_parsed(spark, d, "org-data", "headline", "src-block"), contracts.Contract("c", [top, blocks])))
    return found.select(F.col("source_file").cast("long").alias("customer"), "code")


@_register("SELECT c_custkey AS customer, t.event, t.n FROM customer, (VALUES ('enter',3),('leave',3)) t(event, n)")
def tree_events(spark, d):
    """Headlines entered and left; nothing below the second one is gone into."""
    heads = _parsed(spark, d).where("kind in ('org-data', 'headline')")
    walk = traverse.events(heads)
    return walk.where("kind = 'headline'").groupBy(F.col("source_file").cast("long").alias("customer"), "event").agg(F.count("*").cast("int").alias("n"))


@_register("SELECT c_custkey AS customer, 3 AS headlines FROM customer")
def tree_fold(spark, d):
    e = _parsed(spark, d)
    total = traverse.folded(e, (F.col("kind") == "headline").cast("int"))
    return total.join(e.where("kind = 'org-data'"), ["source_file", "id"], "left_semi").select(F.col("source_file").cast("long").alias("customer"), F.col("value").cast("int").alias("headlines"))


@_register("SELECT s_suppkey AS supplier, CASE WHEN s_suppkey%2=0 THEN 'new' ELSE 'old' END AS title FROM supplier")
def reparsed_documents(spark, d):
    docs = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_file"), F.lit("* old\nbody é\n").alias("text"))
    edits = docs.where(F.col("source_file").cast("long") % 2 == 0).select("source_file", F.lit(2).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"), F.lit("new").alias("text"))
    rows = traverse.reparsed(org.parse(docs), docs, edits).where("kind = 'headline'")
    return rows.select(F.col("source_file").cast("long").alias("supplier"), F.try_element_at("properties", F.lit("title")).alias("title"))


@_register("SELECT s_suppkey AS supplier, 'customer-' || s_suppkey AS slug, DATE '2024-05-06' AS day, 75 AS minutes FROM supplier")
def sql_functions(spark, d):
    traverse.register(spark)
    _table(spark, d, "supplier").createOrReplaceTempView("sheaf_suppliers")
    return spark.sql("SELECT s_suppkey AS supplier, org_slug('Customer# ' || s_suppkey || '!') AS slug, org_date('<2024-05-06 Mon 10:00>') AS day, CAST(org_minutes('1:15') AS INT) AS minutes FROM sheaf_suppliers WHERE org_has_tag('Work:Home', 'home')")


@_register("SELECT s_suppkey AS supplier, 1 AS tasks, 2 AS headlines, 'x^2' AS raised FROM supplier")
def inline_tasks(spark, d):
    """A task within the text, which is no headline, and a raised two."""
    docs = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_file"), F.lit("* a\nx^2 y\n*************** TODO within\nbody\n*************** END\n** b\n").alias("text"))
    e = org.parse(docs)
    raised = F.max(F.when(F.col("kind") == "superscript", F.concat(F.lit("x"), "source_raw")))
    return e.groupBy(F.col("source_file").cast("long").alias("supplier")).agg(F.count_if(F.col("kind") == "inlinetask").cast("int").alias("tasks"), F.count_if(F.col("kind") == "headline").cast("int").alias("headlines"), raised.alias("raised"))
