"""The registered queries of the document engine, each with the SQL that gives the same rows.

Every query is one operator applied to the star schema as an outline, to the lines
of ``documents`` as elements, or to ``events`` as a sequence of clocks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import dates, text
from sheaf.operators import agenda, contracts, export_graph, lint, records, tree, workspace
from sheaf.operators.stored import dealt
from sheaf.plans import elements as eq
from sheaf.plans import outline
from sheaf.plans.match import compile_match
from sheaf.sources import markdown, org, packets

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The outline in SQL: ancestors as columns a1 to a3, tags as a text :a:b:.
OUTLINE = """WITH sections AS (
 SELECT r_regionkey+1 AS section_id, NULL::BIGINT AS parent_id, NULL::BIGINT AS a1, NULL::BIGINT AS a2, NULL::BIGINT AS a3, 1 AS level, r_name AS title, NULL AS todo, NULL AS priority, ':'||lower(r_name)||':' AS tags, NULL::DATE AS scheduled, NULL::BIGINT AS effort, NULL::DOUBLE AS price, NULL AS status FROM region
 UNION ALL SELECT n_nationkey+1000, n_regionkey+1, n_regionkey+1, NULL, NULL, 2, n_name, NULL, NULL, ':'||lower(r_name)||':'||lower(n_name)||':', NULL, NULL, NULL, NULL FROM nation JOIN region ON r_regionkey=n_regionkey
 UNION ALL SELECT c_custkey+1000000, c_nationkey+1000, n_regionkey+1, c_nationkey+1000, NULL, 3, c_name, NULL, NULL, ':'||lower(r_name)||':'||lower(n_name)||':'||c_mktsegment||':', NULL, NULL, NULL, NULL FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey
 UNION ALL SELECT o_orderkey+1000000000, o_custkey+1000000, n_regionkey+1, c_nationkey+1000, o_custkey+1000000, 4, 'Order#'||o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'NEXT' ELSE 'TODO' END,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'B' ELSE 'C' END, ':'||lower(r_name)||':'||lower(n_name)||':'||c_mktsegment||':', o_orderdate::DATE, floor(o_totalprice)::BIGINT*60, o_totalprice, o_orderstatus
  FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey),
 clocks AS (SELECT l_orderkey+1000000000 AS section_id, l_shipdate AS start, CASE WHEN l_linestatus='F' THEN (l_quantity*60)::BIGINT END AS seconds FROM lineitem),
 closure AS (SELECT section_id AS above, * FROM sections UNION ALL SELECT a1, * FROM sections WHERE a1 IS NOT NULL UNION ALL SELECT a2, * FROM sections WHERE a2 IS NOT NULL UNION ALL SELECT a3, * FROM sections WHERE a3 IS NOT NULL)
"""
#: The elements in SQL.
ELEMENTS = """WITH elements AS (
 SELECT 'doc-'||doc_id AS source_file, doc_id, 1::BIGINT AS id, 'document' AS category, 'org-data' AS kind, NULL AS context, lang, source, '' AS source_raw, 0::BIGINT AS line FROM documents
 UNION ALL SELECT 'doc-'||doc_id, doc_id, (pos+1)::BIGINT, 'element', CASE WHEN contains(raw,' | ') THEN 'table' ELSE 'paragraph' END, 'section', lang, source, raw, pos::BIGINT
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)),1) AS pos FROM documents) WHERE trim(raw,' ')<>'')
"""


def _register(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Rollups over the outline.


@_register(OUTLINE + "SELECT section_id, count(*) AS entries, count(seconds) AS closed, count(*)-count(seconds) AS running, coalesce(sum(seconds),0)::BIGINT AS total_seconds FROM clocks GROUP BY section_id")
def clock_summary(spark, d):
    return tree.clock_summary(outline.clocks(spark, d))


@_register(OUTLINE + """, own AS (SELECT section_id AS s, sum(seconds) AS t FROM clocks GROUP BY 1),
 total AS (SELECT above, coalesce(sum(t),0)::BIGINT AS clock_seconds, coalesce(sum(effort),0)::BIGINT AS effort FROM closure LEFT JOIN own ON s=section_id GROUP BY above)
 SELECT section_id, level, title, clock_seconds, total.effort AS effort, clock_seconds-total.effort AS delta_seconds,
 CASE WHEN total.effort=0 THEN 'noEffort' WHEN clock_seconds<total.effort THEN 'underEffort' WHEN clock_seconds=total.effort THEN 'onEffort' ELSE 'overEffort' END AS status FROM sections JOIN total ON above=section_id""")
def clock_rollup(spark, d):
    return tree.clock_rollup(outline.sections(spark, d), outline.clocks(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock and effort rolled up over the whole outline, in outline order."""
    return clock_rollup(spark, sf_dir).orderBy("section_id")


@_register(OUTLINE + """, e AS (SELECT above, coalesce(sum(effort),0)::BIGINT AS effort FROM closure GROUP BY above), b AS (SELECT above, count(todo) AS total, count(*) FILTER (todo='DONE') AS done FROM closure WHERE above<>section_id GROUP BY above)
 SELECT section_id, level, coalesce(total,0) AS total, coalesce(done,0) AS done, coalesce(total,0)-coalesce(done,0) AS open, e.effort AS effort FROM sections JOIN e ON e.above=section_id LEFT JOIN b ON b.above=section_id""")
def progress(spark, d):
    return tree.progress(outline.sections(spark, d))


@_register(OUTLINE + """, local AS (SELECT section_id AS s, sum(CASE WHEN start>=TIMESTAMP '1995-01-01' AND start+to_seconds(seconds)<=TIMESTAMP '1996-01-01' THEN seconds
  ELSE greatest(0, floor((epoch(least(start+to_seconds(seconds),TIMESTAMP '1996-01-01'))-epoch(greatest(start,TIMESTAMP '1995-01-01')))/60)*60) END)::BIGINT AS t FROM clocks WHERE seconds IS NOT NULL GROUP BY 1),
 total AS (SELECT above, coalesce(sum(CASE WHEN tags LIKE '%:BUILDING:%' THEN t END),0)::BIGINT AS clock_seconds, coalesce(sum(effort),0)::BIGINT AS effort FROM closure LEFT JOIN local ON s=section_id GROUP BY above)
 SELECT section_id, level, title, clock_seconds, total.effort AS effort, ((clock_seconds+30)//60//60)||':'||lpad(((clock_seconds+30)//60%60)::VARCHAR,2,'0') AS clock FROM sections JOIN total ON above=section_id WHERE level<=3 AND (clock_seconds>0 OR total.effort>0)""")
def clock_table(spark, d):
    start, end = dates.block_window("1995")
    s = outline.sections(spark, d)
    return tree.clock_table(s, outline.clocks(spark, d), start, end, max_level=3, matched=F.array_contains("effective_tags", "BUILDING"))


def _summary(op: str, agg: str) -> None:
    digits = 6 if op == "mean" else 2
    sql = OUTLINE + f""", l4 AS (SELECT section_id, parent_id, price AS summary FROM sections WHERE level=4), l3 AS (SELECT s.section_id, s.parent_id, {agg}(l4.summary) AS summary FROM sections s LEFT JOIN l4 ON l4.parent_id=s.section_id WHERE s.level=3 GROUP BY ALL),
     l2 AS (SELECT s.section_id, s.parent_id, {agg}(l3.summary) AS summary FROM sections s LEFT JOIN l3 ON l3.parent_id=s.section_id WHERE s.level=2 GROUP BY ALL), l1 AS (SELECT s.section_id, s.parent_id, {agg}(l2.summary) AS summary FROM sections s LEFT JOIN l2 ON l2.parent_id=s.section_id WHERE s.level=1 GROUP BY ALL)
     SELECT section_id, round(summary,{digits}) AS summary FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4)"""

    def query(spark, d):
        s = outline.sections(spark, d)
        price = F.try_element_at("properties", F.lit("PRICE")).try_cast("double")
        return tree.column_summary(s, price, op, 4).select("section_id", F.round("summary", digits).alias("summary"))

    query.__name__ = "column_summary_" + {"+": "sum"}.get(op, op)
    _register(sql)(query)


for _op, _agg in (("+", "sum"), ("min", "min"), ("max", "max"), ("mean", "avg")):
    _summary(_op, _agg)


@_register(OUTLINE + """SELECT parent_id AS section_id, CASE WHEN count(*) FILTER (todo='DONE')=count(*) THEN '[X]' WHEN count(*) FILTER (todo='DONE')>0 THEN '[-]' ELSE '[ ]' END AS state, '['||count(*) FILTER (todo='DONE')||'/'||count(*)||']' AS counts, '['||((count(*) FILTER (todo='DONE')*100+count(*)//2)//count(*))||'%]' AS percent FROM sections WHERE level=4 GROUP BY parent_id""")
def checkbox_summary(spark, d):
    return tree.checkbox_summary(outline.sections(spark, d).where("level = 4"), F.col("todo") == "DONE")


@_register("SELECT o_custkey, round_even(m-s,0)::BIGINT||'-'||round_even(m+s,0)::BIGINT AS estimate FROM (SELECT o_custkey, sum(o_totalprice) AS m, sqrt(sum(pow(o_totalprice*0.1,2))) AS s FROM orders GROUP BY 1)")
def estimate_summary(spark, d):
    o = _table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") * 0.9).alias("lo"), (F.col("o_totalprice") * 1.1).alias("hi"))
    return tree.estimate_summary(o, "o_custkey", "lo", "hi")


@_register(OUTLINE + """, c AS (SELECT above, section_id, todo FROM closure), projects AS (SELECT section_id FROM sections WHERE (level=3 AND section_id%2=0) OR todo IS NOT NULL)
 SELECT above AS section_id, count(*) FILTER (todo<>'DONE') AS open FROM c WHERE above<>section_id AND above IN (SELECT section_id FROM projects) GROUP BY 1 HAVING count(*) FILTER (todo<>'DONE')>0 AND count(*) FILTER (todo='NEXT')=0""")
def stuck_projects(spark, d):
    """Every other customer is a project with a TODO of its own."""
    s = outline.sections(spark, d)
    return tree.stuck_projects(s.withColumn("todo", F.when((F.col("level") == 3) & (F.col("section_id") % 2 == 0), "todo").otherwise(F.col("todo"))))


@_register(OUTLINE + "SELECT section_id, blocked_by FROM (SELECT section_id, lag(section_id) OVER (PARTITION BY parent_id ORDER BY section_id) AS blocked_by FROM sections WHERE todo<>'DONE') WHERE blocked_by IS NOT NULL")
def ordered_blockers(spark, d):
    s = outline.sections(spark, d).where(F.col("todo").isNotNull())
    return tree.ordered_blockers(s, "parent_id", "section_id", F.col("todo") != "DONE").select("section_id", "blocked_by")


@_register(OUTLINE + "SELECT s.section_id, coalesce(s.status, CASE WHEN s.level=3 THEN s.title ELSE p.title END) AS inherited FROM sections s LEFT JOIN sections p ON p.section_id=s.a3 WHERE s.level>=3")
def inherited_value(spark, d):
    s = outline.sections(spark, d)
    value = F.coalesce(F.try_element_at("properties", F.lit("STATUS")), F.when(F.col("level") == 3, F.col("title")))
    return tree.nearest_inherited(s, value)


# Agenda.

A, B = dt.date(1995, 6, 1), dt.date(1995, 6, 14)


@_register(OUTLINE + """SELECT section_id, greatest(scheduled, DATE '1995-06-01') AS display_date, CASE WHEN scheduled<DATE '1995-06-01' THEN 'pastDue' ELSE 'onDate' END AS state FROM sections WHERE todo<>'DONE' AND scheduled<=DATE '1995-06-14'""")
def agenda_scheduled(spark, d):
    return agenda.scheduled_entries(agenda.visible(outline.sections(spark, d)), A, B).select("section_id", "display_date", "state")


@_register(OUTLINE + """SELECT section_id, x::DATE AS target_date, greatest(x::DATE, DATE '1995-06-01') AS display_date, CASE WHEN x<DATE '1995-06-01' THEN 'pastDue' ELSE 'onDate' END AS state
 FROM (SELECT section_id, unnest(generate_series(scheduled, DATE '1995-06-14', INTERVAL 7 DAY)) AS x FROM sections WHERE todo='NEXT' AND scheduled BETWEEN DATE '1995-05-01' AND DATE '1995-06-14')""")
def agenda_repeater(spark, d):
    s = agenda.visible(outline.sections(spark, d)).where("todo = 'NEXT' and scheduled >= date '1995-05-01'")
    return agenda.scheduled_entries(s, B, A, F.lit(1), F.lit("w")).select("section_id", "target_date", "display_date", "state")


@_register(OUTLINE + """SELECT section_id, x::DATE AS target_date, greatest(x::DATE, DATE '1995-06-01') AS display_date, CASE WHEN x<DATE '1995-06-01' THEN 'pastDue' ELSE 'onDate' END AS state
 FROM (SELECT section_id, unnest(generate_series(scheduled, DATE '1995-06-14', INTERVAL 7 DAY)) AS x FROM sections WHERE todo='NEXT' AND scheduled<=DATE '1995-06-14')""")
def agenda_repeater_all(spark, d):
    s = agenda.visible(outline.sections(spark, d)).where("todo = 'NEXT'")
    return agenda.scheduled_entries(s, B, A, F.lit(1), F.lit("w")).select("section_id", "target_date", "display_date", "state")


@_register("""WITH RECURSIVE r AS (SELECT o_orderkey, o_orderdate::DATE AS x FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' UNION ALL SELECT o_orderkey, (x + INTERVAL 1 MONTH)::DATE FROM r WHERE (x + INTERVAL 1 MONTH)::DATE <= DATE '1995-12-31') SELECT o_orderkey, x AS occurrence FROM r""")
def month_repeater(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s")).where("s between date '1995-01-01' and date '1995-12-31'")
    return o.select("o_orderkey", F.explode(dates.occurrences(F.col("s"), F.lit(1), F.lit("m"), F.lit(dt.date(1995, 12, 31)))).alias("occurrence"))


@_register(OUTLINE + """, dl AS (SELECT section_id, scheduled+30 AS deadline FROM sections WHERE todo<>'DONE') SELECT section_id, CASE WHEN deadline<DATE '1995-06-01' THEN DATE '1995-06-01' WHEN deadline<=DATE '1995-06-14' THEN deadline ELSE greatest(deadline-5, DATE '1995-06-01') END AS display_date, CASE WHEN deadline<DATE '1995-06-01' THEN 'overdue' WHEN deadline<=DATE '1995-06-14' THEN 'due' ELSE 'warning' END AS state FROM dl WHERE deadline-5<=DATE '1995-06-14'""")
def agenda_deadline(spark, d):
    s = agenda.visible(outline.sections(spark, d)).withColumn("deadline", F.date_add("scheduled", 30))
    return agenda.deadline_entries(s, A, B, F.lit(5)).select("section_id", "display_date", "state")


@_register("SELECT o_orderkey, x::DATE AS display_date FROM (SELECT o_orderkey, unnest(generate_series(greatest(o_orderdate::DATE,DATE '1995-06-01'), least(o_orderdate::DATE+6,DATE '1995-06-14'), INTERVAL 1 DAY)) AS x FROM orders WHERE o_orderdate::DATE+6>=DATE '1995-06-01' AND o_orderdate::DATE<=DATE '1995-06-14')")
def date_span(spark, d):
    o = _table(spark, d, "orders").withColumn("first", F.col("o_orderdate").cast("date"))
    return agenda.span_entries(o, F.col("first"), F.date_add("first", 6), A, B).select("o_orderkey", "display_date")


@_register(OUTLINE + """SELECT section_id, row_number() OVER (ORDER BY scheduled, level, title, section_id) AS sorted_position FROM sections WHERE todo<>'DONE' AND scheduled BETWEEN DATE '1995-06-01' AND DATE '1995-06-14'""")
def agenda_sorted(spark, d):
    s = agenda.visible(outline.sections(spark, d)).where(F.col("scheduled").between(F.lit(A), F.lit(B)))
    return agenda.in_order(agenda.scheduled_entries(s, A, B), dates.time_of_day(F.col("title")), F.col("title"), F.col("section_id")).select("section_id", "sorted_position")


@_register(OUTLINE + """SELECT section_id, row_number() OVER (ORDER BY greatest(scheduled, DATE '1995-06-01'), level, title, section_id) AS sorted_position FROM sections WHERE todo<>'DONE' AND scheduled<=DATE '1995-06-14'""")
def agenda_sorted_all(spark, d):
    entries = agenda.scheduled_entries(agenda.visible(outline.sections(spark, d)), A, B)
    return agenda.in_order(entries, dates.time_of_day(F.col("title")), F.col("title"), F.col("section_id")).select("section_id", "sorted_position")


@_register(OUTLINE + """SELECT section_id, (1000*(67-ascii(priority)) + CASE WHEN DATE '1998-01-01'-scheduled>0 THEN 1500+5*(DATE '1998-01-01'-scheduled) WHEN DATE '1998-01-01'=scheduled THEN 500 ELSE DATE '1998-01-01'-scheduled END + CASE WHEN todo<>'DONE' THEN 250 ELSE 0 END + CASE WHEN tags LIKE '%:BUILDING:%' THEN 200 ELSE 0 END)::BIGINT AS urgency FROM sections WHERE level=4""")
def agenda_urgency(spark, d):
    return agenda.urgency(outline.sections(spark, d).where("level = 4"), dt.date(1998, 1, 1), ("BUILDING", "now")).select("section_id", "urgency")


@_register(OUTLINE + "SELECT section_id, place, place>3 AS skipped FROM (SELECT section_id, row_number() OVER (PARTITION BY parent_id ORDER BY scheduled DESC, section_id) AS place FROM sections WHERE level=4)")
def agenda_limited(spark, d):
    s = outline.sections(spark, d).where("level = 4")
    return agenda.limited(s, "parent_id", [F.desc_nulls_first("scheduled"), F.col("section_id")], 3).select("section_id", "place", "skipped")


# Predicates and query languages.


def _match(name: str, expression: str, where: str) -> None:
    def query(spark, d):
        s = outline.sections(spark, d)
        special = {"TODO": F.col("todo"), "PRIORITY": F.col("priority"), "LEVEL": F.col("level").cast("string"), "SCHEDULED": F.date_format("scheduled", "yyyy-MM-dd"), "ITEM": F.col("title")}
        return s.where(compile_match(expression, F.col("effective_tags"), F.col("properties"), special, {"west": ["europe", "america"]})).select("section_id")

    query.__name__ = name
    _register(OUTLINE + f"SELECT section_id FROM sections WHERE {where}")(query)


_match("match_tags", "+asia-automobile|+west+LEVEL=3", "(tags ILIKE '%:asia:%' AND tags NOT ILIKE '%:automobile:%') OR ((tags ILIKE '%:europe:%' OR tags ILIKE '%:america:%') AND level=3)")
_match("match_numbers", "PRICE>100000+TODO<>\"DONE\"", "round(price,2)>100000 AND todo<>'DONE'")
_match("match_dates", "SCHEDULED>=\"<1997-01-01>\"-PRIORITY=\"A\"", "scheduled>=DATE '1997-01-01' AND priority<>'A'")
_match("match_pattern", "ITEM={#1}-STATUS=F", "contains(title,'#1') AND (status IS NULL OR status<>'F')")

_FRENCH = ELEMENTS + "SELECT source_file, id FROM elements WHERE category='element' AND kind='paragraph' AND lang='fr'"


@_register(_FRENCH)
def query_builder(spark, d):
    q = eq.Query(category="element", kind="paragraph", property_equals=[("lang", "fr")])
    return eq.run(outline.elements(spark, d), q).select("source_file", "id")


@_register(_FRENCH)
def query_sexpr(spark, d):
    q = eq.from_sexpr('(org-elements-query (kind table) (and (kind paragraph) (property "lang" "fr")))')
    return eq.run(outline.elements(spark, d), q).select("source_file", "id")


@_register(_FRENCH)
def query_packet(spark, d):
    q = eq.from_packet('{"schemaVersion": 1, "category": "element", "predicate": {"all": [{"kind": "paragraph"}, {"propertyEquals": {":lang": "fr"}}, {"not": {"kind": "table"}}]}}')
    return eq.run(outline.elements(spark, d), q).select("source_file", "id")


@_register(ELEMENTS + "SELECT source_file, id FROM elements WHERE category='element' AND kind='table'")
def query_selector(spark, d):
    return eq.run(outline.elements(spark, d), eq.from_selector("(:org-element (:type table))")).select("source_file", "id")


@_register(ELEMENTS + "SELECT source_file, id FROM elements WHERE (kind='table' OR contains(source_raw,'the')) AND NOT (category='document') AND lang='en' AND source='src0'")
def query_predicate(spark, d):
    q = eq.from_sexpr('(query (outline-path-prefix "en" "src0") (outline-depth 2) (predicate (and (or (type table) (source-contains "the")) (not (category document)))))')
    return eq.run(outline.elements(spark, d), q).select("source_file", "id")


@_register(ELEMENTS + "SELECT source_file, id FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY id) AS n FROM elements WHERE category='element') WHERE n<=2")
def query_limit(spark, d):
    return eq.run(outline.elements(spark, d), eq.from_sexpr("(query (category element) (limit 2))")).select("source_file", "id")


@_register(ELEMENTS + "SELECT source_file, id, line FROM elements WHERE category='element' AND contains(translate(source_raw,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'the') AND contains(translate(source_raw,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'and')")
def term_search(spark, d):
    e = outline.elements(spark, d).where("category = 'element'")
    return e.where(text.contains_terms(F.col("source_raw"), ["The AND"])).select("source_file", "id", "line")


@_register(ELEMENTS + "SELECT kind, count(*) AS n, count(DISTINCT source_file) AS documents FROM elements GROUP BY kind")
def kind_counts(spark, d):
    return outline.elements(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("documents"))


@_register(ELEMENTS + "SELECT source_file, count(*) AS facts, count(*) FILTER (kind='table') AS tables, max(line) AS last_line FROM elements GROUP BY source_file")
def document_summary(spark, d):
    return outline.elements(spark, d).groupBy("source_file").agg(F.count("*").alias("facts"), F.count_if(F.col("kind") == "table").alias("tables"), F.max("line").alias("last_line"))


@_register(OUTLINE + "SELECT section_id, parent_id FROM sections WHERE parent_id IN (1,2)")
def relation_child_of(spark, d):
    s = outline.sections(spark, d).withColumnRenamed("section_id", "id")
    return eq.run(s, eq.Query(relations=[("child-of", [1, 2])])).select(F.col("id").alias("section_id"), "parent_id")


@_register(OUTLINE + "SELECT section_id, level FROM sections WHERE a1=3 OR a2=1004")
def relation_descendant_of(spark, d):
    s = outline.sections(spark, d).withColumnRenamed("section_id", "id")
    return eq.run(s, eq.Query(relations=[("descendant-of", [3, 1004])])).select(F.col("id").alias("section_id"), "level")


@_register(OUTLINE + "SELECT DISTINCT x AS section_id FROM (SELECT unnest([a1,a2,a3]) AS x FROM sections WHERE section_id IN (1000000007,1000000011)) WHERE x IS NOT NULL")
def relation_ancestor_of(spark, d):
    s = outline.sections(spark, d).withColumnRenamed("section_id", "id")
    return eq.run(s, eq.Query(relations=[("ancestor-of", [1_000_000_007, 1_000_000_011])])).select(F.col("id").alias("section_id"))


@_register(OUTLINE + "SELECT section_id, CASE WHEN todo='DONE' THEN 'done' WHEN NOT (tags ILIKE '%:asia:%') THEN 'match' WHEN NOT contains(title,'1') THEN 'text' END AS skip_reason FROM sections")
def sparse_tree(spark, d):
    s = outline.sections(spark, d)
    return workspace.sparse_tree(s, compile_match("asia", F.col("effective_tags"), F.col("properties")), include_done=False, text=F.contains("title", F.lit("1"))).select("section_id", "skip_reason")


@_register(OUTLINE + "SELECT section_id, todo FROM sections WHERE todo<>'DONE' ORDER BY scheduled, section_id LIMIT 50")
def task_list(spark, d):
    return workspace.task_list(outline.sections(spark, d), "active", 50, ["scheduled", "section_id"]).select("section_id", "todo")


# Many documents.


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS shipped, CASE WHEN n=1 THEN 'resolved' WHEN n>1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n=1 THEN t END AS target_id FROM lineitem JOIN part ON p_partkey=l_partkey LEFT JOIN (SELECT p_name, count(*) AS n, min(p_partkey) AS t FROM part WHERE p_size>10 GROUP BY p_name) k ON k.p_name=part.p_name""")
def link_resolution(spark, d):
    part = _table(spark, d, "part")
    links = _table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("key")), "l_partkey")
    targets = part.where("p_size > 10").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("target_id"))
    return workspace.resolve_links(links, targets).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("shipped"), "status", "target_id")


@_register("SELECT doc_id, definitions FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS definitions FROM documents) WHERE definitions>1")
def duplicate_targets(spark, d):
    t = _table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    return workspace.duplicate_targets(t, ["key"]).select("doc_id", "definitions")


@_register("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t, floor(epoch(ts)/60)::BIGINT AS start, floor(epoch(ts)/60)::BIGINT + CASE WHEN event_id%7=0 THEN NULL ELSE floor(value)::BIGINT END AS stop FROM events), w AS (SELECT *, last_value(stop IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
 SELECT event_id, issue FROM (SELECT event_id, CASE WHEN stop IS NULL THEN 'noEndTime' WHEN stop-start<0 THEN 'invalidRange' WHEN stop-start>90 THEN 'longDuration' WHEN start<before THEN 'overlap' WHEN start-before>5 THEN 'gap' END AS issue FROM w) WHERE issue IS NOT NULL""")
def clock_issues(spark, d):
    e = _table(spark, d, "events")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    c = e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), minute.alias("start"), F.when(F.col("event_id") % 7 != 0, minute + F.floor("value")).alias("stop"))
    return workspace.clock_issues(c, "user_id", "at", longest=90).select("event_id", "issue")


@_register("SELECT c_custkey FROM customer WHERE c_acctbal<0 AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal>9990)")
def superseded_cards(spark, d):
    c = _table(spark, d, "customer").withColumn("state", F.when(F.col("c_acctbal") < 0, "closed").when(F.col("c_acctbal") > 9990, "current").otherwise("background"))
    return workspace.superseded(c, "c_mktsegment", "state", ("closed", "archived"), "current").select("c_custkey")


_EDGES = "WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN supplier ON s_suppkey=c_custkey WHERE c_nationkey<>s_nationkey)"


@_register(_EDGES + """ SELECT a.src||'>'||a.dst AS cycle FROM e a JOIN e b ON b.src=a.dst AND b.dst=a.src WHERE a.src<a.dst
 UNION ALL SELECT a.src||'>'||b.src||'>'||c.src FROM e a JOIN e b ON b.src=a.dst JOIN e c ON c.src=b.dst AND c.dst=a.src WHERE a.src<b.src AND a.src<c.src AND b.src<>c.src""")
def dependency_cycles(spark, d):
    c, s = _table(spark, d, "customer"), _table(spark, d, "supplier")
    e = c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return workspace.cycles(e, 3).select(F.array_join("path", ">").alias("cycle"))


@_register(_EDGES.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src=r.dst)
 SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON b.src=a.dst AND b.dst=a.src GROUP BY 1""")
def dependency_components(spark, d):
    c, s = _table(spark, d, "customer"), _table(spark, d, "supplier")
    e = c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return workspace.cyclic_components(e)


@_register("SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN s_acctbal>0 THEN 'document' ELSE 'missingPath' END AS status FROM lineitem LEFT JOIN supplier ON s_suppkey=l_suppkey")
def dependency_status(spark, d):
    e = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst"))
    docs = _table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("document"))
    return workspace.dependency_status(e, docs).select("l_orderkey", F.col("dst").alias("l_suppkey"), "l_linenumber", "status")


# Scalars.


@_register("SELECT p_partkey, trim(regexp_replace(lower(p_name||' / '||p_type),'[^a-z0-9]+','-','g'),'-') AS slug, CASE WHEN length(p_name||' '||p_type)>12 THEN substr(p_name||' '||p_type,1,12)||'...' ELSE p_name||' '||p_type END AS preview FROM part")
def text_scalars(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", text.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.preview(F.concat("p_name", F.lit(" \n "), "p_type"), 12).alias("preview"))


@_register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT*3600+90 AS by_clock, l_quantity::BIGINT*60 AS by_minutes, l_quantity::BIGINT*86400+1800 AS by_units, (l_quantity::BIGINT)||':02' AS shown FROM lineitem")
def durations(spark, d):
    q = F.col("l_quantity").cast("long")
    seconds = dates.duration_seconds(F.concat(q, F.lit(":01:30")))
    rows = _table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seconds.alias("by_clock"), dates.duration_seconds(q.cast("string")).alias("by_minutes"), dates.duration_seconds(F.concat(q, F.lit("d 0:30"))).alias("by_units"), dates.hours_minutes(seconds).alias("shown"))


@_register("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d')||' 09:30' AS stamp, o_orderdate::DATE AS strict, o_orderdate::DATE AS tree_day, 570 AS minute FROM orders")
def timestamps(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.concat(F.lit("<"), day, F.lit(" Mon 9:30 +1w>"))
    path = F.array(F.lit("x"), F.substring(day, 1, 4), F.concat(F.substring(day, 1, 7), F.lit(" month")), F.concat(day, F.lit(" day")))
    return _table(spark, d, "orders").select("o_orderkey", dates.timestamp_key(raw).alias("stamp"), dates.strict_date(day).alias("strict"), dates.datetree_date(path).alias("tree_day"), dates.time_of_day(F.concat(F.lit("9:30 call "), raw)).alias("minute"))


@_register("SELECT page_id, CASE WHEN url LIKE 'http%' THEN 'web' ELSE 'fuzzy' END AS kind FROM pages")
def link_kinds(spark, d):
    return _table(spark, d, "pages").select("page_id", text.link_kind(F.col("url")).alias("kind"))


@_register("SELECT p_partkey, p_size AS done, 50 AS total FROM part")
def statistic_cookies(spark, d):
    c = text.cookie(F.format_string("%s [%d/50]", "p_name", "p_size"))
    return _table(spark, d, "part").select("p_partkey", c["done"].cast("int").alias("done"), c["total"].cast("int").alias("total"))


# Sets, sorts, windows and SQL.


@_register("SELECT c_custkey FROM customer WHERE c_acctbal>5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice>100000")
def set_union(spark, d):
    return _table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey").union(_table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey")).distinct()


@_register("SELECT source, string_agg(DISTINCT upper(lang), ',' ORDER BY upper(lang)) AS keys FROM documents GROUP BY source")
def keyword_keys(spark, d):
    return _table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.upper("lang"))), ",").alias("keys"))


@_register("SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id")
def first_match(spark, d):
    return _table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_type"), F.max_by("event_type", "ts").alias("last_type"))


@_register("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS ordinal, last_value(CASE WHEN event_type='click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    e = _table(spark, d, "events")
    carried = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", F.row_number().over(w).cast("long").alias("ordinal"), carried.alias("carried"))


@_register("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def sql_rollup(spark, d):
    return _table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@_register(ELEMENTS + "SELECT a.kind AS kind, count(*) AS n FROM elements a JOIN elements b ON a.source_file=b.source_file AND b.id=a.id+1 WHERE a.category='element' GROUP BY a.kind")
def sql_self_join(spark, d):
    e = outline.elements(spark, d)
    return org.sql(e, "SELECT a.kind AS kind, count(*) AS n FROM org_elements a JOIN org_elements b ON a.source_file=b.source_file AND b.id=a.id+1 WHERE a.category='element' GROUP BY a.kind")


@_register(OUTLINE + "SELECT a3 AS customer, count(*) AS headlines, count(*) FILTER (todo='DONE') AS done, min(scheduled) AS first_day, sum(effort)::BIGINT AS effort_seconds FROM sections WHERE level=4 GROUP BY a3")
def parsed_outline(spark, d):
    """Orders written as Org text, one document for each customer, then parsed and counted."""
    s = outline.sections(spark, d).where("level = 4")
    docs = s.groupBy(F.col("parent_id").alias("customer")).agg(F.array_join(F.array_sort(F.collect_list(org.headline(1, "todo", "priority", "title", "tags", "scheduled", "effort_seconds"))), "").alias("text"))
    rows = org.parse(docs.select(F.col("customer").cast("string").alias("source_file"), "text")).where("kind = 'headline'")
    effort = dates.duration_seconds(F.try_element_at("properties", F.lit("EFFORT")))
    return rows.groupBy(F.col("source_file").cast("long").alias("customer")).agg(F.count("*").alias("headlines"), F.count_if(F.try_element_at("properties", F.lit("TODO")) == "DONE").alias("done"), F.min(F.substring(dates.timestamp_key(F.try_element_at("properties", F.lit("SCHEDULED"))), 1, 10).cast("date")).alias("first_day"), F.sum(effort).alias("effort_seconds"))


# Customers written as Org documents, parsed, and read by the record sets.


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """One Org document for each customer: a headline with id, clock and state change, links, macros, a footnote, two headlines below, a block and a table."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    minutes = (F.lit(10) + k % 50).cast("int")
    text_ = F.concat(
        F.lit("#+MACRO: seg "), "c_mktsegment", F.lit("\n* "), "c_name", F.lit(" :"), F.lower("c_mktsegment"), F.lit(":\n:PROPERTIES:\n:ID: k"), k % 50, F.when(n == 3, F.lit("\n:STYLE: habit")).otherwise(""), F.when(k % 9 == 0, F.lit("\n:EFFORT: soon")).otherwise(F.lit("\n:EFFORT: 1:00")),
        F.lit("\n:END:\n:LOGBOOK:\n- State \"DONE\" from \"TODO\" [1995-01-01 Sun 11:00]\nCLOCK: [1995-01-01 Sun 10:00]--[1995-01-01 Sun "), F.format_string("%02d:%02d", F.floor(F.lit(10) + minutes / 60), minutes % 60), F.lit("] =>  0:"), F.format_string("%02d", minutes),
        F.lit("\n:END:\n[[id:k"), (k + 7) % 60, F.lit("][next]] {{{seg}}} {{{none}}} [fn:1]\n** DONE Old"), k % 5, F.lit("\n** TODO Old"), n % 5, F.lit(" :noexport:\n#+NAME: b"), k % 3, F.lit("\n#+begin_src sql :tangle f"), n, F.lit(".sql\nselect "), k, F.lit("\n#+end_src\n| "), k, F.lit(" |\n#+TBLFM: $1="), n, F.lit("\n"),
    )
    return dealt(_table(spark, d, "customer")).select(k.cast("string").alias("source_file"), text_.alias("text"))


def _parsed(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Their elements, or those of some kinds."""
    return org.parse(_customers(spark, d), kinds or None)


@_register("""SELECT c_custkey AS customer, CASE WHEN n IS NULL THEN 'unresolved' WHEN n=1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN (SELECT c_custkey%50 AS k, count(*) AS n FROM customer GROUP BY 1) t ON t.k=(c_custkey+7)%60""")
def parsed_links(spark, d):
    e = _parsed(spark, d)
    return workspace.resolve_links(records.links(e, abbreviations=False), records.targets(e).where("kind = 'id'")).select(F.col("source_file").cast("long").alias("customer"), "status")


@_register("SELECT c_custkey AS customer, 10+c_custkey%50 AS minutes, (10+c_custkey%50)*60 AS seconds FROM customer")
def parsed_clocks(spark, d):
    return records.clocks(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), (F.col("stop") - F.col("start")).alias("minutes"), "seconds")


@_register("SELECT c_custkey AS customer, kind, stamp FROM customer, (VALUES ('state','1995-01-01 11:00'),('clock','1995-01-01 10:00')) t(kind, stamp)")
def parsed_lifecycle(spark, d):
    return records.lifecycle(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "kind", "stamp")


@_register("SELECT c_custkey AS customer, (10+c_custkey%50)*60 AS clock_seconds, CASE WHEN c_custkey%9=0 THEN NULL ELSE 3600 END AS effort FROM customer WHERE c_nationkey=3")
def parsed_habits(spark, d):
    return records.habits(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "clock_seconds", F.col("effort_seconds").alias("effort"))


@_register("SELECT state, superseded, count(*) AS n FROM (SELECT 'background' AS state, false AS superseded FROM customer UNION ALL SELECT 'current', false FROM customer UNION ALL SELECT 'closed', c_custkey%5 IN (SELECT c_nationkey%5 FROM customer) FROM customer) GROUP BY ALL")
def parsed_memory(spark, d):
    return records.memory_cards(_parsed(spark, d, "headline")).groupBy("state", "superseded").agg(F.count("*").alias("n"))


@_register("SELECT c_custkey AS customer, x.name, CASE WHEN x.name='seg' THEN 'expanded' ELSE 'missingDefinition' END AS status, CASE WHEN x.name='seg' THEN c_mktsegment END AS expansion FROM customer, (VALUES ('seg'),('none')) x(name)")
def parsed_macros(spark, d):
    return records.macros(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "name", "status", "expansion")


@_register("SELECT c_custkey AS customer, '1' AS label, false AS resolved FROM customer")
def parsed_footnotes(spark, d):
    return records.footnotes(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "label", "resolved")


@_register("SELECT display, count(*) AS n, bool_or(m>1) AS ambiguous FROM (SELECT c_name||'/Old'||(c_nationkey%5) AS display, CASE WHEN c_custkey%5=c_nationkey%5 THEN 1 ELSE 1 END AS m FROM customer) GROUP BY display")
def parsed_refile(spark, d):
    rows = records.refile_targets(records.sections(_parsed(spark, d)), [("tag", "noexport")])
    return rows.groupBy("display").agg(F.count("*").alias("n"), F.bool_or("ambiguous").alias("ambiguous"))


@_register("SELECT c_custkey AS customer, t.title FROM customer, LATERAL (SELECT c_name AS title UNION ALL SELECT 'Old'||(c_custkey%5)) t")
def parsed_export(spark, d):
    return records.export_kept(records.sections(_parsed(spark, d, "headline"))).select(F.col("source_file").cast("long").alias("customer"), "title")


@_register("SELECT c_custkey AS customer, '$1' AS lhs, c_nationkey::VARCHAR AS rhs FROM customer")
def parsed_formulas(spark, d):
    return records.table_formulas(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "lhs", "rhs")


@_register("SELECT 'f'||c_nationkey||'.sql' AS target, c_custkey AS customer, 'select '||c_custkey AS content FROM customer")
def parsed_tangle(spark, d):
    return packets.tangle_plan(_parsed(spark, d)).select("target", F.col("source_file").cast("long").alias("customer"), "content")


@_register("SELECT c_custkey AS customer, code FROM customer, (VALUES ('ORG004'),('ORG011')) t(code) WHERE code='ORG004' OR c_custkey%9=0")
def parsed_lint(spark, d):
    return lint.findings(_parsed(spark, d)).select(F.col("source_file").cast("long").alias("customer"), "code")


@_register("SELECT c_custkey AS customer, t.assertion, t.n AS count, t.ok FROM customer, LATERAL (SELECT 'top' AS assertion, 1 AS n, true AS ok UNION ALL SELECT 'below', 2, true UNION ALL SELECT 'blocks', 1, false) t")
def parsed_contract(spark, d):
    top = contracts.Step("top", eq.Query(kind="headline", depth=1), expect=("==", 1))
    below = contracts.Step("below", eq.Query(kind="headline"), within=("child-of", "top"), expect=(">=", 2))
    blocks = contracts.Step("blocks", eq.from_sexpr("(src-block :language sql)"), within=("descendant-of", "below"), expect=(">", 1))
    return contracts.evaluate(_parsed(spark, d, "org-data", "headline", "src-block"), contracts.Contract("c", [top, below, blocks])).select(F.col("source_file").cast("long").alias("customer"), "assertion", "count", "ok")


@_register("SELECT CASE WHEN p_size%2=0 THEN 'checklistItem' ELSE 'listItem' END AS kind, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'list', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'heading', count(DISTINCT p_brand) FROM part")
def markdown_elements(spark, d):
    """Parts written as Markdown lists, one file for each brand, and parsed."""
    item = F.concat(F.when(F.col("p_size") % 2 == 0, "- [x] ").otherwise("- "), "p_name", F.lit("\n"))
    docs = _table(spark, d, "part").groupBy(F.col("p_brand").alias("source_file")).agg(F.array_join(F.collect_list(item), "").alias("list")).select("source_file", F.concat(F.lit("# Parts\n\n"), "list").alias("text"))
    return markdown.parse(docs).groupBy("kind").agg(F.count("*").alias("n"))


@_register("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_size>40 THEN 'orphan' ELSE 'missing' END AS status FROM part WHERE p_size>40 OR p_size<5")
def attachment_gaps(spark, d):
    part = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size")
    return records.attachment_gaps(part.where("p_size <= 40").select("path"), part.where("p_size >= 5").select("path"))


@_register(ELEMENTS + "SELECT source_file, id FROM elements WHERE (kind='table') OR (category='element' AND lang='de')")
def contract_union(spark, d):
    return contracts.union_of(outline.elements(spark, d), [eq.Query(kind="table"), eq.Query(category="element", property_equals=[("lang", "de")])])


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Each nation as a document of settings, parsed: it includes the nation after it, and so on."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    text_ = F.concat(
        F.lit("#+TITLE: "), "n_name", F.lit("\n#+OPTIONS: H:"), r, F.lit(" toc:nil\n#+INCLUDE: \"n"), (n + 1) % 25, F.lit(".org\" :lines \"1-"), n + 2, F.lit("\"\n#+SETUPFILE: s"), r, F.lit(".org\n#+TAGS: [ region : a"), r, F.lit(" b ]\n"),
        F.when(r == 0, F.lit("#+BIBLIOGRAPHY: x.bib\n")).otherwise(""), F.lit("see [cite:@k"), n, F.lit("]\n* A :crypt:\n:PROPERTIES:\n:COLOR_ALL: red blue\n:COLOR: "), F.when(n % 2 == 0, "red").otherwise("green"), F.lit("\n:END:\n** B\n* C\n:PROPERTIES:\n:CRYPTKEY: me\n:END:\n"),
    )
    return org.parse(_table(spark, d, "nation").select(F.concat(F.lit("n"), n, F.lit(".org")).alias("source_file"), text_.alias("text")))


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, 'n'||((n_nationkey+1)%25)||'.org' AS path, 'org' AS mode, 1 AS first_line, n_nationkey+2 AS last_line FROM nation")
def include_plan(spark, d):
    return export_graph.includes(_settings(spark, d)).select("source_file", "path", "mode", "first_line", "last_line")


@_register("SELECT 'n'||n_nationkey||'.org' AS src, 'n'||((n_nationkey+1)%25)||'.org' AS dst, 'includes' AS kind FROM nation UNION ALL SELECT 'n'||n_nationkey||'.org', 's'||n_regionkey||'.org', 'usesSetupFile' FROM nation UNION ALL SELECT 'n'||n_nationkey||'.org', 'x.bib', 'usesBibliography' FROM nation WHERE n_regionkey=0")
def export_dependencies(spark, d):
    return export_graph.dependencies(_settings(spark, d))


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, option, CASE option WHEN 'H' THEN n_regionkey::VARCHAR ELSE 'nil' END AS setting FROM nation, (VALUES ('H'),('toc')) t(option)")
def export_options(spark, d):
    return export_graph.options(_settings(spark, d)).select("source_file", "option", "setting")


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, key, CASE WHEN key='TITLE' THEN n_name ELSE 'H:'||n_regionkey||' toc:nil' END AS value FROM nation, (VALUES ('TITLE'),('OPTIONS')) t(key)")
def publishing_settings(spark, d):
    return export_graph.publishing(_settings(spark, d)).select("source_file", "key", "value")


@_register("SELECT 'k'||n_nationkey AS key, n_regionkey=0 AS has_bibliography FROM nation")
def citation_plan(spark, d):
    return export_graph.citations(_settings(spark, d)).select("key", "has_bibliography")


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, 'region' AS tag_group, m AS member FROM nation, LATERAL (SELECT 'a'||n_regionkey AS m UNION ALL SELECT 'b') t")
def tag_groups(spark, d):
    return export_graph.tag_groups(_settings(spark, d))


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, tag, false AS encrypted, warning FROM nation, (VALUES ('direct','plainBody'),('inherited','plainBody'),(NULL,'keyWithoutTag')) t(tag, warning)")
def crypt_states(spark, d):
    return export_graph.crypt_states(_settings(spark, d)).select("source_file", "tag", "encrypted", "warning")


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, 'COLOR' AS key, 'green' AS value FROM nation WHERE n_nationkey%2=1")
def property_values(spark, d):
    return export_graph.property_values(_settings(spark, d)).select("source_file", "key", "value")


@_register("SELECT 'n'||n_nationkey||'.org' AS source_file, heading, level FROM nation, (VALUES ('A',1),('B',2),('C',1)) t(heading, level)")
def section_index(spark, d):
    return records.sections(_settings(spark, d)).select("source_file", F.col("title").alias("heading"), "level")


def _all() -> None:
    from sheaf import catalog_documents, catalog_grammar  # noqa: F401  register their queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
