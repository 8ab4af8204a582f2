"""Design nodes of a document (headlines of the tag sdd or with SDD_KIND), their status and graph, and the validation rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds, and the property that each kind needs.
NEEDS = {"system": "SDD_CONCERN", "capability": "SDD_CAPABILITY", "view": "SDD_VIEWPOINT", "decision": "SDD_RATIONALE", "audit": "SDD_CONCERN"}
STABLE_ID = r"^(?i)([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-HJKMNP-TV-Z]{26})$"
COOKIE = r"(^|\s)\[(\d+/\d+|\d+%)\](\s|$)"
CODES = tuple(f"ORG{i:03}" for i in range(31, 38))


def _p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def _finding(rows: DataFrame, code: str, message: Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "source_file", "line", "range_start", message.alias("message"))


def _is_node() -> Column:
    return F.array_contains(F.split(F.coalesce(_p("TAGS"), F.lit("")), ":"), "sdd") | _p("SDD_KIND").isNotNull()


def nodes(e: DataFrame) -> DataFrame:
    """One row for each node: kind (lower case), known or not, id, parent as written and the id it names, the other SDD_ properties."""
    parent = F.trim(_p("SDD_PARENT"))
    linked = F.regexp_extract(parent, r"^\[\[id:([^\]]*)\](?:\[[^\]]*\])?\]$", 1)
    target = F.when(linked != "", linked).when(F.startswith(parent, F.lit("id:")), F.trim(F.substring(parent, 4, 1 << 20)))
    kind = F.lower(F.trim(F.coalesce(_p("SDD_KIND"), F.lit(""))))
    more = {k.lower(): F.trim(_p(f"SDD_{k}")) for k in ("CAPABILITY", "VIEWPOINT", "CONCERN", "QUALITY", "RATIONALE", "SLUG")}
    return e.where("kind = 'headline'").where(_is_node()).select(
        "source_file", "line", "range_start", F.col("id").alias("section_id"), "parent_id", "ancestor_ids", _p("title").alias("title"), kind.alias("kind"), kind.isin(*NEEDS).alias("known"), F.trim(_p("ID")).alias("id"),
        F.nullif(parent, F.lit("")).alias("parent"), F.nullif(target, F.lit("")).alias("target_id"), F.nullif(F.lower(F.trim(_p("SDD_STATUS"))), F.lit("")).alias("status"), _p("TODO").alias("todo"), *(v.alias(k) for k, v in more.items()),
    )


def status(e: DataFrame) -> DataFrame:
    """(source_file, kind, status, n): nodes by kind and status."""
    return nodes(e).groupBy("source_file", "kind", "status").agg(F.count("*").alias("n"))


def graph(e: DataFrame) -> DataFrame:
    """Edges from each node to the parent it names: (source_file, id, target_id, resolved)."""
    rows = nodes(e).where("target_id is not null")
    known = nodes(e).where("id is not null").select("source_file", F.col("id").alias("target_id")).distinct().withColumn("found", F.lit(True))
    return rows.join(known, ["source_file", "target_id"], "left").select("source_file", "id", "target_id", F.coalesce("found", F.lit(False)).alias("resolved"))


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes by id that were added, removed or changed between two parses: (source_file, id, change)."""
    of = lambda e: nodes(e).where("id is not null").select("source_file", "id", F.xxhash64("title", "kind", "target_id", "status").alias("state")).dropDuplicates(["source_file", "id"])
    both = of(before).withColumnRenamed("state", "was").join(of(after).withColumnRenamed("state", "now"), ["source_file", "id"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("source_file", "id", change.alias("change")).where("change is not null")


def unstable_ids(e: DataFrame) -> DataFrame:
    """ORG031: no ID, or one that is neither a UUID nor a ULID."""
    return _finding(nodes(e).where(F.col("id").isNull() | ~F.regexp("id", F.lit(STABLE_ID))), "ORG031", F.concat(F.lit("no stable ID: "), "title"))


def unknown_kinds(e: DataFrame) -> DataFrame:
    """ORG032."""
    return _finding(nodes(e).where("not known"), "ORG032", F.concat(F.lit("unknown SDD_KIND: "), "kind"))


def unresolved_parents(e: DataFrame) -> DataFrame:
    """ORG033: a parent that is no id link or names no node; none at all is allowed to systems and unknown kinds only."""
    rows = nodes(e)
    ids = rows.where("id is not null").select("source_file", F.col("id").alias("target_id")).distinct()
    none = rows.where(F.col("parent").isNull() & F.col("known") & (F.col("kind") != "system"))
    odd = rows.where(F.col("parent").isNotNull() & F.col("target_id").isNull())
    lost = rows.where("target_id is not null").join(ids, ["source_file", "target_id"], "left_anti")
    return _finding(none.unionByName(odd).unionByName(lost), "ORG033", F.concat(F.lit("unresolved SDD_PARENT of "), "title"))


def duplicate_ids(e: DataFrame) -> DataFrame:
    """ORG034: an id of two nodes, at the second."""
    w = Window.partitionBy("source_file", "id")
    rows = nodes(e).where("id is not null").withColumn("_i", F.row_number().over(w.orderBy("range_start"))).where("_i = 2")
    return _finding(rows, "ORG034", F.concat(F.lit("duplicate SDD ID "), "id"))


def requirements_without_scenario(e: DataFrame) -> DataFrame:
    """ORG035: below or on a node, a headline Requirement: without a headline Scenario: right below it."""
    heads = e.where("kind = 'headline'").select("source_file", "line", "range_start", "id", "parent_id", "ancestor_ids", F.trim(_p("title")).alias("title"))
    inside = nodes(e).select("source_file", F.col("section_id").alias("above")).distinct()
    wanted = heads.where(F.startswith("title", F.lit("Requirement:")))
    scope = wanted.select("source_file", "id", F.explode(F.concat("ancestor_ids", F.array("id"))).alias("above")).join(inside, ["source_file", "above"], "left_semi").select("source_file", "id").distinct()
    told = heads.where(F.startswith("title", F.lit("Scenario:"))).select("source_file", F.col("parent_id").alias("id")).distinct()
    return _finding(wanted.join(scope, ["source_file", "id"], "left_semi").join(told, ["source_file", "id"], "left_anti"), "ORG035", F.concat(F.lit("no Scenario below "), "title"))


def execution_states(e: DataFrame) -> DataFrame:
    """ORG036: a node with a TODO, a statistics cookie, a checklist right in it, or tasks right below it; one finding for each."""
    heads = e.where("kind = 'headline'")
    own = heads.where(_is_node())
    lists = e.where("kind = 'plain-list'").select("source_file", F.col("id").alias("parent_id"), F.col("parent_id").alias("id"))
    boxed = e.where("kind = 'item'").where(_p("checkbox").isNotNull()).select("source_file", "parent_id").join(lists, ["source_file", "parent_id"]).select("source_file", "id").distinct()
    tasks = heads.where(_p("TODO").isNotNull()).select("source_file", F.col("parent_id").alias("id")).distinct()
    found = [
        own.where(_p("TODO").isNotNull()).withColumn("why", F.lit("has a TODO state")),
        own.where(F.regexp(F.coalesce(_p("title"), F.lit("")), F.lit(COOKIE))).withColumn("why", F.lit("has a progress cookie")),
        own.join(boxed, ["source_file", "id"], "left_semi").withColumn("why", F.lit("has a checklist")),
        own.join(tasks, ["source_file", "id"], "left_semi").withColumn("why", F.lit("has tasks right below it")),
    ]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return _finding(rows, "ORG036", F.concat(F.lit("an SDD headline "), "why"), "warning")


def missing_metadata(e: DataFrame) -> DataFrame:
    """ORG037: the property that a kind needs."""
    needs = F.lit(None).cast("string")
    for kind, key in NEEDS.items():
        needs = F.when((F.col("kind") == kind) & F.col(key[4:].lower()).isNull(), key).otherwise(needs)
    return _finding(nodes(e).withColumn("missing", needs).where("missing is not null"), "ORG037", F.concat(F.lit("missing "), "missing"))


RULES = {"ORG031": unstable_ids, "ORG032": unknown_kinds, "ORG033": unresolved_parents, "ORG034": duplicate_ids, "ORG035": requirements_without_scenario, "ORG036": execution_states, "ORG037": missing_metadata}


def issue_count(findings: DataFrame) -> DataFrame:
    """(source_file, n): findings of these rules in each document that has any."""
    return findings.where(F.col("code").isin(*CODES)).groupBy("source_file").agg(F.count("*").alias("n"))
