"""Record sets drawn from parsed elements: links and targets, clocks, lifecycle, habits, memory cards, refile targets, columns, macros, attachments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.dates import duration_seconds, timestamp_key
from sheaf.functions.text import link_kind
from sheaf.operators.stored import kept

#: Column summaries with a meaning (``columns.summaries``); others are reported as unsupported.
SUPPORTED = ("+", "$", "min", "max", "mean", "X", "X/", "X%", ":", ":min", ":max", ":mean", "est+")
SPECIAL = ("ITEM", "TODO", "PRIORITY", "TAGS", "ALLTAGS", "LEVEL", "CLOSED", "SCHEDULED", "DEADLINE")


def p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def _nearest(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows with ``section_id``, the nearest headline above: within one document, by its ancestors."""
    heads = elements.where("kind = 'headline'").select("source_file", F.col("id").alias("_above"))
    up = rows.select("source_file", "id", F.explode("ancestor_ids").alias("_above")).join(heads, ["source_file", "_above"]).groupBy("source_file", "id").agg(F.max("_above").alias("section_id"))
    return rows.join(up, ["source_file", "id"], "left")


def sections(elements: DataFrame) -> DataFrame:
    """One wide row for each headline; ``ancestor_ids`` holds headlines and the document."""
    tags = lambda key: F.filter(F.split(p(key), ":"), lambda t: t != "")
    return elements.where("kind = 'headline'").select(
        "source_file", F.col("id").alias("section_id"), "parent_id", "ancestor_ids", p("LEVEL").cast("int").alias("level"), p("title").alias("title"), "outline_path", p("TODO").alias("todo"), p("todo-type").alias("todo_type"), F.coalesce(p("PRIORITY"), F.lit("B")).alias("priority"),
        tags("TAGS").alias("tags"), tags("ALLTAGS").alias("effective_tags"), F.coalesce(p("CATEGORY"), p("inherited:CATEGORY")).alias("category"), p("COMMENT").isNotNull().alias("is_comment"), F.array_contains(tags("ALLTAGS"), "ARCHIVE").alias("archived"), p("anchor").alias("anchor"),
        timestamp_key(p("SCHEDULED")).alias("scheduled_key"), F.substring(timestamp_key(p("SCHEDULED")), 1, 10).try_cast("date").alias("scheduled"), F.substring(timestamp_key(p("DEADLINE")), 1, 10).try_cast("date").alias("deadline"), duration_seconds(p("EFFORT")).alias("effort_seconds"), "properties", "line", "range_start", "range_end",
    )


def targets(elements: DataFrame) -> DataFrame:
    """What a link may lead to: headlines, custom ids, ids, targets, radio targets, footnotes, in one space of keys."""
    heads = elements.where("kind = 'headline'")
    own = [
        heads.select("source_file", "range_start", F.lit("headline").alias("kind"), F.concat(F.lit("*"), p("title")).alias("key")),
        heads.where(p("CUSTOM_ID").isNotNull()).select("source_file", "range_start", F.lit("customId").alias("kind"), F.concat(F.lit("#"), p("CUSTOM_ID")).alias("key")),
        heads.where(p("ID").isNotNull()).select("source_file", "range_start", F.lit("id").alias("kind"), F.concat(F.lit("id:"), p("ID")).alias("key")),
        elements.where(F.col("kind").isin("target", "radio-target")).select("source_file", "range_start", "kind", p("value").alias("key")),
        elements.where("kind = 'footnote-definition'").select("source_file", "range_start", "kind", F.concat(F.lit("fn:"), p("label")).alias("key")),
    ]
    out = own[0]
    for x in own[1:]:
        out = out.union(x)
    return out.withColumn("target_id", F.concat_ws(":", "source_file", "range_start"))


def links(elements: DataFrame, abbreviations: bool = True) -> DataFrame:
    """Links with protocol and key (the path before ``::``); abbreviations of ``#+LINK`` lines are expanded first."""
    rows = elements.where("kind = 'link'").select("source_file", "id", "ancestor_ids", "range_start", "line", p("path").alias("path"), p("description").alias("description"))
    if abbreviations:
        parts = F.split(p("value"), r"\s+", 2)
        known = elements.where("kind = 'keyword'").where(p("key") == "LINK").select("source_file", parts[0].alias("_name"), parts[1].alias("_to")).dropDuplicates(["source_file", "_name"])
        tail = F.substring_index(F.col("path"), ":", -1)
        full = F.when(F.contains("_to", F.lit("%s")), F.replace("_to", F.lit("%s"), tail)).when(F.contains("_to", F.lit("%h")), F.replace("_to", F.lit("%h"), F.url_encode(tail))).otherwise(F.concat("_to", tail))
        rows = rows.withColumn("_name", F.substring_index("path", ":", 1)).join(known, ["source_file", "_name"], "left").withColumn("path", F.when(F.col("_to").isNotNull() & F.contains("path", F.lit(":")), full).otherwise(F.col("path"))).drop("_name", "_to")
    return rows.withColumns({"key": F.trim(F.substring_index("path", "::", 1)), "search": F.when(F.contains("path", F.lit("::")), F.substring_index("path", "::", -1)), "protocol": link_kind(F.col("path"))})


def clocks(elements: DataFrame) -> DataFrame:
    """Clock lines with start and stop in minutes (wall time) and declared seconds."""
    stamps = F.regexp_extract_all(p("value"), F.lit(r"(\d{4}-\d{2}-\d{2}[^\]>]*)"), F.lit(1))
    minute = lambda i: F.floor(F.unix_timestamp(timestamp_key(F.try_element_at(stamps, F.lit(i))).try_cast("timestamp")) / 60)
    rows = elements.where("kind = 'clock'").withColumns({"start": minute(1), "stop": minute(2), "seconds": duration_seconds(p("duration"))})
    return _nearest(rows, elements).select("source_file", "section_id", "id", "range_start", "start", "stop", "seconds")


def lifecycle(elements: DataFrame) -> DataFrame:
    """Lines of LOGBOOK drawers by kind: state, note, refiled, rescheduled, deadline, clock, other."""
    rows = elements.where("kind = 'drawer'").where(F.upper(p("name")) == "LOGBOOK").select("source_file", "id", "ancestor_ids", F.posexplode(F.split("source_raw", "\n")).alias("at", "raw"))
    raw = F.regexp_replace(F.trim("raw"), r"^- +", "")
    kind = F.when(F.startswith(raw, F.lit("State ")), "state").when(F.startswith(raw, F.lit("Note taken on")), "note").when(F.startswith(raw, F.lit("Refiled on")), "refiled").when(F.startswith(raw, F.lit("Rescheduled from")), "rescheduled").when(F.startswith(raw, F.lit("New deadline from")), "deadline").when(F.startswith(raw, F.lit("CLOCK:")), "clock").otherwise("other")
    out = rows.where(~F.regexp("raw", F.lit(r"^\s*(:\w+:)?\s*$"))).withColumns({"kind": kind, "stamp": timestamp_key(raw), "to_state": F.regexp_extract(raw, r'^State "([^"]*)"', 1), "from_state": F.regexp_extract(raw, r'from +"([^"]*)"', 1)})
    return _nearest(out, elements).select("source_file", "section_id", "at", "kind", "stamp", "to_state", "from_state")


def habits(elements: DataFrame) -> DataFrame:
    """Headlines of STYLE habit: repeater, last repeat, effort, clocks."""
    rows = sections(elements).where(F.lower(F.try_element_at("properties", F.lit("STYLE"))) == "habit")
    spent = clocks(elements).groupBy("source_file", "section_id").agg(F.count("*").alias("clocks"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))
    repeater = F.regexp_extract(F.try_element_at("properties", F.lit("SCHEDULED")), r"((?:\+\+|\.\+|\+)\d+[hdwmy])", 1)
    return rows.join(spent, ["source_file", "section_id"], "left").select("source_file", "section_id", "title", repeater.alias("repeater"), timestamp_key(F.try_element_at("properties", F.lit("LAST_REPEAT"))).alias("last_repeat"), "effort_seconds", F.coalesce("clocks", F.lit(0)).alias("clocks"), F.coalesce("seconds", F.lit(0)).alias("clock_seconds"))


def memory_cards(elements: DataFrame) -> DataFrame:
    """Headlines as memory: state is archived, closed, current (has a task or a plan) or background, the first that holds; superseded if a current card has the same id or title."""
    rows = sections(elements)
    current = F.col("todo").isNotNull() | F.col("scheduled").isNotNull() | F.col("deadline").isNotNull()
    state = F.when(F.col("archived"), "archived").when(F.col("todo_type") == "done", "closed").when(current, "current").otherwise("background")
    cards = rows.withColumn("state", state)
    keys = F.array_distinct(F.transform(F.array_compact(F.array("title", F.try_element_at("properties", F.lit("ID")), F.try_element_at("properties", F.lit("CUSTOM_ID")))), lambda k: F.lower(k)))
    # Stored: the cards are read three times, and their documents should not be parsed as often.
    cards = kept(cards.withColumn("_keys", keys))
    now = cards.where("state = 'current'").select(F.explode("_keys").alias("_key")).distinct()
    old = cards.where(F.col("state").isin("archived", "closed")).select("source_file", "section_id", F.explode("_keys").alias("_key")).join(now, "_key", "left_semi").select("source_file", "section_id").distinct().withColumn("superseded", F.lit(True))
    return cards.join(old, ["source_file", "section_id"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False))).drop("_keys")


def footnotes(elements: DataFrame) -> DataFrame:
    """References with whether their document defines them; an inline definition counts."""
    known = elements.where("kind = 'footnote-definition'").select("source_file", p("label").alias("label")).distinct().withColumn("defined", F.lit(True))
    rows = elements.where("kind = 'footnote-reference'").select("source_file", "range_start", p("label").alias("label"), F.regexp(p("value"), F.lit(r"^\[fn:[\w-]*:")).alias("inline"))
    return rows.join(known, ["source_file", "label"], "left").withColumn("resolved", F.coalesce("defined", F.lit(False)) | F.col("inline")).drop("defined")


def macros(elements: DataFrame) -> DataFrame:
    """Uses of macros with their expansion: the last definition of a document wins; $1 to $9 are arguments, $0 all of them."""
    parts = F.split(p("value"), r"\s+", 2)
    known = elements.where("kind = 'keyword'").where(p("key") == "MACRO").groupBy("source_file", parts[0].alias("name")).agg(F.max_by(parts[1], "range_start").alias("template"))
    used = elements.where("kind = 'macro'").select("source_file", "range_start", p("name").alias("name"), F.regexp_extract(p("value"), r"\((.*)\)\}\}\}$", 1).alias("all"))
    rows = used.join(known, ["source_file", "name"], "left").withColumn("args", F.split("all", r"\s*,\s*"))
    text = F.replace(F.col("template"), F.lit("$0"), F.col("all"))
    for i in range(1, 10):
        text = F.replace(text, F.lit(f"${i}"), F.coalesce(F.get("args", i - 1), F.lit("")))
    return rows.select("source_file", "range_start", "name", F.when(F.col("template").isNull(), "missingDefinition").otherwise("expanded").alias("status"), text.alias("expansion"))


def source_references(elements: DataFrame) -> DataFrame:
    """Calls and noweb references with whether a block of that name is in the document."""
    blocks = elements.where("kind = 'src-block'")
    names = blocks.where("affiliated_name is not null").select("source_file", F.col("affiliated_name").alias("name")).distinct()
    refs = blocks.where(p("header:noweb-ref").isNotNull()).select("source_file", p("header:noweb-ref").alias("name")).union(names).distinct()
    calls = elements.where(F.col("kind").isin("babel-call", "inline-babel-call")).select("source_file", "range_start", F.lit("call").alias("kind"), F.regexp_extract(p("value"), r"^(?:call_)?([^\s(\[]+)", 1).alias("name"))
    noweb = blocks.select("source_file", "range_start", F.lit("noweb").alias("kind"), F.explode(F.regexp_extract_all(p("value"), F.lit(r"<<([^<>\n]+)>>"), F.lit(1))).alias("name"))
    one = calls.join(names.withColumn("found", F.lit(True)), ["source_file", "name"], "left")
    two = noweb.join(refs.withColumn("found", F.lit(True)), ["source_file", "name"], "left")
    return one.union(two).withColumn("resolved", F.coalesce("found", F.lit(False))).drop("found")


def refile_targets(rows: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """Sections with the specs that take them: all, tag (local, exact), todo, level, maxlevel.  No spec means all."""
    tests = {"all": lambda v: F.lit(True), "tag": lambda v: F.array_contains("tags", v), "todo": lambda v: F.col("todo") == v, "level": lambda v: F.col("level") == int(v), "maxlevel": lambda v: F.col("level") <= int(v), "regexp": lambda v: F.lit(False)}
    receipts = F.array_compact(F.array(*(F.when(tests[k](v), f"{k}:{v}") for k, v in specs or [("all", "")])))
    display = F.array_join("outline_path", "/")
    out = rows.withColumns({"receipts": receipts, "display": display}).where(F.size("receipts") > 0)
    return out.withColumn("ambiguous", F.count("*").over(Window.partitionBy("display")) > 1)


def column_format(text: str) -> list[dict]:
    """The parts of a COLUMNS value: %[width]PROP[(title)][{op;format}]."""
    out = []
    for m in re.finditer(r"%(\d+)?([\w-]+)(?:\(([^)]*)\))?(?:\{([^};]*)(?:;([^}]*))?\})?", text):
        op = m[4] or None
        status = None if op is None else "ignoredSpecialProperty" if m[2].upper() in SPECIAL else "supported" if op in SUPPORTED else "unsupported"
        out.append({"width": int(m[1]) if m[1] else None, "property": m[2].upper(), "title": m[3], "summary": op, "format": m[5], "status": status})
    return out


def table_formulas(elements: DataFrame) -> DataFrame:
    """Left sides, right sides and flags of formula lines; nothing is evaluated."""
    each = F.explode(F.split(F.replace(p("formulas"), F.lit("\n"), F.lit("::")), "::"))
    rows = elements.where("kind = 'table'").where(p("formulas").isNotNull()).select("source_file", "id", "line", each.alias("formula"))
    right = F.regexp_extract("formula", r"^[^=]*=(.*)$", 1)
    return rows.select("source_file", "id", "line", F.trim(F.substring_index("formula", "=", 1)).alias("lhs"), F.trim(F.substring_index(right, ";", 1)).alias("rhs"), F.when(F.contains(right, F.lit(";")), F.trim(F.substring_index(right, ";", -1))).alias("flags"))


def attachment_gaps(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Both ways: attachments without a file, and files that nothing links to."""
    missing = attachments.join(files, "path", "left_anti").select("path", F.lit("missing").alias("status"))
    orphan = files.join(attachments, "path", "left_anti").select("path", F.lit("orphan").alias("status"))
    return missing.union(orphan)


def export_kept(rows: DataFrame, exclude: tuple[str, ...] = ("noexport",), select: tuple[str, ...] = ()) -> DataFrame:
    """Sections that an export keeps: no COMMENT, archived or excluded one or anything below it; if any section of a document has a select tag, those that have one and all above them."""
    low = lambda c: F.transform(c, lambda t: F.lower(t))
    document = Window.partitionBy("source_file")
    so_far = lambda order: document.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Sections nest, so one is below another if it begins after the other's begin and before its end: running extremes find that in one pass over a document.
    bad = F.col("is_comment") | F.col("archived") | F.arrays_overlap(low("tags"), F.array(*map(F.lit, exclude)))
    gone_until = F.max(F.when(bad, F.col("range_end"))).over(so_far("range_start"))
    left = rows.withColumn("_gone", F.coalesce(gone_until > F.col("range_start"), F.lit(False))).where("not _gone").drop("_gone")
    if not select:
        return left
    chosen = F.arrays_overlap(low("effective_tags"), F.array(*map(F.lit, select)))
    following = F.min(F.when(chosen, F.col("range_start"))).over(so_far(F.desc("range_start")))
    left = left.withColumns({"_holds": F.coalesce(following < F.col("range_end"), F.lit(False)), "_any": F.max(F.when(chosen, True)).over(document)})
    return left.where("_holds or _any is null").drop("_holds", "_any")
