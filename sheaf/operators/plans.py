"""Plans and record sets that say what would be done, and never do it: refiling, capture, evaluation, choices, feeds, radio links, search packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.org_text import timers
from sheaf.functions.text import ascii_lower
from sheaf.operators import records


def _p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def refile_plan(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, path array<string>) with the headline of that outline path: resolved, notFound or ambiguous."""
    known = sections.groupBy(F.col("outline_path").alias("path")).agg(F.count("*").alias("n"), F.min("section_id").alias("section_id"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("notFound")
    return requests.join(known, "path", "left").select("request", "path", status.alias("status"), F.when(F.col("n") == 1, F.col("section_id")).alias("section_id"))


def capture_plan(requests: DataFrame) -> DataFrame:
    """Requests (request, level, todo, title, tags array, body) as Org text and whether they can be kept: a title of one line, tags of letters."""
    bad = F.when(F.trim("title") == "", "emptyTitle").when(F.contains("title", F.lit("\n")), "titleOfSeveralLines").when(F.exists("tags", lambda t: ~F.regexp(t, F.lit(r"^[\w@#%]+$"))), "badTag")
    head = F.concat(F.repeat(F.lit("*"), F.col("level")), F.lit(" "), F.coalesce(F.concat("todo", F.lit(" ")), F.lit("")), F.trim("title"), F.when(F.size("tags") > 0, F.concat(F.lit(" :"), F.array_join("tags", ":"), F.lit(":"))).otherwise(""))
    text = F.concat(head, F.lit("\n"), F.when(F.coalesce(F.trim("body"), F.lit("")) != "", F.concat(F.trim("body"), F.lit("\n"))).otherwise(""))
    return requests.withColumns({"status": F.coalesce(bad, F.lit("ready")), "entry": F.when(bad.isNull(), text)})


def evaluation_plan(elements: DataFrame, names: DataFrame) -> DataFrame:
    """For each (source_file, name) the source block it means: ready with its language and text, emptyName, notFound or ambiguous; nothing is run."""
    blocks = elements.where("kind = 'src-block' and affiliated_name is not null").groupBy("source_file", F.trim("affiliated_name").alias("name")).agg(F.count("*").alias("n"), F.min_by(F.struct(_p("language").alias("language"), _p("value").alias("value")), "ordinal").alias("block"))
    status = F.when(F.trim("name") == "", "emptyName").when(F.col("n").isNull(), "notFound").when(F.col("n") > 1, "ambiguous").otherwise("ready")
    return names.join(blocks, ["source_file", "name"], "left").select("source_file", "name", status.alias("status"), F.when(status == "ready", F.col("block.language")).alias("language"), F.when(status == "ready", F.col("block.value")).alias("value"))


def result_patch(elements: DataFrame, results: DataFrame) -> DataFrame:
    """Where the result of a named block goes: (source_file, at, stop, text) replaces those bytes, after the block, or the RESULTS line and the lines of ``: `` below it."""
    blocks = elements.where("kind = 'src-block' and affiliated_name is not null").select("source_file", F.col("affiliated_name").alias("name"), F.col("range_end").alias("after"))
    old = elements.where("kind = 'keyword'").where(_p("key") == "RESULTS").select("source_file", "range_start", F.col("end_line").alias("line"))
    fixed = elements.where("kind = 'fixed-width'").select("source_file", F.col("line"), F.col("range_start").alias("f_start"), F.col("range_end").alias("f_end"))
    rows = results.join(blocks, ["source_file", "name"])
    near = rows.join(old, "source_file", "left").where(F.col("range_start").isNull() | (F.col("range_start") >= F.col("after")))
    first = near.groupBy("source_file", "name", "result", "after").agg(F.min_by(F.struct("range_start", "line"), "range_start").alias("old"))
    first = first.select("source_file", "name", "result", "after", F.col("old.range_start").alias("at"), (F.col("old.line") + 1).alias("line"))
    out = first.join(fixed, ["source_file", "line"], "left")
    here = F.col("at").isNotNull() & F.col("f_end").isNotNull()
    body = F.concat(F.lit("#+RESULTS: "), "name", F.lit("\n"), F.array_join(F.transform(F.split(F.rtrim("result"), "\n"), lambda x: F.concat(F.lit(": "), x)), "\n"), F.lit("\n"))
    return out.select("source_file", "name", F.when(here, F.col("at")).otherwise(F.col("after")).alias("at"), F.when(here, F.col("f_end")).otherwise(F.col("after")).alias("stop"), F.when(here, body).otherwise(F.concat(F.lit("\n"), body)).alias("text"))


def choices(elements: DataFrame) -> DataFrame:
    """The rows of tables named ``choice...``: (source_file, table, place, label, value), headers aside."""
    tables = elements.where("kind = 'table'").where(F.startswith("affiliated_name", F.lit("choice"))).select("source_file", F.col("id").alias("table_id"), F.col("affiliated_name").alias("table"), _p("header").isNotNull().alias("has_header"))
    rows = elements.where("kind = 'table-row'").where(_p("type") == "standard").select("source_file", F.col("id").alias("row_id"), F.col("parent_id").alias("table_id"))
    cells = elements.where("kind = 'table-cell'").select("source_file", F.col("parent_id").alias("row_id"), _p("column").cast("int").alias("column"), _p("value").alias("value"))
    wide = cells.groupBy("source_file", "row_id").agg(F.max(F.when(F.col("column") == 0, F.col("value"))).alias("label"), F.max(F.when(F.col("column") == 1, F.col("value"))).alias("value"))
    w = Window.partitionBy("source_file", "table_id").orderBy("row_id")
    out = rows.join(tables, ["source_file", "table_id"]).withColumn("place", F.row_number().over(w) - F.when(F.col("has_header"), 2).otherwise(1)).where("place >= 0")
    return out.join(wide, ["source_file", "row_id"]).select("source_file", "table", F.col("place").cast("long").alias("place"), "label", "value")


def runtime_metadata(elements: DataFrame) -> DataFrame:
    """(source_file, kind, line, detail, n): timers of headlines and items, FEEDSTATUS drawers with their entries (-1 if they can't be read), flagged headlines, original ids."""
    stamps = elements.where("kind in ('headline', 'item')").select("source_file", "line", F.explode(timers(F.substring_index("source_raw", "\n", 1))).alias("t"))
    feeds = elements.where("kind = 'drawer'").where(F.upper(_p("name")) == "FEEDSTATUS").withColumn("body", F.regexp_extract("source_raw", r"(?s)^[^\n]*\n(.*)\n[^\n]*\n?$", 1))
    opened, closed = (F.length(F.regexp_replace("body", rf"[^{c}]", "")) for c in ("(", ")"))
    entries = F.size(F.regexp_extract_all("body", F.lit(r'(\("[^"]*")'), F.lit(1)))
    heads = elements.where("kind = 'headline'")
    flagged = heads.where(F.array_contains(F.split(_p("ALLTAGS"), ":"), "FLAGGED"))
    none = F.lit(0).cast("long")
    parts = [
        stamps.select("source_file", F.lit("timer").alias("kind"), "line", F.col("t.raw").alias("detail"), F.col("t.seconds").alias("n")),
        feeds.select("source_file", F.lit("feed").alias("kind"), "line", F.lit(None).cast("string").alias("detail"), F.when(opened == closed, entries).otherwise(-1).cast("long").alias("n")),
        flagged.select("source_file", F.lit("flagged").alias("kind"), "line", _p("title").alias("detail"), none.alias("n")),
        heads.where(_p("ORIGINAL_ID").isNotNull()).select("source_file", F.lit("originalId").alias("kind"), "line", _p("ORIGINAL_ID").alias("detail"), none.alias("n")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def radio_links(elements: DataFrame) -> DataFrame:
    """(source_file, id, at, target): places in paragraphs where a radio target of the document stands as whole words, the longest at each place, found once from left to right.

    The targets of a document travel to its paragraphs as one pattern, longest first.
    """
    quoted = lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))
    found = elements.where("kind = 'radio-target'").select("source_file", F.trim(_p("value")).alias("target")).where("target <> ''").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("target")).alias("n"), "target"))), lambda x: quoted(x["target"]))
    patterns = found.groupBy("source_file").agg(F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_<])("), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}_>])")).alias("pattern"))
    text = elements.where("kind = 'paragraph'").join(patterns, "source_file")
    hits = F.regexp_extract_all("source_raw", F.col("pattern"), F.lit(1))
    return text.select("source_file", "id", F.posexplode(hits).alias("at", "target"))


def link_descriptions(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with the text to show: their own description, else the title of the headline that the path names (title, #CUSTOM_ID, id:ID; the first counts), else the path."""
    of = lambda key: F.try_element_at("properties", F.lit(key))
    keys = F.array_compact(F.array(F.concat(F.lit("*"), "title"), F.col("title"), F.concat(F.lit("#"), of("CUSTOM_ID")), F.concat(F.lit("id:"), of("ID"))))
    names = sections.select("source_file", F.explode(keys).alias("path"), "title", "range_start").groupBy("source_file", "path").agg(F.min_by("title", "range_start").alias("alias"))
    return links.join(names, ["source_file", "path"], "left").withColumn("shown", F.coalesce("description", "alias", "path")).drop("alias")


def prescan(documents: DataFrame) -> DataFrame:
    """(source_file, key, value, at): keyword lines of documents, before any parsing, in the JVM."""
    keys = "TITLE|FILETAGS|TAGS|OPTIONS|LINK|INCLUDE|MACRO|ARCHIVE|TODO|SEQ_TODO|TYP_TODO|PROPERTY|BIBLIOGRAPHY|SETUPFILE"
    lines = documents.select("source_file", F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(F.startswith(F.ltrim("raw"), F.lit("#+")))
    part = lambda i: F.regexp_extract("raw", rf"(?i)^\s*#\+({keys}):\s*(.*?)\s*$", i)
    return lines.withColumns({"key": F.upper(part(1)), "value": part(2)}).where("key <> ''").select("source_file", "key", "value", "at")


def document_predicate(kind: str, value: str) -> Column:
    """A test of a document by its path or its metadata (``source_file``, and ``keys``, the keywords it has)."""
    name = F.substring_index("source_file", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    tests = {
        "MetadataExists": lambda: F.array_contains("keys", value.upper()), "SourcePathEquals": lambda: F.col("source_file") == value, "SourcePathContains": lambda: F.contains("source_file", F.lit(value)),
        "SourceFilenameEquals": lambda: name == value, "SourceFilenamePrefix": lambda: F.startswith(name, F.lit(value)), "SourceFilenameSuffix": lambda: F.endswith(name, F.lit(value)), "SourceFilenameStemUppercase": lambda: F.upper(stem) == stem,
    }
    return tests[kind]()


def selected(elements: DataFrame, selector: str) -> DataFrame:
    """The elements of org://path#kind/id, or those that lie in the lines of path:first-last."""
    if selector.startswith("org://"):
        path, _, rest = selector[6:].partition("#")
        kind, _, number = rest.partition("/")
        out = elements.where(F.col("source_file") == path)
        out = out.where(F.col("kind") == kind) if kind else out
        return out.where(F.col("id") == int(number)) if number else out
    path, _, lines = selector.rpartition(":")
    first, _, last = lines.partition("-")
    return elements.where((F.col("source_file") == path) & (F.col("line") >= int(first)) & (F.col("end_line") <= int(last or first)))


def shadowed(facts: DataFrame) -> DataFrame:
    """Facts (path, kind, content, line, end_line) without those that repeat others: a paragraph inside an item that has content, a list with such an item, a fact equal to an earlier one."""
    items = facts.where("kind in ('listItem', 'checklistItem') and trim(coalesce(content, '')) <> ''").select(F.col("path"), F.col("line").alias("i_first"), F.col("end_line").alias("i_last"))
    paragraphs, lists = facts.where("kind = 'paragraph'"), facts.where("kind = 'list'")
    apart = paragraphs.join(items, (paragraphs["path"] == items["path"]) & (items["i_first"] <= paragraphs["line"]) & (paragraphs["end_line"] <= items["i_last"]), "left_anti")
    bare = lists.join(items, (lists["path"] == items["path"]) & (lists["line"] <= items["i_first"]) & (items["i_last"] <= lists["end_line"]), "left_anti")
    rest = facts.where("kind not in ('paragraph', 'list')").unionByName(apart).unionByName(bare)
    w = Window.partitionBy("path", "kind", "content").orderBy("line", "end_line")
    return rest.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def fuzzy(rows: DataFrame, text: Column, pattern: str, limit: int = 50) -> DataFrame:
    """Rows whose text has the letters of each word of a pattern in order, the closest first: by the length of the shortest run that holds them, then the text."""
    score = F.lit(0)
    for word in pattern.lower().split():
        run = ".*?".join("\\Q" + c + "\\E" for c in word)
        found = F.regexp_extract_all(ascii_lower(text), F.lit(f"(?=({run}))"), F.lit(1))
        best = F.array_min(F.transform(found, lambda x: F.length(x)))
        rows = rows.withColumn("_run", best).where("_run is not null")
        rows = rows.withColumn("_score", (F.col("_score") if "_score" in rows.columns else score) + F.col("_run")).drop("_run")
    rows = rows if "_score" in rows.columns else rows.withColumn("_score", score)
    return rows.withColumnRenamed("_score", "score").orderBy("score", text).limit(limit)


def elements_json(elements: DataFrame) -> DataFrame:
    """(source_file, json): a document as one JSON text: all its elements in order, and its source blocks.  A document is what one row holds."""
    element = F.struct("ordinal", "id", "parent_id", "category", "kind", "affiliated_name", "outline_path", "context", "properties", "line", "end_line", "range_start", "range_end")
    every = elements.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(element).alias("json")))).alias("all"), F.array_sort(F.collect_list(F.when(F.col("kind") == "src-block", F.col("ordinal")))).alias("blocks"))
    return every.select("source_file", F.concat(F.lit('{"elements":['), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit('],"sourceBlocks":'), F.to_json("blocks"), F.lit("}")).alias("json"))


def search_packet(elements: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """(source_file, json): of each of the first documents by path that has hits, their number, the facts by kind, and where the hits are."""
    hits = elements.where(F.contains(ascii_lower(F.col("source_raw")), F.lit(query.translate({i: i + 32 for i in range(65, 91)})))).where("category <> 'document'")
    kinds = hits.groupBy("source_file", "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))
    out = kinds.groupBy("source_file").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("kind", "n", "lines"))).alias("kinds"))
    return out.orderBy("source_file").limit(limit).select("source_file", F.to_json(F.struct("n", "kinds")).alias("json"))


def evaluation_json(evaluated: DataFrame) -> DataFrame:
    """(source_file, json): the assertions of a contract over each document, with their counts, and whether all hold."""
    rows = evaluated.groupBy("source_file").agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.struct("assertion", "count", "ok"))).alias("assertions"))
    return rows.select("source_file", F.to_json(F.struct("ok", "assertions")).alias("json"))


def attachment_table(elements: DataFrame) -> DataFrame:
    """Headlines with the folder of their attachments."""
    from sheaf.functions.org_text import attachment_folder

    s = records.sections(elements)
    at = lambda k: F.coalesce(F.try_element_at("properties", F.lit(k)), F.try_element_at("properties", F.lit(f"inherited:{k}")))
    return s.select("source_file", "section_id", attachment_folder(at("DIR"), at("ATTACH_DIR"), at("ID")).alias("folder")).where("folder is not null")
