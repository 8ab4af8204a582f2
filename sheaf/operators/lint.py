"""Validation rules over parsed elements, one union of findings: (code, severity, source_file, line, range_start, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.functions.dates import duration_seconds
from sheaf.operators import export_graph, lint_blocks, lint_progress, lint_sdd, records, schemas
from sheaf.operators.stored import kept, kept_union

#: Keys of which a drawer may have several.
REPEATABLE = ("CONTRACT_ORG",)
#: Keys taken for EFFORT, and answers to an option.
EFFORT_TYPOS = ("EFORT", "EFFORTS", "EFFORTT")
YES_OR_NO = ("t", "true", "yes", "nil", "false", "no")
#: What the rules read: elements of these kinds, and all that have a name; of the source, that of drawers, tables and encrypted sections.
KINDS = ("org-data", "headline", "keyword", "property-drawer", "node-property", "drawer", "plain-list", "item", "table", "src-block", "babel-call", "inline-babel-call", "macro", "link", "target", "radio-target")
COLUMNS = ("source_file", "id", "parent_id", "ancestor_ids", "kind", "affiliated_name", "properties", "line", "range_start")


def _p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def _finding(rows: DataFrame, code: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "source_file", "line", "range_start", message.alias("message"))


def _nth(rows: DataFrame, keys: list[str], place: int) -> DataFrame:
    """The ``place``-th row of each key that has two or more; keys are within one document, so groups are bounded by it."""
    w = Window.partitionBy("source_file", *keys)
    return rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("range_start"))).where((F.col("_n") > 1) & (F.col("_i") == place))


def duplicate_targets(e: DataFrame) -> DataFrame:
    """ORG002: a target key defined twice, found at its first definition."""
    own = e.where(F.col("kind").isin("target", "radio-target")).select("source_file", "line", "range_start", _p("value").alias("key"), F.lit("warning").alias("severity"))
    ids = e.where("kind = 'headline'").select("source_file", "line", "range_start", F.explode(F.array_compact(F.array(F.concat(F.lit("#"), _p("CUSTOM_ID")), F.concat(F.lit("id:"), _p("ID"))))).alias("key"), F.lit("error").alias("severity"))
    rows = _nth(own.union(ids), ["key"], 1)
    return rows.select(F.lit("ORG002").alias("code"), "severity", "source_file", "line", "range_start", F.concat(F.lit("duplicate target "), "key").alias("message"))


def duplicate_macros(e: DataFrame) -> DataFrame:
    """ORG008, at the second definition."""
    rows = e.where("kind = 'keyword'").where(_p("key") == "MACRO").withColumn("name", F.split(_p("value"), r"\s+")[0])
    return _finding(_nth(rows, ["name"], 2), "ORG008", "warning", F.concat(F.lit("duplicate macro "), "name"))


def missing_macros(e: DataFrame) -> DataFrame:
    """ORG004: a macro that its document doesn't define."""
    known = e.where("kind = 'keyword'").where(_p("key") == "MACRO").select("source_file", F.split(_p("value"), r"\s+")[0].alias("name")).distinct()
    used = e.where("kind = 'macro'").withColumn("name", _p("name"))
    return _finding(used.join(known, ["source_file", "name"], "left_anti"), "ORG004", "warning", F.concat(F.lit("missing macro "), "name"))


def bad_priorities(e: DataFrame) -> DataFrame:
    """ORG010: a priority cookie beyond A to Z and 0 to 64."""
    raw = F.regexp_extract(_p("raw"), r"\[#([^\]]*)\]", 1)
    ok = F.regexp(raw, F.lit(r"^([A-Z]|\d|[1-5]\d|6[0-4])$"))
    return _finding(e.where("kind = 'headline'").where((F.regexp_extract(_p("raw"), r"\[#([^\]]*)\]", 0) != "") & ~ok), "ORG010", "warning", F.concat(F.lit("bad priority "), raw))


def bad_efforts(e: DataFrame) -> DataFrame:
    """ORG011: an EFFORT that is no duration."""
    rows = e.where("kind = 'node-property'").where((F.upper(_p("key")) == "EFFORT") & duration_seconds(_p("value")).isNull())
    return _finding(rows, "ORG011", "warning", F.concat(F.lit("bad effort "), _p("value")))


def duplicate_properties(e: DataFrame) -> DataFrame:
    """ORG012: a key twice in one drawer, at the second."""
    rows = e.where("kind = 'node-property'").withColumn("key", F.upper(_p("key"))).where(~F.col("key").isin(*REPEATABLE))
    return _finding(_nth(rows, ["parent_id", "key"], 2), "ORG012", "warning", F.concat(F.lit("duplicate property "), "key"))


def duplicate_blocks(e: DataFrame) -> DataFrame:
    """ORG020: two source blocks of one name, at the second."""
    rows = e.where("kind = 'src-block' and affiliated_name is not null").withColumn("name", F.lower(F.trim("affiliated_name")))
    return _finding(_nth(rows, ["name"], 2), "ORG020", "warning", F.concat(F.lit("duplicate block "), "name"))


def _keywords(e: DataFrame, *names: str) -> DataFrame:
    return e.where("kind = 'keyword'").where(_p("key").isin(*names)).withColumn("value", F.trim(F.coalesce(_p("value"), F.lit(""))))


def _links_defined(e: DataFrame) -> DataFrame:
    parts = F.split("value", r"\s+", 2)
    return _keywords(e, "LINK").withColumns({"name": F.lower(parts[0]), "to": F.get(parts, 1)})


def malformed_links(e: DataFrame) -> DataFrame:
    """ORG005: a LINK line without a name or a replacement."""
    return _finding(_links_defined(e).where(F.col("to").isNull() | (F.col("to") == "")), "ORG005", "warning", F.lit("LINK needs a name and a replacement"))


def duplicate_links(e: DataFrame) -> DataFrame:
    """ORG006: a link abbreviation defined twice, in any case, at the second."""
    return _finding(_nth(_links_defined(e).where("to <> ''"), ["name"], 2), "ORG006", "warning", F.concat(F.lit("duplicate link abbreviation "), "name"))


def bad_options(e: DataFrame) -> DataFrame:
    """ORG007: H without a number, or - or e without a yes or no."""
    rows = _keywords(e, "OPTIONS").withColumn("token", F.explode(F.split("value", r"\s+"))).where(F.contains("token", F.lit(":")))
    rows = rows.withColumns({"key": F.regexp_extract("token", "^([^:]*):", 1), "setting": F.regexp_extract("token", "^[^:]*:(.*)$", 1)})
    bad = ((F.col("key") == "H") & ~F.regexp("setting", F.lit(r"^\+?\d+$"))) | (F.col("key").isin("-", "e") & ~F.lower("setting").isin(*YES_OR_NO))
    return _finding(rows.where(bad), "ORG007", "warning", F.concat(F.lit("unsupported option "), "token"))


def duplicate_todo_keywords(e: DataFrame) -> DataFrame:
    """ORG009: one finding for each declaration of a TODO keyword after its first."""
    rows = _keywords(e, "TODO", "SEQ_TODO", "TYP_TODO").select("source_file", "line", "range_start", F.posexplode(F.split("value", r"\s+")).alias("at", "word"))
    rows = rows.withColumn("name", F.regexp_replace("word", r"\(.*\)$", "")).where(~F.col("name").isin("", "|"))
    w = Window.partitionBy("source_file", "name").orderBy("range_start", "at")
    return _finding(rows.withColumn("_i", F.row_number().over(w)).where("_i > 1"), "ORG009", "warning", F.concat(F.lit("TODO keyword declared again: "), "name"))


def property_typos(e: DataFrame) -> DataFrame:
    """ORG013: a property key that is nearly EFFORT."""
    rows = e.where("kind = 'node-property'").where(F.upper(_p("key")).isin(*EFFORT_TYPOS))
    return _finding(rows, "ORG013", "warning", F.concat(F.lit("property key looks like EFFORT: "), _p("key")))


def malformed_logbook(e: DataFrame) -> DataFrame:
    """ORG014: a state line without two quoted states, or a clock line whose duration is none, in a LOGBOOK."""
    rows = e.where("kind = 'drawer'").where(F.upper(_p("name")) == "LOGBOOK").select("source_file", "range_start", F.col("line").alias("top"), F.posexplode(F.split("source_raw", "\n")).alias("at", "raw"))
    rows = rows.withColumns({"line": F.col("top") + F.col("at"), "text": F.regexp_replace(F.trim("raw"), r"^-\s*", "")})
    state = F.startswith("text", F.lit("State ")) & (F.size(F.regexp_extract_all("text", F.lit(r'"([^"]*)"'), F.lit(1))) < 2)
    clock = F.startswith("text", F.lit("CLOCK:")) & F.contains("text", F.lit("=>")) & duration_seconds(F.trim(F.substring_index("text", "=>", -1))).isNull()
    return _finding(rows.where(state | clock), "ORG014", "warning", F.concat(F.lit("malformed LOGBOOK line: "), "text"))


def _archives(e: DataFrame) -> DataFrame:
    """Archive locations of keywords and properties, as file and heading."""
    columns = ["source_file", "line", "range_start", "value"]
    own = e.where("kind = 'node-property'").where(F.upper(_p("key")) == "ARCHIVE").withColumn("value", F.trim(F.coalesce(_p("value"), F.lit(""))))
    rows = _keywords(e, "ARCHIVE").select(columns).union(own.select(columns))
    heading = F.when(F.contains("value", F.lit("::")), F.regexp_replace(F.trim(F.substring_index("value", "::", -1)), r"^\*+\s*", "")).otherwise("")
    return rows.withColumns({"file": F.trim(F.substring_index("value", "::", 1)), "heading": heading})


def empty_archives(e: DataFrame) -> DataFrame:
    """ORG015: an archive location that names neither a file nor a heading."""
    return _finding(_archives(e).where("file = '' and heading = ''"), "ORG015", "warning", F.lit("empty archive destination"))


def blocked_tasks(e: DataFrame) -> DataFrame:
    """ORG029: an open task below a headline that is ORDERED by a property of its own, after an open sibling."""
    heads = e.where("kind = 'headline'")
    ordered = heads.where(F.lower(F.trim(_p("ORDERED"))).isin("t", "true", "yes", "1")).select("source_file", F.col("id").alias("parent_id"))
    tasks = heads.join(ordered, ["source_file", "parent_id"], "left_semi").where(_p("todo-type") == "todo")
    rows = tasks.withColumn("blocker", F.lag(_p("title")).over(Window.partitionBy("source_file", "parent_id").orderBy("range_start"))).where("blocker is not null")
    return _finding(rows, "ORG029", "warning", F.concat(F.lit("blocked by the open task before it: "), "blocker"))


def disallowed_values(e: DataFrame) -> DataFrame:
    """ORG030: a value outside the KEY_ALL list of its headline, of one above, or of the file; the nearest counts."""
    lists = F.exists(F.map_keys("properties"), lambda k: F.endswith(k, F.lit("_ALL")))
    listing = e.where(F.col("kind").isin("headline", "org-data")).where(lists).select("source_file").distinct()
    own = e.where("kind = 'node-property'").where(F.trim(F.coalesce(_p("value"), F.lit(""))) != "").join(listing, "source_file", "left_semi")
    drawers = e.where("kind = 'property-drawer'").select("source_file", F.col("id").alias("parent_id"), F.col("parent_id").alias("section_id"))
    heads = e.where("kind = 'headline'").select("source_file", F.col("id").alias("section_id"), F.col("properties").alias("of"))
    files = e.where("kind = 'org-data'").select("source_file", F.col("properties").alias("of_file"))
    rows = own.join(drawers, ["source_file", "parent_id"]).join(heads, ["source_file", "section_id"]).join(files, "source_file").withColumn("key", F.upper(_p("key"))).where(~F.endswith("key", F.lit("_ALL")))
    at = lambda of, prefix: F.try_element_at(of, F.concat(F.lit(prefix), "key", F.lit("_ALL")))
    allowed = F.coalesce(at("of", ""), at("of", "inherited:"), at("of_file", ""))
    values = F.regexp_extract_all(allowed, F.lit(r'"([^"]*)"|(\S+)'), F.lit(0))
    bad = allowed.isNotNull() & ~F.array_contains(F.transform(values, lambda v: F.trim(v, F.lit('"'))), _p("value"))
    return _finding(rows.where(bad), "ORG030", "warning", F.concat(F.lit("value not allowed: "), "key"))


def opaque_bodies(e: DataFrame) -> DataFrame:
    """ORG038: a section with a crypt tag whose body is encrypted."""
    states = export_graph.crypt_states(e).where("tag is not null and encrypted").select("source_file", "id")
    return _finding(e.join(states, ["source_file", "id"], "left_semi"), "ORG038", "warning", F.lit("the body is encrypted"))


def keys_without_tag(e: DataFrame) -> DataFrame:
    """ORG039: CRYPTKEY without a crypt tag."""
    states = export_graph.crypt_states(e).where("warning = 'keyWithoutTag'").select("source_file", "id")
    return _finding(e.join(states, ["source_file", "id"], "left_semi"), "ORG039", "warning", F.lit("CRYPTKEY without a crypt tag"))


# Rules that need to know which files there are: ``files`` (path), as the documents name them.


def _local(path: Column) -> Column:
    return ~F.contains(path, F.lit("://")) & ~F.startswith(path, F.lit("~")) & ~F.startswith(path, F.lit("/ssh:")) & ~F.startswith(path, F.lit("/scp:"))


def _absent(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose local ``file`` is not there."""
    return rows.where(_local(F.col("file"))).join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti")


def missing_includes(e: DataFrame, files: DataFrame) -> DataFrame:
    """ORG003: an included file that is not there."""
    quoted, bare = F.regexp_extract("value", '^"([^"]*)"', 1), F.regexp_extract("value", r"^(\S+)", 1)
    rows = _keywords(e, "INCLUDE").withColumn("file", F.substring_index(F.when(quoted != "", quoted).otherwise(bare), "::", 1)).where("file <> ''")
    return _finding(_absent(rows, files), "ORG003", "warning", F.concat(F.lit("included file not found: "), "file"))


def attachments(e: DataFrame) -> DataFrame:
    """Attachment links with the directory of their headline (DIR before ATTACH_DIR before ID, own before inherited) and the file in it."""
    rows = records._nearest(e.where("kind = 'link'").where(F.startswith(_p("path"), F.lit("attachment:"))), e)
    heads = e.where("kind = 'headline'").select("source_file", F.col("id").alias("section_id"), F.col("properties").alias("of"))
    at = lambda key: F.coalesce(F.try_element_at("of", F.lit(key)), F.try_element_at("of", F.lit(f"inherited:{key}")))
    directory = F.coalesce(at("DIR"), at("ATTACH_DIR"), F.concat(F.lit("data/"), text.id_folder(at("ID"))))
    name = F.substring_index(F.regexp_replace(_p("path"), "^attachment:", ""), "::", 1)
    return rows.join(heads, ["source_file", "section_id"], "left").withColumns({"directory": directory, "file": F.concat(F.regexp_replace(directory, "/$", ""), F.lit("/"), name)})


def missing_attachments(e: DataFrame, files: DataFrame) -> DataFrame:
    """ORG016: an attachment whose headline has no directory, or whose file is not there."""
    rows = attachments(e)
    none = _finding(rows.where("directory is null"), "ORG016", "warning", F.lit("attachment without a directory"))
    return none.union(_finding(_absent(rows.where("directory is not null"), files), "ORG016", "warning", F.concat(F.lit("attachment not found: "), "file")))


def missing_files(e: DataFrame, files: DataFrame) -> DataFrame:
    """ORG017: a file link without a path, or to a file that is not there."""
    rows = e.where("kind = 'link'").withColumn("path", _p("path")).where(F.regexp("path", F.lit(r"^(?i)(file(\+\w+)?:|\.{0,2}/|~/)")))
    rows = rows.withColumn("file", F.regexp_replace(F.trim(F.substring_index(F.regexp_replace("path", r"^(?i)file(\+\w+)?:", ""), "::", 1)), r"^\./", ""))
    empty = _finding(rows.where("file = ''"), "ORG017", "warning", F.lit("file link without a path"))
    return empty.union(_finding(_absent(rows.where("file <> ''"), files), "ORG017", "warning", F.concat(F.lit("file not found: "), "file")))


def _wanting(rows: DataFrame, e: DataFrame, files: DataFrame) -> DataFrame:
    """Destinations (file, heading) that are not there: no such file, or no such headline in it; no file means the document itself."""
    heads = e.where("kind = 'headline'").select(F.col("source_file").alias("_in"), F.trim(_p("raw")).alias("heading")).union(e.where("kind = 'headline'").select(F.col("source_file").alias("_in"), _p("title").alias("heading"))).distinct()
    known = files.select(F.col("path").alias("file")).distinct()
    rows = rows.where(_local(F.col("file")))
    gone = rows.where("file <> ''").join(known, "file", "left_anti")
    there = rows.where("file <> ''").join(known, "file", "left_semi").unionByName(rows.where("file = ''"))
    lost = there.where("heading <> ''").withColumn("_in", F.when(F.col("file") == "", F.col("source_file")).otherwise(F.col("file"))).join(heads, ["_in", "heading"], "left_anti")
    return gone.select("source_file", "line", "range_start", "file", "heading").union(lost.select("source_file", "line", "range_start", "file", "heading"))


def missing_archives(e: DataFrame, files: DataFrame) -> DataFrame:
    """ORG018: an archive destination whose file or headline is not there."""
    rows = _archives(e).where("file <> '' or heading <> ''")
    return _finding(_wanting(rows, e, files), "ORG018", "warning", F.concat(F.lit("archive destination not found: "), "file", F.lit("::"), "heading"))


def missing_refiles(e: DataFrame, files: DataFrame) -> DataFrame:
    """ORG019: a line of a LOGBOOK that says where a headline came from, when that file or headline is not there."""
    rows = e.where("kind = 'drawer'").where(F.upper(_p("name")) == "LOGBOOK").select("source_file", "range_start", F.col("line").alias("top"), F.posexplode(F.split("source_raw", "\n")).alias("at", "raw"))
    path = F.regexp_extract("raw", r"^\s*-?\s*Refiled on .*\[\[(?:file(?:\+\w+)?):([^\]]*)\]", 1)
    rows = rows.withColumns({"line": F.col("top") + F.col("at"), "to": path}).where("to <> ''")
    rows = rows.withColumns({"file": F.substring_index("to", "::", 1), "heading": F.when(F.contains("to", F.lit("::")), F.regexp_replace(F.trim(F.substring_index("to", "::", -1)), r"^\*+\s*", "")).otherwise("")})
    return _finding(_wanting(rows, e, files), "ORG019", "warning", F.concat(F.lit("refile destination not found: "), "file", F.lit("::"), "heading"))


def broken_schemas(e: DataFrame, known: list[schemas.Schema] = ()) -> DataFrame:
    """ORG040: a drawer that names a schema which is not known or which it does not keep."""
    return _finding(schemas.findings(e, list(known)), "ORG040", "warning", F.concat_ws(" ", "finding", "property"))


RULES = {
    "ORG002": duplicate_targets, "ORG004": missing_macros, "ORG005": malformed_links, "ORG006": duplicate_links, "ORG007": bad_options, "ORG008": duplicate_macros, "ORG009": duplicate_todo_keywords,
    "ORG010": bad_priorities, "ORG011": bad_efforts, "ORG012": duplicate_properties, "ORG013": property_typos, "ORG014": malformed_logbook, "ORG015": empty_archives, "ORG020": duplicate_blocks,
    "ORG029": blocked_tasks, "ORG030": disallowed_values, "ORG038": opaque_bodies, "ORG039": keys_without_tag, "ORG040": broken_schemas, **lint_blocks.RULES, **lint_progress.RULES, **lint_sdd.RULES,
}
#: Rules that ask whether files are there.
FILE_RULES = {"ORG003": missing_includes, "ORG016": missing_attachments, "ORG017": missing_files, "ORG018": missing_archives, "ORG019": missing_refiles}


def _read_by_rules(e: DataFrame) -> DataFrame:
    """What the rules read of the elements, stored in folders by kind."""
    sealed = (F.col("kind") == "headline") & F.contains("source_raw", F.lit("-----BEGIN PGP MESSAGE-----"))
    raw = F.when(F.col("kind").isin("drawer", "table") | sealed, F.col("source_raw")).otherwise("")
    return kept(e.where(F.col("kind").isin(*KINDS) | F.col("affiliated_name").isNotNull()).select(*COLUMNS, raw.alias("source_raw")), "kind")


def findings(elements: DataFrame, codes: list[str] | None = None, files: DataFrame | None = None, known_schemas: list[schemas.Schema] = ()) -> DataFrame:
    """All findings of some rules; those on files need ``files`` (path), and property schemas are looked up in ``known_schemas``.  Sort by source_file, range_start, code, message to print them.

    The elements are stored first, by kind, since every rule reads some of them; so are the findings of each
    rule before the next is planned, as a driver's memory grows with the plan of several, which Spark makes anew after every stage.
    """
    known = RULES | (FILE_RULES if files is not None else {})
    wanted = codes or list(known)
    more = {"ORG040": known_schemas} | dict.fromkeys(FILE_RULES, files)
    of = lambda code, rows: known[code](rows, more[code]) if code in more else known[code](rows)
    if len(wanted) == 1:
        return of(wanted[0], elements)
    rows = _read_by_rules(elements)
    return kept_union(elements.sparkSession, (of(code, rows) for code in wanted))


def rendered(found: DataFrame, form: str = "text") -> DataFrame:
    """(source_file, line, code, out): findings as ``text`` (path:line: severity code message), ``compact`` (code path:line) or ``json``."""
    out = {
        "text": F.format_string("%s:%d: %s %s %s", "source_file", "line", "severity", "code", "message"),
        "compact": F.format_string("%s %s:%d", "code", "source_file", "line"),
        "json": F.to_json(F.struct("code", "severity", "source_file", "line", "range_start", "message")),
    }[form]
    return found.select("source_file", "line", "code", out.alias("out"))
