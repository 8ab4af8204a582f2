"""Publishing and dependency views of parsed documents: includes, keywords, citations, crypt states, tag groups, options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.records import p

#: Keywords of an export's settings.
PUBLISHING = ("TITLE", "AUTHOR", "DATE", "EMAIL", "LANGUAGE", "OPTIONS", "EXPORT_FILE_NAME", "SELECT_TAGS", "EXCLUDE_TAGS", "BIND", "DESCRIPTION", "KEYWORDS", "SUBTITLE")


def keywords(elements: DataFrame, *names: str) -> DataFrame:
    """Keyword lines (source_file, line, range_start, key, value), all or some."""
    rows = elements.where("kind = 'keyword'").select("source_file", "line", "range_start", p("key").alias("key"), p("value").alias("value"))
    return rows.where(F.col("key").isin(*names)) if names else rows


def includes(elements: DataFrame) -> DataFrame:
    """Include lines: path, mode, first and last line, minimum level."""
    v = F.col("value")
    path = F.regexp_replace(F.regexp_extract(v, r'^("[^"]*"|\S+)', 1), '"', "")
    rest = F.trim(F.regexp_replace(v, r'^("[^"]*"|\S+)', ""))
    mode = F.regexp_extract(rest, r"^(src|example|export|verse|quote)\b", 1)
    number = lambda pattern: F.regexp_extract(rest, pattern, 1).try_cast("int")
    return keywords(elements, "INCLUDE").select("source_file", "line", "range_start", F.substring_index(path, "::", 1).alias("path"), F.when(mode == "", "org").otherwise(mode).alias("mode"), number(r':lines "?(\d*)-').alias("first_line"), number(r':lines "?\d*-(\d*)').alias("last_line"), number(r":minlevel (\d+)").alias("minlevel"))


def dependencies(elements: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) of includes, setup files and bibliographies."""
    inc = includes(elements).select(F.col("source_file").alias("src"), F.col("path").alias("dst"), F.lit("includes").alias("kind"))
    one = lambda key, kind: keywords(elements, key).select(F.col("source_file").alias("src"), F.regexp_replace("value", '"', "").alias("dst"), F.lit(kind).alias("kind"))
    return inc.union(one("SETUPFILE", "usesSetupFile")).union(one("BIBLIOGRAPHY", "usesBibliography")).distinct()


def publishing(elements: DataFrame) -> DataFrame:
    """Settings of an export, and ATTR_ lines with their back end."""
    rows = keywords(elements)
    return rows.where(F.col("key").isin(*PUBLISHING) | F.startswith("key", F.lit("ATTR_"))).withColumn("backend", F.when(F.startswith("key", F.lit("ATTR_")), F.lower(F.substring("key", 6, 40))))


def options(elements: DataFrame) -> DataFrame:
    """Single settings of OPTIONS lines, key:value."""
    each = F.explode(F.regexp_extract_all("value", F.lit(r"(\S+?:\S+)"), F.lit(1)))
    return keywords(elements, "OPTIONS").select("source_file", "line", each.alias("pair")).select("source_file", "line", F.substring_index("pair", ":", 1).alias("option"), F.expr("substring(pair, instr(pair, ':') + 1)").alias("setting"))


def citations(elements: DataFrame) -> DataFrame:
    """Citation keys with whether their document names a bibliography."""
    used = elements.where("kind = 'citation'").select("source_file", "range_start", F.explode(F.regexp_extract_all(p("value"), F.lit(r"@([\w:.#$%&+?<>~/-]+)"), F.lit(1))).alias("key"))
    known = keywords(elements, "BIBLIOGRAPHY").select("source_file").distinct().withColumn("has_bibliography", F.lit(True))
    return used.join(known, "source_file", "left").withColumn("has_bibliography", F.coalesce("has_bibliography", F.lit(False)))


def tag_groups(elements: DataFrame) -> DataFrame:
    """(source_file, tag_group, member) of TAGS lines: [ G : a b ] and { G : a b }."""
    group = F.explode(F.regexp_extract_all("value", F.lit(r"[\[{]\s*([^\[\]{}]+?)\s*[\]}]"), F.lit(1)))
    rows = keywords(elements, "TAGS").select("source_file", group.alias("g")).where(F.contains("g", F.lit(" : ")))
    return rows.select("source_file", F.trim(F.substring_index("g", " : ", 1)).alias("tag_group"), F.explode(F.split(F.trim(F.substring_index("g", " : ", -1)), r"\s+")).alias("member"))


def crypt_states(elements: DataFrame) -> DataFrame:
    """Headlines of the crypt tag, own or inherited: whether the body is encrypted, and a key without a tag."""
    heads = elements.where("kind = 'headline'")
    all_tags, own = F.split(p("ALLTAGS"), ":"), F.split(p("TAGS"), ":")
    rows = heads.withColumns({"tagged": F.array_contains(all_tags, "crypt"), "direct": F.array_contains(own, "crypt"), "key": F.coalesce(p("CRYPTKEY"), p("inherited:CRYPTKEY"))})
    sealed = F.contains("source_raw", F.lit("-----BEGIN PGP MESSAGE-----"))
    warning = F.when(F.col("key").isNotNull() & ~F.col("tagged"), "keyWithoutTag").when(F.col("tagged") & ~sealed, "plainBody")
    return rows.where(F.col("tagged") | F.col("key").isNotNull()).select("source_file", "id", F.when(F.col("direct"), "direct").when(F.col("tagged"), "inherited").alias("tag"), sealed.alias("encrypted"), warning.alias("warning"))


def property_values(elements: DataFrame) -> DataFrame:
    """Values outside a document's or headline's KEY_ALL list."""
    allowed = elements.where("kind = 'node-property'").where(F.endswith(F.upper(p("key")), F.lit("_ALL"))).select("source_file", F.regexp_replace(F.upper(p("key")), "_ALL$", "").alias("key"), F.split(p("value"), r"\s+").alias("allowed")).dropDuplicates(["source_file", "key"])
    used = elements.where("kind = 'node-property'").select("source_file", "line", F.upper(p("key")).alias("key"), p("value").alias("value"))
    return used.join(allowed, ["source_file", "key"]).where(~F.array_contains("allowed", F.col("value"))).drop("allowed")
