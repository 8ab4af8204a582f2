"""Project search over document elements: terms, fields, kinds, tables of contents, owners, plan ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import ascii_lower, contains_terms


def document_elements(elements: DataFrame) -> DataFrame:
    """Search facts of parsed Org elements: kind, path, selector, lines, fields (keys may repeat), text, content."""
    kinds = {"headline": "heading", "paragraph": "paragraph", "node-property": "property", "planning": "planning", "table": "table", "src-block": "block", "example-block": "block", "quote-block": "block", "plain-list": "list", "item": "listItem", "link": "link"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("kind")]
    box = F.try_element_at("properties", F.lit("checkbox"))
    kind = F.when((F.col("kind") == "item") & box.isNotNull(), "checklistItem").otherwise(kind)
    text = F.coalesce(F.try_element_at("properties", F.lit("title")), F.try_element_at("properties", F.lit("text")), F.try_element_at("properties", F.lit("description")), F.col("source_raw"))
    rows = elements.withColumn("fact", kind).where(F.col("fact").isNotNull())
    out = lambda df, k: df.select(F.col("source_file").alias("path"), k.alias("kind"), F.col("kind").alias("source_kind"), F.concat(F.lit("org://"), "source_file", F.lit("#"), k, F.lit("/"), "id").alias("structural_selector"), "line", "end_line", F.map_entries("properties").alias("fields"), text.alias("text"), F.when(F.col("kind") == "headline", F.substring_index("source_raw", "\n", 1)).otherwise(F.col("source_raw")).alias("content"))
    tasks = rows.where("kind = 'headline'").where(F.try_element_at("properties", F.lit("TODO")).isNotNull())
    return out(rows, F.col("fact")).union(out(tasks, F.lit("task")))


def field(test: str) -> Column:
    """``key``: there is such a field; ``key=value``: and its value contains it, case and all; ``text=value`` looks at the text."""
    key, sep, value = test.partition("=")
    if key == "text" and sep:
        return F.contains("text", F.lit(value))
    same = lambda f: F.lower(f["key"]) == key.lower()
    return F.exists("fields", (lambda f: same(f) & F.contains(f["value"], F.lit(value))) if sep else same)


def query(facts: DataFrame, terms: list[str] = (), kinds: list[str] = (), fields: list[str] = ()) -> DataFrame:
    """Facts that meet every term, kind and field; several kinds are all asked for, so two different ones find nothing."""
    blob = F.concat_ws("\n", "kind", "source_kind", "path", "text", "content", F.array_join(F.flatten(F.transform("fields", lambda f: F.array(f["key"], f["value"]))), "\n"))
    out = facts.where(contains_terms(blob, list(terms)))
    for k in kinds:
        out = out.where(F.upper("kind") == k.upper())
    return reduce(lambda df, f: df.where(field(f)), fields, out)


def contents(facts: DataFrame, terms: list[str]) -> DataFrame:
    """Headings of documents in which every term is somewhere: a test by document, then a semi-join."""
    tests = [F.bool_or(F.contains(ascii_lower(F.concat_ws("\n", "text", "path")), F.lit(t.lower()))).alias(f"t{i}") for i, t in enumerate(terms)]
    if not tests:
        return facts.where("kind = 'heading'")
    known = facts.groupBy("path").agg(*tests)
    known = known.where(reduce(lambda a, b: a & b, (F.col(f"t{i}") for i in range(len(terms))))).select("path")
    return facts.where("kind = 'heading'").join(known, "path", "left_semi")


def line_selection(documents: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of each document, from 1."""
    return documents.select("source_file", F.array_join(F.slice(F.split("text", "\n", -1), first, last - first + 1), "\n").alias("content"))


def plan_ledger(documents: DataFrame, prefix: str = "agent-plan-") -> DataFrame:
    """Title and properties of the first headline of ledger files, by expressions on lines only: no parsing."""
    name = F.substring_index("source_file", "/", -1)
    lines = F.split("text", "\n")
    ends = F.array_position(F.transform(lines, lambda x: F.upper(F.trim(x)) == ":END:"), True)
    inside = F.filter(F.slice(lines, 2, F.greatest(ends.cast("int") - 1, F.lit(0))), lambda x: F.regexp(x, F.lit(r"^\s*:[^\s:]+:\s")))
    pairs = F.transform(inside, lambda x: F.struct(F.upper(F.regexp_extract(x, r"^\s*:([^\s:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^\s*:[^\s:]+:\s+(.*)$", 1)).alias("value")))
    rows = documents.where(F.startswith(name, F.lit(prefix)) & F.startswith("text", F.lit("* ")))
    return rows.select("source_file", F.regexp_extract(lines[0], r"^\*+\s+(.*?)\s*$", 1).alias("title"), F.map_from_entries(pairs).alias("properties"))
