"""Plans, selectors and small notations on small rows."""

from pyspark.sql import functions as F

from sheaf.functions import org_text
from sheaf.operators import columns, lint_sdd, plans
from sheaf.sources import org


def parsed(spark, **texts):
    return org.parse(spark.createDataFrame(list(texts.items()), "source_file string, text string"))


def test_fuzzy(spark):
    rows = spark.createDataFrame([("source block",), ("sb",), ("bs",), ("s-o-b",)], "name string")
    found = plans.fuzzy(rows, F.col("name"), "sb")
    assert [(r["name"], r["score"]) for r in found.collect()] == [("sb", 2), ("s-o-b", 5), ("source block", 8)]
    assert plans.fuzzy(rows, F.col("name"), "").count() == 4 and plans.fuzzy(rows, F.col("name"), "s o").count() == 2


def test_selectors(spark):
    e = parsed(spark, a="* h\ntext\n\nmore\n", b="* h\n")
    assert [r["kind"] for r in plans.selected(e, "org://a#paragraph/").collect()] == ["paragraph"] * 2
    assert [r["line"] for r in plans.selected(e, "a:2-2").collect()] == [2]
    assert plans.selected(e, "org://c#").count() == 0


def test_shadowed(spark):
    rows = [("a", "list", None, 1, 4), ("a", "listItem", "x", 1, 2), ("a", "paragraph", "x", 2, 2), ("a", "paragraph", "y", 6, 6), ("a", "paragraph", "y", 8, 8), ("b", "list", None, 1, 4), ("b", "listItem", "", 1, 2)]
    left = plans.shadowed(spark.createDataFrame(rows, "path string, kind string, content string, line int, end_line int"))
    assert sorted((r["path"], r["kind"], r["line"]) for r in left.collect()) == [("a", "listItem", 1), ("a", "paragraph", 6), ("b", "list", 1), ("b", "listItem", 1)]


def test_document_predicates(spark):
    rows = spark.createDataFrame([("x/README.org", ["TITLE"]), ("x/notes.org", [])], "source_file string, keys array<string>")
    count = lambda kind, value: rows.where(plans.document_predicate(kind, value)).count()
    assert count("MetadataExists", "title") == 1 and count("SourcePathEquals", "x/notes.org") == 1 and count("SourcePathContains", "x/") == 2
    assert count("SourceFilenameEquals", "notes.org") == 1 and count("SourceFilenamePrefix", "READ") == 1 and count("SourceFilenameSuffix", ".org") == 2 and count("SourceFilenameStemUppercase", "") == 1


def test_design_graph_changes(spark):
    node = "* {} :sdd:\n:PROPERTIES:\n:ID: {}\n:SDD_KIND: system\n:END:\n"
    before, after = parsed(spark, a=node.format("x", 1) + node.format("y", 2)), parsed(spark, a=node.format("z", 2) + node.format("w", 3))
    assert sorted((r["id"], r["change"]) for r in lint_sdd.graph_diff(before, after).collect()) == [("1", "removed"), ("2", "changed"), ("3", "added")]
    assert [tuple(r) for r in lint_sdd.status(before).collect()] == [("a", "system", None, 2)]


def test_contract_json(spark):
    rows = spark.createDataFrame([("a", "x", 1, True), ("a", "y", 0, False)], "source_file string, assertion string, count long, ok boolean")
    assert plans.evaluation_json(rows).first()["json"] == '{"ok":false,"assertions":[{"assertion":"x","count":1,"ok":true},{"assertion":"y","count":0,"ok":false}]}'


def test_timers_and_numbers(spark):
    r = spark.range(1).select(org_text.timers(F.lit("- 0:01:10 a -1:00:00, 12:30 1:2:3")).alias("t"), columns.number_text(F.lit(2.5)).alias("a"), columns.number_text(F.lit(3.0)).alias("b"), columns.number_text(F.lit(2.0), "%.1f").alias("c")).first()
    assert [tuple(x) for x in r["t"]] == [("0:01:10", 70), ("-1:00:00", -3600)] and (r["a"], r["b"], r["c"]) == ("2.5", "3", "2.0")
