"""What keeps the queries on parsed documents within bounds: even tasks, one parse, plans of bounded size."""

import re

from pyspark.sql.readwriter import DataFrameWriter

from sheaf import catalog
from sheaf.operators import lint, records
from sheaf.sources import org


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_are_dealt_out(spark, sf_dir):
    """One small file of customers is parsed by all cores, and only the kinds asked for leave the parser."""
    assert catalog._customers(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["kind"] for r in catalog._parsed(spark, sf_dir, "org-data", "src-block").select("kind").distinct().collect()} == {"org-data", "src-block"}


def test_export_reads_sections_once(spark):
    """Kept sections come from one pass; nested, repeated and selected ones as by their ancestors."""
    text = "* a :noexport:\n** b :pick:\n* c\n** d :pick:\n*** e\n** f\n* COMMENT g\n*** h :pick:\n* i :ARCHIVE:\n* j"
    docs = spark.createDataFrame([("1", text), ("2", "* k\n** l :noexport:\n** m"), ("3", "* COMMENT n :pick:")], "source_file string, text string")
    rows = records.sections(org.parse(docs))
    kept = records.export_kept(rows)
    assert plan(kept).count("MapInArrow") == 1
    assert sorted(r["title"] for r in kept.collect()) == ["c", "d", "e", "f", "j", "k", "m"]
    picked = records.export_kept(rows, select=("pick",))
    assert plan(picked).count("MapInArrow") == 1 and picked.columns == rows.columns
    assert sorted(r["title"] for r in picked.collect()) == ["c", "d", "e", "k", "m"]


def test_memory_cards_are_stored(spark):
    """No later step of the cards parses documents again."""
    docs = spark.createDataFrame([("1", "* DONE Plan\n* DONE Other"), ("2", "* TODO plan")], "source_file string, text string")
    cards = records.memory_cards(org.parse(docs))
    assert "MapInArrow" not in plan(cards)
    assert sorted((r["title"], r["state"], r["superseded"]) for r in cards.collect()) == [("Other", "closed", False), ("Plan", "closed", True), ("plan", "current", False)]


def test_findings_are_stored_in_parts(spark):
    """No plan holds all rules: what is returned reads stored findings, the same as of each rule alone."""
    docs = spark.createDataFrame([("1", "* a\n:PROPERTIES:\n:C_ALL: red\n:C: blue\n:END:\n[[file:x]] {{{m}}}\n#+NAME: p\ntext\n#+begin_src sql :var v=p w=q\n<<q>>\n#+end_src\n"), ("2", "* k :crypt:\n-----BEGIN PGP MESSAGE-----\n* [#99] p [1/2]\n| 1 |\n#+TBLFM: $1=@9$9\n"), ("3", None)], "source_file string, text string")
    e = org.parse(docs).cache()
    files = spark.createDataFrame([("y",)], "path string")
    found = lint.findings(e, files=files)
    assert "Window" not in plan(found) and "Join" not in plan(found)
    one = [r for f in [*lint.RULES, *lint.FILE_RULES] for r in lint.findings(e, [f], files).collect()]
    assert sorted(found.collect()) == sorted(one) and {r["code"] for r in one} >= {"ORG004", "ORG017", "ORG021", "ORG026", "ORG030", "ORG038"}


def test_each_rule_is_planned_alone(spark, monkeypatch):
    """No plan that runs for the findings names more than one rule, and what is returned is one table."""
    ran, write = [], DataFrameWriter.parquet
    codes = lambda df: set(re.findall(r"ORG\d+", df._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: ran.append(codes(self._df)) or write(self, *a, **b))
    docs = spark.createDataFrame([("1", "* a\n:PROPERTIES:\n:EFFORT: soon\n:EFORT: 1\n:END:\n{{{m}}}\n"), ("2", None)], "source_file string, text string")
    wanted = ["ORG004", "ORG010", "ORG011", "ORG013"]
    found = lint.findings(org.parse(docs), wanted)
    assert sorted(c for x in ran for c in x) == wanted and max(map(len, ran)) == 1
    assert not codes(found) and "Union" not in plan(found)
    assert sorted(r["code"] for r in found.collect()) == ["ORG004", "ORG011", "ORG013"]
