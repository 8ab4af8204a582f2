"""Markdown, lint, contracts, packets, exports and the stream."""

from pyspark.sql import functions as F

from sheaf.operators import contracts, lint
from sheaf.plans.elements import Query
from sheaf.sources import markdown, org, packets
from sheaf.streaming import ingest

MD = "---\ntitle: x\n---\n# A *b*\ntext [l](u) and ![i](v.png)\n\n- [x] done\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\n***\nTitle\n=====\n"
BAD = """#+MACRO: m x
#+MACRO: m y
* TODO [#zz] A [0/2]
:PROPERTIES:
:EFFORT: soon
:EFFORT: 1:00
:CUSTOM_ID: k
:END:
- [X] a
- [ ] b
{{{m}}} {{{none}}} <<t>> <<t>>
* B
:PROPERTIES:
:CUSTOM_ID: k
:END:
#+NAME: n
#+begin_src py :tangle out.py
one
#+end_src
#+NAME: N
#+begin_src py :tangle out.py
two
#+end_src
"""


def test_markdown(spark):
    rows = markdown.elements("a.md", MD)
    kinds = [r["kind"] for r in rows]
    assert kinds == ["frontMatter", "heading", "paragraph", "link", "image", "list", "checklistItem", "listItem", "table", "block", "thematicBreak", "heading"]
    assert rows[-1]["text"] == "Title" and rows[-1]["structural_selector"] == "md://a.md#heading/2"
    docs = spark.createDataFrame([("a.md", MD), ("b.md", None)], "source_file string, text string")
    assert markdown.parse(docs).where(F.exists("fields", lambda f: (f["key"] == "checked") & (f["value"] == "true"))).count() == 1


def test_lint(spark):
    e = org.parse(spark.createDataFrame([("a.org", BAD)], "source_file string, text string"))
    found = sorted((r["code"], r["line"]) for r in lint.findings(e).collect())
    assert found == [("ORG002", 3), ("ORG002", 11), ("ORG004", 11), ("ORG008", 2), ("ORG010", 3), ("ORG011", 5), ("ORG012", 6), ("ORG020", 21), ("ORG028", 3)]


def test_contracts(spark):
    e = org.parse(spark.createDataFrame([("a.org", BAD), ("b.org", "* B\ntext")], "source_file string, text string"))
    b = contracts.Step("b", Query(kind="headline", property_equals=[("title", "B")]), expect=("==", 1))
    src = contracts.Step("src", Query(kind="src-block"), within=("descendant-of", "b"), expect=(">=", 1))
    lost = contracts.Step("lost", Query(kind="src-block"), within=("child-of", "nothing"), expect=("==", 0))
    rows = {(r["assertion"], r["source_file"]): (r["count"], r["ok"]) for r in contracts.evaluate(e, contracts.Contract("c", [b, src, lost])).collect()}
    assert rows == {("b", "a.org"): (1, True), ("b", "b.org"): (1, True), ("src", "a.org"): (2, True), ("src", "b.org"): (0, False), ("lost", "a.org"): (0, True), ("lost", "b.org"): (0, True)}
    assert contracts.union_of(e, [Query(kind="headline"), Query(category="section")]).count() == 3


def test_contracts_read_elements_once(spark):
    """What is evaluated comes from a stored table: no step parses the documents again, and limits and relations hold on it."""
    e = org.parse(spark.createDataFrame([("a.org", BAD), ("b.org", "* B\ntext"), ("c.org", None)], "source_file string, text string"))
    top = contracts.Step("top", Query(kind="headline", limit=1), expect=("==", 1))
    src = contracts.Step("src", Query(kind="src-block"), within=("descendant-of", "top"), expect=("==", 0))
    above = contracts.Step("above", Query(kind="headline", relations=[("ancestor-of", [r["id"] for r in e.where("kind = 'src-block'").collect()])]), expect=(">=", 1))
    found = contracts.evaluate(e, contracts.Contract("c", [top, src, above]))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {(r["assertion"], r["source_file"]): r["count"] for r in found.collect()} == {("top", "a.org"): 1, ("top", "b.org"): 1, ("top", "c.org"): 0, ("src", "a.org"): 0, ("src", "b.org"): 0, ("src", "c.org"): 0, ("above", "a.org"): 1, ("above", "b.org"): 0, ("above", "c.org"): 0}


def test_packets(spark):
    e = org.parse(spark.createDataFrame([("a.org", BAD)], "source_file string, text string"))
    assert packets.tangle_plan(e).first()["content"] == "one\n\ntwo"
    assert packets.owners(e).first()["kinds"]["headline"] == 2
    assert packets.index_json(e).count() == e.count()


def test_formatting_and_export():
    assert packets.formatted("a  \n|x|yy|\n|-\n|1|2|\n\n\n") == "a\n| x | yy |\n|---+----|\n| 1 | 2  |\n"
    text = "* H & *b*\nsome /it/ [[p][d]]\n- [X] a\n| 1 | 2 |\n#+begin_src py\nx<1\n#+end_src\n* COMMENT no\n"
    web, md = packets.exported(text, "html"), packets.exported(text, "markdown")
    assert "<i>it</i>" in web and '<a href="p">d</a>' in web and "x&lt;1" in web and "<td>1</td>" in web and "no" not in web
    assert "*it*" in md and "[d](p)" in md and "```py\nx<1\n```" in md and "- [X] a" in md


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.org").write_text("* A\ntext")
    for _ in range(2):
        ingest.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").where("kind = 'headline'").count() == 1
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert ingest.activity(events).first()["n"] == 2
