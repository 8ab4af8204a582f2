"""Record sets of parsed documents."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import records, workspace
from sheaf.sources import org

A = """#+LINK: wp https://w.org/%s
#+MACRO: hi Hello $1 ($0)
* TODO Plan :work:
SCHEDULED: <2024-05-01 Wed .+2d>
:PROPERTIES:
:ID: x1
:STYLE: habit
:EFFORT: 0:30
:LAST_REPEAT: [2024-04-29 Mon]
:END:
:LOGBOOK:
- State "DONE"       from "TODO"       [2024-04-29 Mon 10:00]
- Note taken on [2024-04-28 Sun]
CLOCK: [2024-04-29 Mon 09:00]--[2024-04-29 Mon 09:30] =>  0:30
:END:
[[id:x2]] [[id:none]] [[wp:Org]] [[*Twice]] {{{hi(a, b)}}} {{{no}}} [fn:1] [fn:2] [fn:3:inline]
** Twice
[fn:1] note
** Twice :noexport:
*** below
#+CALL: blk()
| 1 |
#+TBLFM: $1=2;%.1f::@2$1=vsum(@1..@1)
"""
B = """* DONE Plan
:PROPERTIES:
:ID: x2
:END:
#+NAME: blk
#+begin_src py
<<other>> <<blk>>
#+end_src
"""


@pytest.fixture(scope="module")
def elements(spark):
    return org.parse(spark.createDataFrame([("a.org", A), ("b.org", B)], "source_file string, text string")).cache()


def test_links(elements):
    rows = workspace.resolve_links(records.links(elements), records.targets(elements))
    got = {r["path"]: (r["status"], r["protocol"]) for r in rows.collect()}
    assert got == {"id:x2": ("resolved", "id"), "id:none": ("unresolved", "id"), "https://w.org/Org": ("unresolved", "web"), "*Twice": ("ambiguous", "headline")}


def test_clocks_and_lifecycle(elements):
    c = records.clocks(elements).first()
    assert (c["stop"] - c["start"], c["seconds"]) == (30, 1800)
    assert [(r["kind"], r["to_state"]) for r in records.lifecycle(elements).orderBy("at").collect()] == [("state", "DONE"), ("note", ""), ("clock", "")]
    h = records.habits(elements).first()
    assert (h["repeater"], h["effort_seconds"], h["clock_seconds"], h["last_repeat"]) == (".+2d", 1800, 1800, "2024-04-29 00:00")


def test_memory(elements):
    cards = {(r["source_file"], r["title"]): (r["state"], r["superseded"]) for r in records.memory_cards(elements).collect()}
    assert cards[("a.org", "Plan")] == ("current", False) and cards[("b.org", "Plan")] == ("closed", True) and cards[("a.org", "below")] == ("background", False)


def test_footnotes_and_macros(elements):
    assert sorted((r["label"], r["resolved"]) for r in records.footnotes(elements).collect()) == [("1", True), ("2", False), ("3", True)]
    assert sorted((r["name"], r["status"], r["expansion"]) for r in records.macros(elements).collect()) == [("hi", "expanded", "Hello a (a, b)"), ("no", "missingDefinition", None)]


def test_source_references(elements):
    assert sorted((r["source_file"], r["kind"], r["name"], r["resolved"]) for r in records.source_references(elements).collect()) == [("a.org", "call", "blk", False), ("b.org", "noweb", "blk", True), ("b.org", "noweb", "other", False)]


def test_refile_and_columns(elements):
    rows = records.refile_targets(records.sections(elements), [("tag", "work"), ("maxlevel", "2")])
    assert sorted((r["display"], len(r["receipts"]), r["ambiguous"]) for r in rows.collect()) == [("Plan", 1, True), ("Plan", 2, True), ("Plan/Twice", 1, True), ("Plan/Twice", 1, True)]
    got = records.column_format("%25ITEM(Task) %EFFORT{:} %TODO{X} %N{est+;%.1f} %A{@max}")
    assert [(c["property"], c["summary"], c["status"]) for c in got] == [("ITEM", None, None), ("EFFORT", ":", "supported"), ("TODO", "X", "ignoredSpecialProperty"), ("N", "est+", "supported"), ("A", "@max", "unsupported")]


def test_formulas_and_export(elements, spark):
    assert [(r["lhs"], r["rhs"], r["flags"]) for r in records.table_formulas(elements).collect()] == [("$1", "2", "%.1f"), ("@2$1", "vsum(@1..@1)", None)]
    kept = records.export_kept(records.sections(elements))
    assert sorted(r["title"] for r in kept.collect()) == ["Plan", "Plan", "Twice"]
    assert sorted(r["source_file"] for r in records.export_kept(records.sections(elements), select=("work",)).select("source_file").distinct().collect()) == ["a.org", "b.org"]
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert sorted(tuple(r) for r in records.attachment_gaps(files.where(F.col("path") == "a").union(spark.createDataFrame([("c",)], "path string")), files).collect()) == [("b", "orphan"), ("c", "missing")]
