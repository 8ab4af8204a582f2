"""The Org parser: structure, inherited state, offsets, odd input."""

import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from sheaf.sources import org
from sheaf.sources.parser import records

TEXT = """#+TITLE: Böoks
#+FILETAGS: :lib:
#+TODO: TODO NEXT | DONE
#+PROPERTY: CATEGORY shelf
intro *bold* and [[https://x.org][site]] <2024-01-02 Tue 9:30 +1w>
* NEXT [#A] Read :fun:
SCHEDULED: <2024-05-01 Wed> DEADLINE: <2024-06-01 Sat -3d>
:PROPERTIES:
:EFFORT: 1:30
:CUSTOM_ID: read
:END:
:LOGBOOK:
CLOCK: [2024-05-01 Wed 10:00]--[2024-05-01 Wed 11:00] =>  1:00
:END:
- [X] one
  - [ ] inner
- [-] two :: not a tag
** DONE Read
text with src_python{1+1} and {{{m(x)}}} [fn:a] [1/2]
#+NAME: tab
| a | b |
|---+---|
| 1 | 2 |
#+TBLFM: $2=$1*2
#+begin_src python :results output :var x=1
* not a headline? it is one
#+end_src
* COMMENT Read
[fn:a] The note.
#+begin_quote
quoted /text/
#+end_quote
"""


def by_kind(rows, kind):
    return [r for r in rows if r["kind"] == kind]


def test_structure():
    rows = records("a.org", TEXT)
    heads = by_kind(rows, "headline")
    p = [dict(h["properties"]) for h in heads]
    assert [h["outline_path"] for h in heads] == [["Read"], ["Read", "Read"], ["not a headline? it is one"], ["Read"]]
    assert p[0]["TODO"] == "NEXT" and p[0]["PRIORITY"] == "A" and p[0]["TAGS"] == "fun" and p[0]["ALLTAGS"] == "lib:fun"
    assert p[0]["SCHEDULED"] == "<2024-05-01 Wed>" and p[0]["DEADLINE"] == "<2024-06-01 Sat -3d>" and p[0]["EFFORT"] == "1:30"
    assert p[1]["inherited:EFFORT"] == "1:30" and p[1]["inherited:CATEGORY"] == "shelf" and p[1]["ALLTAGS"] == "lib:fun"
    assert [x["anchor"] for x in p] == ["read", "read-1", "not-a-headline-it-is-one", "read-2"] and p[3]["COMMENT"] == "t"
    items = [dict(r["properties"]) for r in by_kind(rows, "item")]
    assert [i.get("checkbox") for i in items] == ["on", "off", "trans"] and items[2]["tag"] == "two"
    assert dict(by_kind(rows, "clock")[0]["properties"])["duration"] == "1:00"
    table = by_kind(rows, "table")[0]
    assert table["affiliated_name"] == "tab" and dict(table["properties"]) == {"rows": "2", "columns": "2", "header": "a|b", "formulas": "$2=$1*2"}
    assert [dict(r["properties"])["value"] for r in by_kind(rows, "table-cell")] == ["a", "b", "1", "2"]
    assert len(by_kind(rows, "macro")) == len(by_kind(rows, "inline-src-block")) == len(by_kind(rows, "statistics-cookie")) == len(by_kind(rows, "bold")) == len(by_kind(rows, "italic")) == 1
    assert dict(by_kind(rows, "timestamp")[0]["properties"])["repeater"] == "+1w"
    assert by_kind(rows, "footnote-definition") and by_kind(rows, "quote-block")


def test_tree_and_offsets():
    rows = records("a.org", TEXT)
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    raw = TEXT.encode()
    known = {r["id"]: r for r in rows}
    for r in rows:
        assert raw[r["range_start"] : r["range_end"]].decode() == r["source_raw"]
        if r["parent_id"]:
            parent = known[r["parent_id"]]
            assert r["ancestor_ids"] == [*parent["ancestor_ids"], parent["id"]] and parent["range_start"] <= r["range_start"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["* a", "** TODO b :t:", ":PROPERTIES:", ":END:", ":X: 1", "- i", "  - [ ] j", "1. k", "| a |", "|-", "#+begin_src x", "#+end_src", "#+NAME: n", "# c", ": f", "[fn:1] z", "", "text *b* é", "CLOCK: [2024-01-01]", "\\begin{a}", "-----", "[[l]]", "*", "\r"]), max_size=25))
def test_never_fails(lines):
    text = "\n".join(lines)
    rows = records("x", text)
    assert rows[0]["kind"] == "org-data" and rows[0]["source_raw"] == text


def test_parse_frame_and_sql(spark):
    docs = spark.createDataFrame([("a.org", TEXT), ("b.org", None), ("c.org", "")], "source_file string, text string")
    rows = org.parse(docs)
    assert rows.count() == len(records("a", TEXT)) + 2
    found = org.sql(org.org_elements(rows), "select count(*) n, max(source_end_line) m from org_elements where kind = 'src-block' or affiliated_name = 'tab'").first()
    assert found["n"] == 1 and found["m"] == 24
    assert org.org_elements(rows).columns[:3] == ["ordinal", "category", "kind"]


def test_folders(spark, tmp_path):
    for name in ("a.org", "sub/b.org", ".git/c.org", "node_modules/d.org", "e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("* Head\nTerm here")
    docs = org.read_folder(spark, str(tmp_path))
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in docs.collect()) == ["a.org", "b.org"]
    assert org.read_folder(spark, str(tmp_path), hidden=(".git",)).count() == 3
    assert org.prefilter(docs, ["head TERM"]).count() == 2 and org.prefilter(docs, ["absent"]).count() == 0


def test_some_kinds(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", None)], "source_file string, text string")
    rows = lambda df: sorted(df.select("source_file", "id", "ancestor_ids", F.to_json("properties"), "range_start", "source_raw").collect())
    some = rows(org.parse(docs, ("headline", "org-data")))
    assert some and some == rows(org.parse(docs).where("kind in ('headline', 'org-data')"))
