"""Publishing and dependency views."""

from sheaf.operators import export_graph, workspace
from sheaf.sources import org

A = """#+TITLE: t
#+OPTIONS: H:3 toc:nil
#+INCLUDE: "b.org::*x" src :lines "2-5" :minlevel 2
#+SETUPFILE: s.org
#+TAGS: [ G : a b ] { H : c }
#+ATTR_HTML: :width 3
text [cite:@k1;@k2]
* A :crypt:
:PROPERTIES:
:COLOR_ALL: red blue
:COLOR: green
:END:
** B
* C
:PROPERTIES:
:CRYPTKEY: me
:END:
"""


def test_views(spark):
    e = org.parse(spark.createDataFrame([("a.org", A), ("b.org", "#+INCLUDE: a.org\n#+BIBLIOGRAPHY: x.bib\n[cite:@k]")], "source_file string, text string")).cache()
    assert [tuple(r)[3:] for r in export_graph.includes(e).orderBy("source_file").collect()] == [("b.org", "src", 2, 5, 2), ("a.org", "org", None, None, None)]
    edges = export_graph.dependencies(e)
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == [("a.org", "b.org", "includes"), ("a.org", "s.org", "usesSetupFile"), ("b.org", "a.org", "includes"), ("b.org", "x.bib", "usesBibliography")]
    assert [r["path"] for r in workspace.cycles(edges.where("kind = 'includes'")).collect()] == [["a.org", "b.org"]]
    assert {r["key"] for r in export_graph.publishing(e).collect()} == {"TITLE", "OPTIONS", "ATTR_HTML"}
    assert sorted((r["option"], r["setting"]) for r in export_graph.options(e).collect()) == [("H", "3"), ("toc", "nil")]
    assert sorted((r["key"], r["has_bibliography"]) for r in export_graph.citations(e).collect()) == [("k", True), ("k1", False), ("k2", False)]
    assert sorted((r["tag_group"], r["member"]) for r in export_graph.tag_groups(e).collect()) == [("G", "a"), ("G", "b"), ("H", "c")]
    assert sorted((r["tag"] or "", r["warning"]) for r in export_graph.crypt_states(e).collect()) == [("", "keyWithoutTag"), ("direct", "plainBody"), ("inherited", "plainBody")]
    assert [r["value"] for r in export_graph.property_values(e).collect()] == ["green"]
