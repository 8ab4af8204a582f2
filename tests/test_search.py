"""Search over facts, ledgers and contract notations."""

import pytest

from sheaf.operators import contracts, search
from sheaf.plans import contract_language
from sheaf.sources import org

A = "* TODO Budget plan :x:\n:PROPERTIES:\n:PLAN_ID: p1\n:Owner: Ann\n:END:\nThe text of ÀB\n- [ ] pay\n- [[u][see]]\n* Other\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("d/agent-plan-1.org", A), ("d/b.org", "* Notes\nbudget here\n")], "source_file string, text string")


def test_search(docs):
    facts = search.document_elements(org.parse(docs)).cache()
    assert sorted(r["kind"] for r in search.query(facts, ["BUDGET"]).collect()) == ["heading", "paragraph", "task"]
    assert search.query(facts, ["àb"]).count() == 0 and search.query(facts, ["Àb text"]).count() == 1
    assert search.query(facts, kinds=["CHECKLISTITEM"]).count() == 1 and search.query(facts, kinds=["heading", "task"]).count() == 0
    assert search.query(facts, fields=["plan_id=p1"]).count() == 2 and search.query(facts, fields=["plan_id=P1"]).count() == 0 and search.query(facts, fields=["text=pay"]).count() == 2
    assert sorted(r["text"] for r in search.contents(facts, ["budget", "other"]).collect()) == ["Budget plan", "Other"]
    assert search.line_selection(docs, 2, 2).first()["content"] == ":PROPERTIES:"


def test_ledger(docs):
    rows = search.plan_ledger(docs).collect()
    assert [(r["title"], r["properties"]) for r in rows] == [("TODO Budget plan :x:", {"PLAN_ID": "p1", "OWNER": "Ann"})]


def test_contract_notations(docs):
    e = org.parse(docs)
    c = contract_language.from_sexprs("c", '(let top (headline :title "Budget plan")) (assert items == 2 (query (kind item) (within $top))) (exists notes (headline :title "Notes")) (not-exists none (query (kind table) (child-of $lost)))')
    rows = {(r["assertion"], r["source_file"][-5:]): r["ok"] for r in contracts.evaluate(e, c).collect()}
    assert rows == {("items", "1.org"): True, ("items", "b.org"): False, ("notes", "1.org"): False, ("notes", "b.org"): True, ("none", "1.org"): True, ("none", "b.org"): True}
    q = contract_language.from_lines("# c\nkind=item\nproperty.checkbox=off\nlimit=1")
    assert (q.kind, q.category, q.property_equals, q.limit) == ("item", "element", [("checkbox", "off")], 1)
    for bad in ("kind", "colour=1"):
        with pytest.raises(ValueError):
            contract_language.from_lines(bad)
    with pytest.raises(ValueError):
        contract_language.from_sexprs("c", "(maybe x (headline))")
