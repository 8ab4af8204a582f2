"""Match expressions, element queries and scalar functions on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheaf.functions import dates, text
from sheaf.operators import tree, workspace
from sheaf.plans import elements as eq
from sheaf.plans.match import compile_match, parse


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(1, ["work", "Urgent"], {"N": "2", "D": "<2024-03-01 Fri>", "S": "alpha"}), (2, ["home"], {"N": "10", "D": "[2024-02-01 Thu 10:00]"}), (3, [], {"N": "1d"})]
    return spark.createDataFrame(rows, "id long, tags array<string>, p map<string,string>")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("", [1, 2, 3]), ("work", [1]), ("+WORK|home", [1, 2]), ("-work", [2, 3]), ("N>2", [2]), ("N<>2", [2, 3]), ("-N=2", [2, 3]), ("S=alpha", [1]), ("S<>alpha", []), ("-S=alpha", [2, 3]), ("S={lph}", [1]), ("S>{lph}", []),
        ('D<"<2024-02-15>"', [2]), ("N=2.0", [1]), ("place", [1, 2]), ("TAGS=\"work\"", [1]), ("N==2+work", [1]), ("N!=2&home", [2]),
    ],
)
def test_match(tagged, expression, want):
    got = tagged.where(compile_match(expression, F.col("tags"), F.col("p"), groups={"place": ["work", "home"]}))
    assert sorted(r["id"] for r in got.collect()) == want


def test_match_errors():
    with pytest.raises(ValueError):
        parse("(a|b)")


def test_packets():
    q = eq.from_packet('{"category": "element", "outlinePathPrefix": ["a"], "propertyEquals": {"k": "v"}, "relations": [{"type": "child-of", "ids": [1]}], "limit": 3}')
    assert eq.from_packet(eq.to_packet(q)) == q
    with pytest.raises(ValueError):
        eq.from_packet('{"colour": 1}')
    merged = eq.from_sexpr('(and (kind table) (property "a" "1") (kind link) (property "b" "2") (within 4 5))')
    assert (merged.kind, merged.category, merged.property_equals, merged.relations) == ("link", "object", [("a", "1"), ("b", "2")], [("descendant-of", [4, 5])])
    for bad in ("(a", "a)", "(a) (b)"):
        with pytest.raises(ValueError):
            eq.from_sexpr(bad)
    for bad in ("(:org-element)", "(:org-element (:colour x))", "x"):
        with pytest.raises(ValueError):
            eq.from_selector(bad)


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "want"), [("", 0), ("1:30", 5400), ("0:00:05", 5), ("90", 5400), ("1.5", 90), ("1h", 3600), ("2d 1:00", 176400), ("1w2h", 612000), ("1m", 2592000), ("3min", 180), ("-5", None), ("soon", None), ("1:75", None)])
def test_durations(spark, value, want):
    assert one(spark, value, dates.duration_seconds) == want


def test_repeaters(spark):
    def steps(start, value, unit, until):
        day = spark.createDataFrame([(dt.date.fromisoformat(start),)], "d date")
        return [str(x) for x in day.select(dates.occurrences(F.col("d"), F.lit(value), F.lit(unit), F.lit(dt.date.fromisoformat(until))).alias("o")).first()["o"]]

    assert steps("2024-01-31", 1, "m", "2024-04-30") == ["2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29"]
    assert steps("2024-01-01", 2, "w", "2024-02-01") == ["2024-01-01", "2024-01-15", "2024-01-29"]
    assert steps("2024-01-01", 5, "h", "2024-02-01") == ["2024-01-01"] and steps("2024-03-01", 1, "d", "2024-02-01") == ["2024-03-01"]


@pytest.mark.parametrize(("value", "want"), [("9:30 call", 570), ("call at 9am", 540), ("8:15pm", 1215), ("12am", 0), ("<2024-01-01 Mon 9:30> x", None), ("v1:30x", None), ("none", None)])
def test_time_of_day(spark, value, want):
    assert one(spark, value, dates.time_of_day) == want


def test_blocks():
    assert dates.block_window("2024-Q4") == (dt.datetime(2024, 10, 1), dt.datetime(2025, 1, 1))
    assert dates.block_window("2024-W01")[0] == dt.datetime(2024, 1, 1) and dates.block_window("2024-12")[1] == dt.datetime(2025, 1, 1)
    with pytest.raises(ValueError):
        dates.block_window("soon")


@pytest.mark.parametrize(("value", "want"), [("2", 2.0), (" 2", None), ("1d", None), ("-1.5e3", -1500.0), (".5", 0.5), ("", None)])
def test_numbers(spark, value, want):
    assert one(spark, value, text.number) == want


def test_ascii_case(spark):
    assert one(spark, "ÀB", text.ascii_lower) == "Àb" and one(spark, "À b--c!", text.slugify) == "b-c"


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (4, 4), (3, 4)], "src long, dst long")
    assert sorted(r["path"] for r in workspace.cycles(edges).collect()) == [[1, 2], [1, 2, 3]]


def test_long_cycles(spark):
    """A ring of nine, with a chord, a way in, a way out and a second ring that it leads to."""
    ring = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    edges = spark.createDataFrame([*ring, ("n5", "n0"), ("in", "n3"), ("n2", "out"), ("n4", "x"), ("x", "y"), ("y", "x"), ("y", "y")], "src string, dst string")
    names = [f"n{i}" for i in range(9)]
    assert sorted(r["path"] for r in workspace.cycles(edges).collect()) == [names[:6], names, ["x", "y"]]
    assert [r["path"] for r in workspace.cycles(edges, 3).collect()] == [["x", "y"]]
    assert {r["node"]: r["component"] for r in workspace.cyclic_components(edges).collect()} == {**dict.fromkeys(names, "n0"), "x": "x", "y": "x"}
    assert workspace.cycles(edges.where("src = 'in'")).count() == 0


def test_rollup_of_empty(spark):
    s = spark.createDataFrame([], "section_id long, level int, title string, ancestor_ids array<long>, effort_seconds long, todo string")
    c = spark.createDataFrame([], "section_id long, seconds long")
    assert tree.clock_rollup(s, c).count() == 0 and tree.progress(s).count() == 0
