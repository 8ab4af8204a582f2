"""Contracts: named queries over elements and assertions on their counts.

A contract is a list of steps.  ``let`` binds a query's elements to a name, and a
later query may ask for children or descendants of a binding; ``assert`` compares
the number of distinct elements with a bound.  Bindings are semi-joins, never
collected; an assertion is one count for each document.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.stored import kept
from sheaf.plans.elements import Query, condition, run

OPERATORS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass
class Step:
    name: str
    query: Query
    #: (relation, binding): child-of, descendant-of or at the elements of an earlier step.
    within: tuple[str, str] | None = None
    #: (operator, bound) of an assertion; None for a binding only.
    expect: tuple[str, int] | None = None


@dataclass
class Contract:
    id: str
    steps: list[Step]
    #: Which documents it is about.
    scope: Column | None = field(default=None)


def _bound(elements: DataFrame, step: Step, known: dict[str, DataFrame]) -> DataFrame:
    rows = run(elements, step.query)
    if step.within is None:
        return rows
    relation, name = step.within
    if name not in known:
        return rows.limit(0)
    ids = known[name].select("source_file", F.col("id").alias("_of"))
    match relation:
        case "at":
            return rows.join(ids.withColumnRenamed("_of", "id"), ["source_file", "id"], "left_semi")
        case "child-of":
            return rows.join(ids.withColumnRenamed("_of", "parent_id"), ["source_file", "parent_id"], "left_semi")
        case "descendant-of":
            inside = rows.select("source_file", "id", F.explode("ancestor_ids").alias("_of")).join(ids, ["source_file", "_of"], "left_semi").select("source_file", "id").distinct()
            return rows.join(inside, ["source_file", "id"], "left_semi")
    raise ValueError(f"no relation {relation!r}")


def _candidates(elements: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[Step]]:
    """(source_file, own): each document with the ids of its elements that any query may select, stored, since every step reads them and the elements may be costly; and the steps as queries on those."""
    flags = [F.coalesce(condition(s.query), F.lit(False)).alias(f"_step{i}") for i, s in enumerate(steps)]
    above = [k for s in steps for kind, ids in s.query.relations if kind == "ancestor-of" for k in ids]
    wanted = reduce(lambda a, b: a | b, [*flags, *([F.col("id").isin(above)] if above else [])])
    own = F.struct(*(c for c in ("id", "parent_id", "ancestor_ids") if c in elements.columns), *flags)
    out = kept(elements.groupBy("source_file").agg(F.collect_list(F.when(wanted, own)).alias("own")))
    return out, [replace(s, query=Query(predicate=lambda i=i: F.col(f"_step{i}"), relations=s.query.relations, limit=s.query.limit)) for i, s in enumerate(steps)]


def evaluate(elements: DataFrame, contract: Contract) -> DataFrame:
    """(contract, assertion, source_file, count, ok) for each assertion and document in scope."""
    if contract.scope is not None:
        elements = elements.where(contract.scope)
    elements, steps = _candidates(elements, contract.steps)
    documents = elements.select("source_file")
    elements = elements.select("source_file", F.inline("own"))
    known: dict[str, DataFrame] = {}
    out = []
    for step in steps:
        known[step.name] = rows = _bound(elements, step, known)
        if step.expect:
            op, bound = step.expect
            counts = rows.groupBy("source_file").agg(F.countDistinct("id").alias("count"))
            n = F.coalesce("count", F.lit(0))
            out.append(documents.join(counts, "source_file", "left").select(F.lit(contract.id).alias("contract"), F.lit(step.name).alias("assertion"), "source_file", n.alias("count"), OPERATORS[op](n, F.lit(bound)).alias("ok")))
    return reduce(DataFrame.unionByName, out)


def union_of(elements: DataFrame, alternatives: list[Query]) -> DataFrame:
    """Elements of any of some queries, each once; limits hold for each alternative."""
    return reduce(DataFrame.union, (run(elements, q).select("source_file", "id") for q in alternatives)).distinct()


def contract_findings(evaluated: DataFrame) -> DataFrame:
    """ORG044: assertions that don't hold, as findings of their documents."""
    message = F.concat_ws(" ", F.lit("contract"), "contract", F.lit("fails at"), "assertion", F.lit("with"), "count")
    return evaluated.where("not ok").select(F.lit("ORG044").alias("code"), F.lit("warning").alias("severity"), "source_file", F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("range_start"), message.alias("message"))


def in_scope(source_file: Column, folder: str) -> Column:
    """Whether a path lies under a folder; ``~`` and variables are not expanded."""
    base = folder.rstrip("/")
    return (source_file == base) | F.startswith(source_file, F.lit(base + "/")) if base else F.lit(True)


def surface(spark) -> DataFrame:
    """(head, meaning): the heads of the element query language."""
    heads = [("category", "category of an element"), ("kind", "kind of an element"), ("name", "its NAME line"), ("context", "kind of its parent"), ("property", "a property equal to a value"), ("contains", "a property that holds a text"), ("outline", "headlines above it"), ("and", "all of some queries"), ("or", "any of some queries"), ("not", "none of some queries"), ("limit", "the first rows by document and order")]
    return spark.createDataFrame(heads, "head string, meaning string")
