"""Element queries: one query object, reached from Python, a JSON packet, an S-expression or a plist selector.

Predicates compile to a Column, relations to semi-joins on ids; Catalyst sees
one plan whatever the front end was.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("document", "section", "element", "object", "keyword", "property", "target-definition", "footnote-entry")
#: Kinds that imply a category other than element.
IMPLIED = {"headline": "section", "node-property": "property"} | dict.fromkeys(("link", "timestamp", "markup", "entity", "latex-fragment", "footnote-reference", "citation", "target", "radio-target", "macro", "statistics-cookie", "code", "verbatim", "plain-text", "inline-src-block", "line-break", "export-snippet"), "object")


@dataclass
class Query:
    category: str | None = None
    kind: str | None = None
    name: str | None = None
    context: str | None = None
    prefix: list[str] = field(default_factory=list)
    depth: int | None = None
    property_equals: list[tuple[str, str]] = field(default_factory=list)
    property_contains: list[tuple[str, str]] = field(default_factory=list)
    predicate: Callable[[], Column] | None = None
    #: (kind, ids): child-of, descendant-of, ancestor-of or at.
    relations: list[tuple[str, list[int]]] = field(default_factory=list)
    limit: int | None = None


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def property_value(key: str) -> Column:
    """A property by its key, with and without a leading colon."""
    bare = key.lstrip(":")
    return F.coalesce(F.try_element_at("properties", F.lit(key)), F.try_element_at("properties", F.lit(bare)), F.try_element_at("properties", F.lit(":" + bare)))


def leaf(kind: str, *args: str) -> Column:
    """A predicate on one element, never null."""
    match kind:
        case "category" | "kind" | "context":
            return _sure(F.col(kind) == args[0])
        case "name":
            return _sure(F.col("affiliated_name") == args[0])
        case "property":
            return _sure(property_value(args[0]) == args[1])
        case "property-contains":
            return _sure(F.contains(property_value(args[0]), F.lit(args[1])))
        case "source-contains":
            return _sure(F.contains(F.col("source_raw"), F.lit(args[0])))
    raise ValueError(f"no predicate {kind!r}")


def condition(q: Query) -> Column:
    """All of a query but relations and limit."""
    out = F.lit(True)
    for kind in ("category", "kind", "context"):
        if (want := getattr(q, kind)) is not None:
            out &= leaf(kind, want)
    if q.name is not None:
        out &= leaf("name", q.name)
    if q.prefix:
        out &= _sure(F.slice("outline_path", 1, len(q.prefix)) == F.array(*map(F.lit, q.prefix)))
    if q.depth is not None:
        out &= _sure(F.size("outline_path") == q.depth)
    for key, value in q.property_equals:
        out &= leaf("property", key, value)
    for key, value in q.property_contains:
        out &= leaf("property-contains", key, value)
    return out & q.predicate() if q.predicate else out


def run(elements: DataFrame, q: Query) -> DataFrame:
    """The elements a query selects; a limit holds for each document, in id order, after all else.

    A relation with no ids adds nothing, as from a builder that was given none.
    """
    out = elements.where(condition(q))
    for kind, ids in q.relations:
        if not ids:
            continue
        match kind:
            case "child-of":
                out = out.where(F.col("parent_id").isin(ids))
            case "at":
                out = out.where(F.col("id").isin(ids))
            case "descendant-of":
                out = out.where(F.arrays_overlap("ancestor_ids", F.array(*map(F.lit, ids)).cast("array<long>")))
            case "ancestor-of":
                above = elements.where(F.col("id").isin(ids)).select("source_file", F.explode("ancestor_ids").alias("id")).distinct()
                out = out.join(above, ["source_file", "id"], "left_semi")
            case _:
                raise ValueError(f"no relation {kind!r}")
    if q.limit is not None:
        out = out.withColumn("_place", F.row_number().over(Window.partitionBy("source_file").orderBy("id"))).where(F.col("_place") <= q.limit).drop("_place")
    return out


def from_packet(text: str) -> Query:
    """A JSON packet, schemaVersion 1; unknown keys are errors."""
    body = json.loads(text)
    if body.pop("schemaVersion", 1) != 1:
        raise ValueError("schemaVersion is not 1")
    names = {"category": "category", "kind": "kind", "affiliatedName": "name", "context": "context", "outlinePathPrefix": "prefix", "outlinePathExactLen": "depth", "limit": "limit"}
    q = Query()
    for key, value in body.items():
        if key in names:
            setattr(q, names[key], value)
        elif key in ("propertyEquals", "propertyContains"):
            setattr(q, "property_equals" if key == "propertyEquals" else "property_contains", list(value.items()))
        elif key == "relations":
            q.relations = [(r["type"], r["ids"]) for r in value]
        elif key == "predicate":
            q.predicate = lambda value=value: _packet_predicate(value)
        else:
            raise ValueError(f"unknown key {key!r}")
    return q


def _packet_predicate(p: dict) -> Column:
    (kind, value), *more = p.items()
    if more:
        raise ValueError("a predicate has one key")
    match kind:
        case "all" | "any":
            out = F.lit(kind == "all")
            for x in value:
                out = out & _packet_predicate(x) if kind == "all" else out | _packet_predicate(x)
            return out
        case "not":
            return ~_packet_predicate(value)
        case "propertyEquals" | "propertyContains":
            (k, v), *_ = value.items()
            return leaf("property" if kind == "propertyEquals" else "property-contains", k, v)
        case "affiliatedName":
            return leaf("name", value)
    return leaf(kind, value)


def to_packet(q: Query) -> str:
    """The JSON packet of a query without a predicate."""
    body = {"schemaVersion": 1, "category": q.category, "kind": q.kind, "affiliatedName": q.name, "context": q.context, "outlinePathPrefix": q.prefix or None, "outlinePathExactLen": q.depth, "propertyEquals": dict(q.property_equals) or None, "propertyContains": dict(q.property_contains) or None, "relations": [{"type": k, "ids": i} for k, i in q.relations] or None, "limit": q.limit}
    return json.dumps({k: v for k, v in body.items() if v is not None})


def read_sexpr(text: str) -> list:
    """Lists, atoms and strings; a string is a tuple of one, so that it can't be taken for an atom."""
    tokens = re.findall(r';[^\n]*|[()]|"(?:\\.|[^"\\])*"|[^\s()";]+', text)
    stack: list[list] = [[]]
    for t in tokens:
        if t[0] == ";":
            continue
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            done = stack.pop()
            stack[-1].append(done)
        elif t[0] == '"':
            stack[-1].append((re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]),))
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("unbalanced (")
    return stack[0]


def _plain(x) -> str:
    return x[0] if isinstance(x, tuple) else x


def from_sexpr(text: str) -> Query:
    """An S-expression.  ``and`` merges: later scalars overwrite earlier ones, lists append; a real conjunction stands in ``predicate``."""
    forms = read_sexpr(text)
    if len(forms) != 1:
        raise ValueError("one form is expected")
    q = Query()
    _merge(q, forms[0])
    return q


def _merge(q: Query, form: list) -> None:
    head, *rest = form
    match head:
        case "org-elements-query" | "query" | "and":
            for x in rest:
                _merge(q, x)
        case "category" | "context" | "name":
            setattr(q, head, _plain(rest[0]))
        case "kind" | "type":
            q.kind = _plain(rest[0])
            q.category = IMPLIED.get(q.kind, "element")
        case "outline-path-prefix":
            q.prefix = [_plain(x) for x in rest]
        case "outline-path-exact-len" | "outline-depth":
            q.depth = int(rest[0])
        case "property":
            q.property_equals.append((_plain(rest[0]), _plain(rest[1])))
        case "property-contains":
            q.property_contains.append((_plain(rest[0]), _plain(rest[1])))
        case "limit":
            q.limit = int(rest[0])
        case "child-of" | "contents-of" | "descendant-of" | "within" | "in-contents-of" | "ancestor-of" | "lineage-of" | "at":
            kind = {"contents-of": "child-of", "within": "descendant-of", "in-contents-of": "descendant-of", "lineage-of": "ancestor-of"}.get(head, head)
            q.relations.append((kind, [int(x) for x in rest]))
        case "predicate":
            q.predicate = lambda: _sexpr_predicate(rest[0])
        case _:
            q.kind, q.category = head, IMPLIED.get(head, "element")
            for key, value in zip(rest[::2], rest[1::2], strict=True):
                q.property_equals.append((_plain(key).lstrip(":"), _plain(value)))


def _sexpr_predicate(form: list) -> Column:
    head, *rest = form
    match head:
        case "and" | "or":
            out = F.lit(head == "and")
            for x in rest:
                out = out & _sexpr_predicate(x) if head == "and" else out | _sexpr_predicate(x)
            return out
        case "not":
            return ~_sexpr_predicate(rest[0])
        case "=":
            return leaf("property", _plain(rest[0]), _plain(rest[1]))
        case "contains":
            return leaf("property-contains", _plain(rest[0]), _plain(rest[1]))
    return leaf("kind" if head == "type" else head, *map(_plain, rest))


def from_selector(text: str) -> Query:
    """A plist selector, (:org-element (:type T :name N :language L))."""
    match read_sexpr(text):
        case [[":org-element", list(body)]] if len(body) % 2 == 0:
            values = dict(zip(body[::2], map(_plain, body[1::2]), strict=True))
        case _:
            raise ValueError("no element selector")
    if unknown := values.keys() - {":type", ":name", ":language"}:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    q = Query(category="element", kind=values.get(":type"), name=values.get(":name"))
    if ":language" in values:
        q.property_equals.append(("language", values[":language"]))
    return q
