"""Two notations of contracts: S-expressions with bindings, and blocks of key=value lines."""

from __future__ import annotations

from sheaf.operators.contracts import OPERATORS, Contract, Step
from sheaf.plans.elements import IMPLIED, Query, _merge, _plain, read_sexpr

_RELATIONS = {"child-of": "child-of", "contents-of": "child-of", "descendant-of": "descendant-of", "within": "descendant-of", "in-contents-of": "descendant-of", "at": "at"}


def _query(form: list) -> tuple[Query, tuple[str, str] | None]:
    """A query whose relations may name a binding, ``(within $name)``; the last such relation holds."""
    within, rest = None, []
    for part in form[1:] if form[0] in ("query", "and", "org-elements-query") else [form]:
        if isinstance(part, list) and len(part) == 2 and part[0] in _RELATIONS and isinstance(part[1], str) and part[1].startswith("$"):
            within = (_RELATIONS[part[0]], part[1][1:])
        else:
            rest.append(part)
    q = Query()
    _merge(q, ["query", *rest])
    return q, within


def from_sexprs(id_: str, text: str) -> Contract:
    """``(let name query)`` binds; ``(assert name op n query)``, ``(exists name query)`` and ``(not-exists name query)`` count."""
    steps = []
    for form in read_sexpr(text):
        match form:
            case ["let", name, list(body)]:
                expect = None
            case ["exists", name, list(body)]:
                expect = (">", 0)
            case ["not-exists", name, list(body)]:
                expect = ("==", 0)
            case ["assert", name, op, n, list(body)] if _plain(op) in OPERATORS:
                expect = (_plain(op), int(n))
            case _:
                raise ValueError(f"no contract step: {form!r}")
        query, within = _query(body)
        steps.append(Step(_plain(name), query, within, expect))
    return Contract(id_, steps)


def from_lines(text: str) -> Query:
    """A block of ``key=value`` lines; ``#`` begins a comment."""
    q = Query()
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, sep, value = line.partition("=")
        if not sep:
            raise ValueError(f"no key=value: {line!r}")
        match key.strip().split("."):
            case ["kind"]:
                q.kind, q.category = value, IMPLIED.get(value, "element")
            case ["category" | "name" | "context" as what]:
                setattr(q, what, value)
            case ["limit"]:
                q.limit = int(value)
            case ["child_of" | "within" | "descendant_of" | "at" as what]:
                q.relations.append((_RELATIONS[what.replace("_", "-")], [int(x) for x in value.split(",")]))
            case ["property" | "summary", name]:
                q.property_equals.append((name, value))
            case ["property_contains" | "summary_contains", name]:
                q.property_contains.append((name, value))
            case _:
                raise ValueError(f"unknown key {key!r}")
    return q
