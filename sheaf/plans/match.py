"""The tag and property match language, compiled to a Column.

``|`` separates clauses; a clause is a row of terms with ``+`` or ``-``; a term is
a tag, or PROP op value with op one of = == <> != /= < <= > >= (an optional * after
it), and a value that is bare, "quoted" or a {pattern}.  A pattern is a substring.
There are no parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.dates import timestamp_key
from sheaf.functions.text import number

_TERM = re.compile(r"""\s*(?P<sign>[+-]?)(?:(?P<key>[A-Za-z_][\w-]*)\s*(?P<op><>|!=|/=|==|<=|>=|=|<|>)\*?(?:"(?P<quoted>[^"]*)"|\{(?P<pattern>[^}]*)\}|(?P<bare>[^\s|&+"{}]+))|(?P<tag>[\w@#%]+))&?""")


@dataclass(frozen=True)
class Term:
    negative: bool
    key: str | None
    op: str | None
    value: str
    pattern: bool


def parse(text: str) -> list[list[Term]]:
    """Clauses of terms; an empty expression has none and matches everything."""
    clauses = []
    for part in text.split("|"):
        at, terms = 0, []
        part = part.strip()
        while at < len(part):
            m = _TERM.match(part, at)
            if not m or m.end() == at:
                raise ValueError(f"no match term at {part[at:]!r}")
            at = m.end()
            op = {"==": "=", "!=": "<>", "/=": "<>"}.get(m["op"] or "", m["op"])
            value = next((m[k] for k in ("quoted", "pattern", "bare", "tag") if m[k] is not None), "")
            terms.append(Term(m["sign"] == "-", m["key"], op, value, m["pattern"] is not None))
        if terms:
            clauses.append(terms)
    return clauses


def _compare(value: Column, term: Term) -> Column:
    """The ladder: pattern, then numbers, then timestamps, then text."""
    want = F.lit(term.value)
    if term.pattern:
        found = F.contains(value, want)
        return {"=": found, "<>": ~found}.get(term.op, F.lit(False))
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    op = ops[term.op]
    numbers = number(value).isNotNull() & number(want).isNotNull()
    times = timestamp_key(value).isNotNull() & timestamp_key(want).isNotNull()
    return F.when(numbers, op(number(value), number(want))).when(times, op(timestamp_key(value), timestamp_key(want))).otherwise(op(value, want))


def compile_match(text: str, tags: Column, properties: Column, special: dict[str, Column] | None = None, groups: dict[str, list[str]] | None = None) -> Column:
    """The expression as a two-valued Column.

    ``special`` has columns of properties that are no entries of the map; a missing
    property makes its term false, whatever the operator, so ``-PROP=x`` holds.
    ``groups``: a group tag stands for its members too; tags ignore case.
    """
    special = {k.upper(): v for k, v in (special or {}).items()}
    closure = {k.lower(): {k.lower(), *(m.lower() for m in v)} for k, v in (groups or {}).items()}
    for _ in range(len(closure)):
        closure = {k: v | {y for x in v for y in closure.get(x, ())} for k, v in closure.items()}
    low = F.transform(tags, lambda t: F.lower(t))

    def one(term: Term) -> Column:
        if term.key is None:
            names = sorted(closure.get(term.value.lower(), {term.value.lower()}))
            hit = F.arrays_overlap(low, F.array(*map(F.lit, names)))
        elif term.key.upper() in ("TAGS", "ALLTAGS"):
            joined = F.concat(F.lit(":"), F.array_join(tags, ":"), F.lit(":"))
            hit = _compare(joined, term) if term.pattern or term.op not in ("=", "<>") else None
            if hit is None:
                same = (joined == term.value) | F.array_contains(low, term.value.strip(":").lower())
                hit = same if term.op == "=" else ~same
        else:
            value = special.get(term.key.upper(), F.try_element_at(properties, F.lit(term.key.upper())))
            hit = _compare(value, term)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if term.negative else hit

    out = None
    for clause in parse(text):
        every = F.lit(True)
        for term in clause:
            every &= one(term)
        out = every if out is None else out | every
    return F.lit(True) if out is None else out
