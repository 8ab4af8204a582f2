"""Scalar functions on text as Column expressions.

Three regimes of comparison are kept apart: exact, ASCII case folding
(``ascii_lower``; ``lower`` would fold letters outside ASCII too), and typed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUMBER = r"^[+-]?(inf(inity)?|nan|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def slugify(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def selector_component(c: Column) -> Column:
    """A part of a structural selector: ASCII letters, digits, ``-_.`` stay, lower-cased; other runs become a dash."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), r"[^a-z0-9\-_.]+", "-"), "^-+|-+$", "")


def preview(c: Column, chars: int = 240) -> Column:
    """White space collapsed, at most ``chars`` characters and then an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))
    return F.when(F.char_length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("..."))).otherwise(flat)


def contains_terms(blob: Column, terms: list[str]) -> Column:
    """Whether every white-space token of every term stands in ``blob``, ASCII case aside."""
    low = ascii_lower(blob)
    out = F.lit(True)
    for token in (t for term in terms for t in term.split()):
        out &= F.coalesce(F.contains(low, F.lit(token.translate({i: i + 32 for i in range(65, 91)}))), F.lit(False))
    return out


def number(c: Column) -> Column:
    """The value of a text that is a decimal number and nothing else, or null."""
    return F.when(F.regexp(c, F.lit(_NUMBER)), c.try_cast("double"))


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` of a text, from 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


def cookie(c: Column) -> Column:
    """The first statistics cookie, [n/m] or [p%], as struct of done, total, percent."""
    counts = F.regexp_extract(c, r"\[([0-9]*)/([0-9]*)\]", 0)
    percent = F.regexp_extract(c, r"\[([0-9]*)%\]", 0)
    pick = lambda source, pattern: F.regexp_extract(source, pattern, 1).try_cast("long")
    return F.struct(
        F.when(counts != "", pick(counts, r"\[([0-9]*)/")).alias("done"), F.when(counts != "", pick(counts, r"/([0-9]*)\]")).alias("total"), F.when(percent != "", pick(percent, r"\[([0-9]*)%")).alias("percent")
    )


def link_kind(path: Column) -> Column:
    """The protocol class of a link path."""
    head = F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(head.isin("http", "https", "ftp"), "web").when(head.isin("file", "attachment", "id", "doi", "elisp", "shell"), head).when(head == "mailto", "message").when(head == "org-protocol", "org-protocol")
        .when(F.startswith(path, F.lit("#")), "custom-id").when(F.startswith(path, F.lit("*")), "headline").when(F.startswith(path, F.lit("(")) & F.endswith(path, F.lit(")")), "coderef")
        .when(F.regexp(path, F.lit(r"^(/|\./|\.\./|~/)")), "file").when(head != "", "custom").otherwise("fuzzy")
    )


def id_folder(c: Column) -> Column:
    """The folder of an ID below the attachment root: two letters and the rest of a UUID, six digits and the rest of a timestamp, else __/ and the first letter."""
    uuid = F.regexp(c, F.lit(r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    stamp = F.regexp(c, F.lit(r"^\d{8}T\d{6}"))
    cut = lambda n: F.concat(F.substring(c, 1, n), F.lit("/"), F.substring(c, n + 1, 1 << 20))
    return F.when(uuid, cut(2)).when(stamp, cut(6)).when(c != "", F.concat(F.lit("__/"), F.substring(c, 1, 1), F.lit("/"), c))
