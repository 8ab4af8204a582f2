"""Scalar functions on the small notations of outline documents: timers, entities, special strings, table cookies, plot options, bounds of clock tables."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F


def timers(text: Column) -> Column:
    """All timer stamps [-]H:MM:SS that stand alone, as structs of raw and seconds."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w:.-])(-?\d+:[0-5]\d:[0-5]\d)(?![\w:])"), F.lit(1))
    part = lambda t, i: F.regexp_extract(t, r"^-?(\d+):(\d\d):(\d\d)$", i).cast("long")
    sign = lambda t: F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
    return F.transform(found, lambda t: F.struct(t.alias("raw"), (sign(t) * (part(t, 1) * 3600 + part(t, 2) * 60 + part(t, 3))).alias("seconds")))


def entity(name: Column, to: str = "utf8") -> Column:
    """The character of a named entity as ``utf8`` or ``html``; null if there is none.

    The names are those of HTML 4 in the standard library, which org entities share.
    """
    table = F.create_map(*(F.lit(x) for kv in sorted(html.entities.name2codepoint.items()) for x in (kv[0], chr(kv[1]) if to == "utf8" else f"&{kv[0]};")))
    return F.try_element_at(table, name)


def special_strings(text: Column) -> Column:
    r"""``---``, ``--``, ``...`` and ``\-`` as an em dash, an en dash, an ellipsis and a soft hyphen."""
    for a, b in (("---", "—"), ("--", "–"), ("...", "…"), ("\\-", "­")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def percent_decoded(text: Column) -> Column:
    """Percent escapes as characters; a plus stays one."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def alignments(cells: Column) -> Column:
    """Of a row of cells that are all cookies <l>, <c>, <r> (with a width or alone) or empty: left, center, right or null each; null if it is another row."""
    cookie = lambda c: F.regexp(c, F.lit(r"^<([lcr])?\d*>$"))
    ok = F.forall(cells, lambda c: (c == "") | cookie(c)) & F.exists(cells, cookie)
    letter = lambda c: F.regexp_extract(c, r"^<([lcr])\d*>$", 1)
    return F.when(ok, F.transform(cells, lambda c: F.when(letter(c) == "l", "left").when(letter(c) == "c", "center").when(letter(c) == "r", "right")))


def plot_options(value: Column) -> Column:
    """The options of a PLOT line, key:value or key:"some words", as a map with lower-case keys; the first of a key counts."""
    pairs = F.regexp_extract_all(value, F.lit(r'(\w+:(?:"[^"]*"|\S+))'), F.lit(1))
    key = lambda p: F.lower(F.substring_index(p, ":", 1))
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), F.trim(F.regexp_extract(p, r"^\w+:(.*)$", 1), F.lit('"')).alias("value")))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(first)


def bounds(start: Column, stop: Column) -> tuple[Column, Column]:
    """The window of :tstart and :tend, absolute times; an end without a time is the midnight after it."""
    bare = lambda c: F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})(?:[^\d>\]]*(\d{1,2}:\d{2}))?", 1)
    time = lambda c: F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})(?:[^\d>\]]*(\d{1,2}:\d{2}))?", 2)
    moment = lambda c: F.concat(bare(c), F.lit(" "), F.lpad(F.when(time(c) != "", time(c)).otherwise("0:00"), 5, "0")).try_cast("timestamp_ntz")
    end = F.when(time(stop) == "", F.date_add(bare(stop).try_cast("date"), 1).cast("timestamp_ntz")).otherwise(moment(stop))
    return moment(start), end


def diary_dates(sexp: Column, start: Column, end: Column) -> Column:
    """The days of (diary-date M D) from ``start`` to ``end``, one for each year that has such a day; null for another expression."""
    part = lambda i: F.regexp_extract(sexp, r"\(diary-date\s+(\d{1,2})\s+(\d{1,2})\s*\)", i).try_cast("int")
    month, day = part(1), part(2)
    days = F.transform(F.sequence(F.year(start), F.year(end)), lambda y: F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))
    return F.when(month.isNotNull(), F.filter(days, lambda x: x.isNotNull() & (x >= start) & (x <= end)))


def attachment_folder(directory: Column, attach: Column, id_: Column, root: str = "data") -> Column:
    """The folder of a headline's attachments: DIR before ATTACH_DIR before the layout of ID."""
    from sheaf.functions.text import id_folder

    return F.coalesce(directory, attach, F.concat(F.lit(root + "/"), id_folder(id_)))
