"""Agenda views: sort strategies, plans of one view and of several blocks, commands over many documents, and what a planner does next."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import ascii_lower
from sheaf.operators import agenda, tree

#: Keys of a strategy, and the column each one sorts by.
KEYS = {
    "displayDate": "display_date", "time": "time", "kind": "_kind", "level": "level", "title": "title", "targetDate": "target_date", "scheduledDate": "scheduled", "deadlineDate": "deadline", "priority": "priority",
    "category": "category", "todoState": "todo",
}


@dataclass(frozen=True)
class View:
    """What an agenda shows; the values here are the defaults: no done, both planning kinds, days from ``start`` to ``end``."""

    start: dt.date
    end: dt.date
    include_done: bool = False
    scheduled: bool = True
    deadlines: bool = True
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    strategy: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    name: str = "agenda"
    extra: dict = field(default_factory=dict, compare=False)


def order(strategy: tuple[tuple[str, str], ...], columns: list[str]) -> list[Column]:
    """The sort of a strategy of (key, up | down | keep): nulls last going up and first going down; keep says nothing; ties keep the input's order (``ordinal``)."""
    out = []
    for key, direction in strategy:
        if KEYS[key] in columns and direction != "keep":
            c = F.col(KEYS[key])
            out.append(c.asc_nulls_last() if direction == "up" else c.desc_nulls_first())
    return [*out, F.col("ordinal").asc()]


def entries(sections: DataFrame, view: View) -> DataFrame:
    """The entries of a view, scheduled and deadline, with display_date, kind and state."""
    shown = agenda.visible(sections, view.include_done, view.required, view.excluded)
    parts = []
    if view.scheduled:
        parts.append(agenda.scheduled_entries(shown, view.start, view.end))
    if view.deadlines and "deadline" in sections.columns:
        parts.append(agenda.deadline_entries(shown, view.start, view.end).withColumn("target_date", F.col("deadline")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def plan(sections: DataFrame, view: View, blockers: DataFrame | None = None, today: dt.date | None = None) -> DataFrame:
    """A view's entries by document, with ``position`` in its order, whether the limit ``skipped`` it, urgency, and the tasks that block it.

    Places are numbered within a document (``source_file``), as a view is one
    document's; ``blockers``: (section_id, blocked_by).
    """
    kind = F.create_map(*(F.lit(x) for kv in agenda.KIND_ORDER.items() for x in kv))[F.col("kind")]
    rows = entries(sections, view).withColumn("_kind", kind).withColumn("ordinal", F.col("section_id"))
    rows = agenda.urgency(rows, today or view.start) if "priority" in rows.columns else rows
    if blockers is not None:
        held = blockers.groupBy("section_id").agg(F.array_sort(F.collect_set("blocked_by")).alias("blocked_by"))
        rows = rows.join(held, "section_id", "left")
    w = Window.partitionBy("source_file").orderBy(*order(view.strategy, rows.columns), F.col("display_date"), F.col("_kind"))
    rows = rows.withColumn("position", F.row_number().over(w).cast("long"))
    skipped = F.col("position") > view.limit if view.limit is not None else F.lit(False)
    return rows.withColumn("skipped", skipped).drop("_kind")


def block_plan(sections: DataFrame, views: list[View], **more) -> DataFrame:
    """Several views one after the other: their plans with block_index and block_name."""
    parts = [plan(sections, v, **more).withColumns({"block_index": F.lit(i), "block_name": F.lit(v.name)}) for i, v in enumerate(views)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def section_urgency(sections: DataFrame) -> Column:
    """The urgency of a headline without a date: priority, an open task, the tags urgent and now."""
    value = F.ascii(F.coalesce("priority", F.lit("B")))
    pressing = F.size(F.array_intersect(F.transform("effective_tags", lambda t: F.lower(t)), F.array(F.lit("urgent"), F.lit("now"))))
    todo = F.when(F.col("todo").isNotNull() & ~tree.is_done(sections), agenda.TODO_SCORE).otherwise(0)
    return (agenda.PRIORITY_STEP * (F.lit(ord("C")) - value) + todo + agenda.TAG_SCORE * pressing).cast("long")


def search(sections: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Headlines whose title, body (column ``body`` if there is one) or a property, as "KEY value", has the needle."""
    facts = F.transform(F.map_entries("properties"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    parts = [F.array("title"), facts] + ([F.array("body")] if "body" in sections.columns else [])
    fold = (lambda c: c) if case_sensitive else ascii_lower
    text = needle if case_sensitive else needle.translate({i: i + 32 for i in range(65, 91)})
    return sections.where(F.exists(F.concat(*parts), lambda c: F.contains(fold(F.coalesce(c, F.lit(""))), F.lit(text))))


def commands(sections: DataFrame, wanted: list[tuple[str, str, object]], limit: int | None = None) -> DataFrame:
    """Named commands over all documents: (command, kind, source_file, section_id, place, skipped), one after the other.

    ``wanted``: (name, kind, argument); agenda takes a View, todo nothing, match a
    Column, search a text, stuck the next keywords.  A limit holds for each document.
    """
    out = []
    for name, kind, argument in wanted:
        if kind == "agenda":
            rows = entries(sections, argument).select("source_file", "section_id").distinct()
        elif kind == "todo":
            rows = agenda.visible(sections).where(F.col("todo").isNotNull())
        elif kind == "match":
            rows = sections.where(argument)
        elif kind == "search":
            rows = search(sections, argument)
        elif kind == "stuck":
            rows = sections.join(tree.stuck_projects(sections, argument or ("NEXT",)).select("section_id"), "section_id", "left_semi")
        else:
            raise ValueError(f"no such command: {kind}")
        w = Window.partitionBy("source_file").orderBy("section_id")
        rows = rows.select("source_file", "section_id", F.row_number().over(w).cast("long").alias("place"))
        out.append(rows.select(F.lit(name).alias("command"), F.lit(kind).alias("kind"), "source_file", "section_id", "place", (F.col("place") > limit if limit is not None else F.lit(False)).alias("skipped")))
    return reduce(DataFrame.unionByName, out)


def snapshot(sections: DataFrame, view: View, blockers: DataFrame | None = None) -> DataFrame:
    """What a planner should know of each entry: a decision (overdue, due, warning, pastDue, delayed, scheduled) and how pressing it is (error, warning, info)."""
    rows = plan(sections, view, blockers)
    decision = F.when(F.col("kind") == "deadline", F.col("state")).otherwise(F.when(F.col("state") == "onDate", "scheduled").otherwise(F.col("state")))
    severity = F.when(decision == "overdue", "error").when(decision.isin("due", "pastDue"), "warning").otherwise("info")
    return rows.withColumns({"decision": decision, "severity": severity})


def memory(cards: DataFrame, states: tuple[str, ...] = ("current", "closed", "archived", "background"), required: tuple[str, ...] = (), excluded: tuple[str, ...] = (), comments: bool = False) -> DataFrame:
    """Memory cards by state and tags; tags are taken as they are written, without groups."""
    out = cards.where(F.col("state").isin(*states))
    out = out if comments else out.where(~F.col("is_comment"))
    for tag in required:
        out = out.where(F.array_contains("effective_tags", tag))
    return out.where(~F.arrays_overlap("effective_tags", F.array(*map(F.lit, excluded)).cast("array<string>"))) if excluded else out


def memory_search(cards: DataFrame, terms: list[str] = (), properties: dict[str, str] | None = None, prefix: str = "", root_only: bool = False, limit: int = 12) -> DataFrame:
    """Cards whose title, TODO, a property or its value has each term, with the properties asked for, in files of a prefix; the first by file and line."""
    blob = ascii_lower(F.concat_ws("\n", "title", "todo", F.array_join(F.map_values("properties"), "\n")))
    out = cards.where(F.startswith("source_file", F.lit(prefix)))
    for term in terms:
        out = out.where(F.contains(blob, F.lit(term.translate({i: i + 32 for i in range(65, 91)}))))
    for key, value in (properties or {}).items():
        out = out.where(F.try_element_at("properties", F.lit(key.upper())) == value)
    out = out.where("level = 1") if root_only else out
    return out.orderBy("source_file", "line").limit(limit)
