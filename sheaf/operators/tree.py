"""Operators on outlines: closures, rollups, column summaries, blockers, inherited values.

Sums over a subtree are associative, so each row is first added up by section
and then counted once for each ancestor; the closure is the ``ancestor_ids``
array, not a recursion.  A hot ancestor (a root) costs nothing: partial sums
leave each task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.dates import hours_minutes
from sheaf.operators.stored import settled


def is_done(sections: DataFrame) -> Column:
    """Whether a headline's keyword is a done one: by the kind of the keyword where the parser gives it, else by the name DONE."""
    return F.coalesce(F.col("todo_type") == "done" if "todo_type" in sections.columns else F.col("todo") == "DONE", F.lit(False))


def clock_summary(clocks: DataFrame) -> DataFrame:
    """By section: entries, closed, running, total_seconds."""
    closed = F.col("seconds").isNotNull()
    return clocks.groupBy("section_id").agg(F.count("*").alias("entries"), F.count_if(closed).alias("closed"), F.count_if(~closed).alias("running"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("total_seconds"))


def subtree_sums(sections: DataFrame, values: dict[str, Column], include_self: bool = True) -> DataFrame:
    """Sums of section columns over each subtree: (section_id, <name>...)."""
    scope = F.concat("ancestor_ids", F.array("section_id")) if include_self else F.col("ancestor_ids")
    rows = sections.select(F.explode(scope).alias("section_id"), *(v.alias(k) for k, v in values.items()))
    return rows.groupBy("section_id").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in values))


def clock_rollup(sections: DataFrame, clocks: DataFrame) -> DataFrame:
    """Clock and effort of each subtree, their difference and status."""
    own = sections.join(clock_summary(clocks), "section_id", "left")
    total = subtree_sums(own, {"clock_seconds": F.coalesce("total_seconds", F.lit(0)), "effort": F.coalesce("effort_seconds", F.lit(0))})
    delta = F.col("clock_seconds") - F.col("effort")
    status = F.when(F.col("effort") == 0, "noEffort").when(delta < 0, "underEffort").when(delta == 0, "onEffort").otherwise("overEffort")
    return sections.select("section_id", "level", "title").join(total, "section_id").select("section_id", "level", "title", "clock_seconds", "effort", delta.alias("delta_seconds"), status.alias("status"))


def progress(sections: DataFrame) -> DataFrame:
    """Headlines with TODO below each section, itself not counted, and effort with it."""
    state = F.col("todo").isNotNull()
    below = subtree_sums(sections, {"total": state.cast("long"), "done": (state & is_done(sections)).cast("long")}, include_self=False)
    effort = subtree_sums(sections, {"effort": F.coalesce("effort_seconds", F.lit(0))})
    out = sections.select("section_id", "level").join(effort, "section_id").join(below, "section_id", "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    return out.select("section_id", "level", total.alias("total"), done.alias("done"), (total - done).alias("open"), "effort")


def clock_table(sections: DataFrame, clocks: DataFrame, start, end, max_level: int = 2, matched: Column | None = None) -> DataFrame:
    """Clock table rows for a window: an unmatched section loses its own clocks only; a row needs clock or effort and a level up to ``max_level``."""
    stop = F.col("start") + F.make_dt_interval(secs=F.col("seconds"))
    lap = F.greatest(F.lit(0), F.floor((F.least(stop, F.lit(end)).cast("long") - F.greatest(F.col("start"), F.lit(start)).cast("long")) / 60) * 60)
    whole = (F.col("start") >= F.lit(start)) & (stop <= F.lit(end))
    local = clocks.where(F.col("seconds").isNotNull()).select("section_id", F.when(whole, F.col("seconds")).otherwise(lap).alias("seconds")).groupBy("section_id").agg(F.sum("seconds").alias("local"))
    rows = sections.join(local, "section_id", "left")
    mine = F.coalesce("local", F.lit(0)) if matched is None else F.when(matched, F.coalesce("local", F.lit(0))).otherwise(0)
    total = subtree_sums(rows, {"clock_seconds": mine, "effort": F.coalesce("effort_seconds", F.lit(0))})
    out = sections.where(F.col("level") <= max_level).select("section_id", "level", "title").join(total, "section_id")
    return out.where((F.col("clock_seconds") > 0) | (F.col("effort") > 0)).withColumn("clock", hours_minutes(F.col("clock_seconds")))


SUMMARIES: dict[str, Column] = {"+": F.sum, "min": F.min, "max": F.max, "mean": F.avg}


def column_summary(sections: DataFrame, cell: Column, op: str, deepest: int) -> DataFrame:
    """A column view's summary, bottom up: a child's summary stands in place of its own cell, so a mean is a mean of means.

    One aggregation for each level; ``deepest`` bounds the loop.  Each level is
    stored, so that the plan of one doesn't hold those of all below it.
    """
    how = SUMMARIES[op]
    rows = settled(sections.select("section_id", "parent_id", "level", cell.alias("cell")))
    below = rows.where(F.col("level") == deepest).select("section_id", "parent_id", "level", "cell", F.col("cell").alias("summary"))
    out = below
    for level in range(deepest - 1, 0, -1):
        got = below.where(F.col("summary").isNotNull()).groupBy("parent_id").agg(how("summary").alias("got")).withColumnRenamed("parent_id", "section_id")
        below = rows.where(F.col("level") == level).join(got, "section_id", "left").select("section_id", "parent_id", "level", "cell", F.coalesce("got", "cell").alias("summary"))
        below = settled(below) if level > 1 else below
        out = out.union(below)
    return out


def checkbox_summary(sections: DataFrame, done: Column) -> DataFrame:
    """By parent: the X, X/ and X% summaries of its children."""
    g = sections.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count_if(done).alias("n"), F.count("*").alias("all"))
    state = F.when(F.col("n") == F.col("all"), "[X]").when(F.col("n") > 0, "[-]").otherwise("[ ]")
    return g.select(F.col("parent_id").alias("section_id"), state.alias("state"), F.format_string("[%d/%d]", "n", "all").alias("counts"), F.format_string("[%d%%]", F.floor((F.col("n") * 100 + F.floor(F.col("all") / 2)) / F.col("all"))).alias("percent"))


def estimate_summary(ranges: DataFrame, by: str, low: str, high: str) -> DataFrame:
    """est+: the sum of means, plus and minus the root of summed variances, as "lo-hi"."""
    mean, var = (F.col(low) + F.col(high)) / 2, F.pow((F.col(high) - F.col(low)) / 2, F.lit(2))
    g = ranges.groupBy(by).agg(F.sum(mean).alias("m"), F.sqrt(F.sum(var)).alias("s"))
    return g.select(by, F.format_string("%d-%d", F.bround(F.col("m") - F.col("s")).cast("long"), F.bround(F.col("m") + F.col("s")).cast("long")).alias("estimate"))


def ordered_blockers(rows: DataFrame, parent: str, order: str, is_open: Column) -> DataFrame:
    """Open children of an ordered parent, each with the open sibling before it."""
    w = Window.partitionBy(parent).orderBy(order)
    return rows.where(is_open).withColumn("blocked_by", F.lag(order).over(w)).where(F.col("blocked_by").isNotNull())


def stuck_projects(sections: DataFrame, next_keywords: tuple[str, ...] = ("NEXT",)) -> DataFrame:
    """Headlines with a TODO that have an open one below and none that is a next action (by keyword or the tag next, in any case)."""
    is_open = F.col("todo").isNotNull() & ~is_done(sections)
    is_next = F.upper("todo").isin(*(k.upper() for k in next_keywords)) | F.exists("effective_tags", lambda t: F.lower(t) == "next")
    below = subtree_sums(sections, {"open": F.coalesce(is_open, F.lit(False)).cast("long"), "nexts": F.coalesce(is_next, F.lit(False)).cast("long")}, include_self=False)
    projects = sections.where(F.col("todo").isNotNull()).select("section_id")
    return below.where((F.col("open") > 0) & (F.col("nexts") == 0)).join(projects, "section_id", "left_semi").select("section_id", "open")


def nearest_inherited(sections: DataFrame, value: Column) -> DataFrame:
    """The value of the nearest ancestor or self that has one."""
    own = sections.select("section_id", "level", value.alias("value")).where(F.col("value").isNotNull())
    up = sections.select("section_id", F.explode(F.concat("ancestor_ids", F.array("section_id"))).alias("above"))
    return up.join(own.withColumnRenamed("section_id", "above"), "above").groupBy("section_id").agg(F.max_by("value", "level").alias("inherited"))
