"""The agenda: what of an outline shows on which day, in which order, how urgent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.dates import occurrences
from sheaf.operators.stored import settled
from sheaf.operators.tree import is_done

#: Order of kinds on one day.
KIND_ORDER = {"deadline": 0, "scheduled": 1, "timestamp": 2, "diary": 3, "closed": 4}
#: Scores: a step of priority, an open task, a tag that presses.
PRIORITY_STEP, TODO_SCORE, TAG_SCORE = 1000, 250, 200


def _range(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    return (start, end) if start <= end else (end, start)


def visible(sections: DataFrame, include_done: bool = False, required: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Headlines that an agenda may show: none that is done unless asked, all required tags, no excluded one."""
    out = sections if include_done else sections.where(~is_done(sections))
    for tag in required:
        out = out.where(F.array_contains("effective_tags", tag))
    return out.where(~F.arrays_overlap("effective_tags", F.array(*map(F.lit, excluded)).cast("array<string>"))) if excluded else out


def scheduled_entries(sections: DataFrame, start: dt.date, end: dt.date, value: Column | None = None, unit: Column | None = None, delay: Column | None = None) -> DataFrame:
    """Rows for SCHEDULED: on its day, or past due at the start of the range, one for each past occurrence.

    ``delay``: days by which a warning cookie puts a row off.
    """
    a, b = _range(start, end)
    rows = sections.where(F.col("scheduled").isNotNull() & (F.col("scheduled") <= F.lit(b)))
    dates = F.array("scheduled") if value is None else F.when(value.isNull(), F.array("scheduled")).otherwise(occurrences(F.col("scheduled"), value, unit, F.lit(b)))
    rows = rows.withColumn("target_date", F.explode(dates))
    shown = F.col("target_date") if delay is None else F.date_add("target_date", F.coalesce(delay, F.lit(0)).cast("int"))
    state = F.when(F.col("target_date") < F.lit(a), "pastDue").when(shown > F.col("target_date"), "delayed").otherwise("onDate")
    day = F.when(shown < F.lit(a), F.lit(a)).otherwise(shown)
    return rows.select("*", day.alias("display_date"), F.lit("scheduled").alias("kind"), state.alias("state")).where(F.col("display_date").between(F.lit(a), F.lit(b)))


def deadline_entries(rows: DataFrame, start: dt.date, end: dt.date, warning: Column | None = None) -> DataFrame:
    """Rows for DEADLINE: on its day, overdue at the start of the range, or a warning from ``warning`` days before; without a cookie there is no warning."""
    a, b = _range(start, end)
    lead = F.date_sub("deadline", F.coalesce(warning, F.lit(0)).cast("int")) if warning is not None else F.col("deadline")
    state = F.when(F.col("deadline") < F.lit(a), "overdue").when(F.col("deadline") <= F.lit(b), "due").otherwise("warning")
    day = F.when(F.col("deadline") < F.lit(a), F.lit(a)).when(F.col("deadline") <= F.lit(b), F.col("deadline")).otherwise(F.greatest(lead, F.lit(a)))
    return rows.where(F.col("deadline").isNotNull() & (lead <= F.lit(b))).select("*", day.alias("display_date"), F.lit("deadline").alias("kind"), state.alias("state"))


def span_entries(rows: DataFrame, first: Column, last: Column, start: dt.date, end: dt.date) -> DataFrame:
    """One row for each day of a span that lies in the range."""
    a, b = _range(start, end)
    lo, hi = F.greatest(first, F.lit(a)), F.least(last, F.lit(b))
    return rows.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("display_date"))


def in_order(entries: DataFrame, time: Column, title: Column, *ties: Column) -> DataFrame:
    """The default order as 1-based ``sorted_position``: day, time (none first), kind, level, title."""
    kind = F.create_map(*(F.lit(x) for kv in KIND_ORDER.items() for x in kv))[F.col("kind")]
    # Positions of a whole agenda are one sequence: a range exchange sorts, and places are offsets of sorted runs.
    # The runs are stored, as a range exchange that runs twice may cut them elsewhere.
    keys = [F.col("display_date").asc_nulls_first(), time.asc_nulls_first(), kind.asc_nulls_first(), F.col("level").asc_nulls_first(), title.asc_nulls_first(), *ties]
    spark = entries.sparkSession
    runs = settled(entries.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys))
    # Partition in the upper 31 bits, row of it in the lower 33.
    runs = runs.withColumn("_at", F.monotonically_increasing_id())
    runs = runs.select("*", F.shiftright("_at", 33).alias("_run"), (F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("_place")).drop("_at")
    # One row for each run.
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return runs.join(F.broadcast(offsets), "_run").select(*entries.columns, (F.col("_offset") + F.col("_place")).cast("long").alias("sorted_position"))


def urgency(rows: DataFrame, today: dt.date, tags: tuple[str, ...] = ("urgent", "now", "important")) -> DataFrame:
    """A sum of ingredients: priority, deadline, scheduled, TODO, tags."""
    lowest, value = F.lit(ord("C")), F.ascii(F.coalesce("priority", F.lit("B")))
    late = F.date_diff(F.lit(today), F.col("scheduled"))
    scheduled = F.when(F.col("scheduled").isNull(), 0).when(late > 0, 1500 + 5 * late).when(late == 0, 500).otherwise(late)
    pressing = F.size(F.array_intersect("effective_tags", F.array(*map(F.lit, tags))))
    todo = F.when(F.col("todo").isNotNull() & ~is_done(rows), TODO_SCORE).otherwise(0)
    return rows.withColumn("urgency", (PRIORITY_STEP * (lowest - value) + scheduled + todo + TAG_SCORE * pressing).cast("long"))


def limited(rows: DataFrame, partition: str, order: list[Column], limit: int) -> DataFrame:
    """All rows with their place in the partition, and whether the limit lets them through; those beyond it stay, as skipped."""
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("skipped", F.col("place") > limit)
