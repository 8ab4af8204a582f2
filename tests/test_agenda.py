"""The agenda over all entries of a range, past-due ones among them."""

import datetime as dt

from pyspark.sql import functions as F

from sheaf import catalog
from sheaf.operators import agenda


def test_order_is_made_by_several_tasks(spark):
    days = spark.range(400).select(F.col("id").alias("section_id"), F.when(F.col("id") % 10 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 190).cast("int"))).alias("scheduled"), (F.col("id") % 3).alias("level"), F.concat(F.lit("t"), F.col("id") % 7).alias("title"))
    a, b = dt.date(1995, 6, 1), dt.date(1995, 6, 14)
    entries = agenda.scheduled_entries(days.repartition(3), a, b)
    out = agenda.in_order(entries, F.when(F.col("section_id") % 2 == 0, "10:00"), F.col("title"), F.col("section_id")).withColumn("task", F.spark_partition_id()).collect()
    key = lambda r: (r["display_date"], r["section_id"] % 2 == 0, r["level"], r["title"], r["section_id"])
    assert [r["sorted_position"] for r in sorted(out, key=key)] == list(range(1, entries.count() + 1))
    assert len({r["task"] for r in out}) > 1 and {r["state"] for r in out} == {"pastDue", "onDate"}
    assert agenda.in_order(entries.where("level > 9"), F.lit(None).cast("string"), F.col("title")).count() == 0


def test_all_open_entries_are_sorted(spark, sf_dir):
    queries = catalog.queries()
    ids = lambda name: sorted(r["section_id"] for r in queries[name](spark, sf_dir).collect())
    assert ids("agenda_sorted_all") == ids("agenda_scheduled")


def test_old_repeaters_are_expanded(spark, sf_dir):
    queries = catalog.queries()
    out = queries["agenda_repeater_all"](spark, sf_dir)
    late = queries["agenda_scheduled"](spark, sf_dir).select("section_id").join(catalog.outline.sections(spark, sf_dir).where("todo = 'NEXT'"), "section_id")
    assert out.select("section_id").distinct().count() == late.count()
    assert out.groupBy("section_id").agg(F.min("target_date").alias("first")).where("first < date '1995-05-01'").count() == late.where("scheduled < date '1995-05-01'").count() > 0
