"""Progress of headlines by their tasks and boxes, and the validation rules on statistics cookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _p(key: str) -> Column:
    return F.try_element_at("properties", F.lit(key))


def _finding(rows: DataFrame, code: str, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit("warning").alias("severity"), "source_file", "line", "range_start", message.alias("message"))


def task_counts(e: DataFrame) -> DataFrame:
    """(source_file, id, tasks, tasks_done, direct_tasks, direct_done): headlines with a TODO below each headline, and those right below it; done by the keyword's own kind."""
    heads = e.where("kind = 'headline'").where(_p("TODO").isNotNull())
    done = (_p("todo-type") == "done").cast("long")
    rows = heads.select("source_file", done.alias("done"), "parent_id", F.explode("ancestor_ids").alias("id"))
    direct = F.col("id") == F.col("parent_id")
    return rows.groupBy("source_file", "id").agg(F.count("*").alias("tasks"), F.sum("done").alias("tasks_done"), F.count_if(direct).alias("direct_tasks"), F.sum(F.when(direct, F.col("done")).otherwise(0)).alias("direct_done"))


def box_counts(e: DataFrame) -> DataFrame:
    """(source_file, id, boxes, checked, partial, unchecked, direct_boxes, direct_checked): boxes of list items under each element; direct ones are those of a list right in it."""
    items = e.where("kind = 'item'").where(_p("checkbox").isNotNull())
    lists = e.where("kind = 'plain-list'").select("source_file", F.col("id").alias("parent_id"), F.col("parent_id").alias("owner"))
    box = _p("checkbox")
    rows = items.withColumns({"on": (box == "on").cast("long"), "trans": (box == "trans").cast("long")}).join(lists, ["source_file", "parent_id"]).select("source_file", "on", "trans", "owner", F.explode("ancestor_ids").alias("id"))
    direct = F.col("id") == F.col("owner")
    out = rows.groupBy("source_file", "id").agg(F.count("*").alias("boxes"), F.sum("on").alias("checked"), F.sum("trans").alias("partial"), F.count_if(direct).alias("direct_boxes"), F.sum(F.when(direct, F.col("on")).otherwise(0)).alias("direct_checked"))
    return out.withColumn("unchecked", F.col("boxes") - F.col("checked") - F.col("partial"))


def dependency_counts(e: DataFrame) -> DataFrame:
    """(source_file, id, kind, n): what a headline's completion waits for: open tasks below, open boxes, a property ORDERED."""
    heads = e.where("kind = 'headline'").select("source_file", "id", F.lower(F.trim(_p("ORDERED"))).isin("t", "true", "yes", "1").alias("ordered"))
    rows = heads.join(task_counts(e), ["source_file", "id"], "left").join(box_counts(e), ["source_file", "id"], "left")
    of = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    each = F.array(of("openDescendantTodo", F.col("tasks") - F.col("tasks_done")), of("openCheckbox", F.col("boxes") - F.col("checked")), of("orderedProperty", F.col("ordered").cast("long")))
    return rows.select("source_file", "id", F.explode(each).alias("d")).select("source_file", "id", "d.kind", "d.n").where("n > 0")


def cookies(e: DataFrame) -> DataFrame:
    """Statistics cookies of headlines: the domain their counts are of (null if it is ambiguous), and what each should say.

    COOKIE_DATA, own or inherited, chooses direct, todo or checkbox, the first that
    it names, and recursive counts; without it a headline that has tasks only is
    counted by them, one that has boxes only by them, one with both is ambiguous,
    one with neither counts no tasks.
    """
    heads = e.where("kind = 'headline'").withColumn("cookie", F.explode(F.regexp_extract_all(_p("raw"), F.lit(r"(\[\d*/\d*\]|\[\d*%\])"), F.lit(1))))
    rows = heads.join(task_counts(e), ["source_file", "id"], "left").join(box_counts(e), ["source_file", "id"], "left").fillna(0, ["tasks", "tasks_done", "direct_tasks", "direct_done", "boxes", "checked", "direct_boxes", "direct_checked"])
    data = F.lower(F.coalesce(_p("COOKIE_DATA"), _p("inherited:COOKIE_DATA"), F.lit("")))
    named = F.when(F.contains(data, F.lit("direct")), "direct").when(F.contains(data, F.lit("todo")), "todo").when(F.contains(data, F.lit("checkbox")), "checkbox")
    free = F.when((F.col("tasks") > 0) & (F.col("boxes") > 0), None).when(F.col("boxes") > 0, "checkbox").otherwise("todo")
    deep = F.contains(data, F.lit("recursive"))
    pick = lambda all_, own: F.when(deep, F.col(all_)).otherwise(F.col(own))
    rows = rows.withColumn("domain", F.coalesce(named, free))
    tasks, boxes = (F.when(F.col("domain").isin(of, "direct"), 1).otherwise(0) for of in ("todo", "checkbox"))
    done = tasks * pick("tasks_done", "direct_done") + boxes * pick("checked", "direct_checked")
    total = tasks * pick("tasks", "direct_tasks") + boxes * pick("boxes", "direct_boxes")
    percent = F.when(total > 0, F.floor((done * 100 + F.floor(total / 2)) / total)).otherwise(0)
    want = F.when(F.contains("cookie", F.lit("%")), F.format_string("[%d%%]", percent.cast("long"))).otherwise(F.format_string("[%d/%d]", done.cast("long"), total.cast("long")))
    return rows.withColumn("want", F.when(F.col("domain").isNotNull(), want))


def ambiguous_cookies(e: DataFrame) -> DataFrame:
    """ORG027: a cookie over both tasks and boxes, without COOKIE_DATA."""
    return _finding(cookies(e).where("domain is null"), "ORG027", F.lit("say with COOKIE_DATA what the cookie counts"))


def stale_cookies(e: DataFrame) -> DataFrame:
    """ORG028: a cookie that isn't what its headline's tasks or boxes say."""
    return _finding(cookies(e).where("cookie <> want"), "ORG028", F.concat(F.lit("stale cookie "), "cookie", F.lit(", should be "), "want"))


RULES = {"ORG027": ambiguous_cookies, "ORG028": stale_cookies}
