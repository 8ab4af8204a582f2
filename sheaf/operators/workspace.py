"""Operators over many documents: links and targets, clocks in sequence, tasks, search, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.stored import settled
from sheaf.operators.tree import is_done


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links with ``status``: a key resolves only if exactly one target in the whole workspace has it.

    Targets are counted by key first, so a key of very many targets is one row.
    """
    known = targets.groupBy("key").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return links.join(known, "key", "left").select(links["*"], status.alias("status"), F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"))


def duplicate_targets(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each occurrence of a key that is defined twice or more: counts are joined back, no group is gathered."""
    many = targets.groupBy(*keys).agg(F.count("*").alias("definitions")).where("definitions > 1")
    return targets.join(many, keys)


def clock_issues(clocks: DataFrame, partition: str, order: str, longest: int = 600, shortest: int = 0, gap: int = 5) -> DataFrame:
    """The first finding of each clock (start, stop in epoch minutes), compared with the last closed clock before it."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.when(F.col("start").isNotNull() & F.col("stop").isNotNull(), F.col("stop"))
    rows = clocks.withColumn("before", F.last(closed, ignorenulls=True).over(w))
    minutes = F.col("stop") - F.col("start")
    issue = (
        F.when(F.col("start").isNull(), "invalidClock").when(F.col("stop").isNull(), "noEndTime").when(minutes < 0, "invalidRange").when(minutes > longest, "longDuration").when(minutes < shortest, "shortDuration")
        .when(F.col("start") < F.col("before"), "overlap").when(F.col("start") - F.col("before") > gap, "gap")
    )
    return rows.withColumn("issue", issue).where(F.col("issue").isNotNull())


def superseded(cards: DataFrame, key: str, state: str, old: tuple[str, ...], current: str) -> DataFrame:
    """Old cards that share a key with a current one."""
    now = cards.where(F.col(state) == current).select(F.lower(key).alias("_key")).distinct()
    return cards.where(F.col(state).isin(*old)).withColumn("_key", F.lower(key)).join(now, "_key", "left_semi").drop("_key")


def _until_still(rows: DataFrame, grown) -> DataFrame:
    """``rows`` (node, label) after as many rounds of ``grown`` (more rows) as change a node's smallest label or add a node."""
    while True:
        both = rows.withColumn("old", F.col("label")).unionByName(grown(rows).withColumn("old", F.lit(None)))
        both = settled(both.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        rows = both.select("node", "label")
        if both.where("old is null or old <> label").isEmpty():
            return rows


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle of any length: strongly connected components of two nodes or more, named by their smallest node.

    Its size is that of the nodes, where the cycles themselves may be too many to
    list.  The smallest label that reaches a node colours it; of each colour, the
    nodes that reach the label's own node are a component.  What is left goes on.
    """
    step = settled(edges.select("src", "dst").where("src <> dst").distinct())
    found = step.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        # Nodes without a link in or out are on no cycle.
        while True:
            kept = settled(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == step.count()
            step = kept
            if same:
                break
        if step.isEmpty():
            return found
        out = step.withColumnRenamed("src", "node")
        own = step.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
        colour = _until_still(own, lambda rows: rows.join(out, "node").select(F.col("dst").alias("node"), "label"))
        of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_colour"))
        step = settled(step.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = step.select(F.col("dst").alias("node"), "src")
        reached = _until_still(colour.where("node = label"), lambda rows: rows.join(back, "node").select(F.col("src").alias("node"), "label"))
        many = reached.groupBy("label").count().where("count > 1").select("label")
        found = settled(found.union(reached.join(many, "label", "left_semi").select("node", F.col("label").alias("component"))))
        gone = reached.select("node")
        step = settled(step.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Directed cycles, each once, as the path from its smallest node; loops don't count.  ``longest``: most nodes of a cycle, if not all are wanted.

    Paths only go on through nodes above their first, which finds each cycle from
    its smallest node alone.  Without ``longest`` they go on, within cyclic
    components, until none can be extended; dense components may have more cycles
    than can be listed, for those there is ``cyclic_components``.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct()
    if longest is None:
        of = cyclic_components(step)
        inner = step.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").where("a = b")
        step = settled(inner.select("src", "dst"))
    paths = step.where("src < dst").select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.array("src", "dst").alias("path"))
    found, nodes = None, 2
    while True:
        closed = paths.join(step, (paths["tail"] == step["src"]) & (paths["head"] == step["dst"])).select("path")
        found = closed if found is None else found.union(closed)
        nodes += 1
        if longest is not None and nodes > longest:
            return found
        paths = paths.join(step, paths["tail"] == step["src"]).where((F.col("dst") > F.col("head")) & ~F.array_contains("path", F.col("dst"))).select("head", F.col("dst").alias("tail"), F.concat("path", F.array("dst")).alias("path"))
        if longest is None:
            found, paths = settled(found), settled(paths)
            if paths.isEmpty():
                return found


def dependency_status(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with whether their target is a document of the set, else a missing path."""
    return edges.join(documents.select(F.col("document").alias("dst")).distinct().withColumn("known", F.lit(True)), "dst", "left").withColumn("status", F.when(F.col("known"), "document").otherwise("missingPath")).drop("known")


def sparse_tree(sections: DataFrame, match: Column, include_done: bool = True, text: Column | None = None) -> DataFrame:
    """Cards and skips: the first failing test is the reason."""
    reason = F.lit(None).cast("string")
    if text is not None:
        reason = F.when(~text, "text").otherwise(reason)
    reason = F.when(~match, "match").otherwise(reason)
    if not include_done:
        reason = F.when(is_done(sections), "done").otherwise(reason)
    return sections.withColumn("skip_reason", reason)


def task_list(sections: DataFrame, view: str, limit: int, order: list[str]) -> DataFrame:
    """Tasks of a view (active, done), the first ``limit`` in order."""
    state = {"active": ~is_done(sections), "done": is_done(sections)}[view]
    return sections.where(F.col("todo").isNotNull() & state).orderBy(*order).limit(limit)
