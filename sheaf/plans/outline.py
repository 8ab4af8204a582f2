"""The star schema as an outline: region, nation, customer and order are headlines of levels 1 to 4, line items are clocks.

Ids are dense within offsets by level, and every row knows its ancestors, so
closures are arrays and never recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATION, CUSTOMER, ORDER = 1_000, 1_000_000, 1_000_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines: id, parent, ancestors (root first), level, title, path, todo, priority, tags, properties, SCHEDULED, effort.

    Regions and nations are bounded dimension tables, so they are broadcast;
    orders meet customers on the customer key, by whatever join Spark picks.
    """
    region = _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("r"), F.col("r_name").alias("region"))
    nation = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + NATION).cast("long").alias("n"), (F.col("n_regionkey") + 1).cast("long").alias("r"), F.col("n_name").alias("nation"))
    nation = nation.join(F.broadcast(region), "r")
    customer = _read(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER).alias("c"), (F.col("c_nationkey") + NATION).cast("long").alias("n"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    customer = customer.join(F.broadcast(nation), "n")
    order = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") + ORDER).alias("o"), (F.col("o_custkey") + CUSTOMER).alias("c"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("scheduled"), F.col("o_totalprice").alias("price"))
    order = order.join(customer.drop("balance"), "c")
    none = F.lit(None)
    tag = F.lower
    head = lambda df, id_, parent, ancestors, level, title, path, local, inherited, **more: df.select(
        F.lit("outline").alias("source_file"), F.col(id_).alias("section_id"), (F.col(parent) if parent else none.cast("long")).alias("parent_id"), F.array(*ancestors).cast("array<long>").alias("ancestor_ids"), F.lit(level).alias("level"), title.alias("title"),
        F.array(*path).alias("outline_path"), more.get("todo", none.cast("string")).alias("todo"), more.get("priority", none.cast("string")).alias("priority"), F.array(*local).cast("array<string>").alias("tags"), F.array(*inherited, *local).cast("array<string>").alias("effective_tags"),
        F.map_from_arrays(F.array(F.lit("LEVEL"), *(F.lit(k) for k in more.get("properties", {}))), F.array(F.lit(str(level)), *more.get("properties", {}).values())).alias("properties"),
        more.get("scheduled", none.cast("date")).alias("scheduled"), more.get("effort", none.cast("long")).alias("effort_seconds"),
    )
    title = F.concat(F.lit("Order#"), F.col("o") - ORDER)
    rank = F.substring("o_orderpriority", 1, 1)
    return (
        head(region, "r", None, [], 1, F.col("region"), ["region"], [tag("region")], [])
        .union(head(nation, "n", "r", ["r"], 2, F.col("nation"), ["region", "nation"], [tag("nation")], [tag("region")]))
        .union(head(customer, "c", "n", ["r", "n"], 3, F.col("customer"), ["region", "nation", "customer"], ["segment"], [tag("region"), tag("nation")], properties={"BALANCE": F.col("balance").cast("decimal(18,2)").cast("string")}))
        .union(
            head(
                order, "o", "c", ["r", "n", "c"], 4, title, ["region", "nation", "customer", title], [], [tag("region"), tag("nation"), "segment"],
                todo=F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "NEXT").otherwise("TODO"), priority=F.when(rank == "1", "A").when(rank.isin("2", "3"), "B").otherwise("C"),
                properties={"STATUS": F.col("o_orderstatus"), "PRICE": F.col("price").cast("decimal(18,2)").cast("string")}, scheduled=F.col("scheduled"), effort=F.floor("price").cast("long") * 60,
            )
        )
    )


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock lines (section_id, start, seconds): seconds is null for a clock that still runs (line status O)."""
    line = _read(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") + ORDER).alias("section_id"), F.col("l_shipdate").alias("start"), F.when(F.col("l_linestatus") == "F", (F.col("l_quantity") * 60).cast("long")).alias("seconds"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as element rows: a document row, and a paragraph for each line that isn't blank."""
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_file"), "doc_id", "text", "lang", "source")
    lines = docs.select("source_file", "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    own = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source"))
    root = docs.select("source_file", "doc_id", F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("document").alias("category"), F.lit("org-data").alias("kind"), F.lit(None).cast("string").alias("context"), F.array("lang", "source").alias("outline_path"), own.alias("properties"), F.lit("").alias("source_raw"), F.lit(0).cast("long").alias("line"))
    rows = lines.where(F.trim("raw") != "").select("source_file", "doc_id", (F.col("at") + 2).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.lit("element").alias("category"), F.when(F.contains("raw", F.lit(" | ")), "table").otherwise("paragraph").alias("kind"), F.lit("section").alias("context"), F.array("lang", "source").alias("outline_path"), own.alias("properties"), F.col("raw").alias("source_raw"), (F.col("at") + 1).cast("long").alias("line"))
    return root.union(rows)
