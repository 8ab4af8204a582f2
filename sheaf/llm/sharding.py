"""Sharding by fixed virtual slots.

A record's slot is a hash and never changes.  What changes is the map from the
thousands of slots to shards, a small versioned table: version 1 deals slots by
rule, and rebalancing writes a new version in which some slots have moved, judged
by the bytes that each slot holds.  The law kept is ``bytes``: shard sizes near
equal.  Only sizes travel; the map is bounded by the number of slots.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.tables import integral, shared_path, written

SLOTS = 1 << 14
#: Rows that are numbered together at most, on average.
RUN = 1 << 16


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(owner: Sequence[int], load: Mapping[int, int], shards: int) -> list[int]:
    """The map with as few slots moved as it takes to level the shards.

    The fullest shard gives the slot whose size is nearest to half its lead over
    the emptiest; it ends when no slot of the fullest is smaller than that lead.
    """
    owner = list(owner)
    total = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, size in sorted(load.items()):
        total[owner[slot]] += size
        if size:
            own[owner[slot]].append((size, slot))
    for x in own:
        x.sort()
    while True:
        most, least = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        lead = total[most] - total[least]
        at = bisect.bisect_left(own[most], (lead / 2, -1))
        choice = [own[most][i] for i in (at - 1, at) if 0 <= i < len(own[most]) and own[most][i][0] < lead]
        if not choice:
            return owner
        size, slot = min(choice, key=lambda x: (abs(x[0] - lead / 2), x))
        own[most].remove((size, slot))
        bisect.insort(own[least], (size, slot))
        total[most], total[least], owner[slot] = total[most] - size, total[least] + size, least


def grown(owner: Sequence[int], load: Mapping[int, int], shards: int) -> list[int]:
    """The map for one shard more: slots move into the new one only."""
    owner = list(owner)
    total = [0] * (shards + 1)
    for slot, size in load.items():
        total[owner[slot]] += size
    goal = sum(total) / (shards + 1)
    for slot in sorted(load, key=lambda s: (-load[s], s)):
        size = load[slot]
        if total[shards] + size <= goal and total[owner[slot]] - size >= goal - size / 2:
            total[owner[slot]], total[shards], owner[slot] = total[owner[slot]] - size, total[shards] + size, shards
    return owner


def _table(spark: SparkSession, owner: Sequence[int], version: int) -> DataFrame:
    body = F.from_json(F.lit("[" + ",".join(map(str, owner)) + "]"), "array<int>")
    return spark.range(1).select(F.posexplode(body).alias("virtual_slot", "shard")).select(F.lit(version).alias("version"), F.col("virtual_slot").cast("long"), "shard")


def store(spark: SparkSession, path: str, owner: Sequence[int], version: int) -> None:
    """Appends a version to the stored map; earlier versions stay."""
    _table(spark, owner, version).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version, the latest unless one is named."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select("virtual_slot", "shard")


def shard_by_slots(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every row with its shard: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``size``: UTF-8 bytes of the text plus 8, a null text having none; ``slot``:
    the row's place in its shard, gapless from 0; ``grown_shard`` is null, since
    the law is ``bytes``.  The hash covers id and text, so a null id is a record
    like any other; rows equal in both share a slot, equal texts of different ids
    do not, so that a text copied a million times does not fill one shard.  Other columns are left out.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(integral(docs, id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64("id", "text_crc32", "size")).withColumn("virtual_slot", F.pmod("hash", F.lit(slots)))
    # Rows equal in all else are told apart by their place in the written table, so that they are numbered in runs too.
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "sizes")
    held = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    path = path or shared_path(spark, "slots")
    owner = first_map(slots, shards)
    store(spark, path, owner, 1)
    store(spark, path, rebalanced(owner, {s: b for s, (b, _) in held.items()}, shards), 2)
    runs = max([1, *(-(-n // RUN) for _, n in held.values())])
    placed = rows.join(F.broadcast(stored(spark, path, 2)), "virtual_slot").withColumn("run", F.pmod(F.xxhash64("place"), F.lit(runs)))
    # Places: rows are numbered within small runs, and runs follow each other within their shard.
    offsets = placed.groupBy("shard", "virtual_slot", "run").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("virtual_slot", "run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("virtual_slot", "run", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("virtual_slot", "run").orderBy("id", "text_crc32", "size", "place"))
    out = placed.withColumn("number", number - 1).join(offsets, ["virtual_slot", "run"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version"),
    )
