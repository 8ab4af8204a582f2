"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", FOCS 2017): in
round i < t each shingle is thrown into a hashed one of t bins with the value
(i, hash); in round t + j every shingle is thrown into bin j.  A bin keeps its
least value, and a document stops as soon as all its bins are filled, which
round 2t - 1 guarantees.  Two sketches agree in a coordinate with probability
equal to the Jaccard similarity, with concentration as for independent hashes.

Whole result, no pair explosion:

1. documents of equal sets collapse to the smallest id before anything is banded;
2. a bucket links its members to one centre, the member that sits in the most
   crowded buckets; each member checks its ``partners`` most alike centres on the
   full sets, and components form; its other centres in buckets of two are checked
   then, if still in another component;
3. any larger bucket that still holds more than one component is searched exhaustively
   in cells of bounded bytes (blocks of "probes" outside its main component
   against blocks of members), inside the task, which returns only links that
   join two components.

With 32 bands of 4, two documents of similarity 0.8 share a bucket with
probability 1 - 5e-8.  The estimate may only rule a pair out when it is under
``threshold - 0.16`` (4.5 standard deviations of 128 coordinates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.components import connected
from sheaf.llm.tables import fitted, integral, ready, small, written
from sheaf.llm.words import Words, doc_grams, grams, group, lean, mix, of_column, pieces, signed

BINS, ROWS = 128, 4
CELL_BYTES = 8 << 20
_U = np.uint64


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct k-word shingles in one array, and n + 1 offsets; under k words the whole sequence is one shingle."""
    g, at = doc_grams(words, k)
    doc_cuts = np.searchsorted(at, words.first)
    out, n = [], len(words.counts)
    size = np.zeros(n + 1, np.int64)
    h = words.hash
    for i in range(n):
        c = words.counts[i]
        if c >= k:
            s = np.sort(g[doc_cuts[i] : doc_cuts[i + 1]])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        elif c:
            a = words.first[i]
            s = mix(grams(h[a : a + c], int(c)), 1000 + int(c))
        else:
            continue
        out.append(s)
        size[i + 1] = len(s)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum(size)


def sketches(sets: np.ndarray, cuts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of each set, shape (n, bins); zeros for an empty set."""
    n = len(cuts) - 1
    empty = _U(0xFFFFFFFFFFFFFFFF)
    table = np.full(n * bins, empty)
    own = np.repeat(np.arange(n), np.diff(cuts))
    left = sets
    open_ = np.diff(cuts) > 0
    for i in range(2 * bins):
        if not len(left):
            break
        x = mix(left, i + 1)
        value = (x >> _U(32)) | _U(i << 32)
        where = (x & _U(0xFFFFFFFF)) % _U(bins) if i < bins else _U(i - bins)
        np.minimum.at(table, own * bins + where.astype(np.int64), value)
        still = open_ & (table.reshape(n, bins) == empty).any(axis=1)
        if not (still == open_).all():
            go = still[own]
            left, own = left[go], own[go]
            open_ = still
    out = table.reshape(n, bins)
    out[np.diff(cuts) == 0] = 0
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array with one value for each row of a 2-d array."""
    n, width = len(rows), rows[0:1].nbytes
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


@lean
def _nodes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            sets, cuts = shingle_sets(of_column(piece.column("text"), lower=True), k)
            sketch = sketches(sets, cuts)
            width = BINS // ROWS
            seeds = mix(np.arange(width, dtype=np.uint64), 5)
            folded = np.zeros((len(sketch), width), np.uint64)
            for r in range(ROWS):
                folded = mix(folded + sketch[:, r::ROWS])
            bands = signed(mix(folded + seeds))
            full = np.diff(cuts) > 0
            keys = []
            for seed in (11, 12):
                total = np.zeros(len(full), np.uint64)
                if len(sets):
                    total[full] = np.add.reduceat(mix(sets, seed), cuts[:-1][full])
                keys.append(pa.array(signed(total)))
            lists = pa.ListArray.from_arrays(pa.array(np.where(full, width, 0).cumsum() - np.where(full, width, 0), pa.int32()).to_pylist() + [int(full.sum()) * width], pa.array(bands[full].ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.diff(cuts)), *keys, _binary(mix(sketch).astype(np.uint16)), lists], ["id", "n_shingles", "k1", "k2", "sketch", "bands"])


@lean
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            sets, cuts = shingle_sets(of_column(piece.column("text"), lower=True), k)
            body = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * 8), pa.py_buffer(np.ascontiguousarray(sets))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("id"), body], ["id", "shingles"])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


@lean
def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column("sa"), np.uint16) == _matrix(batch.column("sb"), np.uint16)).mean(axis=1)
            go = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("least"), pa.array(same)], ["a", "b", "least", "alike"]).filter(go)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(both) - n)


@lean
def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _cell(table: pa.Table, percent: int) -> pa.Table:
    """Links of one cell: each probe against all rows of other components; local union-find keeps only joining links."""
    ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
    probe = np.flatnonzero(table.column("probe").to_numpy(zero_copy_only=False))
    sketch = _matrix(table.column("sketch").combine_chunks(), np.uint16)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, least = [], (percent / 100 - 0.16) * sketch.shape[1]
    for p in probe:
        near = np.flatnonzero(((sketch == sketch[p]).sum(axis=1) >= least) & (component != component[p]))
        for q in near:
            a, b = find(int(component[p])), find(int(component[q]))
            if a != b and linked(sets[p], sets[q], percent):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[p]), int(ids[q])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, partners: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct
    k-word shingles.  A document of fewer words has its whole sequence as one
    shingle; one without text or words has none and is linked with nothing.  A
    null id is linked with nothing, gets a null component and stays; rows that
    share an id count as one node of the graph.  Other columns are left out, so
    their names don't matter.  An empty table gives an empty table.
    """
    ready(docs.sparkSession)
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = written(source.mapInArrow(partial(_nodes, k=k), "id long, n_shingles long, k1 long, k2 long, sketch binary, bands array<long>"), "sketches")
    n, shingles = nodes.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    some = nodes.where("n_shingles > 0 and id is not null")
    groups = written(fitted(some.groupBy("k1", "k2").agg(F.min("id").alias("rep")), n), "sets")

    ours = some.join(groups.withColumnRenamed("rep", "id"), ["k1", "k2", "id"], "left_semi")
    banded = ours.select(F.explode("bands").alias("band"), "id")
    crowd = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(fitted(banded.join(crowd, "band"), n * (BINS // ROWS)), "buckets")
    m = members.count()

    # Each bucket's centre; each member's most alike centres.
    central = members.groupBy("id").agg(F.sum("n").alias("links"))
    centre = members.join(central, "id").groupBy("band").agg(F.max(F.struct("links", (-F.col("id")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("b"))
    pairs = members.join(centre, "band").where("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.min("n").alias("least"))
    sketch = ours.select("id", "sketch").dropDuplicates(["id"]).join(members.select("id").distinct(), "id", "left_semi")
    sketch = written(fitted(sketch, min(n, m)), "members")
    alike = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").mapInArrow(partial(_alike, least=percent / 100 - 0.16), "a long, b long, least long, alike double")
    ranked = alike.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("alike"), "b"))).where((F.col("place") <= partners) | (F.col("least") == 2))
    ranked = written(fitted(ranked.select("a", "b", "place"), m), "pairs")
    texts = source.join(small(sketch.select("id")), "id", "left_semi")
    sets = written(fitted(texts.mapInArrow(partial(_sets, k=k), "id long, shingles binary").dropDuplicates(["id"]), shingles, 4_000_000), "shingles")
    checked = lambda pairs: pairs.select("a", "b").join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").mapInArrow(partial(_verified, percent=percent), "a long, b long")
    first = written(fitted(checked(ranked.where(F.col("place") <= partners)), partners * shingles, 4_000_000), "links")
    component = connected(first)
    # Pairs beyond the partners that a bucket of two holds, which is not searched below.
    of = lambda end: component.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    beyond = ranked.where(F.col("place") > partners).join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b"))

    # Larger buckets that hold several components still.
    size = sets.select("id", F.octet_length("shingles").alias("bytes"))
    labelled = members.select("band", "id").join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(size, "id")
    parts = labelled.groupBy("band", "component").agg(F.sum(F.col("bytes") + 600).alias("bytes"), F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("bytes", "component")).alias("main"), F.sum("bytes").alias("bytes"))
    mixed = mixed.where("parts > 1 and n > 2").select(
        "band", F.col("main.component").alias("main"), F.ceil(F.col("bytes") / CELL_BYTES).alias("blocks"), F.ceil((F.col("bytes") - F.col("main.bytes")) / CELL_BYTES).alias("probes")
    )
    rest = labelled.join(mixed, "band").withColumn("probe", F.col("component") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("id", "band"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_member = rest.select("*", place(F.col("blocks")).alias("block"), F.explode(every(F.col("probes"))).alias("part")).withColumn("probe", F.lit(False))
    as_probe = rest.where("probe").select("*", F.explode(every(F.col("blocks"))).alias("block"), place(F.col("probes")).alias("part"))
    cells = as_member.unionByName(as_probe).select("band", "block", "part", "id", "component", "probe").join(sketch, "id").join(sets, "id")
    more = written(cells.groupBy("band", "block", "part").applyInArrow(group(_cell, percent), "a long, b long").union(checked(beyond)), "links")
    if not more.isEmpty():
        component = connected(first.union(more))

    labels = groups.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("found"))
    out = nodes.select("id", "n_shingles", "k1", "k2").join(labels, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("found", "id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
