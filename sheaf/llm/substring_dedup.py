"""Substring dedup: word spans that stand in an earlier document, found by suffix automata of reference shards.

An automaton of the whole corpus can't be broadcast, so its shards hold only
what is repeated, and a document meets only the shards it has something in:

1. every document's windows of ``window`` words are hashed; each task sends each
   bucket one block of distinct hashes with their smallest and largest document,
   and the bucket answers with the smallest document of all tasks, the owner;
2. runs of windows that a document owns and others repeat are the reference
   passages; runs owned by a smaller document are that document's queries; a long
   run is divided, every window lying whole in one part;
3. passages are dealt to shards of bounded words, those of one owner to several if
   they are more than a shard holds; equal queries are asked once, and each block
   of a shard's queries gets the shard's automaton, which streams them for
   matching statistics on the words themselves.  Only what the automaton confirms
   is removed, so a chance collision of hashes is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.automaton import Automaton
from sheaf.llm.files import located, put_file
from sheaf.llm.katz import _answers, _spread, _squeezed, _stored
from sheaf.llm.tables import fitted, integral, light, ready, shared_path, small, text_bytes, written
from sheaf.llm.words import Words, doc_grams, group, lean, of_column, pieces

CHUNK_WINDOWS = 1 << 19
#: Bytes of text whose windows share a bucket, and windows of one part of a run.
BUCKET_BYTES, PART_WINDOWS = 4 << 20, 20_000
#: Words of a reference shard, and of the queries that one automaton answers.
SHARD_WORDS, QUERY_WORDS = 50_000, 250_000
NOBODY = np.iinfo(np.int64).min
_U = np.uint64

_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((x, pa.binary()) for x in "abc")])
_ASK_SQL = "bucket long, chunk long, a binary, b binary, c binary"
_INDEX = pa.schema([("chunk", pa.int64()), *((x, pa.binary()) for x in ("bucket", "new", "again")), *((x, pa.list_(pa.int64())) for x in ("keys", "ids", "windows"))])
_INDEX_SQL = "chunk long, bucket binary, new binary, again binary, keys array<long>, ids array<long>, windows array<long>"


@lean
def _ask(batches: Iterator[pa.RecordBatch], window: int, buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    """For each chunk a row for each bucket; in ``folder`` a file that tells how its documents' windows are found in the answers."""
    part, number = TaskContext.get().partitionId(), 0
    keys: list = []
    ids: list = []
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal keys, ids, hashes, counts, held, number
        chunk, number = (part << 20) + number, number + 1
        h, n = np.concatenate(hashes), np.concatenate(counts)
        doc = np.repeat(np.array(ids), n)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), NOBODY)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        # Distinct windows in the order of their first place.
        order = np.argsort(first)
        head = h[first[order]]
        bucket = head % _U(buckets)
        low, high = low[order], high[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        number_of = back[which]
        new = np.zeros(len(h), bool)
        new[first] = True
        index = {"chunk": chunk, "bucket": _squeezed(bucket.astype(np.uint32)), "new": _squeezed(np.packbits(new)), "again": _squeezed(number_of[~new]), "keys": keys, "ids": ids, "windows": n.tolist()}
        put_file(folder, f"{chunk}.parquet", lambda out: pq.write_table(pa.Table.from_pylist([index], schema=_INDEX), out, compression="zstd"))
        own = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[own], np.arange(buckets + 1))
        for b in range(buckets):
            x = own[cuts[b] : cuts[b + 1]]
            if len(x):
                yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": chunk, "a": head[x].tobytes(), "b": _squeezed(low[x]), "c": _squeezed(high[x] - low[x])}], schema=_ASK)
        keys, ids, hashes, counts, held = [], [], [], [], 0

    for batch in batches:
        for piece in pieces(batch.filter(pa.compute.is_valid(batch.column("id")))):
            words = of_column(piece.column("text"))
            g, at = doc_grams(words, window)
            n = np.diff(np.searchsorted(at, words.first))
            some = n > 0
            keys += piece.column("key").filter(pa.array(some)).to_pylist()
            ids += piece.column("id").filter(pa.array(some)).to_pylist()
            hashes.append(g)
            counts.append(n[some])
            held += len(g)
            if held >= CHUNK_WINDOWS:
                yield from flush()
    if held:
        yield from flush()


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["a"], np.uint64) for r in rows]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    n = int(which.max()) + 1
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, NOBODY)
    least = [_spread(r["b"], np.int64) for r in rows]
    np.minimum.at(low, which, np.concatenate(least))
    np.maximum.at(high, which, np.concatenate([x + _spread(r["c"], np.int64) for x, r in zip(least, rows, strict=True)]))
    owner = np.where(low < high, low, NOBODY)
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    out = [{"bucket": r["bucket"], "chunk": r["chunk"], "a": _squeezed(owner[which[a:b]])} for r, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary())]))


@lean
def _runs_of(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of each document with repeated windows: runs of windows of one owner, as (first window, windows, owner)."""
    for batch in batches:
        for r in batch.to_pylist():
            bucket, windows = _spread(r["bucket"], np.uint32), np.array(r["windows"])
            owner = np.empty(len(bucket), np.int64)
            order = np.argsort(bucket, kind="stable")
            owner[order] = np.concatenate([_spread(x["a"], np.int64) for x in _answers(path, r["chunk"])])
            new = np.unpackbits(_spread(r["new"], np.uint8))[: int(windows.sum())] == 1
            number = np.empty(len(new), np.int64)
            number[new] = np.arange(len(bucket))
            number[~new] = _spread(r["again"], np.int64)
            owner = owner[number]
            first = np.cumsum(windows) - windows
            doc = np.repeat(np.arange(len(windows)), windows)
            at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])))
            size = np.diff(np.append(at, len(owner)))
            at, size = at[owner[at] != NOBODY], size[owner[at] != NOBODY]
            if not len(at):
                continue
            docs, begin = np.unique(doc[at], return_index=True)
            runs = pa.StructArray.from_arrays([pa.array(at - first[doc[at]]), pa.array(size), pa.array(owner[at])], ["start", "windows", "owner"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), runs)
            keys, ids = np.array(r["keys"]), np.array(r["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(keys[docs]), pa.array(ids[docs]), lists], ["key", "id", "runs"])


def _parts(runs: list[dict], window: int, part: int) -> Iterator[tuple[int, int, int]]:
    """(first word, words, owner) of the parts of some runs."""
    for run in runs:
        for at in range(0, run["windows"], part):
            yield run["start"] + at, min(part, run["windows"] - at) + window - 1, run["owner"]


@lean
def _passages(batches: Iterator[pa.RecordBatch], window: int, part: int) -> Iterator[pa.RecordBatch]:
    """The words of all runs, joined by one space."""
    for batch in batches:
        for piece in pieces(batch):
            words = of_column(piece.column("text"))
            out = {x: [] for x in ("key", "id", "start", "owner", "words", "passage")}
            for i, (key, id_, runs) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("key", "id", "runs")), strict=True)):
                a = int(words.first[i])
                for start, n, owner in _parts(runs, window, part):
                    x = a + start
                    out["passage"].append(b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[x : x + n].tolist(), words.end[x : x + n].tolist(), strict=True)).decode())
                    out["words"].append(n)
                    out["key"].append(key)
                    out["id"].append(id_)
                    out["start"].append(start)
                    out["owner"].append(owner)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([*((x, pa.int64()) for x in ("key", "id", "start", "owner", "words")), ("passage", pa.string())]))


def _search(table: pa.Table, window: int) -> pa.Table:
    """A shard's automaton against a block of its queries."""
    rows = table.to_pylist()
    # Passages of one owner in the same order everywhere; a query's document is above its owner, and any smaller document will do.
    known = Automaton((r["owner"], r["passage"].split(" ")) for r in rows if r["query"] is None)
    out = []
    for r in rows:
        if r["query"] is not None:
            spans = known.shared(r["passage"].split(" "), window, r["owner"] + 1)
            if spans:
                out.append({"query": r["query"], "spans": [{"start": a, "stop": b} for a, b in spans]})
    return pa.Table.from_pylist(out, schema=pa.schema([("query", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))


def _removed(words: Words, spans: list) -> np.ndarray:
    """Flags of the removed words of a piece."""
    edge = np.zeros(len(words) + 1, np.int64)
    for i, own in enumerate(spans):
        for s in own or ():
            edge[words.first[i] + s["start"]] += 1
            edge[words.first[i] + s["stop"]] -= 1
    return np.cumsum(edge)[:-1] > 0


@lean
def _finished(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words = of_column(piece.column("text"))
            gone = _removed(words, piece.column("spans").to_pylist())
            removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
            # Kept words back to back, one space between those of one document.
            stay = np.flatnonzero(~gone)
            length = words.end[stay] - words.start[stay]
            doc = words.doc[stay]
            final = np.append(doc[1:] != doc[:-1], True) if len(stay) else np.empty(0, bool)
            size = length + ~final
            ends = np.cumsum(size)
            body = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            body[np.repeat(ends - size, length) + within] = words.data[np.repeat(words.start[stay], length) + within]
            cuts = np.append(0, ends)[np.append(0, np.cumsum(words.counts - removed))]
            whole = body.tobytes()
            parts = [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            out = {"id": piece.column("id"), "n_words": pa.array(words.counts), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())}
            if texts:
                was = piece.column("text").to_pylist()
                out["key"] = piece.column("key")
                out["kept_text"] = pa.array([p.decode() if n else t for p, n, t in zip(parts, removed.tolist(), was, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)


def repeated_spans(source: DataFrame, window: int = 50) -> DataFrame:
    """(key, spans): the word spans to remove of each row of ``source`` (key, id, text) that has any; confirmed by automata."""
    spark = ready(source.sparkSession)
    # Buckets follow the bytes, so that what one holds stays the same at any size and any number of partitions.
    size = text_bytes(source)
    buckets = -(-size // BUCKET_BYTES)
    # Partitions that hold little are read together: each would be a chunk of its own.
    chunked = fitted(source, size, 2 * BUCKET_BYTES)
    folder = shared_path(spark, "index")
    store, at = located(folder)
    store.create_dir(at, recursive=True)
    asked = chunked.mapInArrow(partial(_ask, window=window, buckets=max(1, buckets), folder=folder), _ASK_SQL)
    answers = _stored(asked.groupBy("bucket").applyInArrow(group(_answer), "bucket long, chunk long, a binary"), spark, "owners")
    index = spark.read.schema(_INDEX_SQL).parquet(folder)
    runs = written(index.mapInArrow(partial(_runs_of, path=answers), "key long, id long, runs array<struct<start: long, windows: long, owner: long>>"), "runs")
    # Ids first, which may be broadcast; the runs meet only the documents that have any.
    found = source.drop("id").join(small(runs.select("key").distinct()), "key", "left_semi").join(runs.dropDuplicates(["key"]), "key")
    passages = written(fitted(found.mapInArrow(partial(_passages, window=window, part=PART_WINDOWS), "key long, id long, start long, owner long, words long, passage string"), size, 2 * BUCKET_BYTES), "passages")
    n = passages.count()

    refs = passages.where("id = owner").select("owner", "words", "passage").dropDuplicates(["owner", "passage"])
    # One owner's passages, at most the words of its document, fill group after group.
    before = F.sum("words").over(Window.partitionBy("owner").orderBy(F.xxhash64("passage")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    refs = written(fitted(refs.withColumn("group", F.floor((before - 1) / SHARD_WORDS)), n, 50_000), "references")
    groups = refs.groupBy("owner").agg((F.max("group") + 1).alias("groups"))
    queries = passages.where("id > owner").withColumn("query", F.xxhash64("owner", "passage"))
    once = queries.select("query", "owner", "words", "passage").dropDuplicates(["query"])
    total = refs.agg(F.sum("words")).first()[0] or 0
    shards = -(-int(total) // SHARD_WORDS) + 1
    shard = F.pmod(F.xxhash64("owner", "group"), F.lit(shards))
    once = once.join(groups, "owner").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    blocks = once.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("words") / QUERY_WORDS).cast("long").alias("blocks"))
    asking = once.withColumn("shard", shard).join(blocks, "shard").withColumn("block", F.pmod("query", F.col("blocks")))
    shown = refs.withColumn("shard", shard).join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("query", F.lit(None).cast("long"))
    columns = ["shard", "block", "query", "owner", "passage"]
    verdict = shown.select(columns).union(asking.select(columns)).groupBy("shard", "block").applyInArrow(group(_search, window), "query long, spans array<struct<start: long, stop: long>>")
    placed = queries.select("key", "start", "query").join(verdict, "query").select("key", F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["stop"] + F.col("start")).alias("stop"))).alias("spans"))
    # Runs of one document: bounded by its words.
    return fitted(placed.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), n)


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row for each row: id, n_words, n_removed, kept_sha256 (of kept words joined by one space); with ``texts`` also kept_text, and key, the xxhash64 of id and text.

    A word is removed if a window of ``window`` words covers it whose sequence
    also starts in a document with a smaller id; windows are judged on the input.
    ``kept_text`` is the text itself where nothing was removed, else the kept
    words joined by one space.  A null or empty text has no words.  A row with a
    null id loses nothing and takes nothing from others; rows that share an id
    don't count as earlier than each other.  An empty table gives an empty table.
    """
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    source = source.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    spans = light(written(repeated_spans(source, window), "spans"), 16 * F.size("spans"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", key long, kept_text string" * texts
    return source.join(spans, "key", "left").mapInArrow(partial(_finished, texts=texts), schema).withColumnRenamed("id", id_col)
