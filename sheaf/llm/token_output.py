"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

An id is written as its rank by falling frequency, in 1 to 4 little-endian
bytes; two bits give its length, and the bits of four ids make a control byte.
Control bytes lie apart from the data bytes, so a reader turns all of a frame's
control bytes into lengths with one lookup in a table of 256 rows, and the
lengths into values with a few gathers (Lemire, Kurz, Rupp, "Stream VByte").

File: magic, then frames.  A frame: four little-endian int64 (documents, ids,
control bytes, data bytes), int64 document ids, uint32 lengths, a null flag for
each document, control, data.  The rank table is a file of its own, uint32.
Files follow each other in ascending document order (null ids first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.bpe import encoder
from sheaf.llm.files import located, new_file
from sheaf.llm.tables import integral, ready, shared_path, written
from sheaf.llm.words import lean, pieces

MAGIC = b"SHEAFVB1"
#: Ids of a frame; a document is never divided.
FRAME = 1 << 20
#: Bytes of ids, before they are packed, that a file is to hold.
FILE_BYTES = 128 << 20
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 values."""
    n = len(ranks)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    control = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.sum(axis=1, dtype=np.uint8).tobytes(), data[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``pack``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64 if len(data) >> 31 else np.int32)
    at -= length
    body = np.frombuffer(data, np.uint8)
    out = body[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            out[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@lean
def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    narrow = np.uint16 if len(code.token) <= 1 << 16 else np.uint32
    for batch in batches:
        for piece in pieces(batch):
            ids, cuts = code.encode_texts(piece.column("text"))
            flat = np.insert(ids, cuts[1:], end).astype(narrow)
            cuts = (cuts + np.arange(len(cuts))) * flat.itemsize
            body = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([piece.column("id"), body], ["id", "ids"])


def _flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return body.view(f"<u{width}"), (offsets - offsets[0]) // width


@lean
def _counts(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_flat(batch.column("ids"), width)[0], minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])


def _frames(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, cuts = _flat(batch.column("ids"), width)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + FRAME, "right")) - 1)
            yield batch.column("id").slice(at, stop - at), ids[cuts[at] : cuts[stop]], cuts[at : stop + 1] - cuts[at]
            at = stop


@lean
def _write(batches: Iterator[pa.RecordBatch], rank: np.ndarray, folder: str, width: int) -> Iterator[pa.RecordBatch]:
    frames = _frames(batches, width)
    one = next(frames, None)
    if one is None:
        return
    documents = tokens = 0
    with new_file(folder, ".vb") as (uri, out):
        out.write(MAGIC)
        while one is not None:
            names, ids, cuts = one
            control, data = pack(rank[ids])
            out.write(np.array([len(names), len(ids), len(control), len(data)], "<i8").tobytes())
            out.write(pc.fill_null(names, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            out.write(np.diff(cuts).astype("<u4").tobytes())
            out.write(names.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            out.write(control)
            out.write(data)
            documents, tokens = documents + len(names), tokens + len(ids)
            one = next(frames, None)
    yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "uri": uri, "documents": documents, "tokens": tokens}])


def read_frames(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each frame of a file: document ids, whether they are null, lengths, ranks."""
    store, path = located(uri)
    with store.open_input_stream(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        while head := f.read(32):
            documents, ids, control, data = np.frombuffer(head, "<i8").tolist()
            names = np.frombuffer(f.read(8 * documents), "<i8")
            length = np.frombuffer(f.read(4 * documents), "<u4").astype(np.int64)
            null = np.frombuffer(f.read(documents), np.uint8) == 1
            yield names, null, length, unpack(f.read(control), f.read(data), ids)


@lean
def _read(batches: Iterator[pa.RecordBatch], token: np.ndarray, ids_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = row["before"]
            for names, null, length, ranks in read_frames(row["uri"]):
                ids = token[ranks].astype("<u4")
                cuts = np.append(0, np.cumsum(length))
                body = ids.tobytes()
                sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = {"id": pa.array(names, mask=null), "start": pa.array(cuts[:-1] + at), "n_tokens": pa.array(length), "ids_crc32": pa.array(sums, pa.int64())}
                if ids_too:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)
                at += int(cuts[-1])


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, folder: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Encodes ``docs`` and writes the files; returns the manifest (part, uri, documents, tokens) and the id of each rank.

    The rank table is bounded by the vocabulary; it is also written to ``folder``.
    """
    ready(spark)
    code = encoder(path)
    size = len(code.token)
    width = 2 if size <= 1 << 16 else 4
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    encoded = written(source.mapInArrow(partial(_encode, path=path, end=end), "id long, ids binary"), "ids")
    counts = encoded.select("ids").mapInArrow(partial(_counts, width=width, size=size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    for row in counts.toLocalIterator():
        total[row["token"]] = row["n"]
    token = np.argsort(-total, kind="stable").astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[token] = np.arange(size, dtype=np.uint32)
    with new_file(folder, ".ranks") as (_, out):
        out.write(token.astype("<u4").tobytes())
    # A file is what one task writes; ties of ids are dealt on by their contents.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total.sum()) * width // FILE_BYTES))
    ordered = encoded.repartitionByRange(parts, "id", F.length("ids"), F.xxhash64("ids")).sortWithinPartitions("id", F.length("ids"), F.xxhash64("ids"))
    return written(ordered.mapInArrow(partial(_write, rank=rank, folder=folder, width=width), "part long, uri string, documents long, tokens long"), "manifest"), token


def read_tokens(manifest: DataFrame, token: np.ndarray, ids: bool = False) -> DataFrame:
    """Reads the files back: (id, start, n_tokens, ids_crc32), with ``ids`` also the ids themselves."""
    # One row for each file.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "uri", before.alias("before")).repartition("part")
    return files.mapInArrow(partial(_read, token=token, ids_too=ids), "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def token_round_trip(spark: SparkSession, docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files in the shared folder and returns what they hold: id, start, n_tokens (end included), ids_crc32.

    A null or empty text is the end id alone.  Null ids come first; rows of one id
    follow each other by length and a hash of their ids.  An empty table gives no files and no rows.
    """
    manifest, token = write_tokens(spark, docs, path, shared_path(spark, "tokens"), end, id_col, text_col)
    return read_tokens(manifest, token).withColumnRenamed("id", id_col)
