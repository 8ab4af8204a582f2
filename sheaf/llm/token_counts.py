"""Token counts by a separator scan of flat token files.

A flat file is nothing but ids, little-endian, each document followed by the
end-of-document id; it has no index.  The scan cuts files into blocks of fixed
size, finds the separators of a block with one vectorised comparison, and emits
a row for each document end.  What a block can't know, the place of the last
separator before it and the number of ends before it, comes from a prefix scan
over one summary row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.bpe import encoder
from sheaf.llm.files import located, new_file
from sheaf.llm.tables import integral, ready, shared_path, written
from sheaf.llm.words import lean, pieces

#: Ids of a block, and bytes after which a writer begins a new file.
BLOCK, FILE_BYTES = 1 << 21, 256 << 20


@lean
def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end: int, width: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path, special=False)
    todo = (piece for batch in batches for piece in pieces(batch))
    piece = next(todo, None)
    part = 0
    task = TaskContext.get().partitionId()
    while piece is not None:
        wrote, docs = 0, 0
        with new_file(folder, ".ids") as (uri, out):
            while piece is not None and wrote < FILE_BYTES:
                ids, cuts = code.encode_texts(piece.column("text"))
                n = len(cuts) - 1
                flat = np.insert(ids, cuts[1:], end).astype(f"<u{width}")
                out.write(flat.tobytes())
                wrote += flat.nbytes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * n), pa.array(np.full(n, (task << 20) + part)), pa.array(np.arange(docs, docs + n)), piece.column("id"), pa.array([wrote if i == n - 1 else None for i in range(n)], pa.int64())],
                    ["uri", "file", "place", "id", "bytes"],
                )
                docs += n
                piece = next(todo, None)
        part += 1


def id_bytes(path: str, end: int) -> int:
    """Bytes of an id, 2 or 4, for the vocabulary and the end id."""
    return 2 if max(len(encoder(path, special=False).token) - 1, end) < 1 << 16 else 4


def write_flat(docs: DataFrame, path: str, folder: str, end: int = 50256, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes flat files of ``width``-byte ids into ``folder``; returns the catalogue kept beside them: (uri, file, place, id, bytes).

    ``place`` is the document's number in its file; ``bytes``, set now and then,
    has the file's length so far.  Strings of added tokens are ordinary text, so
    the end id stands for an end only.  ``width`` is the least that holds the
    vocabulary (``id_bytes``) if None; one too narrow for it is refused.
    """
    ready(docs.sparkSession)
    width = id_bytes(path, end) if width is None else width
    if width < id_bytes(path, end):
        raise ValueError(f"ids of {path} do not fit in {width} bytes")
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(partial(_write, path=path, folder=folder, end=end, width=width), "uri string, file long, place long, id long, bytes long"), "catalogue")


@lean
def _scan(batches: Iterator[pa.RecordBatch], end: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = located(row["uri"])
            with store.open_input_file(path) as f:
                ids = np.frombuffer(f.read_at(row["ids"] * width, row["from"] * width), dtype=f"<u{width}")
            at = np.flatnonzero(ids == end)
            n = len(at)
            before = np.append(-1, at[:-1]) if n else at
            # The rest after the last separator is a row without an end.
            at, before = np.append(at, len(ids)) + row["from"], np.append(before, at[-1] if n else -1) + row["from"]
            start = pa.array(before + 1, mask=np.arange(n + 1) == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, row["file"])), pa.array(np.full(n + 1, row["from"])), pa.array(np.arange(n + 1)), start, pa.array(at), pa.array(np.arange(n + 1) < n)],
                ["file", "from", "k", "start", "stop", "ended"],
            )


def token_counts(files: DataFrame, end: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Documents of flat files.  ``files``: (uri, file, bytes).  Returns (file, place, start, n_tokens, ended), offsets in ids, ends not counted.

    A file that doesn't close with the end id has a last row with ended = false;
    an empty file has none.  Repeated ends are empty documents.
    """
    ids = F.expr(f"bytes div {width}")
    blocks = files.where(ids > 0).select("uri", "file", ids.alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), (ids - 1), F.lit(block).cast("long"))).alias("from"))
    blocks = blocks.withColumn("ids", F.least(F.lit(block), F.col("all") - F.col("from"))).drop("all").repartition("file", "from")
    rows = written(blocks.mapInArrow(partial(_scan, end=end, width=width), "file long, from long, k long, start long, stop long, ended boolean"), "ends")
    # A row for each block; a window over the blocks of one file, whose size is bounded by the writer.
    w = Window.partitionBy("file").orderBy("from")
    sums = rows.groupBy("file", "from").agg(F.sum(F.col("ended").cast("long")).alias("n"), F.max(F.when(F.col("ended"), F.col("stop"))).alias("last"), F.max("stop").alias("until"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("file", "from", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("places"), F.coalesce(F.max("last").over(past) + 1, F.lit(0)).alias("opened"), F.lead("from").over(w).isNull().alias("final"))
    out = rows.join(carried, ["file", "from"]).withColumn("start", F.coalesce("start", "opened"))
    out = out.where(F.col("ended") | (F.col("final") & (F.col("stop") > F.col("start"))))
    return out.select("file", (F.col("places") + F.col("k")).alias("place"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def corpus_token_counts(spark: SparkSession, docs: DataFrame, path: str, end: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the flat files of a corpus, scans them, and returns (id, file, start, n_tokens): where each document lies, and its tokens.

    A null or empty text has 0 tokens; null and repeated ids stay as they are.
    """
    catalogue = write_flat(docs, path, shared_path(spark, "flat"), end=end, id_col=id_col, text_col=text_col)
    files = catalogue.groupBy("uri", "file").agg(F.max("bytes").alias("bytes"))
    found = token_counts(files, end=end, width=id_bytes(path, end))
    return catalogue.join(found, ["file", "place"]).select(F.col("id").alias(id_col), "file", "start", "n_tokens")
