"""Org documents as DataFrames: reading folders, parsing, the ``org_elements`` view, and writing headlines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.dates import hours_minutes
from sheaf.functions.text import ascii_lower
from sheaf.shipping import shipped

SCHEMA = (
    "source_file string, id long, parent_id long, ancestor_ids array<long>, ordinal long, category string, kind string, affiliated_name string, outline_path array<string>, context string, "
    "properties map<string, string>, line long, end_line long, range_start long, range_end long, source_raw string"
)
_ARROW = pa.schema([
    ("source_file", pa.string()), ("id", pa.int64()), ("parent_id", pa.int64()), ("ancestor_ids", pa.list_(pa.int64())), ("ordinal", pa.int64()), ("category", pa.string()), ("kind", pa.string()), ("affiliated_name", pa.string()), ("outline_path", pa.list_(pa.string())), ("context", pa.string()),
    ("properties", pa.map_(pa.string(), pa.string())), ("line", pa.int64()), ("end_line", pa.int64()), ("range_start", pa.int64()), ("range_end", pa.int64()), ("source_raw", pa.string()),
])
#: Rows of one batch that leaves the parser.
BATCH = 4096
SKIPPED_FOLDERS = ("target", "node_modules", "dist", "build", "__pycache__", "venv", "vendor")


def _parse(batches: Iterator[pa.RecordBatch], kinds: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    from sheaf.sources.parser import records

    rows: list[dict] = []
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += records(name, text, kinds)
            if len(rows) >= BATCH:
                for at in range(0, len(rows), BATCH):
                    yield pa.RecordBatch.from_pylist(rows[at : at + BATCH], schema=_ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def parse(documents: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Elements of (source_file, text).  A narrow pass: no shuffle, one document at a time in a worker.

    ``kinds``: those whose rows leave the worker, if not all are wanted; a row is the same with or without the others.
    """
    shipped(documents.sparkSession)
    return documents.select("source_file", "text").mapInArrow(partial(_parse, kinds=None if kinds is None else frozenset(kinds)), SCHEMA)


def read_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("org", "org_archive"), hidden: tuple[str, ...] = ()) -> DataFrame:
    """(source_file, text) of a folder and its subfolders, whole files.

    Hidden folders, which Spark never lists, and generated ones are left out;
    those named in ``hidden`` are read as roots of their own.
    """
    paths = [path.rstrip("/"), *(f"{path.rstrip('/')}/{h}" for h in hidden if h.startswith("."))]
    docs = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(suffixes) + "}").select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    folders = F.split(F.regexp_replace(F.regexp_replace("source_file", "^file:/+", "/"), F.lit("^\\Q" + path.rstrip("/").removeprefix("file://") + "\\E"), F.lit("")), "/")
    skipped = [f for f in SKIPPED_FOLDERS if f not in hidden]
    return docs.where(~F.arrays_overlap(folders, F.array(*map(F.lit, skipped))))


def prefilter(documents: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that can hold every token of every term: the test runs in the JVM, before any parsing."""
    blob = ascii_lower(F.concat_ws("\n", "text", "source_file"))
    for token in (t for term in terms for t in term.split()):
        documents = documents.where(F.contains(blob, F.lit(token.translate({i: i + 32 for i in range(65, 91)}))))
    return documents


def org_elements(elements: DataFrame) -> DataFrame:
    """The flat table of the SQL surface, with the keys of its rows after the 15 columns."""
    return elements.select(
        "ordinal", "category", "kind", "affiliated_name", F.to_json("outline_path").alias("outline_path_json"), "context", F.to_json("properties").alias("summary_json"), F.try_element_at("properties", F.lit("language")).alias("language"),
        F.col("line").alias("source_start_line"), F.lit(1).cast("long").alias("source_start_column"), F.col("end_line").alias("source_end_line"), F.lit(1).cast("long").alias("source_end_column"), F.col("range_start").alias("source_range_start"), F.col("range_end").alias("source_range_end"), "source_raw",
        "source_file", "id", "parent_id",
    )


def sql(elements: DataFrame, query: str) -> DataFrame:
    """Any Spark SQL over the view ``org_elements``."""
    elements.createOrReplaceTempView("org_elements")
    return elements.sparkSession.sql(query)


def headline(level: int, todo: str, priority: str, title: str, tags: str, scheduled: str, effort: str) -> Column:
    """The text of a headline from columns, with planning line and property drawer."""
    stars = F.lit("*" * level + " ")
    mark = F.concat(F.coalesce(F.concat(F.when(F.col(todo) == "NEXT", "TODO").otherwise(F.col(todo)), F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit("[#"), F.col(priority), F.lit("] ")), F.lit("")))
    label = F.when(F.size(tags) > 0, F.concat(F.lit(" :"), F.array_join(tags, ":"), F.lit(":"))).otherwise("")
    plan = F.coalesce(F.concat(F.lit("SCHEDULED: <"), F.date_format(scheduled, "yyyy-MM-dd"), F.lit(">\n")), F.lit(""))
    drawer = F.coalesce(F.concat(F.lit(":PROPERTIES:\n:EFFORT: "), hours_minutes(F.col(effort)), F.lit("\n:END:\n")), F.lit(""))
    return F.concat(stars, mark, F.col(title), label, F.lit("\n"), plan, drawer)
