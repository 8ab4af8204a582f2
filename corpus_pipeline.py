"""A corpus pipeline of five stages, each calling one operator of ``sheaf.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns a row for each document.  The
result of a stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.bpe import bpe_round_trip
from sheaf.llm.decontaminate import contamination
from sheaf.llm.near_dups import near_dups
from sheaf.llm.quality import quality
from sheaf.llm.queries import table, vocabulary
from sheaf.llm.substring_dedup import substring_dedup
from sheaf.llm.tables import small, written


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the rows of some ids, and of some texts of theirs if ``rejected`` has a text_hash; rows with a null id stay."""
    by_text = "text_hash" in rejected.columns
    gone = rejected.select(F.col("doc_id").alias("gone"), F.col("text_hash" if by_text else "doc_id").alias("gone_hash")).where("gone is not null").distinct()
    same = F.col("doc_id") == F.col("gone")
    return docs.join(small(written(gone, "gone")), same & (F.xxhash64("text") == F.col("gone_hash")) if by_text else same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and is rejected; a row with a null id stays;
    rows that share an id are judged each by its own text, equal rows go or stay
    together; an empty table stays empty.
    """
    return _without(docs, quality(docs).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words and rows with a null id are in no group and stay; rows
    that share an id are one document and stay or go together; an empty table
    stays empty.
    """
    return _without(docs, near_dups(docs, k=5, percent=80).where("not kept"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that earlier documents have are cut out; every document stays.

    A text that loses nothing stays as it is; of another the kept words remain,
    joined by one space, and ``n_chars`` is their length.  Null texts and rows
    with a null id stay as they are; rows that share an id don't count as earlier
    than each other; an empty table stays empty.
    """
    cut = substring_dedup(docs, window=50, texts=True).where("n_removed > 0").select(F.col("key").alias("cut_key"), "kept_text").dropDuplicates(["cut_key"])
    joined = docs.join(written(cut, "cut"), F.xxhash64(F.col("doc_id").cast("long"), "text") == F.col("cut_key"), "left")
    changed = F.col("cut_key").isNotNull()
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return joined.withColumns({"text": text, "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go.

    Null and empty texts and rows with a null id stay; rows that share an id are
    judged each by its own text; an empty table or benchmark removes nothing.
    """
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and their decoding: the counts and checksums of each document.

    A null text counts as empty; null and repeated ids are rows like others.
    """
    return bpe_round_trip(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL can't express near-duplicate components at this size nor BPE; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
