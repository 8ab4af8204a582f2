"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import oracles
from sheaf.llm.bpe import bpe_round_trip
from sheaf.llm.decontaminate import contamination
from sheaf.llm.katz import katz_scores
from sheaf.llm.licenses import license_scan
from sheaf.llm.near_dups import near_dups
from sheaf.llm.quality import quality
from sheaf.llm.sharding import shard_by_slots
from sheaf.llm.substring_dedup import substring_dedup
from sheaf.llm.token_counts import corpus_token_counts
from sheaf.llm.token_output import token_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash near-dedup of ``documents`` on 4-word shingles at a similarity of 0.8."""
    return near_dups(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten ``benchmark`` words in ``documents``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_hash")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of ``documents``."""
    return katz_scores(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in ``documents``."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of near equal bytes."""
    return shard_by_slots(table(spark, sf_dir, "documents"), shards=24)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of ``documents``, scanned for their end ids: where each document lies and how many tokens it has."""
    return corpus_token_counts(spark, table(spark, sf_dir, "documents"), vocabulary(), end=50256)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on ``documents``."""
    return quality(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of ``documents`` and back."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents`` written and read back."""
    return token_round_trip(spark, table(spark, sf_dir, "documents"), vocabulary(), end=2)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that earlier ``documents`` have."""
    return substring_dedup(table(spark, sf_dir, "documents"), window=50)


def queries() -> dict[str, Query]:
    return {"op1_near_dups": op1_near_dups, "op2_decontamination": op2_decontamination, "op3_katz": op3_katz, "op4_licenses": op4_licenses, "op5_sharding": op5_sharding, "op6_token_counts": op6_token_counts, "op7_quality": op7_quality, "op8_bpe": op8_bpe, "op9_token_output": op9_token_output, "op10_substring_dedup": op10_substring_dedup}


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; tests/llm holds the others against plain versions."""
    return {"op1_near_dups": oracles.NEAR_DUPS, "op2_decontamination": oracles.CONTAMINATION, "op4_licenses": oracles.licenses(), "op10_substring_dedup": oracles.SUBSTRING}
