"""Rows that several steps read: stored once, in the order and partitions they have; and rows dealt out before much is made of them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this process's own only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sheaf-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from files of spark.checkpoint.dir; of a folder of this process's own only where none is set."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _deleted(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _new(spark: SparkSession) -> str:
    path = f"{_folder(spark)}/sheaf-{uuid.uuid4().hex}"
    atexit.register(_deleted, spark, path)
    return path


def kept(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` as a compressed Parquet table of the same folder, in folders by the value of ``by``: a reader takes the columns and values it needs.  Deleted when the driver ends."""
    spark = df.sparkSession
    path = _new(spark)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def kept_union(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all ``parts`` as one such table.  Each is stored before the next is asked for, so the driver holds one plan at a time; columns are those of the first."""
    path, schema = _new(spark), None
    for at, df in enumerate(parts):
        schema = schema or df.schema
        df.select(schema.names).write.option("compression", "zstd").parquet(f"{path}/_at={at}")
    return spark.read.schema(schema).parquet(path).select(schema.names)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores, four parts for each: for few bytes that become much work, as narrow rows that are written out as documents and parsed."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
