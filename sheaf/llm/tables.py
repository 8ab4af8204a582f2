"""Written tables that cut lineage, and checks of size before a broadcast."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sheaf.shipping import shipped

#: A broadcast of ids is allowed up to so many rows (16 MB of longs, some 130 MB as a hashed relation at most).
BROADCAST_ROWS = 1_000_000
#: A broadcast of rows of any width is allowed up to so many bytes, as text.
BROADCAST_BYTES = 32 << 20
#: Bytes of one batch between the JVM and Python; a row is never divided.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Before the first Python function of an operator: the package is on its way to the workers, and batches are bounded."""
    shipped(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return spark


def integral(df: DataFrame, column: str) -> Column:
    """The column as long; another type than a whole number is refused, since its values would turn to null."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} is {kind.simpleString()}; ids are whole numbers")
    return F.col(column).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: that of spark.checkpoint.dir; one of this machine's own only in local mode where none is set."""
    ready(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm.get() if jvm.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a table or file that nothing reads any more."""
    context = spark.sparkContext
    if context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/sheaf-{name}-{uuid.uuid4().hex}"
    atexit.register(deleted, spark, path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: computed once, and safe when an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fitted(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """``df``, which has at most ``rows`` rows, in no more partitions than they fill, so that a small table is not many files."""
    return df.coalesce(max(1, -(-rows // each)))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by a pass that reads nothing else."""
    return int(df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def light(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the sum of ``size``, the bytes of a row, is at most ``limit``; for rows without a fixed width."""
    total = df.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def released(spark: SparkSession) -> None:
    """Between two steps: lets Spark's cleaner delete shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
