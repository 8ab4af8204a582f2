"""A folder of Org files as a stream: each new file is parsed once and its rows replace those the sink had of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.sources import org


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(source_file, text, modified) of the files of a folder as they come."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.org").option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def start(spark: SparkSession, path: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parsed elements as Parquet in ``out``, a folder for each batch, so that a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        org.parse(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type under a watermark; serves a stream and a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
