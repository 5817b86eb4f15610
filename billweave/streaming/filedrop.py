"""A directory of texts as a stream: the row-local operators run on it unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_stream(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id (a hash of the path), path and text of files as they arrive."""
    lines = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).schema("value string").load(directory)
    return lines.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to what has arrived and appends the rows to parquet, each file once."""
    return operator(stream).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
