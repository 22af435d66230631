"""Streaming ingest: new files become documents, late deliveries count once, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.sources import files


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of extracted documents, one row for each new file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.extract(stream)


def once(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows delivered again within the watermark count once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("start"), by, "count")


def into_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
