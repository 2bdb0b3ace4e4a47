"""Structured Streaming over messages: decoded columns, then Spark's own windows and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wkt import to_spark_timestamp
from ..operators.decode import pb_decode
from ..schema import MessageSchema
from ..sources.delimited import split_frames


def read_stream_delimited(spark: SparkSession, path: str, m: MessageSchema, frame: str = "varint", files_per_trigger: int = 16) -> DataFrame:
    """A stream of the messages of files that arrive under path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return pb_decode(split_frames(files, frame), "raw", m)


def with_event_time(messages: DataFrame, ts_field: str, late: str, col: str = "message") -> DataFrame:
    """Adds event_time from a decoded Timestamp field, with a watermark."""
    return messages.withColumn("event_time", to_spark_timestamp(F.col(col)[ts_field])).withWatermark("event_time", late)
