"""Incremental ingestion: new files of a source tree become rows of the function table as they arrive.

An extension: batch scans and the stream share extraction, so both give the same rows. The stream's state is the
file source's log in the checkpoint folder; files are processed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from codeweft.core import shared_folder
from codeweft.functions.text import SKIP_DIRS, in_skipped_folder, language_of
from codeweft.operators.extraction import SUPPORTED, extract_functions
from codeweft.sources.scan import decode_utf8

_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def file_stream(spark: SparkSession, root: str, skip: list[str] = SKIP_DIRS, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of files(file_path, language, content) below a folder."""
    raw = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    f = raw.withColumn("file_path", F.regexp_replace("path", "^file:/+", "/")).withColumn("language", language_of("path"))
    return f.where(F.col("language").isin(*SUPPORTED) & ~in_skipped_folder("file_path", skip)).select("file_path", "language", decode_utf8("content").alias("content"))


def ingest(spark: SparkSession, root: str, table: str, checkpoint: str | None = None, once: bool = True):
    """Append the functions of new files to a Parquet table; with `once` it ends when all present files are read."""
    writer = extract_functions(file_stream(spark, root)).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/ingest")
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) of an event stream or table by tumbling window; later rows than the watermark are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
