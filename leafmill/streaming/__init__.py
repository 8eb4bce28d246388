"""Incremental counterparts of stateless queries: the same expressions over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T


def document_stream(spark: SparkSession, folder: str, schema: P.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_within(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """Drops re-deliveries of a key that come within delay; state older than that is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def word_counts(stream: DataFrame) -> DataFrame:
    return stream.select("doc_id", T.word_count("text").alias("words"), F.length("text").alias("characters"))
