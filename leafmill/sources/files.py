"""File sources of document jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON with a given schema and the file's path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def page_geometry(spark: SparkSession, path: str) -> DataFrame:
    """XML pages of words with boxes: page number, word and its four sides."""
    schema = "_number LONG, word ARRAY<STRUCT<_VALUE STRING, _xMin DOUBLE, _yMin DOUBLE, _xMax DOUBLE, _yMax DOUBLE>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = pages.select(F.col("_number").alias("page_number"), F.posexplode("word").alias("word_no", "w"))
    return rows.select("page_number", "word_no", F.col("w._VALUE").alias("text"), F.col("w._xMin").alias("x0"), F.col("w._yMin").alias("top"), F.col("w._xMax").alias("x1"), F.col("w._yMax").alias("bottom"))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files under a folder with size and time; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime").distinct()


def text_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Lines of white-space separated tables, such as lists of fonts or images, split in fields."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("fields"))
    return rows.where(F.size("fields") > skip)


def strict_utf8(c: Column) -> Column:
    """Text of bytes, null where they aren't valid UTF-8."""
    return F.try_validate_utf8(c.cast("string"))


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes Parquet where nothing is yet; Spark commits the files of a job together."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def inventory_differences(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, sha256) as declared against as found: missing, unlisted or changed."""
    both = listed.select("path", F.col("sha256").alias("declared")).join(found.select("path", F.col("sha256").alias("actual")), "path", "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "unlisted").when(F.col("declared") != F.col("actual"), "changed")
    return both.withColumn("state", state).where("state is not null")
