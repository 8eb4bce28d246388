"""Findings: one row per violated rule, grouped into reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding(df: DataFrame, where: Column, severity: str, category: str, location: Column, detail: Column) -> DataFrame:
    return df.where(where).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), location.cast("string").alias("location"), detail.cast("string").alias("detail"))


def union(findings: list[DataFrame]) -> DataFrame:
    """All findings, each with an id that depends on what it says."""
    rows = reduce(DataFrame.unionByName, findings)
    return rows.withColumn("finding_id", F.substring(F.sha2(F.concat_ws("\0", "category", "location", "detail"), 256), 1, 20))


def grouped(findings: DataFrame, examples: int = 3) -> DataFrame:
    """Count and the first distinct locations by severity and category. Locations are cut to so many per task before they move."""
    each = findings.groupBy("severity", "category", "location").agg(F.count("*").alias("n"))
    # the smallest locations of 64 shares of a category first, then the smallest of those
    salted = each.withColumn("_salt", F.pmod(F.xxhash64("location"), F.lit(64)))
    local = salted.withColumn("_i", F.row_number().over(Window.partitionBy("severity", "category", "_salt").orderBy("location"))).where(F.col("_i") <= examples)
    best = local.groupBy("severity", "category").agg(F.array_join(F.slice(F.array_sort(F.collect_list("location")), 1, examples), ", ").alias("examples"))
    sums = each.groupBy("severity", "category").agg(F.sum("n").alias("findings"), F.count("*").alias("locations"))
    counts = sums.join(best, ["severity", "category"])
    return counts.select("severity", "category", "findings", "locations", "examples")


def status(findings: DataFrame) -> DataFrame:
    """One row: failed if any error, passed_with_warnings if any finding, else passed."""
    sums = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return sums.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed"))
