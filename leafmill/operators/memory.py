"""Reuse of repeated units within a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exact_copies(units: DataFrame) -> DataFrame:
    """first_unit: the earliest unit of the job with the same kind, source and placeholders; null for that one itself.

    Texts are compared by hash and the first is found by a map-side minimum, so a text copied everywhere moves once per task.
    """
    keyed = units.withColumn("_same", F.sha2(F.concat_ws("\0", "kind", "source", F.to_json("placeholders"), F.to_json("protections")), 256)).drop("source", "placeholders", "protections")
    first = keyed.groupBy("job_kind", "job_id", "_same").agg(F.min_by(F.struct("unit_no", "unit_id"), F.col("unit_no")).alias("_first"))
    both = keyed.join(first, ["job_kind", "job_id", "_same"])
    return both.withColumn("first_unit", F.when(F.col("_first.unit_no") < F.col("unit_no"), F.col("_first.unit_id"))).drop("_same", "_first")


def templated_labels(units: DataFrame) -> DataFrame:
    """Labels that differ from an earlier one of the job only in their last number: 'Page 2' from 'Page 1'."""
    label = F.trim("source")
    parts = [F.regexp_extract(label, "^(.*?\\D)(\\d+)(\\D*)$", i) for i in (1, 2, 3)]
    rows = units.where(F.col("kind").startswith("attribute:") | (F.col("kind") == "title") | F.col("kind").rlike("^h[1-6]$"))
    rows = rows.where(label.rlike("^.*?\\D\\d+\\D*$")).select("unit_key", "job_kind", "job_id", "unit_no", "unit_id", "kind", T.casefold(parts[0]).alias("prefix"), parts[1].alias("number"), T.casefold(parts[2]).alias("suffix"))
    rows = rows.where(F.col("prefix").rlike("[\\p{L}\\p{N}_]"))
    keys = ["job_kind", "job_id", "kind", "prefix", "suffix"]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("unit_no", "unit_id", "number"), "unit_no").alias("f"))
    out = rows.join(first, keys).where(F.col("unit_no") > F.col("f.unit_no"))
    return out.select("unit_key", F.col("f.unit_id").alias("template_of"), F.col("f.number").alias("template_number"), "number")


def resolved(units: DataFrame) -> DataFrame:
    """Units joined to the unit whose translation they take: their own, or the one they repeat; unresolved where that is missing."""
    source = units.select("job_kind", "job_id", F.col("unit_id").alias("reuse_of"), F.col("unit_key").alias("source_key"))
    both = units.select("unit_key", "job_kind", "job_id", "reuse_of").join(source, ["job_kind", "job_id", "reuse_of"], "left")
    return both.select("unit_key", F.coalesce("source_key", F.when(F.col("reuse_of").isNull(), F.col("unit_key"))).alias("takes_from"), (F.col("reuse_of").isNotNull() & F.col("source_key").isNull()).alias("unresolved"))
