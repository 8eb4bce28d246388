"""Reading tables, dropping re-delivered rows, cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """Scan one Parquet table; naming columns keeps the read schema narrow."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def deduplicate(df: DataFrame, keys: list[str], order: str = "received_at") -> DataFrame:
    """One row per key, the earliest delivery; the aggregate combines map-side, so a hot key moves once per task.

    Null keys form one group of their own. Ties keep any one of the equal rows.
    """
    rest = [c for c in df.columns if c not in keys]
    if order not in rest:
        return df.dropDuplicates(keys)
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_one"))
    return one.select(*[c if c in keys else F.col("_one")[c].alias(c) for c in df.columns])


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder of spark.checkpoint.dir. Where none is set, a session on this machine alone (local[...], as in tests)
    gets a temporary one; on a cluster it is an error, as the other machines couldn't read it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir: name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="leafmill-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
