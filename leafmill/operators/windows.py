"""Ordered operators that don't put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the order one block holds.
BLOCK = 4096


def running_sum(df: DataFrame, keys: list[str], place: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of value up to and with each row, along place (an integer, unique in its group).

    Blocks of places are summed first, then each block's rows start from the sum of the blocks before; a group of any size is
    spread over as many tasks as it has blocks. Null values count as 0, null places sort first.
    """
    rows = df.withColumn("_value", F.coalesce(value, F.lit(0))).withColumn("_block", F.floor(F.col(place) / block))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_block")]
    both = rows.alias("r").join(sums.alias("s"), on, "left").select("r.*", "s._before")
    own = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.col("_before") + F.sum("_value").over(own)).drop("_value", "_block", "_before")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str) -> DataFrame:
    """Number of the island each row lies in: starts is true (over lag columns already there) where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(df: DataFrame, keys: list[str], place: str, column: str, before: str, after: str, block: int = BLOCK) -> DataFrame:
    """The column's value in the row before and after along place (an integer, unique in its group).

    Rows look within their block; the first and last of each block are joined to the edges of the nearest blocks, one row a block.
    """
    rows = df.withColumn("_block", F.floor(F.col(place) / block))
    own = Window.partitionBy(*keys, "_block").orderBy(place)
    edges = rows.groupBy(*keys, "_block").agg(F.min_by(column, place).alias("_first"), F.max_by(column, place).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(*keys, "_block", F.lag("_last").over(along).alias("_left"), F.lead("_first").over(along).alias("_right"))
    rows = rows.withColumn(before, F.lag(column).over(own)).withColumn(after, F.lead(column).over(own)).withColumn("_i", F.row_number().over(own)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_block")))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_block")]
    both = rows.alias("r").join(edges.alias("e"), on, "left").select("r.*", "e._left", "e._right")
    return both.withColumn(before, F.when(F.col("_i") == 1, F.col("_left")).otherwise(F.col(before))).withColumn(after, F.when(F.col("_i") == F.col("_n"), F.col("_right")).otherwise(F.col(after))).drop("_block", "_i", "_n", "_left", "_right")
