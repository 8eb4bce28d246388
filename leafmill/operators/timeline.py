"""Timelines: beats one after another, and beats anchored to others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared_checkpoint
from .windows import running_sum


def frames(seconds: Column, rate: int = 48_000) -> Column:
    return F.floor(seconds * rate + 0.5).cast("long")


def line_frames(line: Column, characters_a_second: float = 15.0) -> Column:
    """Frames a line takes to read; null for an empty one."""
    return F.when(line != "", frames(F.length(line) / characters_a_second))


def running(c: Column | str) -> Column:
    """Running sums of an array of LONG; nulls count as 0."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if x is None else np.cumsum(np.nan_to_num(np.asarray(x, dtype=np.float64))).astype(np.int64) for x in rows], dtype=object)

    return F.pandas_udf(run, "array<long>")(c)


def sequential(beats: DataFrame, key: str, place: str, seconds: str) -> DataFrame:
    """start_frame and end_frame of beats that follow each other."""
    rows = beats.withColumn("_f", frames(F.col(seconds)))
    out = running_sum(rows, [key], place, F.col("_f"), "end_frame")
    return out.withColumn("start_frame", F.col("end_frame") - F.col("_f")).drop("_f")


def anchored(beats: DataFrame, keys: list[str], beat: str, anchor: str, length: str, most: int = 20) -> DataFrame:
    """Starts of beats that begin where another ends, along chains of up to 2**most beats: the reach doubles each round.

    Beats without an anchor start at 0. Beats on a cycle, or whose chain ends in a missing beat, get a null start. Every second
    round is checkpointed, which cuts the plan and tells whether any chain is still open.
    """
    rows = beats.select(*keys, F.col(beat).alias("beat"), F.col(length).cast("long").alias("length"), F.col(anchor).alias("to"))
    lengths = rows.select(*keys, F.col("beat").alias("to"), F.col("length").alias("_add"))
    state = rows.join(lengths, [*keys, "to"], "left")
    broken = F.col("to").isNotNull() & F.col("_add").isNull()
    state = state.select(*keys, "beat", "length", F.when(~broken, F.col("to")).alias("to"), F.coalesce("_add", F.lit(0)).cast("long").alias("add"), broken.alias("broken"))
    for step in range(most):
        other = state.select(*keys, F.col("beat").alias("to"), F.col("to").alias("_to"), F.col("add").alias("_add"), F.col("broken").alias("_broken"))
        both = state.join(other, [*keys, "to"], "left")
        state = both.select(*keys, "beat", "length", F.col("_to").alias("to"), (F.col("add") + F.coalesce("_add", F.lit(0))).alias("add"), (F.col("broken") | F.coalesce("_broken", F.lit(False))).alias("broken"))
        if step % 2:
            state = shared_checkpoint(state)
            if state.where("to is not null").limit(1).count() == 0:
                break
    return state.select(*keys, F.col("beat").alias(beat), "length", F.when(F.col("to").isNull() & ~F.col("broken"), F.col("add")).alias("start"))
