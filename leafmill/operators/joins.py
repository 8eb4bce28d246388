"""Joins beyond equality of keys: unique on both sides, nearest, between shared anchors, along a time scale; and fixpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared_checkpoint
from .windows import running_sum


def unique_pairs(a: DataFrame, b: DataFrame, keys: list[str], id_a: str, id_b: str) -> DataFrame:
    """Rows of a and b whose keys stand once on either side. Keys are counted before anything is joined; null keys match nothing."""
    one = lambda df, i: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(i).alias(i)).where("n = 1").drop("n")
    return one(a, id_a).join(one(b, id_b), keys).select(*keys, id_a, id_b)


def nearest(a: DataFrame, b: DataFrame, keys: list[str], at_a: str, at_b: str, id_a: str, id_b: str, within: float) -> DataFrame:
    """For each row of a the row of b of the same keys nearest to it, no further than within; ties go to the lower id.

    Both sides are put in bands as wide as the reach; a row of b also joins the bands beside its own, so only neighbours meet."""
    band = lambda c: F.floor(F.col(c) / within).cast("long")
    left = a.select(*keys, id_a, F.col(at_a).alias("_a"), band(at_a).alias("_band"))
    right = b.select(*keys, id_b, F.col(at_b).alias("_b"), F.explode(F.array(band(at_b) - 1, band(at_b), band(at_b) + 1)).alias("_band"))
    both = left.join(right, [*keys, "_band"]).withColumn("distance", F.abs(F.col("_a") - F.col("_b"))).where(F.col("distance") <= within)
    return both.groupBy(*keys, id_a).agg(F.min(F.struct("distance", id_b)).alias("m")).select(*keys, id_a, f"m.{id_b}", "m.distance")


def anchored_intervals(a: DataFrame, b: DataFrame, group: str, place: str, anchor: str, slot: str) -> DataFrame:
    """Rows between the same anchors of two sequences, paired by their place in the interval.

    An anchor counts if its value stands once in either sequence of the group. Rows before the first anchor are interval 0."""
    with_anchor = lambda df, name: df.where(F.col(anchor).isNotNull()).select(group, anchor, F.col(place).alias(name))
    shared = unique_pairs(with_anchor(a, "_pa"), with_anchor(b, "_pb"), [group, anchor], "_pa", "_pb")
    # anchors out of order in b would cross; those that fall behind an earlier one don't count
    w = Window.partitionBy(group).orderBy("_pa").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("_high", F.max("_pb").over(w)).where(F.col("_high").isNull() | (F.col("_pb") > F.col("_high"))).select(group, anchor).withColumn("_is", F.lit(1))

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(shared, [group, anchor], "left")
        rows = running_sum(rows, [group], place, F.coalesce("_is", F.lit(0)), "interval")
        w = Window.partitionBy(group, "interval").orderBy(place)
        return rows.select(group, "interval", (F.row_number().over(w) - 1).alias("offset"), F.col(slot).alias(name))

    return numbered(a, "slot_a").join(numbered(b, "slot_b"), [group, "interval", "offset"], "full_outer")


def time_warp(events: DataFrame, knots: DataFrame, keys: list[str], at: str, knot_from: str = "from_time", knot_to: str = "to_time") -> DataFrame:
    """Times of events on another scale, linear between knots; before the first and after the last the shift there holds."""
    w = Window.partitionBy(*keys).orderBy(knot_from)
    spans = knots.select(*keys, F.col(knot_from).alias("f0"), F.col(knot_to).alias("t0"), F.lead(knot_from).over(w).alias("f1"), F.lead(knot_to).over(w).alias("t1"), F.row_number().over(w).alias("_i"))
    both = events.join(spans, keys).where(((F.col(at) >= F.col("f0")) | (F.col("_i") == 1)) & (F.col("f1").isNull() | (F.col(at) < F.col("f1"))))
    inside = F.col("f1").isNotNull() & (F.col(at) >= F.col("f0")) & (F.col("f1") > F.col("f0"))
    new = F.when(inside, F.col("t0") + (F.col(at) - F.col("f0")) * (F.col("t1") - F.col("t0")) / (F.col("f1") - F.col("f0"))).otherwise(F.col("t0") + F.col(at) - F.col("f0"))
    return both.withColumn("warped", new).drop("f0", "t0", "f1", "t1", "_i")


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], open_: Callable[[DataFrame], Column] | None = None, most: int = 6) -> tuple[DataFrame, int, str]:
    """Repeats a step until no row is open, a state comes back, or most passes are done: (rows, passes, why it ended).

    A state is told by one number over all rows; each pass is checkpointed, so plans don't grow."""
    seen: set[tuple] = set()
    for done in range(most + 1):
        df = shared_checkpoint(df)
        if open_ is not None and df.where(open_(df)).limit(1).count() == 0:
            return df, done, "stable"
        state = tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
        if state in seen:
            return df, done, "repeats"
        seen.add(state)
        if done < most:
            df = step(df)
    return df, most, "limit"


def fingerprint(df: DataFrame, keys: list[str], name: str, digest: str, shares: int = 256) -> DataFrame:
    """One hash per group of the sorted (name, digest) lines: first of shares of the names, then of the shares' hashes in order."""
    line = F.concat_ws("\0", name, digest)
    each = df.groupBy(*keys, F.pmod(F.xxhash64(name), F.lit(shares)).alias("_share")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("_h"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_share", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("fingerprint"))
