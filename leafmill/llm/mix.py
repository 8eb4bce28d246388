"""Problem 7: mix sources to target weights with a cap on repeats.

Each document of a source gets the same expected number of copies. The whole part is given at once; the fraction is decided
by pivotal dependent rounding: two fractional documents pass mass between them until one is whole. A partition leaves at most
one fractional document per mix and source; these are paired in a reduction tree of bounded fan-in, so the copies' total stays
within one document of the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared_checkpoint, table

#: Fractional documents one task of the tree takes, at most about.
FAN_IN = 4096
#: Stands for a missing id inside the operator.
NO_ID = -(2**63)
#: What is nearer to 0 or 1 counts as whole.
EPS = 1e-9
#: A plan of up to so many rows is broadcast.
PLAN_ROWS = 10_000
_SCHEMA = "mix_id int, source string, item long, size long, copies int, rest double, part int"


def pivot(rest: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds rest (each in 0..1) in turns: neighbours among those still fractional are paired and pass mass between them until one of
    each pair is whole, all pairs at once. Gives 0/1 decisions and the index left fractional, or -1, whose rest is updated.
    u: uniforms, rows by turn (at least one more than the binary logarithm of the count), columns by index."""
    rest[rest <= EPS], rest[rest >= 1 - EPS] = 0.0, 1.0
    live = np.flatnonzero((rest > 0) & (rest < 1))
    turn = 0
    while len(live) > 1:
        odd = live[-1:] if len(live) % 2 else live[:0]
        a, b = live[0 : len(live) - len(odd) : 2], live[1::2][: (len(live) - len(odd)) // 2]
        p, q, r = rest[a], rest[b], u[turn % len(u)][a]
        s = p + q
        low = s < 1
        with np.errstate(divide="ignore", invalid="ignore"):
            # below 1 one of them gets nothing and the other both; from 1 on one gets a whole and the other what is over
            first = np.where(low, r * s < p, r * (2 - s) < 1 - q)
        rest[a] = np.where(low, np.where(first, s, 0.0), np.where(first, 1.0, s - 1))
        rest[b] = np.where(low, np.where(first, 0.0, s), np.where(first, s - 1, 1.0))
        rest[rest <= EPS], rest[rest >= 1 - EPS] = 0.0, 1.0
        live = np.concatenate([live[: len(live) - len(odd)], odd])
        live = live[(rest[live] > 0) & (rest[live] < 1)]
        turn += 1
    held = int(live[0]) if len(live) else -1
    return (rest == 1.0).astype(np.int32), held


def _uniforms(ids: np.ndarray, mix: int, seed: int) -> np.ndarray:
    """Rows of uniforms, enough turns for pivot()."""
    return np.stack([_uniform(ids, mix, seed + 7919 * k) for k in range(max(1, int(len(ids)).bit_length() + 1))])


def _uniform(ids: np.ndarray, mix: int, seed: int) -> np.ndarray:
    """A uniform for each id that depends on id, mix and seed alone, so a task run again decides alike (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (mix * 1_000_003 + seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2**53


def _round(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds one mix and source; neighbours by size are paired, so tokens are kept nearly as well as counts."""
    rows = rows.sort_values(["size", "item"], kind="stable").reset_index(drop=True)
    rest = rows["rest"].to_numpy(dtype=np.float64, copy=True)
    ids = rows["item"].to_numpy(dtype=np.int64)
    more, held = pivot(rest, _uniforms(ids, int(rows["mix_id"].iloc[0]), seed))
    left = np.zeros(len(rows))
    if held >= 0:
        left[held] = rest[held]
    return rows.assign(copies=rows["copies"].to_numpy() + more, rest=left)


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes(source, size): one row per mix and source with the tokens and documents there are, the target and the copies wanted.

    The aggregate is one row per source. The total of a mix counts all rows with a source, whether the mix uses it or not.
    """
    sums = sizes.where("source is not null").groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("documents"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    plan = targets.select("mix_id", "source", "target_weight", "max_repeats").join(sums, "source", "left").join(F.broadcast(total))
    plan = plan.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    plan = plan.withColumn("target_tokens", F.col("target_weight") * F.col("all_tokens"))
    most = F.col("max_repeats").cast("double")
    return plan.withColumn("copies_each", F.when(F.col("tokens") > 0, F.least(F.col("target_tokens") / F.col("tokens"), most)).otherwise(most))


def mix_sources(items: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """items(item, source, size), targets(mix_id, source, target_weight, max_repeats) -> (copies, plan).

    copies: mix_id, source, item, size, copies for every document with at least one copy. targets is a parameter table. Rows without a
    source belong to no mix. Null sizes count as 0. A source without documents gets no copies and keeps its row in plan; documents of
    size 0 in a source without any tokens get all their copies. Two documents of the same id are two documents. A null id stays null.
    Other columns are left out.

    Sizes are measured once and written to the checkpoint. A document's fate depends on its id, the seed and which documents it is
    paired with; those are its neighbours by size in its Arrow batch, so a task run again over the same rows decides alike, and the
    checkpoint keeps what was decided.
    """
    items = shared_checkpoint(items.select(F.coalesce(F.col("item").cast("long"), F.lit(NO_ID)).alias("item"), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")).where("source is not null"))
    plan = shared_checkpoint(mix_plan(items, targets))
    each = plan.where("copies_each > 0").select("mix_id", "source", "copies_each")
    wanted = items.join(F.broadcast(each) if plan.count() <= PLAN_ROWS else each, "source").select("mix_id", "source", "item", "size", "copies_each")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple[int, str], pd.DataFrame] = {}
        for batch in batches:
            for key, own in batch.groupby(["mix_id", "source"], sort=True):
                whole = own["copies_each"].to_numpy(dtype=np.float64)
                rows = pd.DataFrame({"mix_id": own["mix_id"], "source": own["source"], "item": own["item"], "size": own["size"], "copies": whole.astype(np.int64), "rest": whole - whole.astype(np.int64), "part": part})
                if key in held:
                    rows = pd.concat([held.pop(key), rows])
                rows = _round(rows.astype({"mix_id": "int32", "copies": "int32", "part": "int32"}), seed)
                if (loose := rows["rest"] > 0).any():
                    held[key] = rows[loose]
                    rows = rows[~loose]
                yield rows[rows["copies"] > 0]
        yield from held.values()

    done = shared_checkpoint(wanted.mapInPandas(local, _SCHEMA))
    whole, loose = done.where("rest = 0"), done.where("rest > 0")
    width = max(1, loose.select(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level, width = level + 1, -(-width // FAN_IN)
        last = width == 1

        def merge(rows: pd.DataFrame, at: int = level, last: bool = last) -> pd.DataFrame:
            rows = _round(rows, seed + at)
            if last and len(held := rows.index[rows["rest"] > 0]):  # the one fraction left is decided by chance
                u = _uniform(rows.loc[held, "item"].to_numpy(dtype=np.int64), int(rows["mix_id"].iloc[0]), seed - 1)
                rows.loc[held, "copies"] += (u < rows.loc[held, "rest"].to_numpy()).astype("int32")
                rows["rest"] = 0.0
            return rows.assign(part=rows["part"] // FAN_IN)

        loose = loose.withColumn("_to", F.floor(F.col("part") / FAN_IN)).groupBy("mix_id", "source", "_to").applyInPandas(lambda rows: merge(rows.drop(columns="_to")), _SCHEMA)
        if last:
            break
    copies = whole.unionByName(loose).where("copies > 0").select("mix_id", "source", F.when(F.col("item") != NO_ID, F.col("item")).alias("item"), "size", "copies")
    return copies, plan


def mix_report(items: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Per mix and source: target, what the copies reach, the share of the mix's total reached, and whether it falls short: all its
    documents are used as often as they may be, and what they reach is less than the target."""
    copies, plan = mix_sources(items, targets, seed)
    reached = copies.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    out = plan.join(reached, ["mix_id", "source"], "left").na.fill(0, ["reached_tokens", "copies", "most_copies"])
    out = out.withColumn("falls_short", (F.col("copies") >= F.col("max_repeats") * F.col("documents")) & (F.col("reached_tokens") < F.col("target_tokens")))
    mix = out.groupBy("mix_id").agg(F.sum("reached_tokens").alias("mix_tokens"))
    out = out.join(mix, "mix_id")
    share = F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0))
    return out.withColumn("reached_share", share)


def _documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", F.col("doc_id").alias("item"), "source", F.octet_length("text").cast("long").alias("size"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    report = mix_report(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return report.where("falls_short").select("mix_id", "source").distinct()


def p7_shares(spark, sf_dir: str) -> DataFrame:
    report = mix_report(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return report.select("mix_id", "source", "target_weight", "target_tokens", "reached_tokens", "reached_share", "copies", "most_copies", "falls_short")


def p7_copies(spark, sf_dir: str) -> DataFrame:
    copies, _ = mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return copies.select("mix_id", "source", F.col("item").alias("doc_id"), "copies")


def p7_whole(spark, sf_dir: str) -> DataFrame:
    """Per mix and source: whether no document is used more often than it may be, and whether the tokens reached are within two per
    cent, and twenty of its documents on average, of what the target and the repeats allow."""
    report = mix_report(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    allowed = F.least(F.col("target_tokens"), (F.col("max_repeats") * F.col("tokens")).cast("double"))
    slack = 0.02 * allowed + 20 * F.col("tokens") / F.greatest(F.lit(1), F.col("documents"))
    return report.select("mix_id", "source", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("reached_tokens") - allowed) <= slack).alias("near"))
