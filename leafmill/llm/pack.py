"""Problem 6: fill containers of fixed capacity with whole documents.

Items are spread over shards of a bounded size. Each shard starts from best fit in falling order and is improved by a
swap-based local search that raises the sum of squared fills: a move, an exchange one for one, or two for one between
underfull bins; a bin that empties is dropped. A second round packs the underfull bins of all shards once more.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared_checkpoint, table

#: Items a shard holds on average. Shards are hashed by id, so none grows with the data.
SHARD_ITEMS = 10_000
#: Partitions of a round at most; beyond that one task packs several shards, one after another.
PARTITIONS = 20_000
#: A bin with less than this share filled goes to the second round.
UNDERFULL = 0.98
#: Stands for a missing id inside the operator.
NO_ID = -(2**63)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, by best fit in falling order of size. No size may exceed capacity."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            insort(free, (room - sizes[i], b))
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search among underfull bins to a local optimum of moves, exchanges one for one and two for one. Every step raises the sum
    of squared fills, so it ends; a bin that empties is dropped.

    A sweep sorts the items (and, where those are stuck, the pairs) of all underfull bins by size. Each bin looks up, for every item
    it could give away or for none, the largest that its gap takes; of equal ones that of the emptiest bin. Bins changed in a sweep
    wait for the next.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    while True:
        live = [b for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        if not _sweep(bins, fill, sizes, capacity, live, _singles(bins, fill, sizes, live)) and not _sweep(bins, fill, sizes, capacity, live, _pairs(bins, fill, sizes, live)):
            return [b for b in bins if b]


def _singles(bins: list[list[int]], fill: list[int], sizes: list[int], live: list[int]) -> list[tuple]:
    """(size, -fill of the bin, bin, items) of what a bin could take, in rising order."""
    return sorted((sizes[i], -fill[b], b, (i,)) for b in live for i in bins[b] if sizes[i] > 0)


def _pairs(bins: list[list[int]], fill: list[int], sizes: list[int], live: list[int]) -> list[tuple]:
    return sorted((sizes[i] + sizes[j], -fill[b], b, (i, j)) for b in live for i, j in combinations(sorted(bins[b]), 2) if sizes[i] + sizes[j] > 0)


def _sweep(bins: list[list[int]], fill: list[int], sizes: list[int], capacity: int, live: list[int], offers: list[tuple]) -> bool:
    """Lets every bin, the fullest first, take its best offer once; tells whether any did."""
    keys = [x[0] for x in offers]
    changed: set[int] = set()
    for a in sorted(live, key=lambda b: (-fill[b], b)):
        if a in changed:
            continue
        gap = capacity - fill[a]
        best, step = 0, None
        for x in {sizes[i]: i for i in reversed(bins[a])}.items() if len(bins[a]) else ():
            best, step = _best(offers, keys, changed, fill, a, x[0], gap, best, step, x[1])
        best, step = _best(offers, keys, changed, fill, a, 0, gap, best, step, None)
        if step:
            gone, (_, _, b, come) = step
            bins[a] = [i for i in bins[a] if i != gone] + list(come)
            bins[b] = [i for i in bins[b] if i not in come] + ([] if gone is None else [gone])
            fill[a] += best
            fill[b] -= best
            changed |= {a, b}
    return bool(changed)


def _best(offers, keys, changed, fill, a, given, gap, best, step, gone):
    """The offer that fills bin a most for an item of size given, if it fills more than best and raises the sum of squared fills."""
    at = bisect_right(keys, given + gap) - 1
    while at >= 0 and (gain := keys[at] - given) > best:
        b = offers[at][2]
        if b != a and b not in changed and gain > fill[b] - fill[a]:
            return gain, (gone, offers[at])
        at -= 1
    return best, step


def _pack(group: pd.DataFrame, shard: str) -> pd.DataFrame:
    capacity = int(group["capacity"].iloc[0])
    group = group.sort_values(["size", "item", "part"], ascending=[False, True, True]).reset_index(drop=True)
    sizes = group["size"].tolist()
    fixed, free = [i for i, s in enumerate(sizes) if s >= capacity], [i for i, s in enumerate(sizes) if s < capacity]
    small = [sizes[i] for i in free]
    bins = [[i] for i in fixed] + [[free[i] for i in b] for b in improve(best_fit(small, capacity), small, capacity)]
    at = {i: b for b, own in enumerate(bins) for i in own}
    fill = {b: sum(sizes[i] for i in own) for b, own in enumerate(bins)}
    bin_of = [at[i] for i in range(len(group))]
    return group.assign(container=[f"{shard}-{b}" for b in bin_of], fill=[fill[b] for b in bin_of])


def _shards(df: DataFrame, packs: int, shards: int, label: str) -> DataFrame:
    """Packs each shard of each pack. The number of partitions is given, so small rows don't end up in a few tasks."""
    schema = "pack_id int, capacity long, item long, part int, size long, shard int, container string, fill long"
    keyed = df.withColumn("shard", F.pmod(F.xxhash64("item", "part", F.lit(label)), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _pack(group, f"{label}{int(group['shard'].iloc[0])}")

    return keyed.repartition(min(PARTITIONS, 2 * packs * shards), "pack_id", "shard").groupBy("pack_id", "shard").applyInPandas(run, schema)


def fill_containers(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """items(item LONG, size LONG), capacities(pack_id, capacity_tokens) -> pack_id, container, item, part, parts, size, fill.

    An item over the capacity is cut in parts of the capacity and a rest, the parts alone in their containers, the rest packed
    like any item. Null or negative sizes count as 0; an item of size 0 is placed. Equal items are placed each, a null id stays
    null. No items, no rows. Other columns are left out. capacities is a parameter table and is read to the driver, a thousand rows
    a step; a null or non-positive capacity is an error. Sizes are measured once and written to the checkpoint.
    """
    packs = [(r[0], r[1]) for r in capacities.select("pack_id", "capacity_tokens").toLocalIterator()]
    if any(not c or c <= 0 for _, c in packs):
        raise ValueError("capacities: must be positive")
    if not packs:
        packs, items = [(0, 1)], items.limit(0)
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    items = shared_checkpoint(items.select(F.coalesce(F.col("item").cast("long"), F.lit(NO_ID)).alias("item"), size.alias("size")))
    rows = None
    for k in range(0, len(packs), 1000):
        each = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for p, c in packs[k : k + 1000]])).alias("_p")
        some = items.select("item", "size", each).select("_p.pack_id", "_p.capacity", "item", "size")
        rows = some if rows is None else rows.unionByName(some)
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")).cast("int")))))
    cut = cut.withColumn("size", F.least(F.col("capacity"), F.col("size") - (F.col("part") - 1) * F.col("capacity")))
    first = shared_checkpoint(_shards(cut.select("pack_id", "capacity", "item", "part", "size"), len(packs), max(1, -(-items.count() // SHARD_ITEMS)), "a"))
    again = F.col("fill") < F.col("capacity") * UNDERFULL
    loose = first.where(again).select("pack_id", "capacity", "item", "part", "size")
    second = _shards(loose, len(packs), max(1, -(-loose.count() // (len(packs) * SHARD_ITEMS))), "b")
    placed = first.where(~again).unionByName(second).drop("shard")
    return placed.withColumn("item", F.when(F.col("item") != NO_ID, F.col("item")))


def document_containers(spark, sf_dir: str) -> DataFrame:
    """Sizes are UTF-8 bytes, the tokens of a byte-level tokenizer; they are counted in the scan and no text is moved."""
    items = table(spark, sf_dir, "documents", F.col("doc_id").alias("item"), F.octet_length("text").cast("long").alias("size")).where("size is not null")
    return fill_containers(items, table(spark, sf_dir, "pack_sizes"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Documents that came out in more than one container."""
    placed = document_containers(spark, sf_dir).groupBy("pack_id", "item").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return placed.where("a != b").select("pack_id", F.col("item").alias("doc_id"))


def p6_containers(spark, sf_dir: str) -> DataFrame:
    placed = document_containers(spark, sf_dir)
    return placed.select("pack_id", "container", F.col("item").alias("doc_id"), "part", F.col("size").alias("tokens"))


def p6_fill(spark, sf_dir: str) -> DataFrame:
    """Containers used, tokens placed and the share of space filled, by capacity."""
    placed = document_containers(spark, sf_dir)
    bins = placed.groupBy("pack_id", "capacity", "container").agg(F.sum("size").alias("tokens"))
    return bins.groupBy("pack_id", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("filled"))


def p6_whole(spark, sf_dir: str) -> DataFrame:
    """By capacity: documents and tokens placed, and whether every container is within it."""
    placed = document_containers(spark, sf_dir)
    bins = placed.groupBy("pack_id", "capacity", "container").agg(F.sum("size").alias("tokens"), F.count_if(F.col("part") == 1).alias("documents"))
    return bins.groupBy("pack_id").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.bool_and(F.col("tokens") <= F.col("capacity")).alias("fits"))
