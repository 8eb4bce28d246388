"""Overlap, coverage, order and style measures between and within texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def neighbour_pairs(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row beside the next of its group: columns with _a and _b. Ids are paired first, then the rest is joined."""
    w = Window.partitionBy(*keys).orderBy(order)
    ids = df.select(order, *keys).withColumn("_next", F.lead(order).over(w)).where("_next is not null").select(F.col(order).alias("id_a"), F.col("_next").alias("id_b"))
    a = df.select(F.col(order).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(F.col(order).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return ids.join(a, "id_a").join(b, "id_b")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def token_coverage(pairs: DataFrame, a: str, b: str, ids: list[str]) -> DataFrame:
    """Share of a's tokens, with their counts, that b has; and the same of adjacent pairs of tokens, which shows order. A pair of texts
    is one row and is counted in it. Rows of an a without tokens are left out; order_share is null for an a of one token."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                if x is None or not len(x):
                    out.append((None, None))
                    continue
                x, y = list(x), list(y) if y is not None else []
                out.append(tuple(None if not u else (Counter(u) & Counter(v)).total() / len(u) for u, v in ((x, y), (list(zip(x, x[1:])), list(zip(y, y[1:]))))))
            yield pd.DataFrame(out, columns=["coverage", "order_share"], dtype="float64")

    shares = F.pandas_udf(run, "struct<coverage:double,order_share:double>").asNondeterministic()
    own = lambda c: T.words(T.casefold(c))
    return pairs.select(*ids, shares(own(a), own(b)).alias("s")).select(*ids, "s.*").where("coverage is not null")


def style(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: sentences of three words or more, repeated beginnings, variation of their lengths from eight on."""
    sentences = df.select(key, F.explode(T.sentences_split(text)).alias("s")).select(key, T.style_words("s").alias("w"))
    sentences = sentences.select(key, F.size("w").alias("n"), T.casefold(F.array_join(F.slice("w", 1, 2), " ")).alias("beginning"))
    starts = sentences.groupBy(key, "beginning").agg(F.count("*").alias("times"), F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    out = starts.groupBy(key).agg(F.sum("times").alias("sentences"), F.sum(F.when(F.col("times") > 2, F.col("times") - 2).otherwise(0)).alias("repeated_beginnings"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("sentences")
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("sentences") - mean * mean)) / mean
    return out.withColumn("variation", F.when((F.col("sentences") >= 8) & (mean > 0), F.round(cv, 4))).drop("s1", "s2")


def duplicate_blocks(df: DataFrame, keys: list[str], text: str, least_words: int = 6) -> DataFrame:
    """Blocks of so many words that repeat another of the group: blocks less distinct blocks."""
    rows = df.where(F.size(T.style_words(text)) >= least_words).select(*keys, F.sha2(T.compact(T.casefold(text)), 256).alias("h"))
    each = rows.groupBy(*keys, "h").agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("blocks"), (F.sum("n") - F.count("*")).alias("duplicates"))


#: Canned phrases.
CANNED = (
    "it is important to (?:note|remember)", "in today's (?:world|fast-paced world|digital age)", "in conclusion", "delve(?:s|d)? into", "serves as a testament", "not only.{0,90}but also",
    "este important de (?:menționat|reținut|observat)", "în concluzie", "în lumea de astăzi", "es importante (?:señalar|destacar|recordar)", "en conclusión", "nel mondo di oggi",
    "è importante (?:notare|ricordare|sottolineare)", "abschließend lässt sich sagen", "es ist wichtig zu beachten", "il est important de (?:noter|rappeler)", "en conclusion",
)


def canned_phrases(c: Column | str) -> Column:
    low = F.lower(T.column(c))
    return sum((F.regexp_count(low, F.lit(f"(?<![\\p{{L}}\\p{{N}}_]){p}(?![\\p{{L}}\\p{{N}}_])")) for p in CANNED), F.lit(0))
