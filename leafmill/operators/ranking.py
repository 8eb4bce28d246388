"""Representative sentences, keywords and genre words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words without weight, and words of each genre.
STOP = "this that with from they their have been were will which pentru este sunt care prin dintre poate despre cand doar aceasta aceste acela acesta into would could should than then more most much".split()
GENRES = {
    "fiction": ["poveste", "personaj", "mira", "oras", "story", "character", "conflict"],
    "sf": ["marte", "planeta", "simulare", "nava", "mars", "planet", "spaceship"],
    "philosophy": ["libertate", "adevar", "argument", "dorinta", "freedom", "truth", "thesis"],
    "technical": ["algoritm", "sistem", "verificare", "provenienta", "algorithm", "system", "evaluation"],
}
#: Beginnings of words that show something new, tension, and limits.
NOVELTY = ("nou", "noua", "noutate", "propune", "novel", "new", "propose", "unlike", "instead", "original")
TENSION = ("dar", "insa", "totusi", "conflict", "mister", "risc", "but", "however", "risk", "unexpected", "problem")
LIMITS = ("limita", "limite", "gres", "incert", "cannot", "limitation", "uncertain", "fails", "not guarantee")
LONG_WORD = "\\p{L}{4,}"


def segments(text: str) -> Column:
    """Pieces of more than 15 characters, cut behind closing marks; a tail without a mark is one too."""
    return F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit("(?s).+?(?:[.!?]+[\"'”’»)\\]]*(?:\\s|$)|\\z)"), F.lit(0)), T.compact), lambda s: F.length(s) > 15)


def _long_words(c: Column) -> Column:
    return F.regexp_extract_all(T.unaccented(c), F.lit(LONG_WORD), F.lit(0))


def top_sentences(df: DataFrame, key: str, text: str, k: int = 18) -> DataFrame:
    """The k sentences of each text with most weight: the logs of their words' counts in the whole text, summed, over the root of
    their number. Accents don't count. Ties go to the earlier sentence; pos gives the text's order, rank that of the weights.

    A text is one row: its words are counted in it and nothing is shuffled. Null and empty texts have no sentence."""

    stop = frozenset(STOP)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sentences, words in batches:
            out = []
            for own, every in zip(sentences, words):
                if own is None or every is None:
                    out.append([])
                    continue
                weight = {w: 0.0 if w in stop else math.log(1 + n) for w, n in Counter(every).items()}
                scores = [sum(weight.get(w, 0.0) for w in s) / math.sqrt(max(1, len(s))) for s in own]
                order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 9), i))[:k]
                out.append([{"pos": i, "rank": r, "score": round(scores[i], 6)} for r, i in enumerate(order, 1)])
            yield pd.Series(out, dtype=object)

    scored = F.pandas_udf(run, "array<struct<pos:int,rank:int,score:double>>").asNondeterministic()
    rows = df.select(key, segments(text).alias("_s"), _long_words(F.col(text)).alias("_w"))
    rows = rows.select(key, "_s", scored(F.transform("_s", _long_words), F.col("_w")).alias("_top"))
    rows = rows.select(key, "_s", F.explode("_top").alias("t"))
    return rows.select(key, "t.pos", "t.rank", "t.score", F.col("_s")[F.col("t.pos")].alias("sentence"))


def matching_sentences(df: DataFrame, key: str, text: str, words: Sequence[str], k: int = 8) -> DataFrame:
    """The first k sentences of each text with a word that begins so, accents left out; found in the row."""
    pattern = f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})"
    numbered = F.transform(segments(text), lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
    found = F.slice(F.filter(numbered, lambda x: T.unaccented(x["sentence"]).rlike(pattern)), 1, k)
    rows = df.select(key, F.posexplode(found).alias("i", "x"))
    return rows.select(key, "x.pos", (F.col("i") + 1).alias("place"), "x.sentence")


def genre_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """Genre words each text holds, and the genre with most; ties go to the first genre, none to 'general'."""
    low = T.unaccented(text)
    counts = {g: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) for g, ws in GENRES.items()}
    rows = df.select(key, *[c.alias(g) for g, c in counts.items()])
    most = F.greatest(*GENRES)
    genre = F.when(most == 0, "general")
    for g in GENRES:
        genre = genre.when(F.col(g) == most, g)
    return rows.withColumn("genre", genre)


def keywords(df: DataFrame, group: str, text: str, synonyms: dict[str, list[str]], k: int = 20) -> DataFrame:
    """The k most frequent long words of each group, variants counted under their canonical word."""
    variants = {v: c for c, vs in synonyms.items() for v in vs}
    rows = df.select(group, F.explode(F.filter(T.words(T.casefold(text)), lambda w: F.length(w) >= 5)).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    if variants:
        of = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
        rows = rows.withColumn("word", F.coalesce(of[F.col("word")], F.col("word")))
    each = rows.groupBy(group, "word").agg(F.sum("n").alias("times"))
    w = Window.partitionBy(group).orderBy(F.col("times").desc(), "word")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
