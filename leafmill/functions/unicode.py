"""What Spark SQL has no function for: Unicode normal forms and sequence similarity, in Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(c: Column, form: str = "NFC") -> Column:
    """Null stays null; text already in the form is passed through."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t != t or t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))

    return F.pandas_udf(run, "string")(c)


def strip_accents(c: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t != t or t.isascii() else unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(x) != "Mn")))

    return F.pandas_udf(run, "string")(F.lower(c))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; null if either is null, 1 for two empty ones."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def matching_blocks(a: Column, b: Column) -> Column:
    """Longest matching blocks of two token arrays."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                if x is None or y is None:
                    out.append(None)
                    continue
                m = difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks()
                out.append([{"a": k.a, "b": k.b, "size": k.size} for k in m if k.size])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<a:int,b:int,size:int>>")(a, b)
