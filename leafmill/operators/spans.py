"""Cutting and sharing out text for speech and for templates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"\S.*?(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|$)", re.S)


def draft_spans(text: str | None, most: int = 300) -> list[tuple[int, int]]:
    """Spans of sentences; one over most characters is cut at its last white space within them, or there if it has none."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        a, b = m.start(), m.start() + len(m[0].rstrip())
        while b - a > most:
            cut = next((i for i in range(a + most, a, -1) if text[i - 1].isspace()), a + most)
            end = cut
            while end > a and text[end - 1].isspace():
                end -= 1
            if end > a:
                out.append((a, end))
            a = cut
            while a < b and text[a].isspace():
                a += 1
        if b > a:
            out.append((a, b))
    return out


def distribute(sentences: Sequence[str], weights: Sequence[float]) -> list[list[str]]:
    """Sentences in order over slots, each slot's share rounded from its running weight; all go to one slot if weights are zero."""
    total = float(sum(weights))
    if not weights:
        return []
    if total <= 0:
        return [list(sentences), *([] for _ in weights[1:])]
    out, done, sofar = [], 0, 0.0
    for w in weights:
        sofar += w
        end = int(sofar / total * len(sentences) + 0.5)
        out.append(list(sentences[done:end]))
        done = max(done, end)
    return out


def spans(c: Column, most: int = 300) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in draft_spans(t, most)] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<start:int,end:int>>")(c)
