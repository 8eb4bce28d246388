"""Alignment of two token or block sequences; sequential by nature, so one pair per function call in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs of leaving a block out, of each further block in a split and in a merge; most blocks that go together.
SKIP, SPLIT, MERGE, GROUP = 1.5, 0.15, 0.6, 4


def first_mismatch(a: Sequence[str], b: Sequence[str], joins: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """Places of the first tokens that differ; two tokens of one side may stand for one of the other if their join is known."""
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i + 1 < len(a) and a[i] + a[i + 1] == b[j] and b[j] in joins:
            i, j = i + 2, j + 1
        elif j + 1 < len(b) and b[j] + b[j + 1] == a[i] and a[i] in joins:
            i, j = i + 1, j + 2
        else:
            return i, j
    return None if i == len(a) and j == len(b) else (i, j)


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Blocks given by their counts of sentences: steps (from a, how many, from b, how many) of least cost. A match costs the difference
    of the counts; one block of a may stand for up to GROUP of b (a split) and the other way round (a merge); a block left out costs
    SKIP. Ties go to the match, then to fewer blocks.

    Rows of the table are made one after another with all columns at once, and what a cell came from is kept in one byte, so that
    long texts cost time and a byte a cell."""
    n, m = len(a), len(b)
    left, right = np.concatenate(([0], np.cumsum(np.asarray(a, dtype=np.float64)))), np.concatenate(([0], np.cumsum(np.asarray(b, dtype=np.float64))))
    steps = [(1, 1, 0.0), *((1, k, SPLIT * (k - 1)) for k in range(2, GROUP + 1)), *((k, 1, MERGE * (k - 1)) for k in range(2, GROUP + 1)), (1, 0, SKIP), (0, 1, SKIP)]
    rows: list[np.ndarray] = []
    came = np.zeros((n + 1, m + 1), dtype=np.int8)
    for i in range(n + 1):
        best = np.full(m + 1, np.inf)
        if i == 0:
            best[0] = 0.0
        for s, (x, y, cost) in enumerate(steps[:-1]):
            if x > i or y > m:
                continue
            before = rows[i - x][: m + 1 - y] + cost
            if y:
                before = before + np.abs((left[i] - left[i - x]) - (right[y:] - right[: m + 1 - y]))
            better = before < best[y:] - 1e-12
            best[y:][better] = before[better]
            came[i, y:][better] = s
        # blocks of b left out run along the row: cell j is the least of cell k + SKIP * (j - k)
        ramp = SKIP * np.arange(m + 1)
        least = np.minimum.accumulate(best - ramp)
        skipped = np.concatenate(([False], least[:-1] + ramp[1:] < best[1:] - 1e-12))
        best[skipped] = (least + ramp)[skipped]
        came[i][skipped] = len(steps) - 1
        rows.append(best)
        if i >= GROUP:
            rows[i - GROUP] = rows[i - GROUP][:0]
    out = []
    i, j = n, m
    while i or j:
        x, y, _ = steps[came[i, j]] if i else (0, 1, SKIP)
        i, j = i - x, j - y
        out.append((i, x, j, y))
    return out[::-1]


def mismatch_at(a: Column, b: Column) -> Column:
    """STRUCT<a, b> of the first mismatch of two token arrays, null if there is none."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            out = [None if x is None or y is None else first_mismatch(list(x), list(y)) for x, y in zip(left, right)]
            yield pd.DataFrame({"a": pd.array([m[0] if m else None for m in out], dtype="Int32"), "b": pd.array([m[1] if m else None for m in out], dtype="Int32")})

    return F.pandas_udf(run, "struct<a:int,b:int>")(a, b)


def aligned(a: Column, b: Column) -> Column:
    """Steps of the alignment of two arrays of lengths."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else [dict(zip(("a", "n_a", "b", "n_b"), s)) for s in align(list(x), list(y))] for x, y in zip(left, right)], dtype=object)

    return F.pandas_udf(run, "array<struct<a:int,n_a:int,b:int,n_b:int>>")(a, b)


def interleavings(columns: Sequence[Sequence[str]], target: Sequence[str], most: int = 2) -> int:
    """In how many ways the columns, each in its order, make up the target; numbers from most on count as most.

    Walks the target once with the reachable states, how far each column has been read, and the number of ways to each; states that
    meet are added up, so nothing is tried twice and no stack grows with the text."""
    if sum(map(len, columns)) != len(target):
        return 0
    states: dict[tuple[int, ...], int] = {(0,) * len(columns): 1}
    for token in target:
        after: dict[tuple[int, ...], int] = {}
        for state, ways in states.items():
            for c, read in enumerate(state):
                if columns[c][read : read + 1] == [token]:
                    to = state[:c] + (read + 1,) + state[c + 1 :]
                    after[to] = min(most, after.get(to, 0) + ways)
        states = after
    return sum(states.values())


def interleaved(columns: Column, target: Column) -> Column:
    """0, 1 or 2 (more than one way) for an array of token arrays and the tokens of a text."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for many, one in batches:
            yield pd.Series([None if x is None or y is None else interleavings([list(c) for c in x], list(y)) for x, y in zip(many, one)], dtype="Int32")

    return F.pandas_udf(run, "int")(columns, target)


def restoration(source: Sequence[str], target: Sequence[str], context: int = 6, window: int = 32) -> list[tuple[int, str, str]]:
    """Edits (place in target, old, new) that give target source's punctuation: '' inserts or deletes. Words that differ end a stretch;
    it goes on where the next context words stand once within window tokens on both sides."""
    word = lambda t: any(map(str.isalnum, t))
    out: list[tuple[int, str, str]] = []
    i = j = 0
    while i < len(source) and j < len(target):
        a, b = source[i], target[j]
        if a == b:
            i, j = i + 1, j + 1
        elif not word(a) and not word(b):
            out.append((j, b, a))
            i, j = i + 1, j + 1
        elif not word(a):
            out.append((j, "", a))
            i += 1
        elif not word(b):
            out.append((j, b, ""))
            j += 1
        else:
            grams = lambda s, k: [tuple(x for x in s[p : p + 2 * context] if word(x))[:context] for p in range(k, min(len(s), k + window))]
            left, right = grams(source, i), grams(target, j)
            both = [(p + q, p, q) for p, g in enumerate(left) if len(g) == context and left.count(g) == 1 and right.count(g) == 1 and word(source[i + p]) for q in [right.index(g)] if word(target[j + q])]
            if not both:
                break
            _, p, q = min(both)
            i, j = i + p, j + q
    return out
