"""Order-dependent packing of units into batches of bounded size.

Rows of a group stand next to each other in their task and are read as a stream; the state is one size, one number and, for the
two-level rule, the open chunk. No group is collected, and only ids and sizes move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_CHARS = 32_000


class Packer:
    """One rule: 'simple' breaks before what no longer fits; 'oversize' lets a unit over the limit join and then breaks;
    'paged' breaks only where the page changes; 'two_level' packs chunks of chapters."""

    def __init__(self, rule: str, limit: int) -> None:
        self.rule, self.limit = rule, limit

    def start(self) -> None:
        self.size, self.batch, self.open, self.page = 0, 1, False, None
        self.chapter: object = None
        self.chunk_size = 0

    def add(self, n: int, page: object, chapter: object) -> int:
        """Batch of the next unit, for the rules that know it at once."""
        rule, limit = self.rule, self.limit
        if rule == "simple":
            if self.open and self.size + n > limit:
                self.batch, self.size, self.open = self.batch + 1, 0, False
        elif rule == "oversize":
            if self.open and self.size + n > limit and n <= limit:
                self.batch, self.size, self.open = self.batch + 1, 0, False
        elif self.open and self.size + n > limit and self.page is not None and page != self.page:
            self.batch, self.size, self.open = self.batch + 1, 0, False
        self.size, self.open, self.page = self.size + n, True, page
        at = self.batch
        if rule == "oversize" and self.size > limit:
            self.batch, self.size, self.open = self.batch + 1, 0, False
        return at

    def close_chunk(self) -> int:
        """Places the open chunk; its batch."""
        if self.open and self.size + self.chunk_size > self.limit:
            self.batch, self.size = self.batch + 1, 0
        self.size, self.open = self.size + self.chunk_size, True
        self.chunk_size = 0
        return self.batch


def pack(df: DataFrame, keys: list[str], order: str, size: str, rule: str, limit: int = MAX_CHARS, page: str | None = None, chapter: str | None = None) -> DataFrame:
    """df with batch_no from 1 within keys. Null sizes count as 0."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", batch_no int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, current = Packer(rule, limit), None
        held: list[pd.DataFrame] = []  # two_level: rows of the open chunk, from the batches before
        for batch in batches:
            sizes = batch[size].fillna(0).astype("int64").tolist()
            groups = list(zip(*[batch[k].tolist() for k in keys]))
            pages = batch[page].tolist() if page else [None] * len(batch)
            chapters = batch[chapter].tolist() if chapter else [None] * len(batch)
            if rule != "two_level":
                out = []
                for key, n, p, c in zip(groups, sizes, pages, chapters):
                    if key != current:
                        packer.start()
                        current = key
                    out.append(packer.add(n, p, c))
                yield batch.assign(batch_no=pd.Series(out, dtype="int32", index=batch.index))
                continue
            # rows from begin on, and those held, are of the open chunk, whose batch is known when it closes
            numbers, begin = np.zeros(len(batch), dtype=np.int32), 0
            for i, (key, n, c) in enumerate(zip(groups, sizes, chapters)):
                fresh, some = key != current, bool(held) or i > begin
                if fresh or c != packer.chapter or packer.chunk_size + n > limit and some:
                    if some:
                        at = packer.close_chunk()
                        numbers[begin:i] = at
                        yield from (h.assign(batch_no=np.int32(at)) for h in held)
                    held, begin = [], i
                    if fresh:
                        packer.start()
                        current = key
                    packer.chapter, packer.chunk_size = c, 0
                packer.chunk_size += n
            if begin:
                yield batch.iloc[:begin].assign(batch_no=numbers[:begin])
            held.append(batch.iloc[begin:])
        if held:
            at = packer.close_chunk()
            yield from (h.assign(batch_no=np.int32(at)) for h in held)

    return rows.mapInPandas(run, schema)
