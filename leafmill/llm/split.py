"""Problem 5: cut items over a size limit at natural boundaries, with an overlap.

Structure-tree packing: marks, tags and references are found first, then a text is read as a tree: sections nested by the rank of
their headings, blocks, lists nested by depth, lines, sentences, clauses, words, characters. Sibling subtrees are merged bottom-up
while they fit; only a node that does not fit is opened. No boundary lies inside a mark, tag or reference that fits.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import table

#: Headings by rank: Markdown, wiki, HTML and LaTeX.
_HEADING = re.compile(r"^(?P<hash>#{1,6})[ \t]|^(?P<wiki>={2,6})[^=\n]|<h(?P<html>[1-6])\b|^[ \t]*\\(?P<tex>part|chapter|(?:sub){0,2}section|paragraph)\b", re.M | re.I)
_TEX = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
#: List items, and the tags that nest them.
_ITEM = re.compile(r"^(?P<indent>[ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+(?=\S)|<(?P<close>/?)(?P<tag>ul|ol|li)\b", re.M | re.I)
#: Boundaries below sections, from coarse to fine: a piece may end where the pattern ends. Lists are opened between the first two.
_LEVELS = [
    re.compile(r"\n\s*\n|</(?:p|div|section|ul|ol|table|pre|h[1-6])\s*>", re.I),
    re.compile(r"\n|</li\s*>|<br\s*/?>", re.I),
    re.compile(r"(?:(?<![\s.][^\W\d_])(?<!\b[^\W\d_]{2})[.!?…]+[\"'”’»)\]]*(?:⟦[^⟧]*⟧)*\s+|[。！？।؟]+[”’」』）]*\s*)"),
    re.compile(r"[,;:—，、；：،]\s*"),
    re.compile(r"\s+"),
]
_MARK = re.compile(r"⟦[^⟦⟧]*⟧|&#?\w+;|<[A-Za-z/!][^<>]*>")
SECTIONS, LISTS = "sections", "lists"
_KINDS = (SECTIONS, _LEVELS[0], LISTS, *_LEVELS[1:])


class _Text:
    """A text with its headings and items by place and depth, and the spans that stay whole."""

    def __init__(self, text: str, limit: int, overlap: int) -> None:
        self.text, self.limit, self.room = text, limit, limit - overlap
        room = self.room
        spans = [m.span() for m in _MARK.finditer(text)]
        self.marks = [(a, b) for a, b in spans if b - a <= room]
        self.opens = [a for a, _ in self.marks]
        self.headings: list[tuple[int, int]] = []
        for m in _HEADING.finditer(text):
            rank = len(m["hash"] or m["wiki"] or "") or (int(m["html"]) if m["html"] else _TEX[m["tex"].lower()])
            self.headings.append((m.start(), rank))
        self.items: list[tuple[int, int]] = []
        #: Ends of lists within lists, which end no block.
        self.inner: set[int] = set()
        depth = 0
        for m in _ITEM.finditer(text):
            tag = (m["tag"] or "").lower()
            if tag in ("ul", "ol"):
                depth = max(0, depth - 1) if m["close"] else depth + 1
                if m["close"] and depth:
                    self.inner.add(text.find(">", m.end()) + 1)
            elif tag == "li":
                if not m["close"]:
                    self.items.append((m.start(), 1000 * depth))
            else:
                self.items.append((m.start(), 1000 * depth + len(m["indent"].expandtabs(4))))

    def inside(self, at: int) -> bool:
        """Whether a place lies within a mark, tag or reference that is to stay whole."""
        k = bisect_left(self.opens, at) - 1
        return k >= 0 and at < self.marks[k][1]

    def cuts(self, start: int, end: int, kind: object) -> list[int]:
        """Places where the children of [start, end) of a kind begin, but for the first."""
        if kind is SECTIONS or kind is LISTS:
            places = self.headings if kind is SECTIONS else self.items
            own = places[bisect_right(places, (start, 1 << 30)) : bisect_left(places, (end, -1))]
            top = min((depth for _, depth in own), default=0)
            found = [at for at, depth in own if depth == top]
        else:
            found = [m.end() for m in kind.finditer(self.text, start, end) if start < m.end() < end]
        return [at for at in found if at not in self.inner and not self.inside(at)]

    def left(self, start: int) -> int:
        """Characters a tile that begins here may have: the first carries no overlap."""
        return self.room if start else self.limit

    def pack(self, start: int, end: int, level: int = 0) -> list[tuple[int, int]]:
        """Tiles of [start, end), subtrees that fit."""
        if end - start <= self.left(start):
            return [(start, end)]
        if level == len(_KINDS):
            return self.characters(start, end)
        kind = _KINDS[level]
        cuts = self.cuts(start, end, kind)
        if not cuts:
            return self.pack(start, end, level + 1)
        out: list[tuple[int, int]] = []
        edges = [start, *cuts, end]
        for a, b in zip(edges, edges[1:]):
            if out and b - out[-1][0] <= self.left(out[-1][0]):
                out[-1] = (out[-1][0], b)  # merge siblings
            elif b - a <= self.left(a):
                out.append((a, b))
            else:
                # sections and lists hold further ones; the first child has none at this depth
                inner = self.pack(a, b, level if kind in (SECTIONS, LISTS) and self.cuts(a, b, kind) else level + 1)
                if kind is not SECTIONS and out and inner[0][1] - out[-1][0] <= self.left(out[-1][0]):
                    out[-1] = (out[-1][0], inner[0][1])
                    inner = inner[1:]
                out.extend(inner)
        return out

    def characters(self, start: int, end: int) -> list[tuple[int, int]]:
        """Runs of as many characters as fit; a mark, and a base with its combining marks, stay whole if they fit."""
        text, out = self.text, []
        while end - start > self.left(start):
            cut = start + self.left(start)
            if self.inside(cut) and (a := self.marks[bisect_left(self.opens, cut) - 1][0]) > start:
                cut = a
            else:
                back = cut
                while back > start and (unicodedata.combining(text[back]) or text[back] in "\u200d\ufe0f" or text[back - 1] == "\u200d"):
                    back -= 1
                cut = back if back > start else cut
            out.append((start, cut))
            start = cut
        return [*out, (start, end)]


def pieces(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """Spans [start, end) in code points, each at most limit long; each but the first begins exactly overlap before the last end.

    Null text gives no piece, a null or non-positive limit one whole piece. A negative or null overlap counts as 0, one of
    limit or more as limit - 1.
    """
    if text is None:
        return []
    n = len(text)
    if limit is None or limit <= 0 or n <= limit:
        return [(0, n)]
    limit = int(limit)
    overlap = min(max(int(overlap or 0), 0), limit - 1)
    tiles = _Text(text, limit, overlap).pack(0, n)
    # the first piece must be at least as long as the overlap it passes on; what it takes for that fits, as it has no overlap itself
    first = 0
    while tiles[first][1] < overlap:
        first += 1
    tiles = [(0, tiles[first][1]), *tiles[first + 1 :]]
    return [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(tiles)]


def split_items(df: DataFrame, text: str, limit: str, overlap: str, out: str = "pieces") -> DataFrame:
    """Adds out: ARRAY<STRUCT<start INT, end INT>>, the pieces' spans. An item within its limit never leaves the JVM's side
    path: it gets one span by expression, so only oversized texts reach Python.

    Null text: empty array. Empty text, a null limit: one span. Further columns pass through unread, whatever their names.
    """

    def spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, limits, overlaps in batches:
            yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in pieces(t, None if pd.isna(m) else int(m), None if pd.isna(o) else int(o))] for t, m, o in zip(texts, limits, overlaps)], dtype=object)

    udf = F.pandas_udf(spans, "array<struct<start:int,end:int>>").asNondeterministic()
    size = F.length(text)
    over = (F.col(limit) > 0) & (size > F.col(limit))
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
    cut = udf(F.when(over, F.col(text)), F.col(limit).cast("int"), F.col(overlap).cast("int"))
    return df.withColumn(out, F.when(F.col(text).isNull(), F.array().cast("array<struct<start:int,end:int>>")).when(over, cut).otherwise(whole))


def unit_pieces(spark, sf_dir: str) -> DataFrame:
    """Oversized units of keep and ar jobs with the spans of their pieces.

    Ids and limits first: a unit no longer than the smallest limit of all jobs can't be oversized and isn't shuffled.
    """
    limits = None
    for kind in ("keep", "ar"):
        jobs = table(spark, sf_dir, f"{kind}_jobs", F.lit(kind).alias("job_kind"), "job_id", F.col("prepared.batchMaximumChars").alias("max_chars"))
        limits = jobs if limits is None else limits.unionByName(jobs)
    limits = limits.groupBy("job_kind", "job_id").agg(F.max("max_chars").alias("max_chars")).where("max_chars > 0")
    smallest = limits.agg(F.min("max_chars")).first()[0]
    units = table(spark, sf_dir, "job_units", "unit_key", "job_kind", "job_id", "source")
    units = units.where(F.length("source") > F.lit(smallest))
    settings = table(spark, sf_dir, "split_settings")
    over = units.join(limits, ["job_kind", "job_id"]).where(F.length("source") > F.col("max_chars")).dropDuplicates(["unit_key"]).join(settings, "job_kind", "left")
    return split_items(over, "source", "max_chars", "overlap_chars")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Units that came out in more than one piece."""
    return unit_pieces(spark, sf_dir).where(F.size("pieces") > 1).select("unit_key").distinct()


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    """Every piece of every oversized unit: the pieces without their overlaps joined give the unit back."""
    cut = unit_pieces(spark, sf_dir).select("unit_key", "source", "overlap_chars", F.posexplode("pieces").alias("piece_no", "span"))
    return cut.select("unit_key", (F.col("piece_no") + 1).alias("piece_no"), F.col("span.start").alias("start_pos"), F.col("span.end").alias("end_pos"), F.expr("substring(source, span.start + 1, span.end - span.start)").alias("piece"))


def p5_whole(spark, sf_dir: str) -> DataFrame:
    """Of every oversized unit its characters, whether all pieces are within the limit, and whether they make it up with the overlaps
    exactly as set."""
    cut = unit_pieces(spark, sf_dir).withColumn("_over", F.least(F.coalesce("overlap_chars", F.lit(0)), F.col("max_chars") - 1))
    sizes = F.aggregate("pieces", F.lit(0), lambda total, p: total + p["end"] - p["start"])
    steps = F.forall(F.arrays_zip(F.slice("pieces", 1, F.size("pieces") - 1).alias("a"), F.slice("pieces", 2, F.size("pieces")).alias("b")), lambda x: x["b"]["start"] == x["a"]["end"] - F.col("_over"))
    whole = (sizes - F.col("_over") * (F.size("pieces") - 1) == F.length("source")) & steps
    return cut.select("unit_key", F.length("source").alias("characters"), F.forall("pieces", lambda p: p["end"] - p["start"] <= F.col("max_chars")).alias("fits"), whole.alias("whole"))
