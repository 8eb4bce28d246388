"""Words on pages: lines, running matter, hyphenation, spacing and typography, from positions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import deduplicate, table
from .windows import islands

LINE = ["evidence_id", "page_number", "line_no"]


def page_words(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Words of pages, each once."""
    need = list(dict.fromkeys(["word_id", *columns, "received_at"]))
    return deduplicate(table(spark, sf_dir, "evidence_words", *need), ["word_id"]).drop("received_at")


def page_lines(words: DataFrame) -> DataFrame:
    """Lines in reading order; a line is bounded by its page's width, so it is joined in one row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*LINE).agg(joined.alias("line_text"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("size_pt").alias("size_pt"))


def running_matter(lines: DataFrame, least: int = 3) -> DataFrame:
    """First lines of pages that stand on three pages or more of a file."""
    first = lines.groupBy("evidence_id", "page_number").agg(F.min_by("line_text", "line_no").alias("line_text"))
    found = first.groupBy("evidence_id", T.compact("line_text").alias("running_text")).agg(F.count("*").alias("pages"))
    return found.where((F.col("pages") >= least) & (F.col("running_text") != ""))


def running_keys(lines: DataFrame, least: int = 3) -> DataFrame:
    """Keys of first and last lines that stand, whatever their page numbers, on three pages or more of a file."""
    ends = lines.groupBy("evidence_id", "page_number").agg(F.array(F.min_by("line_text", "line_no"), F.max_by("line_text", "line_no")).alias("ends"))
    keys = ends.select("evidence_id", "page_number", F.explode(F.array_distinct(F.transform("ends", T.running_key))).alias("key")).where("key <> ''")
    return keys.groupBy("evidence_id", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def hyphen_candidates(lines: DataFrame) -> DataFrame:
    """Line ends with a hyphen and the next line of the page: the two halves and the word they would make."""
    w = Window.partitionBy("evidence_id", "page_number").orderBy("line_no")
    rows = lines.select(*LINE, "line_text", F.lead("line_text").over(w).alias("next_text"))
    head, tail = F.regexp_extract("line_text", "(\\p{L}+)[-‐]$", 1), F.regexp_extract("next_text", "^(\\p{L}+)", 1)
    return rows.select(*LINE, head.alias("head"), tail.alias("tail")).where("head <> '' and tail <> ''").withColumn("joined", T.casefold(F.concat("head", "tail")))


def vocabulary(words: DataFrame) -> DataFrame:
    """Distinct case-folded words of letters, with how often and in how many files they stand."""
    rows = words.select("evidence_id", F.explode(T.words("text")).alias("w")).groupBy(T.casefold("w").alias("word"), "evidence_id").agg(F.count("*").alias("n"))
    return rows.groupBy("word").agg(F.sum("n").alias("times"), F.count("*").alias("files"))


def word_groups(words: DataFrame, gap: float = 6.0) -> DataFrame:
    """Groups of words on a line; a new one begins after a gap or where the weight or slant changes."""
    w = Window.partitionBy(*LINE).orderBy("word_no")
    rows = words.withColumn("_x1", F.lag("x1").over(w)).withColumn("_bold", F.lag("bold").over(w)).withColumn("_italic", F.lag("italic").over(w))
    begins = F.col("_x1").isNotNull() & ((F.col("x0") - F.col("_x1") > gap) | ~F.col("bold").eqNullSafe(F.col("_bold")) | ~F.col("italic").eqNullSafe(F.col("_italic")))
    return islands(rows, LINE, ["word_no"], begins, "group_no").drop("_x1", "_bold", "_italic")


def leading(lines: DataFrame) -> DataFrame:
    """Distance of each line to the one above on its page."""
    w = Window.partitionBy("evidence_id", "page_number").orderBy("line_no")
    return lines.select(*LINE, F.round(F.col("top") - F.lag("top").over(w), 3).alias("leading")).where("leading is not null")


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with how many rows are below and up to each: order statistics without sorting all rows of a group."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    each = each.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return each.withColumn("below", F.col("upto") - F.col("n"))


def at_index(ranked: DataFrame, keys: list[str], value: str, index, out: str) -> DataFrame:
    """The element at an index (an expression of total) of the group's sorted values."""
    return ranked.where((F.col("below") <= index) & (index < F.col("upto"))).select(*keys, F.col(value).alias(out))


def body_style(words: DataFrame) -> DataFrame:
    """Size and family that carry most characters of a file; ties go to the smaller size, then the family first in order."""
    each = words.groupBy("evidence_id", "size_pt", F.coalesce("font_family", F.lit("")).alias("family")).agg(F.sum(F.length("text")).alias("characters"))
    best = each.groupBy("evidence_id").agg(F.min_by(F.struct("size_pt", "family", "characters"), F.struct(-F.col("characters"), "size_pt", "family")).alias("b"))
    return best.select("evidence_id", "b.size_pt", "b.family", "b.characters")


def heading_levels(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Level of each line by its size against the body's: 1.8, 1.35 and 1.12 times or more."""
    rows = lines.join(body.select("evidence_id", F.col("size_pt").alias("body_pt")), "evidence_id")
    ratio = F.col("size_pt") / F.col("body_pt")
    return rows.withColumn("level", F.when(ratio >= 1.8, "h1").when(ratio >= 1.35, "h2").when(ratio >= 1.12, "h3").otherwise("p")).drop("body_pt")


def box_overlaps(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words whose box meets a line's box on their page other than their own line's: a join on page and band of height.

    Both sides are put in bands of 32 points, so only neighbours are compared; a pair that shares two bands counts once."""
    band = 32.0

    def banded(df: DataFrame) -> DataFrame:
        low, high = F.floor(F.col("top") / band), F.floor(F.col("bottom") / band)
        return df.withColumn("band", F.explode(F.sequence(low, F.greatest(low, high))))

    a = banded(words.select("word_id", "evidence_id", "page_number", "line_no", "top", "bottom", "x0", "x1")).alias("a")
    b = banded(lines.select("evidence_id", "page_number", F.col("line_no").alias("other_line"), "top", "bottom", "x0", "x1")).alias("b")
    meets = (F.col("a.line_no") != F.col("b.other_line")) & (F.col("a.top") < F.col("b.bottom")) & (F.col("b.top") < F.col("a.bottom")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    return a.join(b, ["evidence_id", "page_number", "band"]).where(meets).select("word_id", "other_line").distinct()


def grid_coverage(cells: DataFrame) -> DataFrame:
    """cells(table_id, row, col, rowspan, colspan) -> places of the grid covered never or more than once."""
    size = cells.groupBy("table_id").agg(F.max(F.col("row") + F.col("rowspan") - 1).alias("rows"), F.max(F.col("col") + F.col("colspan") - 1).alias("cols"))
    grid = size.select("table_id", F.explode(F.sequence(F.lit(1), "rows")).alias("r"), "cols").select("table_id", "r", F.explode(F.sequence(F.lit(1), "cols")).alias("c"))
    taken = cells.select("table_id", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("r"), "col", "colspan").select("table_id", "r", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("c"))
    counts = taken.groupBy("table_id", "r", "c").agg(F.count("*").alias("times"))
    return grid.join(counts, ["table_id", "r", "c"], "left").na.fill(0, ["times"]).where("times <> 1")
