"""Queries of pages read as units and chapters, and of text functions that have no other query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import html
from ..sources import table
from .registry import _BARE, documents, pairs, query


def _keep_pages(spark, sf_dir):
    return table(spark, sf_dir, "keep_jobs", "job_id", "source").where("source is not null")


@query()
def html_units(spark, sf_dir):
    """Units of the pages of rewrite jobs. Copies of a re-delivered page give the same units and fall together by their numbers."""
    rows = html.extract_units(_keep_pages(spark, sf_dir), "job_id", "source").dropDuplicates(["job_id", "unit_no"])
    return rows.select("job_id", "unit_no", "unit_id", "kind", "text", "anchor", "chapter_id", "word_count")


@query()
def html_chapters(spark, sf_dir):
    rows = html.extract_units(_keep_pages(spark, sf_dir), "job_id", "source").dropDuplicates(["job_id", "unit_no"])
    return html.extract_chapters(rows, "job_id").select("job_id", "chapter_no", "chapter_id", "chapter_title", "words", "prose_words", "units", "reason", "included")


@query(f"SELECT doc_id, md5({_BARE.format('text')}) AS bare FROM documents")
def unaccented_text(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.md5(T.unaccented("text")).alias("bare"))


@query()
def matching_blocks(spark, sf_dir):
    """Equal stretches of neighbours' lines, the longest first within what is left on either side, line by line of the same place."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), T.compact), lambda x: x != "")
    both = pairs(spark, sf_dir).select("id_a", "id_b", F.posexplode(F.arrays_zip(lines("text_a").alias("a"), lines("text_b").alias("b"))).alias("place", "l")).where("l.a is not null and l.b is not null")
    return both.select("id_a", "id_b", "place", F.size(U.matching_blocks(F.col("l.a"), F.col("l.b"))).alias("blocks"))
