"""Units of texts and jobs, chapters over them and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import deduplicate, table
from .windows import running_sum

#: Titles of chapters that are no content, beginnings or ends of titles of bibliographies, what legal matter says.
CONTENTS = ("contenido", "contents", "cuprins", "indice", "inhaltsverzeichnis", "sommaire", "table des matières", "table of contents", "índice")
BIBLIOGRAPHY = (
    "bibliografia", "bibliografie", "bibliografía", "bibliographie", "bibliography", "literaturverzeichnis", "quellen", "references", "referencias", "referinte", "referințe", "riferimenti", "références", "sources", "works cited",
)
LEGAL = "(?i)(?:©|copyright|all rights reserved|toate drepturile rezervate|todos los derechos reservados|tutti i diritti riservati|alle rechte vorbehalten|isbn(?![a-z0-9_]))"
#: Headings whose text is left out up to the next heading.
SKIPPED = ("bibliography", "references", "bibliografie", "referințe", "cuprins", "contents", "table of contents")


def document_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line: key, line_no from 1, unit_id, unit_text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "unit_text"))
    lines = lines.withColumn("unit_text", T.compact("unit_text")).where("unit_text <> ''")
    return lines.select(key, (F.col("line_no") + 1).alias("line_no"), F.concat(F.lit("u"), F.lpad((F.col("line_no") + 1).cast("string"), 6, "0")).alias("unit_id"), "unit_text")


def job_units(spark, sf_dir: str, *columns: str) -> DataFrame:
    """Units of keep and ar jobs, each once."""
    need = list(dict.fromkeys(["unit_key", "job_kind", "job_id", "unit_no", *columns, "received_at"]))
    return deduplicate(table(spark, sf_dir, "job_units", *need), ["unit_key"]).drop("received_at")


def assign_chapters(units: DataFrame) -> DataFrame:
    """chapter: how many h1 units came so far in the job; 0 is what stands before the first."""
    return running_sum(units, ["job_kind", "job_id"], "unit_no", F.when(F.col("kind") == "h1", 1).otherwise(0), "chapter")


def exclusion(title: Column, front: Column, words: Column, prose: Column, legal: Column) -> Column:
    """Why a chapter is left out; null for one that is content. front: it is what stands before the first chapter."""
    key = T.heading_key(F.coalesce(title, F.lit("")))
    bibliography = F.lit(False)
    for p in BIBLIOGRAPHY:
        bibliography = bibliography | (key == p) | key.startswith(p + " ") | key.endswith(" " + p)
    return (
        F.when(key.isin(*CONTENTS), "contents")
        .when(bibliography, "bibliography")
        .when(~front & (prose < 40) & (words < 80), "structural-or-title-page")
        .when(front & (prose < 80), "structural-front-matter")
        .when(legal, "legal-or-metadata")
    )


def chapter_table(units: DataFrame) -> DataFrame:
    """Per chapter: title, words, prose words, whether all units are legal matter, and why it is left out, if it is."""
    rows = units.select("job_kind", "job_id", "chapter", "unit_no", "kind", "plain_text", T.word_count("plain_text").alias("words"))
    out = rows.groupBy("job_kind", "job_id", "chapter").agg(
        F.min_by(F.when(F.col("kind") == "h1", F.col("plain_text")), F.col("unit_no")).alias("title"),
        F.sum("words").alias("words"),
        F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("words"))), F.lit(0)).alias("prose_words"),
        F.count("*").alias("units"),
        F.bool_and(F.col("plain_text").rlike(LEGAL)).alias("legal"),
    )
    reason = exclusion(F.col("title"), F.col("chapter") == 0, F.col("words"), F.col("prose_words"), F.col("legal"))
    return out.withColumn("reason", reason).withColumn("included", F.col("reason").isNull())


def bootstrap_pages(units: DataFrame) -> DataFrame:
    """Two pages of each job to begin with: the first with two paragraphs, 150 words of prose and two thirds prose; else the two
    with most prose."""
    rows = units.where("page is not null").select("job_kind", "job_id", "page", "unit_no", "kind", F.size(T.words("plain_text")).alias("words"))
    pages = rows.groupBy("job_kind", "job_id", "page").agg(F.min("unit_no").alias("first_unit"), F.count_if(F.col("kind") == "p").alias("paragraphs"), F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("words"))), F.lit(0)).alias("prose"), F.sum("words").alias("total"))
    good = (F.col("paragraphs") >= 2) & (F.col("prose") >= 150) & (F.col("prose") >= 0.65 * F.col("total"))
    job = Window.partitionBy("job_kind", "job_id")
    pages = pages.withColumn("good", good).withColumn("any_good", F.max("good").over(job))
    place = F.when(F.col("any_good"), F.row_number().over(job.orderBy(F.col("good").desc(), "first_unit"))).otherwise(F.row_number().over(job.orderBy(F.col("prose").desc(), F.col("page").desc())))
    return pages.withColumn("place", place).where((F.col("place") <= 2) & (~F.col("any_good") | F.col("good"))).select("job_kind", "job_id", "page", "place", "prose")


def quartile_samples(units: DataFrame) -> DataFrame:
    """The first 1,200 characters of the paragraphs a quarter, half and all but one through each job."""
    rows = units.where("kind = 'p'").select("unit_key", "job_kind", "job_id", "unit_no")
    counts = rows.groupBy("job_kind", "job_id").agg(F.count("*").alias("n"))
    rows = running_sum(rows, ["job_kind", "job_id"], "unit_no", F.lit(1), "i").withColumn("i", F.col("i") - 1).join(counts, ["job_kind", "job_id"])
    at = (F.col("i") == F.floor(F.col("n") / 4)) | (F.col("i") == F.floor(F.col("n") / 2)) | (F.col("i") == F.greatest(F.lit(0), F.col("n") - 2))
    chosen = rows.where(at).select("unit_key", F.col("i").alias("position"))
    return units.select("unit_key", "plain_text").join(chosen, "unit_key").select("unit_key", "position", F.substring("plain_text", 1, 1200).alias("sample"))
