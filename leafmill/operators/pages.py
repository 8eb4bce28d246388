"""HTML pages by expressions: what can be told from the tags' text without building a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "pre", "table", "section", "img", "nav", "script")


def page_language(c: Column | str) -> Column:
    """lang attribute of the html element; null if there is none or it is empty."""
    tag = F.regexp_extract(T.column(c), "(?i)<html([^>]*)>", 1)
    lang = F.regexp_extract(tag, "(?i)\\slang\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    return F.when(lang != "", lang)


def page_title(c: Column | str) -> Column:
    title = T.compact(F.regexp_extract(T.column(c), "(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title)


def tag_counts(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """How often each tag opens, one column per tag."""
    return df.select(*keys, *[F.regexp_count(F.lower(html), F.lit(f"<{t}[\\s>/]")).alias(f"n_{t}") for t in TAGS])


def references(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Distinct targets of src and href, and whether they are remote, in the page or local."""
    found = F.array_distinct(F.regexp_extract_all(T.column(html), F.lit("(?i)\\s(?:src|href)\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1)))
    rows = df.select(*keys, F.explode(found).alias("target"))
    kind = F.when(F.col("target").rlike("(?i)^(?:[a-z][a-z0-9+.-]*:)?//|^(?:https?|mailto|data):"), "remote").when(F.col("target").startswith("#"), "anchor").otherwise("local")
    return rows.withColumn("kind", kind)


def marks(c: Column | str, kind: str) -> Column:
    """Sorted ids of the placeholder marks of one kind in a unit."""
    return F.array_sort(F.regexp_extract_all(T.column(c), F.lit(f"⟦{kind}:(T\\d+)⟧"), F.lit(1)))


def patch_once(c: Column | str, old: str, new: str) -> Column:
    """The text with old replaced, if old stands in it exactly once; else null."""
    text = T.column(c)
    times = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.when(times == 1, F.replace(text, F.lit(old), F.lit(new)))
