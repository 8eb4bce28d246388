"""Checks of structured results that other programs wrote, each giving findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding


def weighted_score(centrality: Column, recurrence: Column, originality: Column) -> Column:
    """A half, a quarter and a quarter."""
    return 0.5 * centrality + 0.25 * recurrence + 0.25 * originality


def score_findings(df: DataFrame, key: str, slack: float = 0.011) -> DataFrame:
    """Rows whose score isn't that of its parts within slack, or a part outside 0 to 1. Columns centrality, recurrence, originality,
    score; a null one is outside."""
    parts = [F.col(c) for c in ("centrality", "recurrence", "originality", "score")]
    outside = ~F.coalesce(parts[0].between(0, 1) & parts[1].between(0, 1) & parts[2].between(0, 1) & parts[3].between(0, 1), F.lit(False))
    off = F.abs(weighted_score(*parts[:3]) - parts[3]) > slack
    a = finding(df, outside, "error", "score-range", F.col(key), F.lit("a part or the score is not between 0 and 1"))
    return a.unionByName(finding(df, ~outside & off, "error", "score-sum", F.col(key), F.lit("the score is not that of its parts")))


def id_findings(df: DataFrame, key: str, cited: str, allowed: DataFrame, allowed_id: str, on: str | None = None) -> DataFrame:
    """Cited ids that no row of allowed has (in the same group on), and groups without any citation."""
    rows = df.select(key, *([on] if on else []), F.explode_outer(cited).alias("_id"))
    keys = [*([on] if on else []), "_id"]
    known = allowed.select(*([on] if on else []), F.col(allowed_id).alias("_id")).distinct()
    unknown = rows.where("_id is not null").join(known, keys, "left_anti")
    a = finding(unknown, F.lit(True), "error", "unknown-id", F.col(key), F.col("_id"))
    return a.unionByName(finding(df, F.coalesce(F.size(cited), F.lit(0)) <= 0, "error", "no-source", F.col(key), F.lit("cites nothing")))


def order_findings(df: DataFrame, key: str, got: str, want: str) -> DataFrame:
    """Rows whose list isn't the wanted one: other members, or the same in another order."""
    same = F.array_sort(got) == F.array_sort(want)
    a = finding(df, F.coalesce(~same, F.lit(True)), "error", "coverage", F.col(key), F.lit("not exactly the wanted members"))
    return a.unionByName(finding(df, F.coalesce(same & (F.col(got) != F.col(want)), F.lit(False)), "error", "order", F.col(key), F.lit("members out of order")))


def term_findings(df: DataFrame, group: str, term: str) -> DataFrame:
    """Keyword terms that are empty, hold a comma or line break, or repeat another of the group."""
    key = F.lower(F.regexp_replace(F.trim(term), "\\s+", " "))
    bad = F.coalesce(F.trim(term) == "", F.lit(True)) | F.col(term).rlike("[,\\r\\n]")
    repeated = df.where(~bad).groupBy(group, key.alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    return finding(df, bad, "error", "term-form", F.col(group), F.coalesce(F.col(term), F.lit(""))).unionByName(finding(repeated, F.lit(True), "error", "term-repeated", F.col(group), F.col("_key")))


def job_state(complete: Column, valid: Column, drafted: Column, built: Column) -> Column:
    """How far a job has come, from what is there."""
    return F.when(built, "built").when(drafted, "ready_to_build").when(valid & complete, "draft_required").when(complete, "synthesis_required").otherwise("analysis_required")
