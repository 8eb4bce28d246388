"""The queries over the test tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import alignment, batching, findings, geometry, memory, pages, quality, ranking, timeline, units, windows
from ..sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Pieces of SQL that several queries share.
_UNITS = "u AS (SELECT DISTINCT unit_key, job_kind, job_id, unit_no, unit_id, kind, page, source, plain_text, reuse_of FROM job_units)"
_RUNS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '\p{{L}}+'))"
_FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"
_WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’\-][\p{{L}}\p{{N}}]+)*'))"
_SPACE = "[\t\n\x0b\f\r \xa0  -     　﻿]"
_COMPACT = f"regexp_replace(regexp_replace({{}}, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
_LINES = f"""lines AS (SELECT doc_id, i AS line_no, {_COMPACT.format('part')} AS unit_text FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS part FROM documents) WHERE {_COMPACT.format('part')} <> '')"""
_BARE = "regexp_replace(translate(lower({}), '" + T.accents()[0] + "', '" + T.accents()[1] + "'), '" + T.DIACRITICS + "', '', 'g')"
_PAIRS = """pairs AS (SELECT doc_id AS id_a, lead(doc_id) OVER (PARTITION BY book_id, chapter_no ORDER BY doc_id) AS id_b FROM documents),
  p AS (SELECT id_a, id_b, a.text AS text_a, b.text AS text_b FROM pairs JOIN documents a ON a.doc_id = id_a JOIN documents b ON b.doc_id = id_b)"""
_PAGE_LINES = """w AS (SELECT DISTINCT word_id, evidence_id, book_id, page_number, line_no, word_no, text, bold, italic, size_pt, x0, x1, top, bottom, font_family FROM evidence_words),
  l AS (SELECT evidence_id, page_number, line_no, string_agg(text, ' ' ORDER BY word_no) AS line_text, min(top) AS top, max(bottom) AS bottom, min(x0) AS x0, max(x1) AS x1, max(size_pt) AS size_pt FROM w GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def pairs(spark, sf_dir) -> DataFrame:
    return quality.neighbour_pairs(documents(spark, sf_dir, "doc_id", "book_id", "chapter_no", "text"), ["book_id", "chapter_no"], "doc_id", ["text"])


# scalar functions


@query(f"SELECT doc_id, {_WORDS.format('text')} AS words, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, length(text) AS characters FROM documents")
def doc_word_counts(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.word_count("text").alias("words"), T.letters("text").alias("letters"), F.length("text").alias("characters"))


@query(f"SELECT doc_id, len({_RUNS.format('text')}) AS words, len(list_distinct(list_transform({_RUNS.format('text')}, lambda w: {_FOLD.format('w')}))) AS distinct_words FROM documents")
def doc_plain_words(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", T.words("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct(F.transform("w", T.casefold))).alias("distinct_words"))


@query(f"SELECT word, count(*) AS times, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {_FOLD.format('unnest(' + _RUNS.format('text') + ')')} AS word FROM documents) GROUP BY word")
def word_frequencies(spark, sf_dir):
    """Every word with its times and documents: one shuffle by word, summed map-side; a document is one row."""
    words = T.words(T.casefold("text"))
    each = lambda w, times, docs: F.transform(w, lambda x: F.struct(x.alias("word"), F.lit(times).alias("times"), F.lit(docs).alias("docs")))
    both = F.flatten(F.transform(F.array(words), lambda w: F.concat(each(w, 1, 0), each(F.array_distinct(w), 0, 1))))
    return documents(spark, sf_dir, F.explode(both).alias("w")).groupBy("w.word").agg(F.sum("w.times").alias("times"), F.sum("w.docs").alias("docs"))


@query(r"""SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (
  SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).+?[.!?]+["''”’»)\]]*(?:\s|$)'), lambda x: """ + _COMPACT.format("x") + ") AS s FROM documents)")
def doc_sentences(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", T.sentences_closed("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query()
def sentence_style(spark, sf_dir):
    return quality.style(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS fingerprint, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE text IS NOT NULL")
def doc_fingerprints(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", F.sha2("text", 256).alias("fingerprint")).where("fingerprint is not null")
    return rows.join(rows.groupBy("fingerprint").agg(F.count("*").alias("copies")), "fingerprint").select("doc_id", "fingerprint", "copies")


@query()
def fact_tokens(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.explode(T.fact_tokens("text")).alias("fact"))


@query()
def fact_tokens_loose(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.explode(T.fact_tokens("text", loose=True)).alias("fact"))


@query(r"""WITH t AS (SELECT DISTINCT lang, replace(trim(lang), '_', '-') AS tag FROM documents WHERE lang IS NOT NULL)
  SELECT lang, CASE WHEN regexp_full_match(tag, '[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*') AND lower(tag) <> 'und' THEN array_to_string(list_transform(string_split(tag, '-'), lambda p, i:
    CASE WHEN i = 1 THEN lower(p) WHEN regexp_full_match(p, '[A-Za-z]{4}') THEN upper(p[1]) || lower(p[2:]) WHEN regexp_full_match(p, '[A-Za-z]{2}|[0-9]{3}') THEN upper(p) ELSE lower(p) END), '-') END AS tag,
    CASE WHEN regexp_full_match(trim(lang), '[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*') AND lower(trim(lang)) <> 'und' THEN true ELSE false END AS strict FROM t""")
def language_tags(spark, sf_dir):
    rows = documents(spark, sf_dir, "lang").where("lang is not null").distinct()
    return rows.select("lang", T.language_tag("lang").alias("tag"), T.language_tag("lang", underscores=False).isNotNull().alias("strict"))


@query(f"""WITH b AS (SELECT book_id, sum({_WORDS.format('text')}) AS words FROM documents GROUP BY book_id)
  SELECT book_id, words, CASE WHEN words <= 5000 THEN 275 WHEN words <= 20000 THEN 425 ELSE 600 END AS target, CASE WHEN words <= 5000 THEN 250 WHEN words <= 20000 THEN 375 ELSE 550 END AS least,
    CASE WHEN words <= 5000 THEN 300 WHEN words <= 20000 THEN 475 ELSE 650 END AS most FROM b""")
def book_budgets(spark, sf_dir):
    rows = documents(spark, sf_dir, "book_id", T.word_count("text").alias("n")).groupBy("book_id").agg(F.sum("n").alias("words")).withColumn("b", T.budget("words"))
    return rows.select("book_id", "words", "b.target", "b.least", "b.most")


@query("""SELECT chapter_no, CAST(round_even(chapter_no * 12.5, 0) AS INTEGER) AS target, CAST(floor(round_even(chapter_no * 12.5, 0) * CAST(0.9 AS DOUBLE)) AS INTEGER) AS least, CAST(ceil(round_even(chapter_no * 12.5, 0) * CAST(1.1 AS DOUBLE)) AS INTEGER) AS most
  FROM (SELECT DISTINCT chapter_no FROM documents WHERE chapter_no IS NOT NULL)""")
def word_targets(spark, sf_dir):
    rows = documents(spark, sf_dir, "chapter_no").where("chapter_no is not null").distinct().withColumn("t", T.word_target(F.col("chapter_no") / 16.0))
    return rows.select("chapter_no", "t.target", "t.least", "t.most")


@query(f"WITH {_LINES} SELECT doc_id, " + r"regexp_replace(regexp_replace(replace(replace(lower(unit_text), 'ß', 'ss'), 'ς', 'σ'), '^[ .:;—–-]+|[ .:;—–-]+$', '', 'g'), '^ | $', '', 'g') AS heading_key FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1")
def heading_keys(spark, sf_dir):
    first = units.document_lines(documents(spark, sf_dir, "doc_id", "text")).groupBy("doc_id").agg(F.min_by("unit_text", "line_no").alias("t"))
    return first.select("doc_id", T.heading_key("t").alias("heading_key"))


@query()
def marker_keys(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "kind", "plain_text").where(F.col("kind").rlike("^h[1-6]$"))
    return rows.select("unit_key", T.marker_key("plain_text").alias("marker")).where("marker is not null")


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents WHERE text IS NOT NULL")
def escaped_documents(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.sha2(T.escape_html("text"), 256).alias("escaped")).where("escaped is not null")


@query("SELECT event_id, floor(value * 10000 + 0.5) / 10000 AS half_up, CAST(floor(value * 48000 + 0.5) AS BIGINT) AS frames, greatest(1.0, least(1.2, value / 100)) AS clamped FROM events WHERE value IS NOT NULL")
def rounded_values(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events", "event_id", "value").where("value is not null").select("event_id", T.round_half_up(v, 4).alias("half_up"), timeline.frames(v).alias("frames"), F.greatest(F.lit(1.0), F.least(F.lit(1.2), v / 100)).alias("clamped"))


@query("SELECT DISTINCT job_id, regexp_extract(prepared.output, '/([a-z]{2})/[^/]*$', 1) AS folder_language FROM ar_jobs")
def path_languages(spark, sf_dir):
    return table(spark, sf_dir, "ar_jobs", "job_id", F.regexp_extract("prepared.output", "/([a-z]{2})/[^/]*$", 1).alias("folder_language")).distinct()


@query(r"""SELECT DISTINCT font_name, CASE WHEN regexp_matches(font_name, '(?i)bold|black|heavy') AND regexp_matches(font_name, '(?i)italic|oblique') THEN 'bold-italic' WHEN regexp_matches(font_name, '(?i)bold|black|heavy') THEN 'bold'
  WHEN regexp_matches(font_name, '(?i)italic|oblique') THEN 'italic' ELSE 'regular' END AS style,
  regexp_replace(lower(regexp_replace(regexp_replace(font_name, '^[A-Z]{6}\+', ''), '(?i)[-, ]*(?:bold|italic|oblique|regular|medium|light|semibold|black|roman)+$', '')), '[^a-z0-9]+', '', 'g') AS family FROM evidence_words WHERE font_name IS NOT NULL""")
def font_styles(spark, sf_dir):
    rows = table(spark, sf_dir, "evidence_words", "font_name").where("font_name is not null").distinct()
    return rows.select("font_name", T.font_style("font_name").alias("style"), T.family_key("font_name").alias("family"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS composed FROM documents WHERE text IS NOT NULL")
def composed_text(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", F.sha2(U.normal_form(F.col("text"), "NFC"), 256).alias("composed")).where("composed is not null")


# units, chapters, selection


@query(f"WITH {_LINES} SELECT doc_id, line_no, 'u' || lpad(CAST(line_no AS VARCHAR), 6, '0') AS unit_id, length(unit_text) AS characters FROM lines")
def document_units(spark, sf_dir):
    rows = units.document_lines(documents(spark, sf_dir, "doc_id", "text"))
    return rows.select("doc_id", "line_no", "unit_id", F.length("unit_text").alias("characters"))


@query(f"WITH {_UNITS} SELECT unit_key, CAST(sum(CASE WHEN kind = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS BIGINT) AS chapter FROM u")
def chapter_assignment(spark, sf_dir):
    return units.assign_chapters(units.job_units(spark, sf_dir, "kind")).select("unit_key", "chapter")


_BIBLIOGRAPHY = "bibliografia|bibliografie|bibliografía|bibliographie|bibliography|literaturverzeichnis|quellen|references|referencias|referinte|referințe|riferimenti|références|sources|works cited"
_CHAPTERS = f"""WITH {_UNITS},
  c AS (SELECT *, sum(CASE WHEN kind = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS chapter, {_WORDS.format('plain_text')} AS words FROM u),
  g AS (SELECT job_kind, job_id, chapter, min(CASE WHEN kind = 'h1' THEN plain_text END) AS title, sum(words) AS words, coalesce(sum(CASE WHEN kind = 'p' THEN words END), 0) AS prose_words, count(*) AS units,
    bool_and(regexp_matches(plain_text, '(?i)(?:©|copyright|all rights reserved|toate drepturile rezervate|todos los derechos reservados|tutti i diritti riservati|alle rechte vorbehalten|isbn\\b)')) AS legal FROM c GROUP BY ALL),
  k AS (SELECT *, regexp_replace(regexp_replace({_FOLD.format("coalesce(title, '')")}, '^[ .:;—–-]+|[ .:;—–-]+$', '', 'g'), '^ | $', '', 'g') AS key FROM g)
  SELECT job_kind, job_id, CAST(chapter AS BIGINT) AS chapter, CAST(words AS BIGINT) AS words, CAST(prose_words AS BIGINT) AS prose_words, units, CASE
    WHEN key IN ('contenido', 'contents', 'cuprins', 'indice', 'inhaltsverzeichnis', 'sommaire', 'table des matières', 'table of contents', 'índice') THEN 'contents'
    WHEN regexp_matches(key, '^(?:{_BIBLIOGRAPHY})(?: |$)| (?:{_BIBLIOGRAPHY})$') THEN 'bibliography'
    WHEN chapter > 0 AND prose_words < 40 AND words < 80 THEN 'structural-or-title-page' WHEN chapter = 0 AND prose_words < 80 THEN 'structural-front-matter' WHEN legal THEN 'legal-or-metadata' END AS reason FROM k"""


@query(_CHAPTERS)
def chapter_exclusion(spark, sf_dir):
    rows = units.chapter_table(units.assign_chapters(units.job_units(spark, sf_dir, "kind", "plain_text")))
    return rows.select("job_kind", "job_id", "chapter", "words", "prose_words", "units", "reason")


@query(f"""WITH {_UNITS}, r AS (SELECT *, len({_RUNS.format('plain_text')}) AS words FROM u WHERE page IS NOT NULL),
  g AS (SELECT job_kind, job_id, page, min(unit_no) AS first_unit, count(*) FILTER (kind = 'p') AS paragraphs, coalesce(sum(words) FILTER (kind = 'p'), 0) AS prose, sum(words) AS total FROM r GROUP BY ALL),
  q AS (SELECT *, paragraphs >= 2 AND prose >= 150 AND prose >= 0.65 * total AS good FROM g), a AS (SELECT *, bool_or(good) OVER (PARTITION BY job_kind, job_id) AS any_good FROM q),
  p AS (SELECT *, CASE WHEN any_good THEN row_number() OVER (PARTITION BY job_kind, job_id ORDER BY good DESC, first_unit) ELSE row_number() OVER (PARTITION BY job_kind, job_id ORDER BY prose DESC, page DESC) END AS place FROM a)
  SELECT job_kind, job_id, page, place, CAST(prose AS BIGINT) AS prose FROM p WHERE place <= 2 AND (NOT any_good OR good)""")
def bootstrap_pages(spark, sf_dir):
    return units.bootstrap_pages(units.job_units(spark, sf_dir, "kind", "page", "plain_text"))


@query(f"""WITH {_UNITS}, r AS (SELECT unit_key, plain_text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY job_kind, job_id) AS n FROM u WHERE kind = 'p' WINDOW w AS (PARTITION BY job_kind, job_id ORDER BY unit_no))
  SELECT unit_key, i AS position, sha256(substring(plain_text, 1, 1200)) AS sample FROM r WHERE i = floor(n / 4) OR i = floor(n / 2) OR i = greatest(0, n - 2)""")
def quartile_samples(spark, sf_dir):
    rows = units.quartile_samples(units.job_units(spark, sf_dir, "kind", "plain_text"))
    return rows.select("unit_key", "position", F.sha2("sample", 256).alias("sample"))


@query(f"WITH {_UNITS} SELECT unit_key, lag(unit_id) OVER w AS before, lead(unit_id) OVER w AS after FROM u WINDOW w AS (PARTITION BY job_kind, job_id ORDER BY unit_no)")
def unit_neighbours(spark, sf_dir):
    return windows.neighbours(units.job_units(spark, sf_dir, "unit_id"), ["job_kind", "job_id"], "unit_no", "unit_id", "before", "after").select("unit_key", "before", "after")


# batching


def _fold_sql(key: str, step_new: str, size_new: str, start_size: str = "n", cols: str = "", limit: int = 4000, value: str = "length(source)", after: str | None = None) -> str:
    return f"""WITH RECURSIVE {_UNITS}, c AS (SELECT *, sum(CASE WHEN kind = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS chapter, {value} AS n FROM u),
      o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY unit_no) AS rn FROM c),
      r AS (SELECT o.*, CAST(n AS BIGINT) AS size, 1 AS batch_no FROM o WHERE rn = 1
        UNION ALL SELECT o.*, CAST({size_new} AS BIGINT), CAST({step_new} AS INTEGER) FROM r JOIN o ON {' AND '.join(f'r.{k.strip()} = o.{k.strip()}' for k in key.split(','))} AND o.rn = r.rn + 1)
      SELECT unit_key, batch_no FROM r"""


@query(_fold_sql("job_kind, job_id", "CASE WHEN r.size + o.n > 4000 THEN r.batch_no + 1 ELSE r.batch_no END", "CASE WHEN r.size + o.n > 4000 THEN o.n ELSE r.size + o.n END"))
def batches_simple(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "source").select("unit_key", "job_kind", "job_id", "unit_no", F.length("source").alias("n"))
    return batching.pack(rows, ["job_kind", "job_id"], "unit_no", "n", "simple", 4000).select("unit_key", "batch_no")


@query(_fold_sql("job_kind, job_id, chapter", "CASE WHEN r.size > 4000 OR (r.size + o.n > 4000 AND o.n <= 4000) THEN r.batch_no + 1 ELSE r.batch_no END", "CASE WHEN r.size > 4000 OR (r.size + o.n > 4000 AND o.n <= 4000) THEN o.n ELSE r.size + o.n END"))
def batches_oversize(spark, sf_dir):
    rows = units.assign_chapters(units.job_units(spark, sf_dir, "kind", "source").select("unit_key", "job_kind", "job_id", "unit_no", "kind", F.length("source").alias("n")))
    return batching.pack(rows, ["job_kind", "job_id", "chapter"], "unit_no", "n", "oversize", 4000).select("unit_key", "batch_no")


_COST = "CASE WHEN reuse_of IS NULL THEN length(source) ELSE 0 END"
_TURN = "r.size + o.n > 4000 AND r.page IS NOT NULL AND r.page IS DISTINCT FROM o.page"


@query(_fold_sql("job_kind, job_id", f"CASE WHEN {_TURN} THEN r.batch_no + 1 ELSE r.batch_no END", f"CASE WHEN {_TURN} THEN o.n ELSE r.size + o.n END", value=_COST))
def batches_paged(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "source", "page", "reuse_of").select("unit_key", "job_kind", "job_id", "unit_no", "page", F.when(F.col("reuse_of").isNull(), F.length("source")).otherwise(0).alias("n"))
    return batching.pack(rows, ["job_kind", "job_id"], "unit_no", "n", "paged", 4000, page="page").select("unit_key", "batch_no")


@query(f"""WITH RECURSIVE {_UNITS}, c AS (SELECT *, sum(CASE WHEN kind = 'h1' THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS chapter, {_COST} AS n FROM u),
  o AS (SELECT *, row_number() OVER (PARTITION BY job_kind, job_id, chapter ORDER BY unit_no) AS rn FROM c),
  r AS (SELECT o.*, CAST(n AS BIGINT) AS size, 1 AS chunk FROM o WHERE rn = 1
    UNION ALL SELECT o.*, CAST(CASE WHEN r.size + o.n > 4000 THEN o.n ELSE r.size + o.n END AS BIGINT), CAST(CASE WHEN r.size + o.n > 4000 THEN r.chunk + 1 ELSE r.chunk END AS INTEGER) FROM r JOIN o ON r.job_kind = o.job_kind AND r.job_id = o.job_id AND r.chapter = o.chapter AND o.rn = r.rn + 1),
  g AS (SELECT job_kind, job_id, chapter, chunk, sum(n) AS n FROM r GROUP BY job_kind, job_id, chapter, chunk), k AS (SELECT *, row_number() OVER (PARTITION BY job_kind, job_id ORDER BY chapter, chunk) AS rn FROM g),
  b AS (SELECT k.*, CAST(n AS BIGINT) AS size, 1 AS batch_no FROM k WHERE rn = 1
    UNION ALL SELECT k.*, CAST(CASE WHEN b.size + k.n > 4000 THEN k.n ELSE b.size + k.n END AS BIGINT), CAST(CASE WHEN b.size + k.n > 4000 THEN b.batch_no + 1 ELSE b.batch_no END AS INTEGER) FROM b JOIN k ON b.job_kind = k.job_kind AND b.job_id = k.job_id AND k.rn = b.rn + 1)
  SELECT r.unit_key, b.batch_no FROM r JOIN b ON r.job_kind = b.job_kind AND r.job_id = b.job_id AND r.chapter = b.chapter AND r.chunk = b.chunk""")
def batches_two_level(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "kind", "source", "reuse_of").select("unit_key", "job_kind", "job_id", "unit_no", "kind", F.when(F.col("reuse_of").isNull(), F.length("source")).otherwise(0).alias("n"))
    return batching.pack(units.assign_chapters(rows), ["job_kind", "job_id"], "unit_no", "n", "two_level", 4000, chapter="chapter").select("unit_key", "batch_no")


@query(_fold_sql("job_kind, job_id", "CASE WHEN r.size + o.n > 4000 THEN r.batch_no + 1 ELSE r.batch_no END", "CASE WHEN r.size + o.n > 4000 THEN o.n ELSE r.size + o.n END", value="length(plain_text) + len(regexp_extract_all(plain_text, '[\U00010000-\U0010ffff]'))"))
def batches_utf16(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "plain_text").select("unit_key", "job_kind", "job_id", "unit_no", T.utf16_length("plain_text").alias("n"))
    return batching.pack(rows, ["job_kind", "job_id"], "unit_no", "n", "simple", 4000).select("unit_key", "batch_no")


# reuse


@query(f"""WITH u AS (SELECT DISTINCT unit_key, job_kind, job_id, unit_no, unit_id, kind, source, CAST(placeholders AS VARCHAR) AS ph, CAST(protections AS VARCHAR) AS pr FROM job_units),
  f AS (SELECT unit_key, unit_id, first_value(unit_id) OVER (PARTITION BY job_kind, job_id, kind, source, ph, pr ORDER BY unit_no) AS f FROM u) SELECT unit_key, CASE WHEN f <> unit_id THEN f END AS first_unit FROM f""")
def exact_copies(spark, sf_dir):
    return memory.exact_copies(units.job_units(spark, sf_dir, "unit_id", "kind", "source", "placeholders", "protections")).select("unit_key", "first_unit")


_NUMBERED = r"'^(.*?\D)(\d+)(\D*)$'"


@query(f"""WITH {_UNITS}, r AS (SELECT *, {_FOLD.format(f'regexp_extract(trim(source), {_NUMBERED}, 1)')} AS prefix, regexp_extract(trim(source), {_NUMBERED}, 2) AS number, {_FOLD.format(f'regexp_extract(trim(source), {_NUMBERED}, 3)')} AS suffix FROM u
    WHERE (kind LIKE 'attribute:%' OR kind = 'title' OR regexp_full_match(kind, 'h[1-6]')) AND regexp_matches(trim(source), {_NUMBERED})),
  w AS (SELECT unit_key, first_value(unit_id) OVER x AS template_of, first_value(number) OVER x AS template_number, number, row_number() OVER x AS i FROM r WHERE regexp_matches(prefix, '[\\p{{L}}\\p{{N}}_]') WINDOW x AS (PARTITION BY job_kind, job_id, kind, prefix, suffix ORDER BY unit_no))
  SELECT unit_key, template_of, template_number, number FROM w WHERE i > 1""")
def templated_labels(spark, sf_dir):
    return memory.templated_labels(units.job_units(spark, sf_dir, "unit_id", "kind", "source"))


@query(f"""WITH {_UNITS} SELECT a.unit_key, CASE WHEN b.unit_key IS NOT NULL THEN b.unit_key WHEN a.reuse_of IS NULL THEN a.unit_key END AS takes_from, a.reuse_of IS NOT NULL AND b.unit_key IS NULL AS unresolved
  FROM u a LEFT JOIN u b ON a.job_kind = b.job_kind AND a.job_id = b.job_id AND a.reuse_of = b.unit_id""")
def memory_resolution(spark, sf_dir):
    return memory.resolved(units.job_units(spark, sf_dir, "unit_id", "reuse_of"))


@query(r"""WITH u AS (SELECT DISTINCT unit_key, source FROM job_units), m AS (SELECT unit_key, list_sort(regexp_extract_all(source, '⟦OPEN:(T\d+)⟧', 1)) AS o, list_sort(regexp_extract_all(source, '⟦CLOSE:(T\d+)⟧', 1)) AS c FROM u)
  SELECT unit_key, len(o) AS opened, len(c) AS closed, o = c AS balanced FROM m WHERE len(o) + len(c) > 0""")
def mark_balance(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "source").select("unit_key", pages.marks("source", "OPEN").alias("o"), pages.marks("source", "CLOSE").alias("c"))
    return rows.where(F.size("o") + F.size("c") > 0).select("unit_key", F.size("o").alias("opened"), F.size("c").alias("closed"), (F.col("o") == F.col("c")).alias("balanced"))


# comparisons of neighbouring documents of a chapter

_GRAMS = """list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], chr(0))))"""


@query(f"""WITH {_PAIRS}, w AS (SELECT id_a, id_b, list_filter(list_transform({_RUNS.format('text_a')}, lambda w: {_FOLD.format('w')}), lambda w: length(w) > 2) AS a, list_filter(list_transform({_RUNS.format('text_b')}, lambda w: {_FOLD.format('w')}), lambda w: length(w) > 2) AS b FROM p),
  g AS (SELECT id_a, id_b, {_GRAMS.format('a')} AS a, {_GRAMS.format('b')} AS b FROM w)
  SELECT id_a, id_b, len(a) AS grams_a, len(list_intersect(a, b)) AS shared, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0 END AS overlap FROM g""")
def ngram_overlap(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("id_a", "id_b", T.ngrams("text_a").alias("a"), T.ngrams("text_b").alias("b"))
    return rows.select("id_a", "id_b", F.size("a").alias("grams_a"), F.size(F.array_intersect("a", "b")).alias("shared"), F.round(quality.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"""WITH {_PAIRS}, w AS (SELECT id_a, id_b, {_RUNS.format(_FOLD.format('text_a'))} AS a, {_RUNS.format(_FOLD.format('text_b'))} AS b FROM p),
  ta AS (SELECT id_a, id_b, 'token' AS level, unnest(a) AS x FROM w UNION ALL SELECT id_a, id_b, 'pair', unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) FROM w),
  tb AS (SELECT id_a, id_b, 'token' AS level, unnest(b) AS x FROM w UNION ALL SELECT id_a, id_b, 'pair', unnest(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) FROM w),
  ca AS (SELECT id_a, id_b, level, x, count(*) AS n FROM ta GROUP BY ALL), cb AS (SELECT id_a, id_b, level, x, count(*) AS n FROM tb GROUP BY ALL)
  SELECT ca.id_a, ca.id_b, round(sum(least(ca.n, coalesce(cb.n, 0))) FILTER (ca.level = 'token') / sum(ca.n) FILTER (ca.level = 'token'), 6) AS coverage,
    round(sum(least(ca.n, coalesce(cb.n, 0))) FILTER (ca.level = 'pair') / sum(ca.n) FILTER (ca.level = 'pair'), 6) AS order_share
  FROM ca LEFT JOIN cb ON ca.id_a = cb.id_a AND ca.id_b = cb.id_b AND ca.level = cb.level AND ca.x = cb.x GROUP BY ca.id_a, ca.id_b""")
def token_coverage(spark, sf_dir):
    out = quality.token_coverage(pairs(spark, sf_dir), "text_a", "text_b", ["id_a", "id_b"])
    return out.select("id_a", "id_b", F.round("coverage", 6).alias("coverage"), F.round("order_share", 6).alias("order_share"))


@query(f"""WITH {_PAIRS}, l AS (SELECT id_a, id_b, len(regexp_extract_all(text_a, '\\p{{L}}')) AS a, len(regexp_extract_all(text_b, '\\p{{L}}')) AS b FROM p)
  SELECT id_a, id_b, CASE WHEN a > 0 THEN round(b / a, 6) ELSE 1 END AS ratio, CASE WHEN a > 0 THEN b / a < 0.45 OR b / a > 2.2 ELSE false END AS unusual FROM l""")
def length_ratio(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("id_a", "id_b", T.letters("text_a").alias("a"), T.letters("text_b").alias("b"))
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(F.lit(1.0))
    return rows.select("id_a", "id_b", F.round(ratio, 6).alias("ratio"), ((F.col("a") > 0) & ((ratio < 0.45) | (ratio > 2.2))).alias("unusual"))


_NORM = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ')"


@query(f"""WITH {_PAIRS}, {_LINES}, q AS (SELECT id_a, id_b, line_no, {_NORM.format('unit_text')} AS t, {_NORM.format('text_b')} AS b FROM p JOIN lines ON lines.doc_id = id_a)
  SELECT id_a, id_b, count(*) AS lines, count(*) FILTER (contains(b, t)) AS present FROM q WHERE length(t) >= 24 GROUP BY ALL""")
def line_coverage(spark, sf_dir):
    both = pairs(spark, sf_dir).select("id_a", "id_b", F.explode(F.split("text_a", "\n")).alias("line"), T.normalized("text_b").alias("b")).withColumn("t", T.normalized("line"))
    return both.where(F.length("t") >= 24).groupBy("id_a", "id_b").agg(F.count("*").alias("lines"), F.count_if(F.contains("b", "t")).alias("present"))


@query(f"""WITH {_PAIRS}, t AS (SELECT id_a, id_b, list_filter(list_distinct(string_split({_NORM.format('text_a')}, ' ')), lambda w: length(w) >= 4) AS a, {_NORM.format('text_b')} AS b FROM p)
  SELECT id_a, id_b, len(a) AS tokens, CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_filter(a, lambda w: contains(b, w))) / len(a), 6) END AS ratio FROM t""")
def coverage_ratio(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("id_a", "id_b", F.filter(F.array_distinct(F.split(T.normalized("text_a"), " ")), lambda w: F.length(w) >= 4).alias("a"), T.normalized("text_b").alias("b"))
    present = F.size(F.filter("a", lambda w: F.contains(F.col("b"), w)))
    return rows.select("id_a", "id_b", F.size("a").alias("tokens"), F.when(F.size("a") == 0, F.lit(1.0)).otherwise(F.round(present / F.size("a"), 6)).alias("ratio"))


@query()
def unsupported_facts(spark, sf_dir):
    """Facts of a document that the document before it in the chapter doesn't have."""
    rows = pairs(spark, sf_dir).select("id_a", "id_b", F.explode(F.array_except(T.fact_tokens("text_b"), T.fact_tokens("text_a"))).alias("fact"))
    return rows


@query(f"""WITH {_PAIRS}, {_LINES}, a AS (SELECT id_a, id_b, unit_text, row_number() OVER (PARTITION BY id_a ORDER BY line_no) AS i FROM p JOIN lines ON doc_id = id_a),
  b AS (SELECT id_a, id_b, unit_text, row_number() OVER (PARTITION BY id_a ORDER BY line_no) AS i FROM p JOIN lines ON doc_id = id_b)
  SELECT id_a, id_b, count(*) AS places, count(*) FILTER (a.unit_text = b.unit_text) AS equal, count(*) FILTER (a.i IS NULL OR b.i IS NULL) AS unmatched FROM a FULL JOIN b USING (id_a, id_b, i) GROUP BY ALL""")
def positional_zip(spark, sf_dir):
    p = pairs(spark, sf_dir)

    def side(c: str) -> DataFrame:
        found = F.filter(F.transform(F.split(c, "\n"), T.compact), lambda x: x != "")
        return p.select("id_a", "id_b", F.posexplode(found).alias("i", c))

    both = side("text_a").join(side("text_b"), ["id_a", "id_b", "i"], "full_outer")
    return both.groupBy("id_a", "id_b").agg(F.count("*").alias("places"), F.count_if(F.col("text_a") == F.col("text_b")).alias("equal"), F.count_if(F.col("text_a").isNull() | F.col("text_b").isNull()).alias("unmatched"))


@query()
def similar_neighbours(spark, sf_dir):
    """Ratcliff-Obershelp similarity of neighbours' lines of the same place, all lines of both texts; 0 where one has no such line."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), T.compact), lambda x: x != "")
    rows = pairs(spark, sf_dir).select("id_a", "id_b", F.posexplode(F.arrays_zip(lines("text_a").alias("a"), lines("text_b").alias("b"))).alias("place", "l"))
    return rows.select("id_a", "id_b", "place", F.coalesce(F.round(U.similarity(F.col("l.a"), F.col("l.b")), 6), F.lit(0.0)).alias("similarity"))


@query()
def token_mismatch(spark, sf_dir):
    """First place at which neighbours' words differ."""
    rows = pairs(spark, sf_dir).select("id_a", "id_b", alignment.mismatch_at(T.words(T.casefold("text_a")), T.words(T.casefold("text_b"))).alias("m"))
    return rows.select("id_a", "id_b", F.col("m.a").alias("at_a"), F.col("m.b").alias("at_b"))


@query()
def block_alignment(spark, sf_dir):
    """Least-cost alignment of neighbours' lines by their sentences; a line without a closing mark is one."""
    sizes = lambda c: F.transform(F.filter(F.transform(F.split(c, "\n"), T.compact), lambda x: x != ""), lambda x: F.greatest(F.lit(1), F.size(T.sentences_closed(x))))
    rows = pairs(spark, sf_dir).select("id_a", "id_b", F.explode(alignment.aligned(sizes("text_a"), sizes("text_b"))).alias("s"))
    return rows.select("id_a", "id_b", "s.*")


@query(f"""WITH {_UNITS}, b AS (SELECT job_kind, job_id, {_FOLD.format('plain_text')} AS t FROM u), f AS (SELECT job_kind, job_id, {_COMPACT.format('t')} AS t FROM b WHERE len({_RUNS.format('t')}) >= 6)
  SELECT job_kind, job_id, count(*) AS blocks, count(*) - count(DISTINCT t) AS duplicates FROM f GROUP BY ALL""")
def duplicate_blocks(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "plain_text").where(F.size(T.words(T.casefold("plain_text"))) >= 6)
    return quality.duplicate_blocks(rows, ["job_kind", "job_id"], "plain_text", 0)


@query()
def canned_phrases(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", quality.canned_phrases("text").alias("phrases"))


# pages of words


@query(f"""WITH {_PAGE_LINES}, e AS (SELECT evidence_id, page_number, line_text FROM l QUALIFY line_no = min(line_no) OVER (PARTITION BY evidence_id, page_number) OR line_no = max(line_no) OVER (PARTITION BY evidence_id, page_number)),
  k AS (SELECT DISTINCT evidence_id, page_number, regexp_replace(lower(regexp_extract({_COMPACT.format('line_text')}, '^(.{{6,}}?)\\s*[·•|]\\s*\\d{{1,4}}$', 1)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM e)
  SELECT evidence_id, key, count(*) AS pages FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) >= 3""")
def running_keys(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt")
    return geometry.running_keys(geometry.page_lines(words))


@query(f"WITH {_PAGE_LINES}, f AS (SELECT evidence_id, page_number, line_text FROM l QUALIFY row_number() OVER (PARTITION BY evidence_id, page_number ORDER BY line_no) = 1) SELECT evidence_id, {_COMPACT.format('line_text')} AS running_text, count(*) AS pages FROM f GROUP BY ALL HAVING count(*) >= 2 AND {_COMPACT.format('line_text')} <> ''")
def running_matter(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt")
    return geometry.running_matter(geometry.page_lines(words), 2)


@query(rf"""WITH {_PAGE_LINES}, n AS (SELECT *, lead(line_text) OVER (PARTITION BY evidence_id, page_number ORDER BY line_no) AS next_text FROM l),
  h AS (SELECT evidence_id, page_number, line_no, regexp_extract(line_text, '(\p{{L}}+)[-‐]$', 1) AS head, regexp_extract(next_text, '^(\p{{L}}+)', 1) AS tail FROM n)
  SELECT *, {_FOLD.format('head || tail')} AS joined FROM h WHERE head <> '' AND tail <> ''""")
def hyphen_candidates(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt")
    return geometry.hyphen_candidates(geometry.page_lines(words))


@query(f"WITH {_PAGE_LINES}, t AS (SELECT evidence_id, {_FOLD.format('unnest(' + _RUNS.format('text') + ')')} AS word FROM w) SELECT word, count(*) AS times, count(DISTINCT evidence_id) AS files FROM t GROUP BY word")
def page_vocabulary(spark, sf_dir):
    return geometry.vocabulary(geometry.page_words(spark, sf_dir, "evidence_id", "text"))


@query(f"""WITH {_PAGE_LINES}, g AS (SELECT *, lag(x1) OVER x AS px, lag(bold) OVER x AS pb, lag(italic) OVER x AS pi FROM w WINDOW x AS (PARTITION BY evidence_id, page_number, line_no ORDER BY word_no)),
  i AS (SELECT word_id, evidence_id, page_number, line_no, sum(CASE WHEN px IS NOT NULL AND (x0 - px > 6.0 OR bold IS DISTINCT FROM pb OR italic IS DISTINCT FROM pi) THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id, page_number, line_no ORDER BY word_no) AS group_no FROM g)
  SELECT evidence_id, page_number, line_no, max(group_no) + 1 AS groups, count(*) AS words FROM i GROUP BY ALL""")
def word_groups(spark, sf_dir):
    rows = geometry.word_groups(geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "x0", "x1", "bold", "italic"))
    return rows.groupBy(*geometry.LINE).agg((F.max("group_no") + 1).alias("groups"), F.count("*").alias("words"))


@query(f"""WITH {_PAGE_LINES}, d AS (SELECT evidence_id, round(top - lag(top) OVER (PARTITION BY evidence_id, page_number ORDER BY line_no), 3) AS gap FROM l),
  o AS (SELECT evidence_id, gap, row_number() OVER (PARTITION BY evidence_id ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY evidence_id) AS n FROM d WHERE gap IS NOT NULL)
  SELECT evidence_id, max(gap) FILTER (i = n // 2) AS upper_median, max(gap) FILTER (i = floor(n * 0.9)) AS p90, max(gap) FILTER (i = floor((n - 1) * 0.95)) AS p95 FROM o GROUP BY evidence_id""")
def leading_statistics(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt")
    ranked = geometry.ranked_values(geometry.leading(geometry.page_lines(words)), ["evidence_id"], "leading")
    at = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("upto")), F.col("leading")))
    n = F.col("total")
    return ranked.groupBy("evidence_id").agg(at(F.floor(n / 2)).alias("upper_median"), at(F.floor(n * 0.9)).alias("p90"), at(F.floor((n - 1) * 0.95)).alias("p95"))


@query(f"""WITH {_PAGE_LINES}, c AS (SELECT evidence_id, size_pt, coalesce(font_family, '') AS family, sum(length(text)) AS characters FROM w GROUP BY ALL)
  SELECT evidence_id, size_pt, family, CAST(characters AS BIGINT) AS characters FROM c QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY characters DESC, size_pt, family) = 1""")
def body_styles(spark, sf_dir):
    return geometry.body_style(geometry.page_words(spark, sf_dir, "evidence_id", "size_pt", "font_family", "text"))


@query(f"""WITH {_PAGE_LINES}, c AS (SELECT evidence_id, size_pt, coalesce(font_family, '') AS family, sum(length(text)) AS characters FROM w GROUP BY ALL),
  b AS (SELECT evidence_id, size_pt AS body_pt FROM c QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY characters DESC, size_pt, family) = 1)
  SELECT evidence_id, CASE WHEN size_pt / body_pt >= 1.8 THEN 'h1' WHEN size_pt / body_pt >= 1.35 THEN 'h2' WHEN size_pt / body_pt >= 1.12 THEN 'h3' ELSE 'p' END AS level, count(*) AS lines FROM l JOIN b USING (evidence_id) GROUP BY ALL""")
def heading_levels(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt", "font_family")
    rows = geometry.heading_levels(geometry.page_lines(words), geometry.body_style(words))
    return rows.groupBy("evidence_id", "level").agg(F.count("*").alias("lines"))


@query(f"""WITH {_PAGE_LINES} SELECT DISTINCT w.word_id, l.line_no AS other_line FROM w JOIN l ON w.evidence_id = l.evidence_id AND w.page_number = l.page_number AND w.line_no <> l.line_no
  AND w.top < l.bottom AND l.top < w.bottom AND w.x0 < l.x1 AND l.x0 < w.x1""")
def box_overlaps(spark, sf_dir):
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "text", "top", "bottom", "x0", "x1", "size_pt")
    return geometry.box_overlaps(words, geometry.page_lines(words))


@query("""WITH t AS (SELECT o_orderkey % 97 AS table_id, 1 + o_orderkey % 7 AS r, 1 + o_custkey % 5 AS c FROM orders), g AS (SELECT table_id, max(r) AS rows, max(c) AS cols FROM t GROUP BY ALL),
  x AS (SELECT table_id, r, unnest(range(1, cols + 1)) AS c FROM (SELECT table_id, cols, unnest(range(1, rows + 1)) AS r FROM g)), n AS (SELECT table_id, r, c, count(*) AS times FROM t GROUP BY ALL)
  SELECT x.table_id, x.r, x.c, coalesce(n.times, 0) AS times FROM x LEFT JOIN n ON x.table_id = n.table_id AND x.r = n.r AND x.c = n.c WHERE coalesce(n.times, 0) <> 1""")
def grid_coverage(spark, sf_dir):
    one = F.lit(1).cast("long")
    cells = table(spark, sf_dir, "orders", (F.col("o_orderkey") % 97).alias("table_id"), (1 + F.col("o_orderkey") % 7).alias("row"), (1 + F.col("o_custkey") % 5).alias("col"), one.alias("rowspan"), one.alias("colspan"))
    return geometry.grid_coverage(cells)


# ranking


#: Pieces over 15 characters, cut behind closing marks; the tail counts as one.
_SEGMENTS = r"""s AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS sentence FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?(?:[.!?]+["''”’»)\]]*(?:\s|$)|\z)'), lambda y: """ + _COMPACT.format("y") + """), lambda y: length(y) > 15) AS x FROM documents))"""


@query(rf"""WITH {_SEGMENTS}, t AS (SELECT doc_id, unnest(regexp_extract_all({_BARE.format('text')}, '\p{{L}}{{4,}}')) AS word FROM documents), f AS (SELECT doc_id, word, count(*) AS freq FROM t GROUP BY ALL),
  w AS (SELECT doc_id, pos, unnest(regexp_extract_all({_BARE.format('sentence')}, '\p{{L}}{{4,}}')) AS word FROM s),
  c AS (SELECT w.doc_id, pos, sum(CASE WHEN w.word IN ({', '.join(f"'{x}'" for x in ranking.STOP)}) THEN 0 ELSE ln(1 + coalesce(freq, 0)) END) / sqrt(count(*)) AS score FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.word = f.word GROUP BY ALL),
  r AS (SELECT s.doc_id, s.pos, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, s.pos) AS rank FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.pos = c.pos)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 18""")
def top_sentences(spark, sf_dir):
    return ranking.top_sentences(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text").select("doc_id", "pos", "rank", "score")


def _matching_sql(pattern: str) -> str:
    return rf"""WITH {_SEGMENTS}, m AS (SELECT doc_id, pos, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM s WHERE regexp_matches({_BARE.format('sentence')}, '\b(?:{'|'.join(pattern)})'))
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(place AS INTEGER) AS place, sentence FROM m WHERE place <= 8"""


def _matching(spark, sf_dir, words) -> DataFrame:
    return ranking.matching_sentences(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", words).select("doc_id", "pos", "place", "sentence")


@query(_matching_sql(ranking.TENSION))
def tension_sentences(spark, sf_dir):
    return _matching(spark, sf_dir, ranking.TENSION)


@query(_matching_sql(ranking.NOVELTY))
def novelty_sentences(spark, sf_dir):
    return _matching(spark, sf_dir, ranking.NOVELTY)


@query(_matching_sql(ranking.LIMITS))
def limitation_sentences(spark, sf_dir):
    return _matching(spark, sf_dir, ranking.LIMITS)


def _genre_sql() -> str:
    sums = {g: " + ".join(f"CASE WHEN contains(bare, '{w}') THEN 1 ELSE 0 END" for w in ws) for g, ws in ranking.GENRES.items()}
    cols = ", ".join(f"{s} AS {g}" for g, s in sums.items())
    names = list(ranking.GENRES)
    case = " ".join(f"WHEN {g} = greatest({', '.join(names)}) THEN '{g}'" for g in names)
    return f"SELECT *, CASE WHEN greatest({', '.join(names)}) = 0 THEN 'general' {case} END AS genre FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, {_BARE.format('text')} AS bare FROM documents))"


@query(_genre_sql())
def genre_scores(spark, sf_dir):
    return ranking.genre_scores(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


#: Words counted under one of them.
SYNONYMS = {"archive": ["archives", "arhivă", "arhivei", "archivo", "archivio"], "chapter": ["capitolul", "kapitel", "chapitre", "capítulo", "capitolo"], "museum": ["muzeul", "musée", "museo", "museu"]}
_CANON = " ".join(f"WHEN word IN ({', '.join(chr(39) + v + chr(39) for v in vs)}) THEN '{c}'" for c, vs in SYNONYMS.items())


@query(f"""WITH w AS (SELECT source, unnest(list_filter({_RUNS.format(_FOLD.format('text'))}, lambda w: length(w) >= 5)) AS word FROM documents WHERE source IS NOT NULL), c AS (SELECT source, CASE {_CANON} ELSE word END AS word FROM w),
  g AS (SELECT source, word, count(*) AS times FROM c GROUP BY ALL) SELECT source, word, times, row_number() OVER (PARTITION BY source ORDER BY times DESC, word) AS rank FROM g QUALIFY rank <= 20""")
def source_keywords(spark, sf_dir):
    return ranking.keywords(documents(spark, sf_dir, "source", "text").where("source is not null"), "source", "text", SYNONYMS)


@query(f"""WITH w AS (SELECT source, unnest(list_filter({_RUNS.format(_FOLD.format('text'))}, lambda w: length(w) >= 5)) AS word FROM documents WHERE source IS NOT NULL), c AS (SELECT source, CASE {_CANON} ELSE word END AS word FROM w),
  g AS (SELECT source, word, count(*) AS times FROM c GROUP BY ALL), k AS (SELECT source, word, times, row_number() OVER (PARTITION BY source ORDER BY times DESC, word) AS rank FROM g QUALIFY rank <= 20) SELECT source, string_agg(word, ', ' ORDER BY rank) AS keywords FROM k GROUP BY source""")
def keyword_file(spark, sf_dir):
    rows = ranking.keywords(documents(spark, sf_dir, "source", "text").where("source is not null"), "source", "text", SYNONYMS)
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("keywords"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS i FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang) WHERE i = 1")
def dominant_labels(spark, sf_dir):
    each = documents(spark, sf_dir, "source", "lang", "doc_id").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    best = each.groupBy("source").agg(F.max_by(F.struct("lang", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("source", "b.lang", "b.n")


# html pages


@query(r"""SELECT DISTINCT job_id, nullif(regexp_extract(regexp_extract(source, '(?i)<html([^>]*)>', 1), '(?i)\slang\s*=\s*["'']([^"'']*)["'']', 1), '') AS lang, nullif(""" + _COMPACT.format("regexp_extract(source, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '') AS title FROM unicode_jobs")
def page_heads(spark, sf_dir):
    return table(spark, sf_dir, "unicode_jobs", "job_id", pages.page_language("source").alias("lang"), pages.page_title("source").alias("title")).distinct()


@query("SELECT DISTINCT job_id, " + ", ".join(rf"len(regexp_extract_all(lower(source), '<{t}[\s>/]')) AS n_{t}" for t in pages.TAGS) + " FROM keep_jobs")
def page_tag_counts(spark, sf_dir):
    return pages.tag_counts(table(spark, sf_dir, "keep_jobs", "job_id", "source"), ["job_id"], "source").distinct()


@query("WITH s AS (SELECT job_id, " + ", ".join(rf"len(regexp_extract_all(lower(source), '<{t}[\s>/]')) AS s_{t}, len(regexp_extract_all(lower(html), '<{t}[\s>/]')) AS h_{t}" for t in ("p", "li", "pre", "h1", "h2")) + " FROM keep_jobs WHERE html IS NOT NULL) SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT job_id, '{t}' AS tag, s_{t} AS in_source, h_{t} AS in_html FROM s WHERE s_{t} <> h_{t}" for t in ("p", "li", "pre", "h1", "h2")) + ")")
def element_differences(spark, sf_dir):
    """Tags that the rebuilt page has more or fewer of than its source."""
    jobs = table(spark, sf_dir, "keep_jobs", "job_id", "source", "html").where("html is not null")
    count = lambda c, t: F.regexp_count(F.lower(c), F.lit(f"<{t}[\\s>/]"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), count("source", t).alias("in_source"), count("html", t).alias("in_html")) for t in ("p", "li", "pre", "h1", "h2")]))
    return jobs.select("job_id", each.alias("x")).select("job_id", "x.*").where("in_source <> in_html").distinct()


@query(r"""WITH r AS (SELECT job_id, unnest(list_distinct(regexp_extract_all(source, '(?i)\s(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1))) AS target FROM keep_jobs)
  SELECT DISTINCT job_id, target, CASE WHEN regexp_matches(target, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//|^(?:https?|mailto|data):') THEN 'remote' WHEN target LIKE '#%' THEN 'anchor' ELSE 'local' END AS kind FROM r""")
def page_references(spark, sf_dir):
    return pages.references(table(spark, sf_dir, "keep_jobs", "job_id", "source"), ["job_id"], "source").distinct()


# inventories, findings, status

_JOBS = "j AS (SELECT DISTINCT job_id, book_id, prepared.units AS units, prepared.batchMaximumChars AS max_chars, prepared.batches AS batches, prepared.completedBatches AS done, prepared.remainingBatches AS remaining, prepared.status AS status FROM keep_jobs)"


def _keep_jobs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "keep_jobs", "job_id", "book_id", F.col("prepared.units").alias("units"), F.col("prepared.batchMaximumChars").alias("max_chars"), F.col("prepared.batches").alias("batches"), F.col("prepared.completedBatches").alias("done"), F.col("prepared.remainingBatches").alias("remaining"), F.col("prepared.status").alias("status"))
    return rows.distinct()


@query(f"WITH {_UNITS}, {_JOBS}, n AS (SELECT job_id, count(*) AS found FROM u WHERE job_kind = 'keep' GROUP BY job_id) SELECT coalesce(j.job_id, n.job_id) AS job_id, j.units AS recorded, n.found FROM j FULL JOIN n ON j.job_id = n.job_id WHERE j.units IS DISTINCT FROM n.found")
def unit_inventory(spark, sf_dir):
    """Jobs whose recorded number of units is not that of the units found."""
    found = units.job_units(spark, sf_dir).where("job_kind = 'keep'").groupBy("job_id").agg(F.count("*").alias("found"))
    both = _keep_jobs(spark, sf_dir).select("job_id", F.col("units").alias("recorded")).join(found, "job_id", "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("found")))


_FINDINGS = f"""{_JOBS}, f AS (
  SELECT 'error' AS severity, 'batch-progress' AS category, CAST(job_id AS VARCHAR) AS location, 'completed and remaining differ from all' AS detail FROM j WHERE done + remaining <> batches
  UNION ALL SELECT 'warning', 'no-limit', CAST(job_id AS VARCHAR), 'no largest batch' FROM j WHERE max_chars IS NULL
  UNION ALL SELECT 'warning', 'few-units', CAST(job_id AS VARCHAR), 'fewer than five units' FROM j WHERE units < 5
  UNION ALL SELECT 'error', 'ready-but-open', CAST(job_id AS VARCHAR), 'ready with batches left' FROM j WHERE status = 'ready_to_build' AND remaining > 0)"""


def _job_findings(spark, sf_dir) -> DataFrame:
    j = _keep_jobs(spark, sf_dir)
    return findings.union([
        findings.finding(j, F.col("done") + F.col("remaining") != F.col("batches"), "error", "batch-progress", F.col("job_id"), F.lit("completed and remaining differ from all")),
        findings.finding(j, F.col("max_chars").isNull(), "warning", "no-limit", F.col("job_id"), F.lit("no largest batch")),
        findings.finding(j, F.col("units") < 5, "warning", "few-units", F.col("job_id"), F.lit("fewer than five units")),
        findings.finding(j, (F.col("status") == "ready_to_build") & (F.col("remaining") > 0), "error", "ready-but-open", F.col("job_id"), F.lit("ready with batches left")),
    ])


@query(f"WITH {_FINDINGS} SELECT severity, category, location, detail, substring(sha256(category || chr(0) || location || chr(0) || detail), 1, 20) AS finding_id FROM f")
def job_findings(spark, sf_dir):
    return _job_findings(spark, sf_dir)


@query(f"WITH {_FINDINGS} SELECT severity, category, count(*) AS findings, count(DISTINCT location) AS locations, array_to_string(list_sort(list_distinct(list(location)))[1:3], ', ') AS examples FROM f GROUP BY severity, category")
def findings_grouped(spark, sf_dir):
    return findings.grouped(_job_findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM f")
def report_status(spark, sf_dir):
    return findings.status(_job_findings(spark, sf_dir))


@query("SELECT job_kind, job_id, unit_id, count(DISTINCT unit_key) AS times FROM job_units GROUP BY ALL HAVING count(DISTINCT unit_key) > 1")
def duplicate_ids(spark, sf_dir):
    return units.job_units(spark, sf_dir, "unit_id").groupBy("job_kind", "job_id", "unit_id").agg(F.count("*").alias("times")).where("times > 1")


@query("SELECT b.book_id FROM books b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.book_id = b.book_id)")
def books_without_documents(spark, sf_dir):
    return table(spark, sf_dir, "books", "book_id").join(documents(spark, sf_dir, "book_id"), "book_id", "left_anti")


@query("SELECT book_mode, count(*) AS books, count(*) FILTER (edition_no IS NULL) AS without_edition, max(edition_no) AS latest FROM books GROUP BY book_mode")
def book_modes(spark, sf_dir):
    return table(spark, sf_dir, "books", "book_mode", "edition_no").groupBy("book_mode").agg(F.count("*").alias("books"), F.count_if(F.col("edition_no").isNull()).alias("without_edition"), F.max("edition_no").alias("latest"))


# timelines


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, line_no, CAST(floor(length(unit_text) / 15.0 * 48000 + 0.5) AS BIGINT) AS f FROM lines), e AS (SELECT doc_id, line_no, f, sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) AS end_frame FROM b)
  SELECT doc_id, line_no, CAST(end_frame - f AS BIGINT) AS start_frame, CAST(end_frame AS BIGINT) AS end_frame FROM e""")
def sequential_timeline(spark, sf_dir):
    """A document's lines are one row, so their ends are summed in it and nothing is shuffled."""
    lines = F.transform(F.split("text", "\n"), T.compact)
    rows = documents(spark, sf_dir, "doc_id", F.transform(lines, lambda x: timeline.line_frames(x)).alias("f"))
    ends = rows.select("doc_id", F.posexplode(F.arrays_zip("f", timeline.running("f").alias("end_frame"))).alias("i", "x")).where("x.f is not null")
    return ends.select("doc_id", (F.col("i") + 1).alias("line_no"), (F.col("x.end_frame") - F.col("x.f")).alias("start_frame"), "x.end_frame")


@query(f"""WITH RECURSIVE {_LINES}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS beat, length(unit_text) AS length FROM lines),
  r AS (SELECT doc_id, beat, length, CAST(0 AS BIGINT) AS start FROM n WHERE beat = 1 UNION ALL SELECT n.doc_id, n.beat, n.length, CAST(r.start + r.length AS BIGINT) FROM r JOIN n ON n.doc_id = r.doc_id AND n.beat // 2 = r.beat AND n.beat > 1)
  SELECT doc_id, beat, start FROM r""")
def anchored_timeline(spark, sf_dir):
    """Each line begins where the line half as far down ends."""
    found = F.filter(F.transform(F.split("text", "\n"), T.compact), lambda x: x != "")
    rows = documents(spark, sf_dir, "doc_id", F.posexplode(found).alias("i", "t")).select("doc_id", (F.col("i") + 1).cast("long").alias("beat"), F.length("t").alias("length"))
    rows = rows.withColumn("anchor", F.when(F.col("beat") > 1, F.floor(F.col("beat") / 2)))
    return timeline.anchored(rows, ["doc_id"], "beat", "anchor", "length").select("doc_id", "beat", "start")
