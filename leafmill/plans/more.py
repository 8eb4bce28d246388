"""Further queries: line and style checks, joins by position and containment, states and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, contracts, geometry, quality, spans, units, windows
from ..sources import table
from .registry import _FOLD, _JOBS, _LINES, _NORM, _PAGE_LINES, _PAIRS, _RUNS, _UNITS, _WORDS, _keep_jobs, documents, pairs, query

_LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def _tokens_sql(c: str) -> str:
    for a, b in _LIGATURES:
        c = f"replace({c}, '{a}', '{b}')"
    return f"regexp_extract_all(replace({_FOLD.format(c)}, '\xad', ''), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"WITH {_PAGE_LINES} SELECT evidence_id, sum(len({_tokens_sql('text')})) AS tokens, count(*) FILTER (len({_tokens_sql('text')}) > 1) AS split_words FROM w GROUP BY evidence_id")
def page_tokens(spark, sf_dir):
    """Tokens of page words: ligatures spelt out, no soft hyphens, case folded."""
    c = F.col("text")
    for a, b in _LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    tokens = F.regexp_extract_all(F.replace(T.casefold(c), F.lit("\xad"), F.lit("")), F.lit(T.RUN), F.lit(0))
    rows = geometry.page_words(spark, sf_dir, "evidence_id", "text").select("evidence_id", F.size(tokens).alias("n"))
    return rows.groupBy("evidence_id").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 1).alias("split_words"))


_PROTECTED = r"https?://[^\s<>()]+|[A-Za-z0-9._+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_PROTECTED}')) AS spans, length(regexp_replace(text, '{_PROTECTED}', '⟦P⟧', 'g')) AS characters FROM documents WHERE regexp_matches(text, '{_PROTECTED}')")
def protected_spans(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text").where(F.col("text").rlike(_PROTECTED))
    return rows.select("doc_id", F.regexp_count("text", F.lit(_PROTECTED)).alias("spans"), F.length(F.regexp_replace("text", _PROTECTED, "⟦P⟧")).alias("characters"))


@query(f"""WITH {_PAIRS}, {_LINES}, a AS (SELECT id_a, id_b, {_NORM.format('unit_text')} AS t, count(*) AS n FROM p JOIN lines ON doc_id = id_a GROUP BY ALL), b AS (SELECT id_a, id_b, {_NORM.format('unit_text')} AS t, count(*) AS n FROM p JOIN lines ON doc_id = id_b GROUP BY ALL)
  SELECT a.id_a, a.id_b, count(*) AS matches FROM a JOIN b ON a.id_a = b.id_a AND a.id_b = b.id_b AND a.t = b.t WHERE a.n = 1 AND b.n = 1 AND a.t <> '' GROUP BY ALL""")
def unique_matches(spark, sf_dir):
    """Lines of neighbours that match exactly one line of each other."""
    p = pairs(spark, sf_dir)

    def side(c: str):
        return p.select("id_a", "id_b", F.explode(F.split(c, "\n")).alias("line")).select("id_a", "id_b", T.normalized("line").alias("t")).where("t <> ''").groupBy("id_a", "id_b", "t").agg(F.count("*").alias("n")).where("n = 1").drop("n")

    return side("text_a").join(side("text_b"), ["id_a", "id_b", "t"]).groupBy("id_a", "id_b").agg(F.count("*").alias("matches"))


@query(f"SELECT d.doc_id, b.book_id FROM documents d JOIN books b ON d.book_id = b.book_id WHERE contains({_NORM.format('d.text')}, {_NORM.format('split_part(b.title, chr(58), 1)')})")
def guard_phrases(spark, sf_dir):
    """Documents that hold the first part of their book's title, both normalised."""
    books = table(spark, sf_dir, "books", "book_id", T.normalized(F.split_part(F.col("title"), F.lit(":"), F.lit(1))).alias("phrase"))
    return documents(spark, sf_dir, "doc_id", "book_id", "text").join(books, "book_id").where(F.contains(T.normalized("text"), F.col("phrase"))).select("doc_id", "book_id")


@query(f"""WITH {_UNITS}, h AS (SELECT *, sum(CASE WHEN regexp_full_match(kind, 'h[1-6]') THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS g FROM u), t AS (SELECT job_kind, job_id, g, unit_id FROM h WHERE regexp_full_match(kind, 'h[1-6]'))
  SELECT h.unit_key, t.unit_id AS heading FROM h LEFT JOIN t ON h.job_kind = t.job_kind AND h.job_id = t.job_id AND h.g = t.g WHERE NOT regexp_full_match(h.kind, 'h[1-6]')""")
def nearest_headings(spark, sf_dir):
    """The heading each unit stands under: the nearest before it in its job."""
    is_heading = F.col("kind").rlike("^h[1-6]$")
    rows = windows.running_sum(units.job_units(spark, sf_dir, "unit_id", "kind"), ["job_kind", "job_id"], "unit_no", F.when(is_heading, 1).otherwise(0), "g")
    heads = rows.where(is_heading).select("job_kind", "job_id", "g", F.col("unit_id").alias("heading"))
    return rows.where(~is_heading).join(heads, ["job_kind", "job_id", "g"], "left").select("unit_key", "heading")


_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Devanagari", "Thai", "Han")


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '\\p{{{s}}}')) AS {s.lower()}" for s in _SCRIPTS) + " FROM documents")
def script_counts(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", *[F.regexp_count("text", F.lit(f"\\p{{Is{s}}}")).alias(s.lower()) for s in _SCRIPTS])


@query()
def style_penalty(spark, sf_dir):
    """Canned phrases, dense dashes, colons and semicolons, and repeated beginnings."""
    rows = documents(spark, sf_dir, "doc_id", "text")
    words = F.size(T.style_words("text"))
    dense = sum((F.when((n >= 3) & (n > 0.025 * words), n - 2).otherwise(0) for n in (F.regexp_count("text", F.lit(p)) for p in "—:;")), F.lit(0))
    own = rows.select("doc_id", (quality.canned_phrases("text") + dense).alias("own"))
    starts = quality.style(rows, "doc_id", "text").select("doc_id", "repeated_beginnings")
    return own.join(starts, "doc_id", "left").select("doc_id", (F.col("own") + F.coalesce("repeated_beginnings", F.lit(0))).alias("penalty"))


@query(f"""WITH {_PAGE_LINES}, c AS (SELECT evidence_id, round(x0, 1) AS left_edge, count(*) AS lines FROM l GROUP BY ALL), s AS (SELECT *, sum(lines) OVER (PARTITION BY evidence_id) AS total FROM c)
  SELECT evidence_id, left_edge, lines, round(lines / total, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY lines DESC, left_edge) = 1""")
def page_left_edges(spark, sf_dir):
    """Most frequent left edge of a file's lines and its share."""
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "x0")
    lines = words.groupBy(*geometry.LINE).agg(F.min("x0").alias("x0"))
    each = lines.groupBy("evidence_id", F.round("x0", 1).alias("left_edge")).agg(F.count("*").alias("lines"))
    best = each.groupBy("evidence_id").agg(F.max_by(F.struct("left_edge", "lines"), F.struct("lines", -F.col("left_edge"))).alias("b"), F.sum("lines").alias("total"))
    return best.select("evidence_id", "b.left_edge", "b.lines", F.round(F.col("b.lines") / F.col("total"), 6).alias("share"))


@query(f"""WITH {_PAGE_LINES} SELECT evidence_id, page_number, line_no, sum(length(text)) AS characters, sum(CASE WHEN bold THEN length(text) ELSE 0 END) AS bold_characters FROM w GROUP BY ALL HAVING sum(CASE WHEN bold THEN length(text) ELSE 0 END) >= 0.75 * sum(length(text))""")
def bold_lines(spark, sf_dir):
    """Lines of which three quarters or more are bold."""
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "text", "bold")
    rows = words.groupBy(*geometry.LINE).agg(F.sum(F.length("text")).alias("characters"), F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("bold_characters"))
    return rows.where(F.col("bold_characters") >= 0.75 * F.col("characters"))


@query(f"""WITH {_PAGE_LINES} SELECT word_id, coalesce(font_family, first_value(font_family IGNORE NULLS) OVER (PARTITION BY evidence_id, page_number, line_no ORDER BY word_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(font_family IGNORE NULLS) OVER (PARTITION BY evidence_id, page_number, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS family FROM w""")
def filled_families(spark, sf_dir):
    """Missing font families from the next word of the line that has one, else from the last before."""
    w = Window.partitionBy(*geometry.LINE).orderBy("word_no")
    after = F.first("font_family", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last("font_family", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return geometry.page_words(spark, sf_dir, *geometry.LINE, "word_no", "font_family").select("word_id", F.coalesce("font_family", after, before).alias("family"))


@query(f"""WITH {_UNITS}, r AS (SELECT *, sum(CASE WHEN kind <> 'li' THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS g FROM u) SELECT job_kind, job_id, min(unit_no) AS first_unit, count(*) AS items FROM r WHERE kind = 'li' GROUP BY job_kind, job_id, g""")
def list_runs(spark, sf_dir):
    """Lists: items that follow each other in a job."""
    rows = windows.running_sum(units.job_units(spark, sf_dir, "kind"), ["job_kind", "job_id"], "unit_no", F.when(F.col("kind") != "li", 1).otherwise(0), "g")
    return rows.where("kind = 'li'").groupBy("job_kind", "job_id", "g").agg(F.min("unit_no").alias("first_unit"), F.count("*").alias("items")).drop("g")


@query(f"WITH {_UNITS} SELECT job_kind, kind, min(unit_key) AS first_key, max_by(unit_id, unit_key) AS last_value FROM u GROUP BY ALL")
def first_place_last_value(spark, sf_dir):
    """By key, the place of its first row and the value of its last."""
    return units.job_units(spark, sf_dir, "unit_id", "kind").groupBy("job_kind", "kind").agg(F.min("unit_key").alias("first_key"), F.max_by("unit_id", "unit_key").alias("last_value"))


@query()
def draft_spans(spark, sf_dir):
    """Spans of at most 300 characters for speech."""
    return documents(spark, sf_dir, "doc_id", F.posexplode(spans.spans(F.col("text"))).alias("i", "s")).select("doc_id", "i", "s.start", "s.end")


@query("""SELECT doc_id, instr(text, 'the ') AS first_at, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS INTEGER) AS times, CASE WHEN (length(text) - length(replace(text, 'the ', ''))) / 4 = 0 THEN 'missing' WHEN (length(text) - length(replace(text, 'the ', ''))) / 4 = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM documents""")
def located_text(spark, sf_dir):
    """Whether a piece of text is missing, unique or ambiguous in each document, and where it first stands."""
    times = ((F.length("text") - F.length(F.replace("text", F.lit("the "), F.lit("")))) / 4).cast("int")
    return documents(spark, sf_dir, "doc_id", F.instr("text", "the ").alias("first_at"), times.alias("times"), F.when(times == 0, "missing").when(times == 1, "unique").otherwise("ambiguous").alias("state"))


@query(f"""WITH {_JOBS}, b AS (SELECT job_id, bool_or(html IS NOT NULL) AS built FROM keep_jobs GROUP BY job_id) SELECT j.job_id, CASE WHEN b.built AND status = 'ready_to_build' THEN 'built' WHEN status = 'ready_to_build' THEN 'ready_to_build' WHEN remaining = 0 AND done = batches THEN 'draft_required'
  WHEN remaining = 0 THEN 'synthesis_required' ELSE 'analysis_required' END AS state FROM j JOIN b ON j.job_id = b.job_id""")
def job_states(spark, sf_dir):
    built = table(spark, sf_dir, "keep_jobs", "job_id", "html").groupBy("job_id").agg(F.bool_or(F.col("html").isNotNull()).alias("has_html"))
    j = _keep_jobs(spark, sf_dir).join(built, "job_id")
    ready = F.col("status") == "ready_to_build"
    return j.select("job_id", contracts.job_state(F.col("remaining") == 0, F.col("done") == F.col("batches"), ready, ready & F.col("has_html")).alias("state"))


@query(f"WITH {_JOBS} SELECT status, count(*) AS jobs, count(*) FILTER (remaining > 0) AS open, sum(batches) AS batches, max(units) AS most_units FROM j GROUP BY status")
def status_counts(spark, sf_dir):
    return _keep_jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("jobs"), F.count_if(F.col("remaining") > 0).alias("open"), F.sum("batches").alias("batches"), F.max("units").alias("most_units"))


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, line_no, CAST(floor(length(unit_text) / 15.0 * 1000 + 0.5) AS BIGINT) AS f FROM lines), e AS (SELECT doc_id, line_no, CAST(sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS ms FROM b)
  SELECT doc_id, line_no, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS ends FROM e""")
def caption_times(spark, sf_dir):
    """End of each line's caption, read at 15 characters a second."""
    rows = units.document_lines(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "line_no", F.floor(F.length("unit_text") / 15.0 * 1000 + 0.5).alias("f"))
    out = windows.running_sum(rows, ["doc_id"], "line_no", F.col("f"), "ms").withColumn("ms", F.col("ms").cast("long"))
    part = lambda d, m: F.floor(F.col("ms") / d) % m if m else F.floor(F.col("ms") / d)
    return out.select("doc_id", "line_no", F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), F.col("ms") % 1000).alias("ends"))


_PHRASES = {"page": 1, "chapter": 2, "archive": 3, "index": 1, "map": 1}


@query("SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in _PHRASES.items()) + " AS score FROM documents WHERE " + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in _PHRASES.items()) + " > 2")
def phrase_scores(spark, sf_dir):
    """Documents by the weights of phrases they hold, above two."""
    low = F.lower("text")
    return documents(spark, sf_dir, "doc_id", sum((F.when(F.contains(low, F.lit(p)), w).otherwise(0) for p, w in _PHRASES.items()), F.lit(0)).alias("score")).where("score > 2")


@query(f"""WITH {_UNITS} SELECT job_kind, job_id, count(*) FILTER (reuse_of IS NULL) AS requests, coalesce(sum(length(source)) FILTER (reuse_of IS NULL), 0) AS characters FROM u GROUP BY ALL""")
def request_bounds(spark, sf_dir):
    """Requests and characters a job can cost at most: those of its units that repeat no other."""
    fresh = F.col("reuse_of").isNull()
    rows = units.job_units(spark, sf_dir, "source", "reuse_of")
    return rows.groupBy("job_kind", "job_id").agg(F.count_if(fresh).alias("requests"), F.coalesce(F.sum(F.when(fresh, F.length("source"))), F.lit(0)).alias("characters"))


@query(rf"""WITH {_UNITS} SELECT unit_key, regexp_full_match(trim(plain_text), '[\d\s.,;:()–-]+') AS is_label, regexp_matches(lower(plain_text), 'copyright|all rights reserved|isbn|©') AS is_legal FROM u WHERE regexp_full_match(trim(plain_text), '[\d\s.,;:()–-]+') OR regexp_matches(lower(plain_text), 'copyright|all rights reserved|isbn|©')""")
def verify_only_units(spark, sf_dir):
    """Units not to be rewritten: page labels and legal matter."""
    label, legal = F.trim("plain_text").rlike("^[\\d\\s.,;:()–-]+$"), F.lower("plain_text").rlike("copyright|all rights reserved|isbn|©")
    return units.job_units(spark, sf_dir, "plain_text").where(label | legal).select("unit_key", label.alias("is_label"), legal.alias("is_legal"))


_CHECKED = f"""p2 AS (SELECT id_a, id_b, len(regexp_extract_all(text_a, '\\p{{L}}')) AS a, len(regexp_extract_all(text_b, '\\p{{L}}')) AS b, {_NORM.format('text_a')} AS na, {_NORM.format('text_b')} AS nb FROM p),
  f AS (SELECT id_a, id_b, 'error' AS severity, 'untranslated-content' AS category FROM p2 WHERE na = nb AND a >= 30 UNION ALL SELECT id_a, id_b, 'warning', 'translation-length' FROM p2 WHERE a > 0 AND (b / a < 0.45 OR b / a > 2.2))"""


@query(f"WITH {_PAIRS}, {_CHECKED} SELECT id_a, id_b, CASE WHEN bool_or(severity = 'error') THEN 'failed' ELSE 'passed_with_warnings' END AS status, count(*) AS findings FROM f GROUP BY ALL")
def pair_reports(spark, sf_dir):
    """Neighbours that are the same or of very different length, and the status that gives."""
    rows = pairs(spark, sf_dir).select("id_a", "id_b", T.letters("text_a").alias("a"), T.letters("text_b").alias("b"), (T.normalized("text_a") == T.normalized("text_b")).alias("same"))
    same, length = F.col("same") & (F.col("a") >= 30), (F.col("a") > 0) & ((F.col("b") / F.col("a") < 0.45) | (F.col("b") / F.col("a") > 2.2))
    rows = rows.where(same | length)
    return rows.select("id_a", "id_b", F.when(same, "failed").otherwise("passed_with_warnings").alias("status"), (same.cast("long") + length.cast("long")).alias("findings"))


@query(f"""WITH {_UNITS}, x AS (SELECT unit_key, job_kind, job_id, unit_no, length(source) AS n FROM u), s AS (SELECT job_kind, job_id, max(n) AS longest, count(*) AS units FROM x GROUP BY ALL)
  SELECT job_kind, CASE WHEN longest > 4000 THEN 'over' ELSE 'within' END AS size, count(*) AS jobs, sum(units) AS units FROM s GROUP BY ALL""")
def size_classes(spark, sf_dir):
    rows = units.job_units(spark, sf_dir, "source").groupBy("job_kind", "job_id").agg(F.max(F.length("source")).alias("longest"), F.count("*").alias("units"))
    return rows.groupBy("job_kind", F.when(F.col("longest") > batching.MAX_CHARS // 8, "over").otherwise("within").alias("size")).agg(F.count("*").alias("jobs"), F.sum("units").alias("units"))


_HEADING_KEY = "regexp_replace(regexp_replace(" + _FOLD.format("{}") + ", '^[ .:;—–-]+|[ .:;—–-]+$', '', 'g'), '^ | $', '', 'g')"


@query(f"""WITH {_UNITS}, h AS (SELECT *, sum(CASE WHEN regexp_full_match(kind, 'h[1-6]') THEN 1 ELSE 0 END) OVER (PARTITION BY job_kind, job_id ORDER BY unit_no) AS g FROM u), t AS (SELECT job_kind, job_id, g, {_HEADING_KEY.format('plain_text')} AS k FROM h WHERE regexp_full_match(kind, 'h[1-6]'))
  SELECT h.job_kind, h.job_id, count(*) AS units, count(*) FILTER (regexp_full_match(t.k, '(?:selected )?(?:bibliography|references|bibliografie|referințe|cuprins|contents|table of contents)')) AS skipped FROM h LEFT JOIN t ON h.job_kind = t.job_kind AND h.job_id = t.job_id AND h.g = t.g GROUP BY ALL""")
def skipped_units(spark, sf_dir):
    """Units under a heading of contents or references, up to the next heading."""
    is_heading = F.col("kind").rlike("^h[1-6]$")
    rows = windows.running_sum(units.job_units(spark, sf_dir, "kind", "plain_text"), ["job_kind", "job_id"], "unit_no", F.when(is_heading, 1).otherwise(0), "g")
    heads = rows.where(is_heading).select("job_kind", "job_id", "g", T.heading_key("plain_text").alias("k"))
    both = rows.select("job_kind", "job_id", "g").join(heads, ["job_kind", "job_id", "g"], "left")
    skip = F.col("k").rlike(f"^(?:selected )?(?:{'|'.join(units.SKIPPED)})$")
    return both.groupBy("job_kind", "job_id").agg(F.count("*").alias("units"), F.count_if(skip).alias("skipped"))


@query(f"""WITH {_PAGE_LINES}, o AS (SELECT evidence_id, round(bottom, 1) AS bottom, row_number() OVER (PARTITION BY evidence_id ORDER BY round(bottom, 1)) - 1 AS i, count(*) OVER (PARTITION BY evidence_id) AS n FROM (SELECT evidence_id, page_number, max(bottom) AS bottom FROM l GROUP BY ALL))
  SELECT evidence_id, max(n) AS pages, max(bottom) FILTER (i = floor((n - 1) * 0.95)) AS bottom_p95, max(bottom) FILTER (i = n // 2) AS bottom_median FROM o GROUP BY evidence_id""")
def page_bottoms(spark, sf_dir):
    """Where pages of a file end: the middle one and the 95th of a hundred."""
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "bottom")
    ends = words.groupBy("evidence_id", "page_number").agg(F.round(F.max("bottom"), 1).alias("bottom"))
    ranked = geometry.ranked_values(ends, ["evidence_id"], "bottom")
    at = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("upto")), F.col("bottom")))
    n = F.col("total")
    return ranked.groupBy("evidence_id").agg(F.max(n).alias("pages"), at(F.floor((n - 1) * 0.95)).alias("bottom_p95"), at(F.floor(n / 2)).alias("bottom_median"))


@query(f"""WITH {_PAGE_LINES} SELECT evidence_id, page_number, count(*) AS lines, max(size_pt) AS largest FROM l GROUP BY ALL HAVING count(*) BETWEEN 3 AND 14 AND max(size_pt) >= 18""")
def display_pages(spark, sf_dir):
    """Pages like a title's: few lines, one of them large."""
    words = geometry.page_words(spark, sf_dir, *geometry.LINE, "size_pt")
    pages_ = words.groupBy("evidence_id", "page_number").agg(F.count_distinct("line_no").alias("lines"), F.max("size_pt").alias("largest"))
    return pages_.where(F.col("lines").between(3, 14) & (F.col("largest") >= 18))
