import difflib
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import unicode as U
from leafmill.operators import alignment, batching, findings, geometry, memory, pages, quality, ranking, timeline, units, windows
from leafmill.sources import deduplicate, shared_checkpoint


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text, n", [("One — two. Three well-known words.", 5), ("", 0), ("l’art d'or x1 2024", 4), ("数字 и слово", 3)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count("t"), t=text) == n


def test_words_touch_no_digits(spark):
    assert one(spark, T.words("t"), t="abc a1 _x été 7") == ["abc", "été"]


def test_compact_unicode_spaces(spark):
    assert one(spark, T.compact("t"), t="  a　 b\t\nc﻿") == "a b c"


@pytest.mark.parametrize("text, n", [("One sentence. Another question? Final answer!", 3), ("No end", 0), ("A. tail", 1)])
def test_sentences_closed(spark, text, n):
    assert len(one(spark, T.sentences_closed("t"), t=text)) == n


def test_fact_tokens(spark):
    facts = one(spark, T.fact_tokens("t"), t="See https://a.example/x, mail a.b@c.org; 10.1000/ABC and -12.5 % of 3km, é12.")
    assert {"https://a.example/x", "a.b@c.org", "-12.5 %", "3km"} <= set(facts) and "12" not in facts


@pytest.mark.parametrize("tag, want", [("ro_ro", "ro-RO"), ("und", None), ("en-Latn-US", "en-Latn-US"), ("RO-ro", "ro-RO"), ("", None), (None, None), ("12", None)])
def test_language_tag(spark, tag, want):
    df = spark.createDataFrame([(tag,)], "t string")
    assert df.select(T.language_tag("t")).first()[0] == want


@pytest.mark.parametrize("words, target", [(5000, 275), (5001, 425), (20000, 425), (20001, 600)])
def test_budget(spark, words, target):
    assert one(spark, T.budget("w"), w=words)["target"] == target


@pytest.mark.parametrize("text, key", [("Chapter 4: x", "chapter-4"), ("Volumul ii", "volume-ii"), ("Appendix B", "appendix-b"), ("LATTICE-2307 log", "code-lattice-2307"), ("12. Intro", "numbered-12"), ("Nothing", None)])
def test_marker_key(spark, text, key):
    assert one(spark, T.marker_key("t"), t=text) == key


def test_round_half_up(spark):
    assert one(spark, T.round_half_up("v"), v=-2.5) == -2.0


def test_utf16_length(spark):
    assert one(spark, T.utf16_length("t"), t="a😀b") == 4


def test_escape_html(spark):
    assert one(spark, T.escape_html("t"), t="<a b=\"c\">&'") == "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;"


@pytest.mark.parametrize("a, b, want", [("abcde", "abXde", 0.8), ("tide", "diet", 0.25), ("😀abc", "😀axc", 0.75)])
def test_similarity(spark, a, b, want):
    assert one(spark, U.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_similarity_nulls(spark):
    assert spark.createDataFrame([(None, "x")], "a string, b string").select(U.similarity(F.col("a"), F.col("b"))).first()[0] is None


def test_matching_blocks(spark):
    got = one(spark, U.matching_blocks(F.split("a", " "), F.split("b", " ")), a="a b c d", b="x b c y d")
    assert [tuple(x) for x in got] == [tuple(m) for m in difflib.SequenceMatcher(None, "abcd", "xbcyd", autojunk=False).get_matching_blocks()[:-1]]


def test_normal_form(spark):
    assert one(spark, U.normal_form(F.col("t")), t="é") == "é"


def test_running_sum_blocks(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r["g"], r["i"]): r["s"] for r in windows.running_sum(df, ["g"], "i", F.col("v"), "s", block=7).collect()}
    for g in ("a", "b", None):
        total = 0
        for i in range(50):
            total += i % 5
            assert got[g, i] == total


def test_neighbours_over_blocks(spark):
    df = spark.createDataFrame([(g, i, f"{g}{i}") for g in "ab" for i in range(0, 60, 3)], "g string, i long, v string")
    got = {r["v"]: (r["p"], r["n"]) for r in windows.neighbours(df, ["g"], "i", "v", "p", "n", block=10).collect()}
    for g in "ab":
        own = [f"{g}{i}" for i in range(0, 60, 3)]
        for x, y, z in zip([None, *own], own, [*own[1:], None]):
            assert got[y] == (x, z)


def brute_pack(rule, sizes, limit, pages_=None, chapters=None):
    out, batch, size, open_, page = [], 1, 0, False, None
    if rule == "two_level":
        chunks, chunk, n, last = [], [], 0, object()
        for i, s in enumerate(sizes):
            if chunk and (chapters[i] != last or n + s > limit):
                chunks.append(chunk)
                chunk, n = [], 0
            chunk.append(i)
            n, last = n + s, chapters[i]
        if chunk:
            chunks.append(chunk)
        out = [0] * len(sizes)
        for c in chunks:
            s = sum(sizes[i] for i in c)
            if open_ and size + s > limit:
                batch, size = batch + 1, 0
            size, open_ = size + s, True
            for i in c:
                out[i] = batch
        return out
    for i, s in enumerate(sizes):
        turn = {"simple": True, "oversize": s <= limit, "paged": page is not None and pages_[i] != page}[rule]
        if open_ and size + s > limit and turn:
            batch, size, open_ = batch + 1, 0, False
        out.append(batch)
        size, open_, page = size + s, True, pages_[i] if pages_ else None
        if rule == "oversize" and size > limit:
            batch, size, open_ = batch + 1, 0, False
    return out


@pytest.mark.parametrize("rule", ["simple", "oversize", "paged", "two_level"])
def test_pack(spark, rule):
    rng = random.Random(rule)
    rows = []
    for g in range(4):
        page = chapter = 1
        for i in range(60):
            page += rng.random() < 0.3
            chapter += rng.random() < 0.15
            rows.append((g, i, rng.choice([5, 20, 60, 130]), page, chapter))
    df = spark.createDataFrame(rows, "g long, i long, n long, page long, chapter long")
    got = {(r["g"], r["i"]): r["batch_no"] for r in batching.pack(df, ["g"], "i", "n", rule, 100, page="page", chapter="chapter").collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        assert [got[g, i] for i in range(60)] == brute_pack(rule, [r[2] for r in own], 100, [r[3] for r in own], [r[4] for r in own])


def test_pack_empty_and_null_sizes(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5)], "g long, i long, n long")
    assert batching.pack(df, ["g"], "i", "n", "simple", 3).count() == 2
    assert batching.pack(df.limit(0), ["g"], "i", "n", "two_level", 3, chapter="g").count() == 0


def test_exact_copies_and_resolution(spark):
    rows = [(1, "keep", 1, 1, "u1", "p", "Same"), (2, "keep", 1, 2, "u2", "p", "Other"), (3, "keep", 1, 3, "u3", "p", "Same"), (4, "keep", 2, 1, "u1", "p", "Same")]
    df = spark.createDataFrame(rows, "unit_key long, job_kind string, job_id long, unit_no int, unit_id string, kind string, source string")
    df = df.withColumn("placeholders", F.lit(None).cast("map<string,string>")).withColumn("protections", F.lit(None).cast("map<string,string>"))
    assert {r["unit_key"]: r["first_unit"] for r in memory.exact_copies(df).collect()} == {1: None, 2: None, 3: "u1", 4: None}


def test_templated_labels(spark):
    rows = [(i, "ar", 1, i, f"u{i}", "attribute:alt", f"Page {i}") for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "unit_key long, job_kind string, job_id long, unit_no int, unit_id string, kind string, source string")
    assert {r["unit_key"]: r["template_of"] for r in memory.templated_labels(df).collect()} == {2: "u1", 3: "u1"}


def test_style(spark):
    text = "The cat sat here. The cat ran off. The cat came back. A dog barked loudly."
    r = quality.style(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").first()
    assert (r["sentences"], r["repeated_beginnings"], r["variation"]) == (4, 1, None)


def test_token_coverage(spark):
    df = spark.createDataFrame([(1, "a b a c", "c a b")], "id long, x string, y string")
    r = quality.token_coverage(df, "x", "y", ["id"]).first()
    assert r["coverage"] == 0.75 and r["order_share"] == pytest.approx(1 / 3)


def test_grid_coverage(spark):
    cells = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 2, 1, 1, 1), (1, 1, 2, 1, 1)], "table_id long, row long, col long, rowspan long, colspan long")
    assert {(r["r"], r["c"], r["times"]) for r in geometry.grid_coverage(cells).collect()} == {(1, 2, 2), (2, 2, 0)}


def test_word_groups(spark):
    rows = [(i, 1, 1, 1, i, 10.0 * i, 10.0 * i + 8 + (i == 3) * -6, False, False) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "word_id long, evidence_id long, page_number int, line_no int, word_no int, x0 double, x1 double, bold boolean, italic boolean")
    assert sorted((r["word_id"], r["group_no"]) for r in geometry.word_groups(df, 6).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_timeline(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "k long, i long, s double")
    assert [(r["start_frame"], r["end_frame"]) for r in timeline.sequential(df, "k", "i", "s").orderBy("i").collect()] == [(0, 48000), (48000, 72000)]


def test_anchored_timeline(spark):
    rows = [(1, "a", None, 3), (1, "b", "a", 4), (1, "c", "b", 5), (1, "x", "y", 1), (1, "y", "x", 1), (1, "z", "gone", 1), (1, "w", "z", 1)]
    df = spark.createDataFrame(rows, "k long, beat string, anchor string, n long")
    got = {r["beat"]: r["start"] for r in timeline.anchored(df, ["k"], "beat", "anchor", "n", most=4).collect()}
    assert got == {"a": 0, "b": 3, "c": 7, "x": None, "y": None, "z": None, "w": None}


def test_first_mismatch():
    assert alignment.first_mismatch("a b c".split(), "a b c".split()) is None
    assert alignment.first_mismatch("ex termination here".split(), "extermination here".split(), frozenset({"extermination"})) is None
    assert alignment.first_mismatch("ex termination here".split(), "extermination here".split()) == (0, 0)
    assert alignment.first_mismatch([], ["a"]) == (0, 0)


def test_align_merges():
    assert alignment.align([10, 10, 30], [20, 30]) == [(0, 2, 0, 1), (2, 1, 1, 1)]
    assert alignment.align([], [5]) == [(0, 0, 0, 1)]


def test_patch_once(spark):
    df = spark.createDataFrame([("a b",), ("b b",), (None,)], "t string")
    assert [r[0] for r in df.select(pages.patch_once("t", "b", "c")).collect()] == ["a c", None, None]


def test_top_sentences(spark):
    df = spark.createDataFrame([(1, "Apples are tasty apples. Short one. Apples grow on apple trees here.")], "id long, t string")
    assert [r["pos"] for r in ranking.top_sentences(df, "id", "t", k=1).collect()] == [0]
    assert ranking.top_sentences(df.limit(0), "id", "t").count() == 0


def test_findings(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, n long")
    f = findings.union([findings.finding(df, F.col("n").isNull(), "warning", "none", F.col("id"), F.lit("x"))])
    assert findings.status(f).first()["status"] == "passed_with_warnings"
    assert findings.status(f.limit(0)).first()["status"] == "passed"
    assert findings.grouped(f).first()["examples"] == "1"


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (None, "b", 1)], "id long, v string, received_at long")
    assert sorted(deduplicate(df, ["id"]).collect(), key=str) == sorted(df.where("received_at = 1").collect(), key=str)


def test_checkpoint(spark):
    assert shared_checkpoint(spark.range(3)).count() == 3


def test_chapter_reasons(spark):
    rows = [(1, "keep", 1, 1, "h1", "Contents"), (2, "keep", 1, 2, "p", "a " * 90), (3, "keep", 1, 3, "h1", "References"), (4, "keep", 1, 4, "p", "b " * 90), (5, "keep", 1, 5, "h1", "Real"), (6, "keep", 1, 6, "p", "c " * 90)]
    df = spark.createDataFrame(rows, "unit_key long, job_kind string, job_id long, unit_no int, kind string, plain_text string")
    got = [r["reason"] for r in units.chapter_table(units.assign_chapters(df)).orderBy("chapter").collect()]
    assert got == ["contents", "bibliography", None]


def test_draft_spans():
    from leafmill.operators.spans import distribute, draft_spans

    text = "One. " + "word " * 100 + "end. Tail"
    got = draft_spans(text, 60)
    assert all(b - a <= 60 for a, b in got) and " ".join(text[a:b] for a, b in got).split() == text.split()
    assert draft_spans(None) == [] == draft_spans("")
    assert [len(x) for x in distribute(list("abcdef"), [1, 2, 3])] == [1, 2, 3] and distribute(["a"], [0, 0]) == [["a"], []]


def test_contracts(spark):
    from leafmill.operators import contracts as C

    scores = spark.createDataFrame([("ok", 0.8, 0.4, 0.6, 0.65), ("off", 0.8, 0.4, 0.6, 0.7), ("out", 1.2, 0.4, 0.6, 0.65), ("null", None, 0.4, 0.6, 0.65)], "id string, centrality double, recurrence double, originality double, score double")
    assert {(r["location"], r["category"]) for r in C.score_findings(scores, "id").collect()} == {("off", "score-sum"), ("out", "score-range"), ("null", "score-range")}
    cited = spark.createDataFrame([("a", ["u1"]), ("b", ["u9"]), ("c", [])], "id string, ids array<string>")
    allowed = spark.createDataFrame([("u1",)], "u string")
    assert {(r["location"], r["category"]) for r in C.id_findings(cited, "id", "ids", allowed, "u").collect()} == {("b", "unknown-id"), ("c", "no-source")}
    lists = spark.createDataFrame([("a", ["x", "y"], ["x", "y"]), ("b", ["y", "x"], ["x", "y"]), ("c", ["x"], ["x", "y"])], "id string, got array<string>, want array<string>")
    assert {(r["location"], r["category"]) for r in C.order_findings(lists, "id", "got", "want").collect()} == {("b", "order"), ("c", "coverage")}
    terms = spark.createDataFrame([("g", "A"), ("g", "a "), ("g", "x,y"), ("g", "")], "g string, t string")
    assert sorted(r["category"] for r in C.term_findings(terms, "g", "t").collect()) == ["term-form", "term-form", "term-repeated"]
