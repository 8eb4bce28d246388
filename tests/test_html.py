"""Pages as units and chapters, on literal pages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import alignment, html
from leafmill.plans.registry import QUERIES, SQL


def units(page):
    return [(u["kind"], u["text"], u["chapter_id"]) for u in html.page_units(page)]


def test_content_root_and_what_is_left_out():
    page = """<!doctype html><html lang=en><head><title>T</title><style>p{}</style></head><body><p>outside</p><main><p>other</p></main>
    <main data-reader-content><nav><p>menu</p></nav><h1 id=a>One &amp; two</h1><p>First <b>bold</b>
    text.<p hidden>no<p aria-hidden=true>no<p translate=no>no<ul><li>item<li>see <code>x</code><ul><li>inner</ul></ul><pre>code</pre>
    <blockquote><p>quoted</p></blockquote><p>...</p><script>'<p>no</p>'</script><table><tr><th>head<td>cell</table><h1>Next</h1><p>Last"""
    assert units(page) == [
        ("h1", "One & two", "chapter-0001"), ("p", "First bold text.", "chapter-0001"), ("li", "item", "chapter-0001"), ("li", "inner", "chapter-0001"), ("p", "quoted", "chapter-0001"), ("th", "head", "chapter-0001"), ("td", "cell", "chapter-0001"), ("h1", "Next", "chapter-0002"), ("p", "Last", "chapter-0002"),
    ]
    assert html.page_units(page)[0]["anchor"] == "a" == html.page_units(page)[1]["chapter_anchor"]


def test_chapters_by_section_or_document():
    page = "<html><body><p>Before.</p><section><h2 id=s>First</h2><p>One.</p></section><article class='source-copyright'><p>All rights.</p></article></body></html>"
    got = html.page_units(page)
    assert [(u["text"], u["chapter_id"], u["chapter_title"], u["told_reason"]) for u in got] == [("Before.", "front-matter", "Front matter", None), ("First", "chapter-0001", "First", None), ("One.", "chapter-0001", "First", None), ("All rights.", "chapter-0002", "Section 2", "legal-or-metadata")]
    assert {u["chapter_id"] for u in html.page_units("<html><body><h3>Title</h3><p>Text.</p></body></html>")} == {"document"}


@pytest.mark.parametrize("page", [None, "", "<p>no document</p>", "<html><body></body></html>", "<html><body><p>...</p></body></html>"])
def test_pages_without_units(page):
    assert html.page_units(page) == []


def test_extraction_edges(spark):
    words = "word " * 100
    rows = [(1, f"<html><body><h1>Contents</h1><p>{words}</p><h1>Œuvre</h1><p>{words}</p><h1>References</h1><p>{words}</p></body></html>"), (2, None), (3, "<html><body>" + "<div>" * 3000 + "<p>deep</p>"), (4, "<html><body>" + "<p>x</p>" * 20_000), (1, "<html><body><p>again")]
    df = spark.createDataFrame(rows, "unit_no long, page string")
    got = html.extract_units(df.withColumnRenamed("unit_no", "id"), "id", "page")
    assert got.groupBy("id").count().where("id = 4").first()["count"] == 20_000 and got.where("id = 3").first()["text"] == "deep" and got.where("id = 2").count() == 0
    chapters = html.extract_chapters(html.extract_units(df.withColumnRenamed("unit_no", "id").limit(1), "id", "page"), "id")
    assert [(r["chapter_title"], r["reason"]) for r in chapters.orderBy("chapter_no").collect()] == [("Contents", "contents"), ("Œuvre", None), ("References", "bibliography")]
    assert html.extract_units(df.limit(0).withColumnRenamed("unit_no", "id"), "id", "page").count() == 0


def test_running_and_marker_keys(spark):
    lines = ["A Long Title · 6", "A Long  Title · 7", "A Long Title | 8", "Sho · 9", "No number", "1 . Title", None]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r[0] for r in df.select(T.running_key("t")).collect()] == ["alongtitle"] * 3 + [None] * 4
    assert [r[0] for r in df.select(T.marker_key("t")).collect()] == [None] * 5 + ["numbered-1", None]


def test_unaccented(spark):
    df = spark.createDataFrame([("Însă ORAȘ Čapek ё й ΆΈ が ä", )], "t string")
    assert df.select(T.unaccented("t")).first()[0] == "insa oras capek е и αε か a"


def test_unaccented_sigma_as_in_sql(spark, tmp_path):
    texts = ["ΤΟΡΝΆΚΗΣ: ΖΙΜΠΡΈΛΟΣ:", "Ο ΣΊΣΥΦΟΣ, Σ. ΣΑΣ ΣΣ", "οδός ς σ", "İΣ", "ΟΔΟΣ\u0301 ΑΣ’", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(SQL["unaccented_text"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(tuple(r) for r in QUERIES["unaccented_text"](spark, str(tmp_path)).collect()) == sorted(want)
    df = spark.createDataFrame([(texts[0],)], "t string")
    assert df.select(T.unaccented("t")).first()[0] == "τορνακησ: ζιμπρελοσ:"


def brute_align(a, b):
    """Least cost by trying every step from every cell."""
    best = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = [best[i, j]] if (i, j) in best else []
            if i:
                here.append(best[i - 1, j] + alignment.SKIP)
            if j:
                here.append(best[i, j - 1] + alignment.SKIP)
            for k in range(1, alignment.GROUP + 1):
                if i and j >= k:
                    here.append(best[i - 1, j - k] + abs(a[i - 1] - sum(b[j - k : j])) + alignment.SPLIT * (k - 1))
                if j and i >= k:
                    here.append(best[i - k, j - 1] + abs(sum(a[i - k : i]) - b[j - 1]) + alignment.MERGE * (k - 1))
            best[i, j] = min(here)
    return best[len(a), len(b)]


def test_align_against_brute_force():
    import random

    rng = random.Random(7)
    for _ in range(150):
        a, b = ([rng.randrange(1, 6) for _ in range(rng.randrange(9))] for _ in range(2))
        steps = alignment.align(a, b)
        cost = 0.0
        at = (0, 0)
        for i, x, j, y in steps:
            assert (i, j) == at
            at = (i + x, j + y)
            cost += alignment.SKIP if not x or not y else abs(sum(a[i : i + x]) - sum(b[j : j + y])) + (alignment.SPLIT * (y - 1) if x == 1 else alignment.MERGE * (x - 1))
        assert at == (len(a), len(b)) and cost == pytest.approx(brute_align(a, b))


def test_interleaved(spark):
    rows = [([["a", "b"], ["c"]], ["a", "c", "b"]), ([["a"], ["a"]], ["a", "a"]), ([["a"], ["b"]], ["b", "b"]), (None, ["a"]), ([["x"] * 3000, ["y"]], ["x"] * 3000 + ["y"])]
    df = spark.createDataFrame(rows, "c array<array<string>>, t array<string>")
    assert [r[0] for r in df.select(alignment.interleaved(F.col("c"), F.col("t"))).collect()] == [1, 2, 0, None, 1]
