"""HTML pages as units of text and chapters: the content root, what is left out, the innermost text blocks and the chapter of each.

A page is read once, in Arrow batches, into a table of elements with the stretch of text each holds; containment is then a matter of
comparing stretches, so no tree is walked again for each question.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import units as U

#: Elements whose innermost ones are units, and elements that hold no text to work on.
TEXT_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
SKIP_TAGS = frozenset("code kbd math nav pre samp script style svg".split())
_RAW = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins ends these, if they are the innermost open ones: HTML's optional end tags.
_ENDS = {tag: frozenset({"p"}) for tag in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_ENDS |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th", "p"}), "body": frozenset({"head"})}
#: What an optional end doesn't reach over.
_WALLS = frozenset("ul ol dl table div section article main body blockquote figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>|<[!?][^<>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_HEADING = re.compile(r"h[1-6]")
_SPACE = re.compile(r"\s+")


class Element(NamedTuple):
    tag: str
    attrs: dict[str, str]
    parent: int  # place in the table, -1 for none
    start: int  # of its text in the page's text
    end: int
    hidden: bool  # left out, by itself or by an element around it


def read(page: str) -> tuple[list[Element], str]:
    """Elements in the order they begin, and the page's text with references decoded. Markup in raw elements is none; an element left
    open ends with the one around it."""
    tags: list[str] = []
    attrs: list[dict[str, str]] = []
    parents: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    hidden: list[bool] = []
    parts: list[str] = []
    at = pos = 0
    stack: list[int] = []

    def put(raw: str) -> None:
        nonlocal at
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            at += len(text)

    def close(k: int) -> None:
        while len(stack) > k:
            ends[stack.pop()] = at

    while m := _TOKEN.search(page, pos):
        put(page[pos : m.start()])
        pos = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if tags[stack[k]] == tag), None)
            if k is not None:
                close(k)
            continue
        k = len(stack)
        for j in range(len(stack) - 1, -1, -1):
            if tags[stack[j]] in _ENDS.get(tag, ()):
                k = j
            elif tags[stack[j]] in _WALLS:
                break
        close(k)
        own = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m["attrs"])}
        out = tag in SKIP_TAGS or own.get("translate", "").lower() == "no" or own.get("aria-hidden") == "true" or "hidden" in own
        tags.append(tag)
        attrs.append(own)
        parents.append(stack[-1] if stack else -1)
        starts.append(at)
        ends.append(at)
        hidden.append(out or bool(stack) and hidden[stack[-1]])
        if tag in _VOID or m["attrs"].endswith("/") and tag not in TEXT_TAGS and not own.get("href", "").endswith("/"):
            if tag == "br":
                put(" ")
            continue
        stack.append(len(tags) - 1)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if tag != "script" and tag != "style":
                put(page[pos : end.start() if end else len(page)])
            pos = end.end() if end else len(page)
            close(len(stack) - 1)
    put(page[pos:])
    close(0)
    return list(map(Element, tags, attrs, parents, starts, ends, hidden)), "".join(parts)


def compact(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def content_root(elements: list[Element]) -> int | None:
    """The reader's main element, else the first main, else the body."""
    mains = [i for i, e in enumerate(elements) if e.tag == "main"]
    return next((i for i in mains if "data-reader-content" in elements[i].attrs), mains[0] if mains else next((i for i, e in enumerate(elements) if e.tag == "body"), None))


def page_units(page: str | None) -> list[dict]:
    """Units of a page in order: unit_no, kind, text, anchor, and their chapter: chapter_no in the page, its id, title, anchor and a
    reason that its markup gives for leaving it out. A page that is null or has no html and body element has none.

    A unit is an innermost text block with words. Chapters begin at h1 units; without any they are the root's sections and articles;
    without these the document is one."""
    if not page:
        return []
    elements, text = read(page)
    root = content_root(elements)
    if root is None or not any(e.tag == "html" for e in elements):
        return []
    last = root
    inside = {root}
    for i in range(root + 1, len(elements)):
        if elements[i].parent in inside:
            inside.add(i)
            last = i
    blocks = [i for i in range(root, last + 1) if i in inside and elements[i].tag in TEXT_TAGS and not elements[i].hidden and _WORD.search(text, elements[i].start, elements[i].end)]
    holders = set()
    for i in blocks:  # every element around a block is no innermost one
        p = elements[i].parent
        while p >= root and p not in holders:
            holders.add(p)
            p = elements[p].parent
    leaves = [i for i in blocks if i not in holders]
    said = lambda i: compact(text[elements[i].start : elements[i].end])
    anchor = lambda i: elements[i].attrs.get("id") or None
    chapters: list[tuple[str, str, str | None, str | None]] = []
    of: dict[int, int] = {}
    sections = [i for i in range(root, last + 1) if i in inside and elements[i].parent == root and elements[i].tag in ("article", "section")]
    if any(elements[i].tag == "h1" for i in blocks):
        chapters.append(("front-matter", "Front matter", None, None))
        for i in leaves:
            if elements[i].tag == "h1":
                chapters.append((f"chapter-{len(chapters):04d}", said(i), anchor(i), None))
            of[i] = len(chapters) - 1
    elif sections:
        chapters.append(("front-matter", "Front matter", None, None))
        within: dict[int, int] = {}
        for n, i in enumerate(sections, 1):
            within[i] = n
            own = [j for j in range(i, (sections[n] if n < len(sections) else last + 1)) if j in inside]
            for j in own:
                if elements[j].parent in within and within[elements[j].parent] == n:
                    within[j] = n
            head = next((j for j in own if within.get(j) == n and _HEADING.fullmatch(elements[j].tag)), None)
            legal = "doc-copyright" in elements[i].attrs.get("role", "").split() or "source-copyright" in elements[i].attrs.get("class", "").split()
            chapters.append((f"chapter-{n:04d}", said(head) if head is not None else f"Section {n}", anchor(head) if head is not None else None, "legal-or-metadata" if legal else None))
        of = {i: within.get(i, 0) for i in leaves}
    else:
        head = next((i for i in range(root, last + 1) if i in inside and _HEADING.fullmatch(elements[i].tag)), None)
        chapters.append(("document", said(head) if head is not None else "Document", anchor(head) if head is not None else None, None))
    out = []
    for n, i in enumerate(leaves, 1):
        c = of.get(i, 0)
        name, title, place, reason = chapters[c]
        out.append({"unit_no": n, "kind": elements[i].tag, "text": said(i), "anchor": anchor(i), "chapter_no": c, "chapter_id": name, "chapter_title": title, "chapter_anchor": place, "told_reason": reason})
    return out


_UNITS = "array<struct<unit_no:int,kind:string,text:string,anchor:string,chapter_no:int,chapter_id:string,chapter_title:string,chapter_anchor:string,told_reason:string>>"


def extract_units(df: DataFrame, key: str, page: str) -> DataFrame:
    """key and the units of each page, one row a unit, with unit_id and word_count. Pages without any unit give no row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([page_units(p) for p in pages], dtype=object)

    units = F.pandas_udf(run, _UNITS).asNondeterministic()
    rows = df.select(key, units(F.col(page)).alias("_u")).select(key, F.explode("_u").alias("u")).select(key, "u.*")
    return rows.withColumn("unit_id", F.concat(F.lit("u"), F.lpad(F.col("unit_no").cast("string"), 6, "0"))).withColumn("word_count", T.word_count("text"))


def extract_chapters(units: DataFrame, key: str) -> DataFrame:
    """Chapters of extracted units: words, prose words, units, and why each is left out, if it is."""
    rows = units.groupBy(key, "chapter_no", "chapter_id", "chapter_title", "told_reason").agg(
        F.sum("word_count").alias("words"),
        F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("word_count"))), F.lit(0)).alias("prose_words"),
        F.count("*").alias("units"),
        F.bool_and(F.col("text").rlike(U.LEGAL)).alias("legal"),
    )
    reason = F.coalesce("told_reason", U.exclusion(F.col("chapter_title"), F.col("chapter_id") == "front-matter", F.col("words"), F.col("prose_words"), F.col("legal")))
    return rows.withColumn("reason", reason).withColumn("included", F.col("reason").isNull()).drop("told_reason", "legal")
