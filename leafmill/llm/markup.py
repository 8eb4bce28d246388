"""Problem 2: HTML, Markdown, wiki and LaTeX markup, also one inside another, to clean text that keeps its structure.

One pass over tags, fences and verbatim blocks (leftmost first) turns a text into a flow of leaves, the runs of text between block
tags. Leaves are chosen by tag-path ratios: text length and punctuation outside links are summed per root-to-leaf tag path, fused to a
score, smoothed over paths a small edit apart and held against a threshold taken from the page. Leaves of the paths chosen, and those
that carry structure of their own (headings, items, cells, formulas, scripts that write no marks) unless they are nothing but links,
alone feed the next pass: its lines give headings and list items, formulas and inline code are lifted out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ref rp rt ruby s samp small span strike strong sub sup time tt u var wbr nowiki".split())
_BLOCK = frozenset(
    "address article aside base blockquote body br button canvas caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe img input li link main"
    " math meta nav noscript object ol optgroup option p picture pre script section select source style summary svg syntaxhighlight table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
#: Their content is not page text.
_DROPPED = frozenset("script style title nav template noscript svg iframe head textarea select".split())
_CODE = frozenset("pre syntaxhighlight".split())
_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>|<(?:!doctype|\?xml)[^<>]*>"
    r"|^[ \t]*(?P<fence>`{3,}|~{3,})[ \t]*[\w+-]*[ \t]*$|\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?",
    re.S | re.M | re.I,
)
_AT = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>|<(?:!doctype|\?xml)[^<>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});?")
_KNOWN: dict[str, str] = {}


def unescape(text: str) -> str:
    """html.unescape, with each reference looked up once."""

    def one(m: re.Match) -> str:
        ref = m[0]
        out = _KNOWN.get(ref)
        if out is None:
            out = html.unescape(ref)
            if len(_KNOWN) < 50_000:
                _KNOWN[ref] = out
        return out

    return _REFERENCE.sub(one, text)


_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LIFT = re.compile(
    r"(?P<tick>`+)(?P<code>[^`\n](?:[^`]*[^`])?)(?P=tick)(?!`)"
    r"|\\begin\{(?P<env>equation|align|displaymath|gather|multline|eqnarray|math)(?P<star>\*?)\}(?P<body>.*?)(?:\\end\{(?P=env)(?P=star)\}|\Z)"
    r"|\\\[(?P<display>.*?)(?:\\\]|\Z)|\\\((?P<inline>.*?)(?:\\\)|\Z)"
    r"|(?<!\\)\$\$(?P<dollars>[^$]*)(?:\$\$|\Z)|(?<![\\$\w])\$(?P<dollar>[^\s$](?:[^$\n]|\n(?!\s*\n))*?(?<![\s\\]))\$(?![\d$])",
    re.S,
)
_MARKS = re.compile(
    r"\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*|(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])|(?<![\w_])__?[^\s_](?:[^_\n]*[^\s_])?__?(?![\w_])|~~[^\s~][^\n]*?~~"
    r"|!?\[[^\]\n]*\]\([^)\s]*(?:\s[^)\n]*)?\)|\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]|\{\{[^{}\n]*\}\}|'{2,5}(?=[^\s'])[^\n]*?'{2,5}|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:begin|end)\{"
)
_ITEM = re.compile(r"(?P<bullet>[*+\-•])[ \t]+(?=\S)|(?P<wiki>[*#]{1,6})[ \t]*(?=[^\s*#])|(?P<number>\d{1,9})[.)][ \t]+(?=\S)")
_WIKI_HEADING = re.compile(r"(={1,6})([^=].*?)\1$")
_HASH = re.compile(r"(#{1,6})[ \t]+(\S.*)$")
_LATEX_LINE = re.compile(r"\\(?:(?P<head>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{(?P<title>[^\n]*?)\}|(?P<item>item)(?![A-Za-z])(?:\[[^\]\n]*\])?|(?P<cut>chapter|(?:sub){0,2}section)\*?\{(?P<rest>[^}\n]*)$)")
_STRIP = [
    (re.compile(r"~?\\(?:cite[a-z]*|label|ref|pageref|index|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{[^{}\n]*\}"), ""),
    (re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\[https?://[^\s\]]+ ?([^\]\n]*)\]"), r"\1"),
    (re.compile(r"\{\{lang\|[^{}|\n]*\|([^{}\n]*)\}\}"), r"\1"),
    (re.compile(r"\{\{[^{}\n]*\}\}"), ""),
    (re.compile(r"'{2,5}(?=\S)([^\n]*?)(?<=\S)'{2,5}"), r"\1"),
    (re.compile(r"\*\*(?=\S)([^\n]*?)(?<=\S)\*\*|~~(?=\S)([^\n]*?)(?<=\S)~~|(?<!\w)__(?=\S)([^\n]*?)(?<=\S)__(?!\w)"), lambda m: m[1] or m[2] or m[3] or ""),
    (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]*)(?<=[^\s_])_(?![\w_])"), lambda m: m[1] or m[2] or ""),
]
_STRIPPABLE = re.compile(r"[*_~`\\{\[]|''")

#: Private marks that stand in the flow for what was lifted out; the same characters in a text are blanked first.
H, LI, CODE, FORMULA, TEXT = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_PRIVATE = re.compile("[\ue000-\ue004]")


class Page(NamedTuple):
    markup: bool
    blocks: list[tuple[str, str]]  # kind ('heading', 'list_item', 'code_block', 'formula', 'text') and text, in order
    lang: str | None  # of the html element


class _Leaf:
    """A run of text between block tags: its path, its places in the flow, and what it holds in and outside links."""

    __slots__ = ("path", "places", "length", "punct", "linked")

    def __init__(self, path: tuple[str, ...]) -> None:
        self.path, self.places = path, []
        self.length = self.punct = self.linked = 0


class _Flow:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.codes: list[str] = []
        self.formulas: list[str] = []
        self.markup = False
        self.lang: str | None = None
        self.leaves: list[_Leaf] = []
        self.open: _Leaf | None = None
        self.link = False  # within a link; one left open ends with its block

    def add(self, text: str, path: list[str]) -> None:
        leaf = self.open
        if leaf is None:
            leaf = self.open = _Leaf(tuple(path))
            self.leaves.append(leaf)
        leaf.places.append(len(self.out))
        size = len(text) - text.count(" ") - text.count("\n")
        if self.link:
            leaf.linked += size
        else:
            leaf.length += size
            leaf.punct += len(_PUNCT.findall(text))
        self.out.append(text)


_LANG = re.compile(r"\blang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCT = re.compile(r"[,.;:!?،؛؟।。，；：！？、]")


#: Escapes of the ampersand that only hide another reference, however many.
_NESTED = re.compile(r"&(?:amp;)+(?=#?[A-Za-z0-9]+;)")


def _text(flow: _Flow, text: str, path: list[str], opened: bool) -> None:
    if "&" in text:
        plain = unescape(_NESTED.sub("&", text) if "&amp;" in text else text)
        if plain != text:
            flow.markup = True
            if "<" in plain and (m := _SCAN.search(plain)) and (m["tag"] or "").lower() in _BLOCK | _INLINE:
                _tags(flow, plain, tuple(path), True)
                return
            text = plain
    flow.add(text, path)


def _tags(flow: _Flow, text: str, within: tuple[str, ...] = (), opened: bool = False) -> None:
    pos, path, n = 0, list(within), len(text)
    skip: str | None = None
    level = 0
    # without fences and verbatim blocks only '<' matters
    fenced = "```" in text or "~~~" in text or "\\begin{" in text
    look = 0
    while True:
        if fenced:
            m = _SCAN.search(text, pos)
        else:
            look = text.find("<", max(look, pos))
            if look < 0:
                break
            m = _AT.match(text, look)
            if m is None:
                look += 1
                continue
        if m is None:
            break
        start, end = m.span()
        tag = m["tag"]
        if tag is not None:
            tag = tag.lower()
            if tag not in _BLOCK and tag not in _INLINE:
                if not skip:
                    _text(flow, text[pos:end], path, opened)
                pos = end
                continue
        if not skip and start > pos:
            _text(flow, text[pos:start], path, opened)
        flow.markup = True
        pos = end
        if tag is None:
            if not fenced:
                continue
            if m["fence"] and not skip:
                mark = m["fence"]
                close = re.compile(rf"^[ \t]*{mark[0]}{{{len(mark)},}}[ \t]*$", re.M).search(text, end)
                flow.codes.append(text[end : close.start() if close else n].strip("\n"))
                flow.out.append(f"\n\n{CODE}\n\n")
                flow.open = None
                pos = close.end() if close else n
            elif m["env"] and not skip:
                close = text.find(f"\\end{{{m['env']}}}", end)
                flow.codes.append(text[end : close if close >= 0 else n].strip("\n"))
                flow.out.append(f"\n\n{CODE}\n\n")
                pos = close + len(m["env"]) + 6 if close >= 0 else n
            continue
        attrs, closing = m["attrs"], bool(m["close"])
        if skip:
            if tag == skip:
                level += -1 if closing else not attrs.endswith("/")
                if level == 0:
                    skip = None
            elif skip == "p" and not closing and tag in _BLOCK and tag != "br":  # a hidden paragraph without end tag
                skip = None
                pos = start
            continue
        if tag in _BLOCK and tag != "br":
            flow.open, flow.link = None, False
        if closing:
            if tag == "a":
                flow.link = False
            if tag in path[len(within) :]:
                while path.pop() != tag:
                    pass
            if tag in _BLOCK:
                flow.out.append("\n\n")
            continue
        if tag == "html" and flow.lang is None and (a := _LANG.search(attrs)):
            flow.lang = a[1] or a[2] or a[3] or ""
        if tag == "head":
            continue
        if tag in _DROPPED or (attrs and tag not in _VOID and _HIDDEN.search(attrs)):
            if tag in ("script", "style", "title", "textarea"):  # no tags inside
                close = re.compile(rf"</{tag}\s*>", re.I).search(text, end)
                pos = close.end() if close else n
            else:
                skip, level = tag, 1
            if tag in _BLOCK:
                flow.out.append("\n\n")
            continue
        if tag in _CODE or tag == "math":
            close = re.compile(rf"</{tag}\s*>", re.I).search(text, end)
            inner = text[end : close.start() if close else n]
            pos = close.end() if close else n
            if tag == "math":
                flow.formulas.append(html.unescape(re.sub(r"<[^<>]*>", "", inner)).strip())
                flow.add(FORMULA, path)
            else:
                flow.codes.append(html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", inner)).strip("\n"))
                flow.out.append(f"\n\n{CODE}\n\n")
            continue
        if tag in _INLINE:
            if tag == "a":
                flow.link = "href" in attrs.lower()
            if tag == "ref":
                close = re.compile(r"</ref\s*>", re.I).search(text, end)
                pos = close.end() if close and not attrs.endswith("/") else end
            continue
        if tag not in _VOID:
            if tag == "li" and "li" in path and path[-1] == "li" or tag == "p" and path and path[-1] == "p":
                path.pop()
            path.append(tag)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            flow.out.append(f"\n\n{H}")
        elif tag == "li":
            flow.out.append(f"\n\n{LI}")
        elif tag == "br":
            flow.out.append(f"\n{TEXT}")
        else:
            flow.out.append("\n\n")
    if not skip and pos < n:
        _text(flow, text[pos:], path, opened)


#: Scripts that write no marks between sentences: Thai, Lao, Burmese and Khmer.
_UNPUNCTUATED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


def _structured(text: str) -> bool:
    """Whether a text node has a formula, or lines that are headings or items of their own."""
    if ("$" in text or "\\" in text or "`" in text) and _LIFT.search(text):
        return True
    lines = [line.strip(" \t\r\xa0") for line in text.split("\n")]
    if any(b and a and (not b.strip("=") or not b.strip("-") and len(b) > 1) for a, b in zip(lines, lines[1:])):
        return True
    return any(_ITEM.match(x) or _HASH.match(x) or _WIKI_HEADING.match(x) or _LATEX_LINE.match(x) for x in lines)


#: Leaves of these elements carry structure whatever their length: items, cells, terms, captions, formulas.
_OWN = frozenset("li dd dt td th caption figcaption summary option legend math".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A path is content from this share of the page's mean score, weighted by length.
SHARE = 0.4
#: Weights of paths one and two edits away in the smoothing.
NEAR = (0.135, 0.018)


def _apart(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Edits between two tag paths, up to 3, which stands for more."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return min(3, max(len(a), len(b)) - head - tail)


def path_scores(leaves: list[_Leaf]) -> dict[tuple[str, ...], float]:
    """Tag-path ratios: the log of mean length times mean punctuation of a path's leaves, and of what these vary by, smoothed."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for x in leaves:
        s = sums.setdefault(x.path, [0, 0, 0, 0, 0])
        for k, v in enumerate((1, x.length, x.punct, x.length * x.length, x.punct * x.punct)):
            s[k] += v
    raw = {}
    for path, (n, length, punct, length2, punct2) in sums.items():
        vary = math.sqrt(max(0.0, length2 / n - (length / n) ** 2) * max(0.0, punct2 / n - (punct / n) ** 2))
        raw[path] = math.log1p(length / n * punct / n) + 0.1 * math.log1p(vary)
    # only paths of nearly the same length can be near each other
    by: dict[int, list[tuple[str, ...]]] = {}
    for path in raw:
        by.setdefault(len(path), []).append(path)
    out = {}
    for path, own in raw.items():
        total, weight = own, 1.0
        for size in range(len(path) - 2, len(path) + 3):
            for other in by.get(size, ()):
                if other is not path and (d := _apart(path, other)) <= 2:
                    total += NEAR[d - 1] * raw[other]
                    weight += NEAR[d - 1]
        out[path] = total / weight
    return out


def unchosen(flow: _Flow) -> list[_Leaf]:
    """Leaves that aren't content. A heading goes with its section: it is left out if all leaves up to the next heading are."""
    leaves = [x for x in flow.leaves if x.length or x.linked]
    if len(leaves) < 2:
        return []
    scores = path_scores(leaves)
    size = sum(x.length for x in leaves)
    floor = SHARE * sum(scores[x.path] * x.length for x in leaves) / max(1, size)
    poor = {path for path, score in scores.items() if score < floor}
    if not poor:
        return []

    def kept(x: _Leaf) -> bool:
        if x.path not in poor or any(FORMULA in flow.out[i] for i in x.places):
            return True
        links = x.linked > 0 and x.length <= x.linked // 4
        if links:
            return False
        if not _OWN.isdisjoint(x.path):
            return True
        return any(_UNPUNCTUATED.search(flow.out[i]) for i in x.places) or _structured("".join(flow.out[i] for i in x.places))

    out: list[_Leaf] = []
    head: list[_Leaf] = []
    section: list[bool] = []

    def close() -> None:
        if section and not any(section):
            out.extend(x for x in head if not any(FORMULA in flow.out[i] for i in x.places))

    for x in leaves:
        if not _HEADINGS.isdisjoint(x.path):
            if section:
                close()
                head, section = [], []
            head.append(x)
        else:
            section.append(keep := kept(x))
            if not keep:
                out.append(x)
    close()
    return out


def _wiki(text: str) -> bool:
    return bool(re.search(r"^={2,6}[^=\n].*[^=\n]={2,6}[ \t]*$|\[\[|\{\{|'''|<math>", text, re.M))


def parse(text: str | None) -> Page:
    """Reads one text. Null and empty texts have no markup and no blocks; unclosed code and formulas run to the text's end."""
    if not text:
        return Page(False, [], None)
    flow = _Flow()
    if _PRIVATE.search(text):
        text = _PRIVATE.sub(" ", text)
    wiki = "[[" in text or "'''" in text or "{{" in text or "==" in text and _wiki(text)
    if "<" in text or "&" in text or "```" in text or "~~~" in text or "\\begin{" in text:
        _tags(flow, text)
        for leaf in unchosen(flow):
            for at in leaf.places:
                flow.out[at] = " "
            at = leaf.places[0] - 1  # the mark of a heading or an item goes with its text
            while at > 0 and flow.out[at].isspace():
                at -= 1
            if at >= 0 and flow.out[at].endswith((H, LI)):
                flow.out[at] = "\n\n"
        text = "".join(flow.out)
    if "$" in text or "`" in text or "\\" in text:
        if FORMULA in text:  # keep the order of formulas lifted before
            seen = iter(flow.formulas)
            flow.formulas = []
            pattern = re.compile(_LIFT.pattern + "|" + FORMULA, re.S)
        else:
            seen, pattern = iter(()), _LIFT

        def lift(m: re.Match) -> str:
            if m[0] == FORMULA:
                flow.formulas.append(next(seen, ""))
                return FORMULA
            flow.markup = True
            if m["tick"]:
                return m["code"]
            flow.formulas.append(next(g for g in (m["body"], m["display"], m["inline"], m["dollars"], m["dollar"]) if g is not None).strip())
            return FORMULA

        text = pattern.sub(lift, text)
    blocks: list[tuple[str, str]] = []
    para: list[str] = []
    markup = flow.markup
    kind = "text"
    codes, formulas = iter(flow.codes), iter(flow.formulas)

    def flush() -> None:
        nonlocal para, kind
        if para:
            body = " ".join(para)
            if FORMULA in body:
                parts = body.split(FORMULA)
                for x in parts[1:]:
                    found.append(("formula", next(formulas, "")))
                body = " ".join(parts)
            if body.strip():
                blocks.append((kind, body.strip()))
            blocks.extend(found)
            found.clear()
        para, kind = [], "text"

    found: list[tuple[str, str]] = []
    lines = text.split("\n")
    inside = False  # a list is open: the line before was an item
    number = 0
    k = len(lines)
    blank = True
    for at in range(k):
        line = lines[at].strip(" \t\r\xa0")
        if not line:
            flush()
            blank, inside = True, inside and not blank and False
            continue
        c = line[0]
        if c == CODE:
            flush()
            blocks.append(("code_block", next(codes, "")))
            blank, inside = True, False
            continue
        if c == H or c == LI:
            flush()
            kind = "heading" if c == H else "list_item"
            line = line[1:].strip()
            if not line:
                blocks.append((kind, ""))
                kind = "text"
            else:
                para.append(line)
            blank, inside = False, False
            continue
        if c == TEXT:
            flush()
            if len(line) > 1:
                para.append(line[1:])
            blank, inside = not para, False
            continue
        if c in "#*+-•" or "0" <= c <= "9":
            if c == "#" and (h := _HASH.match(line)):
                # a lone '# line' is a heading, two or more in a row are a wiki list
                row = inside if at and lines[at - 1].lstrip().startswith(("#", "*")) else at + 1 < k and lines[at + 1].lstrip().startswith(("# ", "##")) and len(h[1]) == 1
                if (not row or re.search(r"[ \t]#+$", line)) and (blank or not para):
                    flush()
                    title = re.sub(r"[ \t]+#+$", "", h[2])
                    blocks.append(("heading", _plain(title)))
                    markup, blank, inside = True, True, False
                    continue
            if c == "-" and para and kind == "text" and len(para) == 1 and len(line) >= 3 and not line.strip("-"):
                kind = "heading"
                flush()
                markup, blank, inside = True, True, False
                continue
            i = _ITEM.match(line) if blank or inside else None
            if i and i["wiki"] and c == "#" and not (wiki or line.startswith("# ") or inside):
                i = None
            if i and i["wiki"] and c == "*" and line.startswith("**") and not (inside or wiki):
                i = None
            if i and i["wiki"] and c == "*" and not line[len(i["wiki"])].isspace() and not wiki:
                i = None
            if i and i["number"]:
                value = int(i["number"])
                if value != (number + 1 if inside and number else 1):
                    i = None
                else:
                    number = value
            elif i:
                number = 0
            if i:
                flush()
                kind = "list_item"
                para.append(line[i.end() :])
                markup, blank, inside = True, False, True
                continue
        elif c == "=":
            w = _WIKI_HEADING.match(line)
            if w and (blank or inside or not para):
                flush()
                blocks.append(("heading", _plain(w[2].strip())))
                markup, blank, inside = True, True, False
                continue
            if para and kind == "text" and len(para) == 1 and len(line) >= 3 and not line.strip("="):
                kind = "heading"
                flush()
                markup, blank, inside = True, True, False
                continue
        elif c == "\\" and (x := _LATEX_LINE.match(line)):
            flush()
            markup = True
            if x["item"]:
                kind = "list_item"
                para.append(line[x.end() :].strip())
                blank, inside = False, True
            else:
                blocks.append(("heading", _plain(x["title"] if x["head"] else x["rest"])))
                rest = line[x.end() :].strip()
                if rest:
                    para.append(rest)
                blank, inside = not rest, False
            continue
        elif c in "{|!" and line[:2] in ("{|", "|}", "|-", "||"):
            markup = True
        elif c in "_*" and len(line) >= 3 and not line.strip(c):
            flush()
            markup, blank = True, True
            continue
        elif c == ">" and blank:
            markup = True
            line = line[1:].lstrip()
        elif c == ":" and (line[1:2] == FORMULA or wiki):
            line = line.lstrip(":")
        para.append(line)
        blank = False
        if kind != "list_item":
            inside = False
    flush()
    if not markup:
        markup = bool(_MARKS.search(text))
    if markup:
        blocks = [(kind, _plain(body)) if kind in ("text", "heading", "list_item") else (kind, body) for kind, body in blocks]
        # a line of nothing but markup commands is no text
        blocks = [b for b in blocks if b[1] or b[0] != "text"]
    return Page(markup, blocks, flow.lang)


def _plain(text: str) -> str:
    if _STRIPPABLE.search(text):
        for pattern, to in _STRIP:
            text = pattern.sub(to, text)
    return text.strip()


_SHOWN = {"heading": "# {}", "list_item": "- {}", "code_block": "```\n{}\n```", "formula": "${}$", "text": "{}"}


def clean(page: Page) -> str:
    """One plain form of the content: '# ' headings, '- ' items, fenced code, $formulas$, blank lines between."""
    return "\n\n".join(_SHOWN[kind].format(body) for kind, body in page.blocks)


def structure_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Runs of rows as [kind, count]; ('markup', 0) first."""
    for texts in batches:
        out = []
        for text in texts:
            page = parse(text)
            if not page.markup:
                out.append(None)
                continue
            counts = {"heading": 0, "list_item": 0, "code_block": 0, "formula": 0}
            for kind, _ in page.blocks:
                if kind in counts:
                    counts[kind] += 1
            out.append(list(counts.values()))
        yield pd.Series(out, dtype=object)


def clean_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else clean(parse(t)) for t in texts], dtype=object)


def structure(df: DataFrame, text: str, out: str = "structure") -> DataFrame:
    """Adds ARRAY<INT>: headings, list items, code blocks, formulas; null for texts without markup, null and empty ones.

    A column named out is replaced; others pass through, whatever their names."""
    counts = F.pandas_udf(structure_udf, "array<int>").asNondeterministic()
    maybe = F.col(text).rlike(_MAYBE)
    return df.withColumn(out, F.when(maybe, counts(F.when(maybe, F.col(text)))))


def clean_text(df: DataFrame, text: str, out: str = "clean_text") -> DataFrame:
    """Adds the clean text; null stays null, empty stays empty."""
    return df.withColumn(out, F.pandas_udf(clean_udf, "string").asNondeterministic()(F.col(text)))


def _fields(spark, sf_dir: str) -> list[tuple[str, DataFrame]]:
    documents = table(spark, sf_dir, "documents", F.col("doc_id").alias("record_id"), F.col("text"))
    keep = table(spark, sf_dir, "keep_jobs", "job_id", "source", "html")
    return [
        ("documents.text", documents),
        ("keep_jobs.source", keep.select(F.col("job_id").alias("record_id"), F.col("source").alias("text"))),
        ("keep_jobs.html", keep.select(F.col("job_id").alias("record_id"), F.col("html").alias("text"))),
    ]


#: Any of these must be in a text that holds markup, so the rest never leaves the JVM.
_MAYBE = r"[<&`*_~$\\{#=\[]|--|''|(?m)^\s*(?:[-+•>|]|\d+[.)])"


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Copies of a re-delivered job give the same rows; they fall together in the last distinct, which moves ids and counts only."""
    each = None
    for name, df in _fields(spark, sf_dir):
        rows = structure(df.where(F.col("text").rlike(_MAYBE)), "text", "n").select(F.lit(name).alias("field_name"), "record_id", "n")
        each = rows if each is None else each.unionByName(rows)
    each = each.where("n is not null").distinct()
    kinds = [("markup", None), *((k, i) for i, k in enumerate(("heading", "list_item", "code_block", "formula")))]
    top = F.array(*[F.struct(F.lit(k).alias("kind"), (F.array(F.lit(0)) if i is None else F.when(F.col("n")[i] > 0, F.sequence(F.lit(1), F.col("n")[i])).otherwise(F.array().cast("array<int>"))).alias("ordinals")) for k, i in kinds])
    rows = each.select("field_name", "record_id", F.explode(top).alias("k")).select("field_name", "record_id", F.col("k.kind").alias("kind"), F.explode("k.ordinals").alias("ordinal"))
    return rows


def p2_clean(spark, sf_dir: str) -> DataFrame:
    """Clean text of every record of the three fields."""
    each = None
    for name, df in _fields(spark, sf_dir):
        if name != "documents.text":
            df = df.dropDuplicates(["record_id"])
        rows = clean_text(df.where("text is not null"), "text").select(F.lit(name).alias("field_name"), "record_id", "clean_text")
        each = rows if each is None else each.unionByName(rows)
    return each
