"""Problem 3: one form for text that looks the same.

Arrow text is copied to one numpy array of code points per batch. Lookup tables say of every code point what it is and what it
becomes; longer results come from an expansion pool by offsets; marks are composed with their bases by a sorted array of pairs.
Look-alike letters are told by the scripts of the word around them, counted per run of letters. No step works row by row.
"""

from __future__ import annotations

import html
import html.entities
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import deduplicate, table

#: The tables cover three planes; above are private planes, which stay, and invisible tags and selectors, which share one entry.
SIZE = 0x30000
TAGS, TAG = (0xE0000, 0xE0FFF), 0x2060
PLAIN, INVISIBLE, SPACE, VARIANT, WIDE_SIGN, MARK, UNIT = range(7)
LATIN, CYRILLIC, GREEK, ARABIC, INDIC, THAI, HAN, KANA, OTHER = range(1, 10)

#: Letters of Cyrillic and Greek and the Latin letter each looks like.
_CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԌԜаеѕіјорсухһԁԛԝъьѵгпкт", "ABESIJKMHOPCTYXYhGWaesijopcyxhdqwbbvrnkt"))
_GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΥϹϳοανικργυωϲτ", "ABEZHIKMNOPTYXYCjoavikpyuwct"))
_LATIN_CYRILLIC = {v: k for k, v in reversed(_CYRILLIC_LATIN.items()) if k not in "ъьѵгпктҮҺԌԜһԁԛԝ"} | {"m": "м", "k": "к", "n": "п", "u": "и", "b": "ь", "r": "г"}
_LATIN_GREEK = {v: k for k, v in reversed(_GREEK_LATIN.items()) if k not in "ϹϳϲωΥ"} | {"Y": "Υ", "u": "υ", "a": "α", "i": "ι", "x": "χ"}
_ACCENTED = {"έ": "é", "ό": "ó", "ά": "á", "ί": "í", "ύ": "ú", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï"}
_CYRILLIC_GREEK = {"А": "Α", "В": "Β", "Е": "Ε", "Н": "Η", "І": "Ι", "К": "Κ", "М": "Μ", "О": "Ο", "Р": "Ρ", "Т": "Τ", "Х": "Χ", "Г": "Γ", "П": "Π", "Ф": "Φ", "о": "ο", "а": "α", "р": "ρ", "к": "κ", "у": "γ", "х": "χ", "і": "ι"}
#: Letters that another of the same script replaces in the languages at hand, and signs that pass for others.
_ALWAYS = {
    "ţ": "ț", "Ţ": "Ț", "ş": "ș", "Ş": "Ș", "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ⅼ": "l", "ǃ": "!", "ʼ": "’", "ʹ": "'", "ˈ": "'", "․": ".", "∶": ":", "꞉": ":", "ː": ":", "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "﹣": "-", "－": "-",
    "ی": "ي", "ک": "ك", "ىٔ": "ئ", "ہ": "ه", "ە": "ه", "ھ": "ه", "ۃ": "ة", "ے": "ي", "ګ": "ك", "ڪ": "ك", "ٱ": "ا", ";": ";", "·": "·", "ǝ": "e", "ə": "e",
}
#: Sequences that look like one character.
_SEQUENCES = {"เเ": "แ", "ํา": "ำ", "अा": "आ", "अॉ": "ऑ", "एे": "ऐ", "आॅ": "ऑ", "अो": "ओ", "अौ": "औ"}
_INVISIBLE_RANGES = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xFE00, 0xFE0F))


class Tables(NamedTuple):
    kind: np.ndarray  # uint8
    to: np.ndarray  # uint32: the character it becomes
    long_at: np.ndarray  # int32: offset in pool, or -1
    long_size: np.ndarray
    pool: np.ndarray
    script: np.ndarray  # uint8
    word: np.ndarray  # bool: letters and marks
    emoji: np.ndarray
    like: dict[tuple[int, int], np.ndarray]  # (script, script) -> uint32, 0 where nothing
    pairs: np.ndarray  # base << 32 | mark, sorted
    composed: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    kind = np.zeros(SIZE, np.uint8)
    to = np.arange(SIZE, dtype=np.uint32)
    script = np.zeros(SIZE, np.uint8)
    word = np.zeros(SIZE, bool)
    long_at = np.full(SIZE, -1, np.int32)
    long_size = np.zeros(SIZE, np.int32)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for a, b in ((0x41, 0x24F), (0x250, 0x2AF), (0xFB00, 0xFB06), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)):
        script[a : b + 1] = LATIN
    for n, spans in ((CYRILLIC, ((0x400, 0x52F),)), (GREEK, ((0x370, 0x3FF), (0x1F00, 0x1FFF))), (ARABIC, ((0x600, 0x6FF), (0x750, 0x77F))), (INDIC, ((0x900, 0x97F),)), (THAI, ((0xE00, 0xE7F),)), (HAN, ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))), (KANA, ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)))):
        for a, b in spans:
            script[a : b + 1] = n
    for c in range(0x80, SIZE):
        if 0x3400 <= c <= 0x9FFF or 0x20000 <= c < 0x2F800 or 0xAC00 <= c <= 0xDFFF or 0xE000 <= c < 0xF900:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        letter = category[0] in "LM"
        word[c] = letter
        if category == "Zs":
            kind[c], to[c] = SPACE, 0x20
            continue
        if category[0] == "M":
            kind[c] = MARK
        deco = unicodedata.decomposition(ch)
        if not deco:
            continue
        nfc = unicodedata.normalize("NFC", ch)
        if nfc != ch:  # looks the same by definition
            if ch in "Ω":
                continue
            result, k = nfc, UNIT if ch in "KÅ" else VARIANT
        elif not deco.startswith("<"):
            base, mark = (int(x, 16) for x in deco.split())
            pairs[base << 32 | mark] = c
            continue
        else:
            tag = deco[1 : deco.index(">")]
            nfkc = unicodedata.normalize("NFKC", ch)
            if c == 0xB5:
                result, k = "μ", UNIT
            elif tag in ("wide", "narrow", "small"):
                result, k = nfkc, VARIANT if nfkc[0].isalnum() or category[0] in "LM" else WIDE_SIGN
            elif tag in ("initial", "medial", "final", "isolated", "font") or tag == "compat" and letter or 0x2F00 <= c <= 0x2FD5:
                if 0x2100 <= c <= 0x214F or 0x3130 <= c <= 0x32FF or c in (0x0E33, 0x0EB3) or nfkc[:1] == " ":
                    continue
                result, k = nfkc, VARIANT
            else:
                continue
        kind[c] = k
        if len(result) == 1:
            to[c] = ord(result)
        else:
            long_at[c], long_size[c] = len(pool), len(result)
            pool.extend(map(ord, result))
    # letters with one decomposition inside the ideographs' gap and ASCII
    word[0x41:0x5B] = word[0x61:0x7B] = word[0x3400:0xA000] = word[0xAC00:0xD7A4] = True
    script[0x5B:0x61] = script[0x7B:0xAA] = 0
    for c in range(0xAA, 0x250):
        if not word[c]:
            script[c] = 0
    for a, b in _INVISIBLE_RANGES:
        kind[a : b + 1] = INVISIBLE
        word[a : b + 1] = False
    for a, b in _ALWAYS.items():
        if len(a) == 1:
            kind[ord(a)], to[ord(a)] = VARIANT, ord(b)
    for c in range(0x2E80, 0x2EF4):  # radicals stand in for ideographs; a few have no equal
        if c != 0x2E9A:
            kind[c] = VARIANT
    for a, b in (("⻚", "页"), ("⻄", "西"), ("⻅", "见"), ("⻆", "角"), ("⻉", "贝"), ("⻋", "车"), ("⻓", "长"), ("⻔", "门"), ("⻘", "青"), ("⻛", "风"), ("⻜", "飞"), ("⻝", "食"), ("⻢", "马"), ("⻥", "鱼"), ("⻦", "鸟"), ("⻨", "麦"), ("⻩", "黄"), ("⻬", "齐"), ("⻮", "齿"), ("⻰", "龙"), ("⺠", "民"), ("⻁", "虎"), ("⺫", "目")):
        to[ord(a)] = ord(b)
    emoji = np.zeros(SIZE, bool)
    for a, b in ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x2190, 0x21FF)):
        emoji[a : b + 1] = True
    like: dict[tuple[int, int], np.ndarray] = {}
    for a, b, letters in ((CYRILLIC, LATIN, _CYRILLIC_LATIN), (GREEK, LATIN, _GREEK_LATIN), (LATIN, CYRILLIC, _LATIN_CYRILLIC), (LATIN, GREEK, _LATIN_GREEK), (CYRILLIC, GREEK, _CYRILLIC_GREEK), (GREEK, CYRILLIC, {v: k for k, v in _CYRILLIC_GREEK.items()})):
        own = np.zeros(SIZE, np.uint32)
        for x, y in letters.items():
            own[ord(x)] = ord(y)
        if b == LATIN:
            for x, y in _ACCENTED.items():
                if script[ord(x)] == a:
                    own[ord(x)] = ord(y)
        like[a, b] = own
    keys = np.array(sorted(pairs), dtype=np.uint64)
    return Tables(kind, to, long_at, long_size, np.array(pool or [0], dtype=np.uint32), script, word, emoji, like, keys, np.array([pairs[int(k)] for k in keys], dtype=np.uint32))


def _entries(codes: np.ndarray) -> np.ndarray:
    """Places in the tables; what has no entry shares that of character 0."""
    return np.where(codes < SIZE, codes, np.where((codes >= TAGS[0]) & (codes <= TAGS[1]), TAG, 0))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and each row's start (one more for the end). Null rows are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    raw = texts.buffers()[2]
    data = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else b""
    codes = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))) if len(data) else np.zeros(1, np.int64)
    return codes, lead[offsets - offsets[0]]


def to_arrow(codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows as Arrow text again."""
    data = codes.astype(np.uint32).tobytes().decode("utf-32-le", "replace").encode("utf-8")
    lead = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    offsets = np.append(lead, len(data))[starts].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.string())


#: Characters after the ampersand of the longest named reference, with its semicolon.
NAME = max(map(len, html.entities.html5))


@lru_cache(maxsize=50_000)
def _reference(ref: str) -> tuple[int, int, int, int]:
    """Of what follows an ampersand: how many characters belong to the reference, how many it stands for (up to two), and these."""
    if not ref:
        return 0, 0, 0, 0
    text = "&" + ref
    out = html.unescape(text)
    if out == text:
        return 0, 0, 0, 0
    for made in (2, 1, 0):
        rest = out[made:]
        if len(out) >= made and text.endswith(rest):
            c = [ord(x) for x in out[:made]] + [0, 0]
            return len(text) - len(rest) - 1, made, c[0], c[1]
    return 0, 0, 0, 0


def decode_page(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pages without their tags and with character references decoded."""
    if not len(codes):
        return codes, starts
    following = np.append(codes[1:], 0)
    opens = (codes == 60) & (((following | 32) >= 97) & ((following | 32) <= 122) | (following == 47) | (following == 33))
    row_start = np.zeros(len(codes), bool)
    row_start[starts[:-1][starts[:-1] < len(codes)]] = True
    # a tag lasts from its '<' to the next '>' of the row
    at = np.arange(len(codes))
    last_open = np.maximum.accumulate(np.where(opens, at, -1))
    last_close = np.maximum.accumulate(np.where((codes == 62) | row_start, np.where(codes == 62, at, at - 1), -1))
    before_close = np.append(-1, last_close[:-1])
    inside = (last_open >= 0) & (last_open > before_close)
    keep = ~inside
    codes = codes.copy()
    # a tag separates what stands on its sides, a break of line does it here
    first = opens & ~np.append(False, inside[:-1])
    tag_letter = np.where(following == 47, np.append(codes[2:], [0, 0]), following) | 32
    block = first & np.isin(tag_letter, np.frombuffer("phudlnatrsm".encode(), dtype=np.uint8))
    codes[block] = 10
    keep |= block
    amp = np.flatnonzero((codes == 38) & keep)
    if len(amp):
        # a reference's name or number lasts to the first sign that can't belong to it, a tag or the row's end
        part = ((codes >= 48) & (codes <= 57) | ((codes | 32) >= 97) & ((codes | 32) <= 122)) & keep & ~row_start
        part[amp] = False
        sharp = np.append(codes[1:], 0)[amp] == 35
        part[np.minimum(amp[sharp] + 1, len(codes) - 1)] = True
        stops = np.append(np.flatnonzero(~part), len(codes))
        end = stops[np.searchsorted(stops, amp, side="right")]
        closed = (end < len(codes)) & (codes[np.minimum(end, len(codes) - 1)] == 59) & ~row_start[np.minimum(end, len(codes) - 1)]
        end = end + closed
        # each distinct reference is looked up once; a longer one than any name is looked up by itself
        size = end - amp
        grid = np.zeros((len(amp), NAME), np.uint32)
        for k in range(1, NAME + 1):
            live = k < size
            grid[live, k - 1] = codes[amp[live] + k]
        grid[size > NAME, 0] = 0
        kinds, which = np.unique(grid, axis=0, return_inverse=True)
        known = np.array([_reference("".join(map(chr, g[g > 0]))) for g in kinds], dtype=np.int64).reshape(-1, 4)[which.reshape(-1)]
        for i in np.flatnonzero(size > NAME):
            known[i] = _reference("".join(map(chr, codes[amp[i] + 1 : end[i]])))
        ok = known[:, 0] > 0
        amp, taken, made, first, second = amp[ok], known[ok, 0], known[ok, 1], known[ok, 2], known[ok, 3]
        gone = np.zeros(len(codes) + 1, np.int32)
        np.add.at(gone, amp + made, 1)
        np.add.at(gone, amp + 1 + taken, -1)
        keep &= np.cumsum(gone[:-1]) == 0
        codes[amp[made > 0]] = first[made > 0]
        codes[amp[made > 1] + 1] = second[made > 1]
    kept = np.append(0, np.cumsum(keep))
    return codes[keep], kept[starts]


class Found(NamedTuple):
    case: np.ndarray  # bool by row: a case for certain
    whole: np.ndarray  # uint8 by row: letters all of one script that could all be another's, 1 Cyrillic, 2 Greek, 3 Latin
    wide: np.ndarray  # bool by row: full-width signs without ideographs beside them
    letters: np.ndarray  # int32 (rows, 10): letters by script


#: Letters that tell a block's script.
ENOUGH = 9


def _runs(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the run of word characters at each position, -1 outside; and how many there are."""
    begin = word & ~(np.append(False, word[:-1]) & (np.append(-1, row[:-1]) == row))
    run = np.cumsum(begin) - 1
    return np.where(word, run, -1), int(begin.sum())


def _composable(codes: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Positions of marks that compose with the character before, and what they make."""
    safe = _entries(codes)
    marks = np.flatnonzero(t.kind[safe] == MARK)
    marks = marks[(marks > 0)]
    marks = marks[row[marks] == row[marks - 1]] if len(marks) else marks
    if not len(marks):
        return marks, marks
    key = codes[marks - 1].astype(np.uint64) << np.uint64(32) | codes[marks].astype(np.uint64)
    i = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    hit = t.pairs[i] == key
    return marks[hit], t.composed[i[hit]]


def _around(script: np.ndarray, scripts: tuple[int, ...], block: np.ndarray, row: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Letters of the scripts around runs that begin at these places, themselves (own) left out: those of the block of text, or where
    it shows too few, of the whole row."""
    out = []
    for of in (block, row):
        counts = np.stack([np.bincount(of, weights=script == s, minlength=int(of[-1]) + 1 if len(of) else 1) for s in scripts], axis=1)
        out.append(counts[of[at]].astype(np.int64) - own)
    return np.where((out[0].sum(axis=1) >= ENOUGH)[:, None], out[0], out[1])


def examine(codes: np.ndarray, starts: np.ndarray) -> tuple[Found, np.ndarray]:
    """Cases by row, and for each position the letter a look-alike should be (0 where none)."""
    t = tables()
    rows = len(starts) - 1
    row = np.repeat(np.arange(rows), np.diff(starts))
    block = np.cumsum((codes == 10) | np.append(True, row[1:] != row[:-1])) - 1 if len(codes) else row
    safe = _entries(codes)
    kind = t.kind[safe]
    # a variant counts for the script of what it becomes
    shown = np.where((kind == VARIANT) & (t.to[safe] < SIZE), t.to[safe], safe)
    script = t.script[shown]
    flag = np.zeros(len(codes), bool)
    emoji = t.emoji[safe]
    beside = np.append(False, emoji[:-1]) | np.append(emoji[1:], False) | np.append(np.append(False, False), emoji[:-2])[: len(codes)]
    if (tag := (codes >= TAGS[0]) & (codes <= TAGS[1])).any():  # a sequence of tags belongs to the emoji before it
        at = np.arange(len(codes))
        beside |= tag & emoji[np.maximum(np.maximum.accumulate(np.where(tag, -1, at)), 0)]
    flag |= (kind == INVISIBLE) & ~beside
    flag |= (kind == SPACE) | (kind == VARIANT)
    marks, _ = _composable(codes, row, t)
    flag[marks] = True
    for pair in _SEQUENCES:
        a, b = map(ord, pair)
        hit = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
        flag[hit[row[hit] == row[hit + 1]]] = True
    word = t.word[safe] | (codes >= SIZE) & (safe == 0) | (kind == INVISIBLE)
    run, count = _runs(word, row)
    real = np.zeros(len(codes), np.uint32)
    letters = np.zeros((rows, 10), np.int32)
    np.add.at(letters, (row, script), 1)
    letters[:, 0] = 0
    whole = np.zeros(rows, np.uint8)
    if count:
        inside = run >= 0
        by = np.zeros((count, 4), np.int32)
        for s in (LATIN, CYRILLIC, GREEK):
            by[:, s] = np.bincount(run[inside & (script == s)], minlength=count)
        first = np.flatnonzero(inside & (np.append(-2, run[:-1]) != run))
        last = np.flatnonzero(inside & (np.append(run[1:], -2) != run))
        # mixed runs: the lesser script's letters that look like the greater's
        mixed = (by[:, 1:] > 0).sum(axis=1) > 1
        length = last - first + 1
        # a letter with a raised or lowered number, and a pair like the sign of a change or a unit, are symbols
        after = codes[np.minimum(last + 1, len(codes) - 1)]
        symbol = (last + 1 < len(codes)) & ((after == 0xB2) | (after == 0xB3) | (after == 0xB9) | (after >= 0x2070) & (after <= 0x2089)) & (length <= 2)
        symbol |= mixed & (length == 2) & (np.bincount(run[inside & (script == GREEK) & (t.like[GREEK, LATIN][safe] == 0)], minlength=count) == 1)
        # a run of one script, all of whose letters could be another's, among letters of that other
        near = _around(script, (LATIN, CYRILLIC, GREEK), block, row, first, by[:, 1:])
        for a in (LATIN, CYRILLIC, GREEK):
            for b in (LATIN, CYRILLIC, GREEK):
                if a == b:
                    continue
                like = t.like[a, b][shown]
                alike = np.bincount(run[inside & (script == a) & (like > 0)], minlength=count)
                # in a mixed run: a is lesser, or as many and b rules around
                lesser = (by[:, a] < by[:, b]) | (by[:, a] == by[:, b]) & ((near[:, b - 1] > near[:, a - 1]) | (near.sum(axis=1) == 0) & (b == LATIN))
                back = np.bincount(run[inside & (script == b) & (t.like[b, a][shown] > 0)], minlength=count)
                # or all of a's letters look like b's, and not the other way round
                lesser = lesser & (alike == by[:, a]) | (alike == by[:, a]) & (back < by[:, b]) | lesser & (back < by[:, b]) & (by[:, a] * 2 <= by[:, b])
                hit = mixed & (alike > 0) & lesser & (by[:, b] > 0) & ~symbol
                # all letters alike, and nine in ten around are of b
                alone = ~mixed & (alike > 0) & (alike == by[:, a]) & ~symbol
                hit |= alone & (near[:, b - 1] >= ENOUGH) & (near[:, b - 1] * 10 >= near.sum(axis=1) * 9)
                if a != LATIN and b == LATIN or a == LATIN and b != LATIN:
                    only = alone & (near.sum(axis=1) < ENOUGH)
                    code = 1 if a == CYRILLIC else 2 if a == GREEK else 3
                    whole[row[first[only]]] = code
                at = inside & (script == a) & (like > 0)
                at[at] = hit[run[at]]
                real[at] = like[at]
                flag |= at
        greek = np.flatnonzero(kind == UNIT)
        if len(greek):
            size = np.bincount(run[inside], minlength=count)
            r = run[greek]
            flag[greek] |= (r >= 0) & np.where(codes[greek] == 0xB5, by[np.maximum(r, 0), GREEK] > 0, size[np.maximum(r, 0)] >= 3)
    wide_sign = np.flatnonzero(kind == WIDE_SIGN)
    wide = np.zeros(rows, bool)
    if len(wide_sign):
        r, of = row[wide_sign], block[wide_sign]
        none = np.bincount(block, weights=(script == HAN) | (script == KANA))[of] == 0
        some = np.bincount(block, weights=script > 0)[of] >= 4
        flag[wide_sign[none & some & (letters[r][:, [HAN, KANA]].sum(axis=1) == 0)]] = False
        wide[r[none]] = True
    case = np.zeros(rows, bool)
    case[row[flag]] = True
    return Found(case, whole, wide & ~case, letters), real


def unify(codes: np.ndarray, starts: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form: look-alikes as in real, variants replaced and expanded, marks composed, invisible characters dropped."""
    t = tables()
    rows = len(starts) - 1
    row = np.repeat(np.arange(rows), np.diff(starts))
    safe = _entries(codes)
    kind = t.kind[safe]
    letters_east = np.zeros(rows, bool)
    letters_east[row[np.isin(t.script[safe], (HAN, KANA))]] = True
    change = (kind == SPACE) | (kind == VARIANT) | (kind == WIDE_SIGN) & ~letters_east[row]
    out = np.where(change & (codes < SIZE), t.to[safe], codes)
    out = np.where(real > 0, real, out).astype(np.uint32)
    size = np.where(change & (t.long_at[safe] >= 0) & (real == 0), t.long_size[safe], 1)
    emoji = t.emoji[safe]
    beside = np.append(False, emoji[:-1]) | np.append(emoji[1:], False)
    if (tag := (codes >= TAGS[0]) & (codes <= TAGS[1])).any():
        at = np.arange(len(codes))
        beside |= tag & emoji[np.maximum(np.maximum.accumulate(np.where(tag, -1, at)), 0)]
    size[(kind == INVISIBLE) & ~beside] = 0
    for pair, one in _SEQUENCES.items():
        a, b = map(ord, pair)
        hit = np.flatnonzero((codes[:-1] == a) & (codes[1:] == b))
        hit = hit[row[hit] == row[hit + 1]]
        out[hit], size[hit + 1] = ord(one), 0
    # expansion: every output place points back to its character, and past the first to the pool
    ends = np.cumsum(size)
    back = np.repeat(np.arange(len(codes)), size)
    inner = np.arange(len(back)) - np.repeat(ends - size, size)
    long = size[back] > 1
    result = out[back]
    result[long] = t.pool[t.long_at[safe[back[long]]] + inner[long]]
    new_row = row[back]
    while True:  # marks one after another on the same base
        at, made = _composable(result, new_row, t)
        if not len(at):
            break
        first = np.append(True, np.diff(at) > 1)
        at, made = at[first], made[first]
        result[at - 1] = made
        keep = np.ones(len(result), bool)
        keep[at] = False
        result, new_row = result[keep], new_row[keep]
    return result, np.append(0, np.cumsum(np.bincount(new_row, minlength=rows)))


#: Bytes of text the arrays of one step are made for; a longer text is a step of its own.
STEP = 2 << 20


def _steps(texts: pa.Array) -> list[pa.Array]:
    """Slices of whole rows of about STEP bytes, so memory doesn't grow with the batch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(sizes // STEP)) + 1).tolist(), len(texts)] if len(texts) else [0, 0]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a or len(texts) == 0]


_FOUND = "struct<case:boolean,whole:tinyint,wide:boolean,latin:int,cyrillic:int,greek:int,east:int,other:int>"


def _found_array(found: Found) -> pa.Array:
    n = found.letters
    return pa.StructArray.from_arrays(
        [pa.array(found.case), pa.array(found.whole.astype(np.int8)), pa.array(found.wide), pa.array(n[:, LATIN]), pa.array(n[:, CYRILLIC]), pa.array(n[:, GREEK]), pa.array(n[:, HAN] + n[:, KANA]), pa.array(n[:, [ARABIC, INDIC, THAI]].sum(axis=1).astype(np.int32))],
        ["case", "whole", "wide", "latin", "cyrillic", "greek", "east", "other"],
    )


def look_alikes(df: DataFrame, text: str, out: str = "found", page: bool = False) -> DataFrame:
    """Adds a struct: case, and what only a wider context can decide (whole, wide), with the letters by script.

    page: text is an HTML page; tags are left out and references decoded. Null and empty texts are no cases."""

    def step(texts: pa.Array) -> pa.Array:
        codes, starts = code_points(texts)
        if page:
            codes, starts = decode_page(codes, starts)
        return _found_array(examine(codes, starts)[0])

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays(list(map(step, _steps(texts))))

    return df.withColumn(out, F.arrow_udf(run, _FOUND).asNondeterministic()(F.col(text)))


#: What a wider context can decide of a word: from which script to which its letters go.
DECIDED = {1: (CYRILLIC, LATIN), 2: (GREEK, LATIN), 3: (LATIN, CYRILLIC), 4: (LATIN, GREEK)}


def unified(df: DataFrame, text: str, out: str = "unified", page: bool = False, decided: str | None = None) -> DataFrame:
    """Adds the text in its one form. Null stays null. Full-width signs stay in rows with ideographs or kana.

    decided: a column of the keys of DECIDED, by which all letters of the row go to the other script; 0 or null decides nothing."""

    def step(texts: pa.Array, codes_of: np.ndarray | None = None) -> pa.Array:
        codes, starts = code_points(texts)
        if page:
            codes, starts = decode_page(codes, starts)
        real = examine(codes, starts)[1]
        if codes_of is not None and codes_of.any():
            t, safe, own = tables(), _entries(codes), np.repeat(codes_of, np.diff(starts))
            for code, (a, b) in DECIDED.items():
                at = (own == code) & (t.script[safe] == a) & (real == 0)
                real[at] = t.like[a, b][safe[at]]
        made = to_arrow(*unify(codes, starts, real))
        return pc.if_else(pc.is_valid(texts), made, pa.scalar(None, pa.string()))

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays(list(map(step, _steps(texts))))

    def run_decided(texts: pa.Array, codes_of: pa.Array) -> pa.Array:
        each = pc.fill_null(codes_of, 0).to_numpy(zero_copy_only=False)
        parts, at = [], 0
        for part in _steps(texts):
            parts.append(step(part, each[at : at + len(part)]))
            at += len(part)
        return pa.concat_arrays(parts)

    if decided is not None:
        return df.withColumn(out, F.arrow_udf(run_decided, "string").asNondeterministic()(F.col(text), F.col(decided).cast("int")))
    return df.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(F.col(text)))


_SUMS = ("latin", "cyrillic", "greek", "east", "other")


def _decide(words: DataFrame, group: str, text: str) -> DataFrame:
    """Words of which their scripts leave something open or that are cases, with found, is_case and decided (0 or a key of DECIDED).

    Groups (one file, one language) are summed map-side to one row; only undecided words are joined to their group."""
    seen = look_alikes(words, text)
    sums = seen.groupBy(group).agg(*[F.sum(f"found.{x}").alias(f"_{x}") for x in _SUMS])
    # the certain and the undecided ones only; the rest has gone into the sums
    some = seen.where("found.case or found.whole > 0 or found.wide").join(sums, group, "left")
    every = F.col("_latin") + F.col("_cyrillic") + F.col("_greek")
    latin = F.col("_latin") * 10 >= every * 8
    code = F.when(F.col("found.whole").isin(1, 2) & latin, F.col("found.whole").cast("int"))
    code = code.when((F.col("found.whole") == 3) & (F.col("_cyrillic") * 10 >= every * 8), 3).when((F.col("found.whole") == 3) & (F.col("_greek") * 10 >= every * 8), 4)
    some = some.withColumn("decided", F.coalesce(code.otherwise(0), F.lit(0)))
    is_case = F.col("found.case") | (F.col("decided") > 0) | F.coalesce(F.col("found.wide") & (F.col("_east") == 0), F.lit(False))
    return some.withColumn("is_case", is_case).select(*words.columns, "found", "is_case", "decided")


def word_cases(words: DataFrame, group: str, text: str) -> DataFrame:
    """Words with their found struct and `is_case`: certain ones, and those that the scripts of their group decide. Words without a
    group stand for themselves. Columns found, is_case and decided of the input are replaced."""
    words = words.drop("found", "is_case", "decided", *[f"_{x}" for x in _SUMS])
    return _decide(words, group, text).where("is_case").drop("decided")


def words_unified(words: DataFrame, group: str, text: str, out: str = "unified") -> DataFrame:
    """Words with out, the one form: as unified(), but letters that the group decides go to the group's script."""
    words = words.drop("found", "is_case", "decided", out, *[f"_{x}" for x in _SUMS])
    told = _decide(words, group, text).where("found.whole > 0").select(*words.columns, "decided")
    sure = look_alikes(words, text).where("found is null or found.whole = 0").select(*words.columns, F.lit(0).alias("decided"))
    return unified(sure.unionByName(told), text, out, decided="decided").drop("decided")


def p3_found(spark, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "evidence_words", "word_id", "evidence_id", "text").where("text is not null")
    pages = table(spark, sf_dir, "unicode_jobs", "job_id", "source").where("source is not null")
    a = word_cases(words, "evidence_id", "text").select(F.lit("evidence_words.text").alias("field_name"), F.col("word_id").alias("record_id"))
    b = look_alikes(pages, "source", page=True).where("found.case").select(F.lit("unicode_jobs.source").alias("field_name"), F.col("job_id").alias("record_id"))
    return a.unionByName(b).distinct()


def p3_unified(spark, sf_dir: str) -> DataFrame:
    """Words and pages, each once, in the one form."""
    words = deduplicate(table(spark, sf_dir, "evidence_words", "word_id", "evidence_id", "text", "received_at"), ["word_id"])
    pages = deduplicate(table(spark, sf_dir, "unicode_jobs", "job_id", "source", "received_at"), ["job_id"])
    a = words_unified(words, "evidence_id", "text").select(F.lit("evidence_words.text").alias("field_name"), F.col("word_id").alias("record_id"), "unified")
    b = unified(pages, "source", page=True).select(F.lit("unicode_jobs.source").alias("field_name"), F.col("job_id").alias("record_id"), "unified")
    return a.unionByName(b)
