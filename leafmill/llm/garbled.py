"""Problem 8: text decoded with the wrong character encoding.

Round-trip repair: the characters are encoded again under each candidate legacy encoding and strictly decoded as the intended
one, layer after layer, and a layer is accepted when the garbling cost drops. The cost is that of the words with other than
ASCII characters: their cross-entropy under the best of the languages' character models. Text that lost characters (replacement
characters) is found and left as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import table
from .charmodels import WORD, CharModels, inventory

#: Encodings text may have been read as by mistake, and single-byte and multi-byte ones it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "iso8859-16", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "cp874")
SINGLE = ("cp1252", "cp1250", "iso8859-2", "iso8859-16", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1253", "iso8859-7", "cp737", "cp1256", "iso8859-6", "cp874", "mac-roman", "cp850", "cp437", "cp852")
DOUBLE = ("cp932", "gbk", "euc_jp", "big5", "euc_kr")
#: Readings common enough that two words changed for the better show one.
COMMON = ("cp1252", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "cp866", "cp1253", "iso8859-7")
WIDE = ("gb18030", "cp932", "big5")
READ_AS_DOUBLE = ("latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac-roman")
#: The cost must drop by so many nats.
LEAST = 6.0
#: Words of a non-Latin script that average more nats a character over so many words of a line, or over a shorter line of at least
#: so many characters, make it worth a trial.
SUSPECT, STRETCH, SHORT = 4.2, 3, 8
#: Letters and signs outside the samples that clean text in these scripts may hold.
_SIGNS = frozenset("«»‹›“”„‘’‚…—–―‐‑•·°№ºª½¼¾²³¹₂©®™±×÷§€£µ¿¡   　、。「」『』・ー！？：；，（）।॥؟،؛")
_RANGES = ((0x0391, 0x03CE), (0x0400, 0x045F), (0x0621, 0x0652), (0x0660, 0x0669), (0x0901, 0x0963), (0x0E01, 0x0E5B), (0x3041, 0x30FE), (0x4E00, 0x9FA5), (0xFF01, 0xFF5E))
_ALPHABETS = frozenset("ÀÂÆÇÈÉÊËÎÏÔŒÙÛÜŸàâæçèéêëîïôœùûüÿÄÖÜäöüßẞÁÉÍÑÓÚÜáéíñóúüÌÒìòÃÕãõĂÂÎȘȚăâîșțŞŢşţ")


def _plausible(c: str, seen: frozenset[str]) -> bool:
    return c < "\x80" and (c >= " " or c in "\t\n\r") or c in seen or c in _SIGNS or c in _ALPHABETS or any(a <= ord(c) <= b for a, b in _RANGES)


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte for bytes 80-FF; an undefined byte is the control character of its number, as browsers read it."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    if encoding == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _utf8_pattern(encoding: str) -> re.Pattern:
    """Whole UTF-8 sequences as the wrong encoding shows them."""
    by = {b: c for c, b in reversed(_bytes_of(encoding).items())}
    group = lambda a, b: "[" + "".join(re.escape(c) for c, x in _bytes_of(encoding).items() if a <= x <= b) + "]"
    cont = group(0x80, 0xBF)
    tail = "|" + re.escape(by[0xC3]) + "(?= )" if by.get(0xA0) == "\xa0" and 0xC3 in by else ""
    lost = "|" + re.escape(by[0xE2] + by[0x80]) + "(?![\x80-￿])" if encoding in ("cp1252", "cp1250") else ""
    return re.compile(f"(?:{group(0xC2, 0xDF)}{cont}|{group(0xE0, 0xEF)}{cont}{{2}}|{group(0xF0, 0xF4)}{cont}{{3}})+{lost}{tail}")


@lru_cache(maxsize=None)
def _utf8_parts(encoding: str) -> tuple[frozenset[str], frozenset[str]]:
    codes = _bytes_of(encoding)
    return frozenset(c for c, b in codes.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in codes.items() if b <= 0xBF)


def _undo_utf8(text: str, encoding: str, plausible) -> tuple[str, int]:
    """The text with its sequences decoded, and how many characters came. Sequences whose character is neither plausible nor such as a
    further layer shows stay; none is decoded where those are eight times the others."""
    codes = _bytes_of(encoding)
    good = bad = 0

    def back(m: re.Match) -> str:
        nonlocal good, bad
        raw = bytes([codes[c] for c in m[0]])
        if raw == b"\xe2\x80":  # the third byte, 9D, has no character and was dropped
            good += 1
            return "”"
        if raw == b"\xc3":  # the second byte, A0, became a plain space
            good += 1
            return "à"
        parts, at = [], 0
        while at < len(raw):
            size = 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                c = raw[at : at + size].decode("utf-8")
            except UnicodeDecodeError:
                c = ""
            # what stands there by chance, in a part that isn't garbled, stays
            if c and (plausible(c) or "\x80" <= c <= "ÿ" or c in _LAYERED):
                good += 1
            else:
                c = m[0][at : at + size]
                bad += 1
            parts.append(c)
            at += size
        return "".join(parts)

    out = _utf8_pattern(encoding).sub(back, text)
    return (out, good) if good and bad <= 8 * good else (text, 0)


_HAN = re.compile("[⺀-퟿豈-﫿！-～‐-⁯€�ぁ-ヿ]{3,}")


def _undo_utf8_double(text: str, encoding: str, plausible) -> tuple[str, int]:
    """The same for UTF-8 read as an encoding of two bytes a character: runs of ideographs, as far as they decode strictly. What lies
    around a lost byte stays as it is."""
    total = 0

    def back(m: re.Match) -> str:
        nonlocal total
        parts: list[bytes] = []
        for c in m[0]:
            try:
                parts.append(c.encode(encoding))
            except UnicodeEncodeError:
                parts.append(b"\xff")  # never part of UTF-8
        out, at = [], 0
        while at < len(parts):
            raw, end = b"".join(parts[at:]), len(parts)
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError as e:
                size, end = 0, at
                while end < len(parts) and size + len(parts[end]) <= e.start:
                    size += len(parts[end])
                    end += 1
            while end > at:  # a part ends where a character ends in both encodings
                try:
                    to = b"".join(parts[at:end]).decode("utf-8")
                    break
                except UnicodeDecodeError:
                    end -= 1
            good = sum(1 for c in to if c > "\x7f" and plausible(c)) if end > at else 0
            if good >= 2 and good >= 1.5 * (len(to) - good):
                total += good
                out.append(to)
            else:
                end = max(end, at + 1)
                out.append(m[0][at:end])
            at = end
        return "".join(out)

    return _HAN.sub(back, text), total


def _double_traces(text: str, encoding: str, plausible) -> bool:
    """Whether runs of ideographs read mostly as UTF-8, bytes lost on the way or not."""
    for m in _HAN.finditer(text):
        to = m[0].replace("\ufffd", "").encode(encoding, "ignore").decode("utf-8", "replace")
        good = sum(1 for c in to if c != "\ufffd" and c > "\x7f" and plausible(c))
        if good >= 2 and good >= 1.5 * (len(to) - good):
            return True
    return False


#: Characters that bytes 80-FF show as in the encodings a text is likely to be read as.
_LAYERED = frozenset("".join(_bytes_of(e) and "".join(_bytes_of(e)) for e in ("cp1252", "cp437", "cp850", "mac-roman", "cp1251", "cp1250")))


@lru_cache(maxsize=None)
def _single_map(wrong: str, right: str) -> dict[int, str] | None:
    """Character map of wrong -> right for bytes 80-FF, where both know the byte."""
    out = {}
    for c, b in _bytes_of(wrong).items():
        try:
            to = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if to != c:
            out[ord(c)] = to
    return out or None


@lru_cache(maxsize=None)
def _double_pattern(wrong: str, right: str) -> re.Pattern:
    by = _bytes_of(wrong)
    cls = lambda *spans: "[" + "".join(re.escape(c) for a, b in spans for c in [*(chr(x) for x in range(a, min(b, 127) + 1)), *(c for c, x in by.items() if a <= x <= b)]) + "]"
    pair = {
        "cp932": (cls((0x81, 0x9F), (0xE0, 0xFC)), cls((0x40, 0x7E), (0x80, 0xFC))),
        "gbk": (cls((0x81, 0xFE)), cls((0x40, 0x7E), (0x80, 0xFE))),
        "big5": (cls((0xA1, 0xF9)), cls((0x40, 0x7E), (0xA1, 0xFE))),
        "euc_jp": (cls((0xA1, 0xFE)), cls((0xA1, 0xFE))),
        "euc_kr": (cls((0xA1, 0xFE)), cls((0xA1, 0xFE))),
    }[right]
    return re.compile(f"(?:{pair[0]}{pair[1]}|[0-9 ])*(?:{pair[0]}{pair[1]}){{2,}}(?:{pair[0]}{pair[1]}|[0-9])*")


def _undo_double(text: str, wrong: str, right: str) -> tuple[str, int]:
    codes = _bytes_of(wrong)
    count = 0

    def back(m: re.Match) -> str:
        nonlocal count
        try:
            to = bytes([codes.get(c, ord(c)) for c in m[0]]).decode(right)
        except (UnicodeDecodeError, ValueError):
            return m[0]
        if sum("぀" <= c <= "鿿" for c in to) < 2:
            return m[0]
        count += 1
        return to

    return _double_pattern(wrong, right).sub(back, text), count


_OTHER = re.compile(r"[^\s!-@\[-`{-~]*[^\x00-\x7f][^\s!-@\[-`{-~]*")
_LOST = re.compile("�|ï¿½|п»ї|ï»¿")


#: Letters beyond a-z that clean text in each language uses.
_LETTERS = {
    "de": "äöüß", "en": "éèêëïöüçñàâô", "es": "áéíñóúü", "fr": "àâæçèéêëîïôœùûüÿ", "it": "àèéìíîòóùú", "pt": "áâãàçéêíóôõúü", "ro": "ăâîșțşţ",
    "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
}
#: A sign that stands between two letters shows a wrong decoding; so does a control character.
_BETWEEN = re.compile(r"[^\W\d_][¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿‚ƒ„…†‡ˆ‰‹‘“”•–—˜™›€¡√∞∑∏∫≈◊∂░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀]+[^\W\d_]|[\x80-\x9f]")
_AMID = frozenset(re.search(r"\]\[(.+?)\]\+\[", _BETWEEN.pattern)[1]) - frozenset("“”«»–—…¡") | frozenset(map(chr, range(0x80, 0xA0)))
_SCRIPTS = (("Ͱ", "Ͽ"), ("Ѐ", "ѿ"), ("؀", "ۿ"))
_OPENERS, _CLOSERS = "“„«‘‹¿¡—–", "”»’“›…—–°"


@lru_cache(maxsize=None)
def _level1(c: str) -> bool:
    """One of the usual ideographs, by the first levels of the national character sets."""
    for encoding, low, high in (("gb2312", 0xB0A1, 0xD7F9), ("cp932", 0x889F, 0x9872)):
        try:
            if low <= int.from_bytes(c.encode(encoding), "big") <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


#: What the last repairers of a worker process remember.
_LIVE: dict[str, tuple[dict, dict, dict]] = {}


class Repairer:
    def __init__(self, models: CharModels) -> None:
        self.models = models
        self._remember()
        self.alphabets = {lang: frozenset(_LETTERS.get(lang, "") + _LETTERS.get(lang, "").upper()) | frozenset(c for c in models.alphabets.get(lang, ()) if c > "\x7f") for lang in models.langs}

    def _remember(self) -> None:
        """Costs of runs and kinds of characters, shared by a process's tasks that have the same models."""
        self._costs: dict[str, float]
        self._plain: dict[str, bool]
        self._kinds: dict[str, int]
        key = self.models.key
        if key and key not in _LIVE:
            while len(_LIVE) >= 4:
                _LIVE.pop(next(iter(_LIVE)))
            _LIVE[key] = ({}, {}, {})
        self._costs, self._plain, self._kinds = _LIVE[key] if key else ({}, {}, {})
        self._known: dict[tuple[str, str], tuple | None] = {}

    def __getstate__(self) -> dict:
        return {"models": self.models, "alphabets": self.alphabets}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._remember()

    def _odd(self, c: str) -> bool:
        odd = self._plain.get(c)
        if odd is None:
            odd = self._plain[c] = not _plausible(c, self.models.seen) or "Ѐ" <= c <= "ѿ" and c.lower() not in _LETTERS["ru"]
        return odd

    def _kind(self, c: str) -> int:
        """1 odd, 2 a Latin letter beyond ASCII, 4 Greek, Cyrillic or Arabic, 16 a rare ideograph, 32 a sign that may stand amid letters;
        0 none of these."""
        if self._odd(c):
            return 1
        if ("À" <= c <= "ɏ" or "˂" <= c <= "˿" or c in "ºª") and c not in _SIGNS:
            return 2
        if any(a <= c <= b for a, b in _SCRIPTS):
            return 4
        if "一" <= c <= "龥":
            return 0 if _level1(c) else 16
        return 32 if c in _AMID else 0

    def cost(self, runs: list[str]) -> dict[str, float]:
        """Nats of each run of characters around one that isn't ASCII, with a charge for each character no clean text has."""
        known = self._costs
        if len(known) > 200_000:
            known.clear()
        if fresh := [r for r in dict.fromkeys(runs) if r not in known]:
            s, _ = self.models.score([WORD.findall(r.lower()) for r in fresh])
            best = -s.max(axis=1) if s.shape[1] else np.zeros(len(fresh))
            for r, nats in zip(fresh, best):
                known[r] = float(nats) + 9.0 * sum(map(self._odd, r)) + 9.0 * len(_BETWEEN.findall(r))
        return {r: known[r] for r in runs}

    def total(self, text: str) -> float:
        runs = _OTHER.findall(text)
        costs = self.cost(runs)
        return sum(costs[r] for r in runs)

    def languages(self, text: str) -> list[str]:
        """Languages that win a line of the text."""
        lines = [w for w in (WORD.findall(x.lower()) for x in text.split("\n")) if w]
        if not lines or not self.models.langs:
            return []
        s, n = self.models.score(lines)
        won = {self.models.langs[k] for k, size in zip(s.argmax(axis=1), n) if size >= 20}
        whole = self.models.langs[int(s.sum(axis=0).argmax())]
        return [whole, *sorted(won - {whole})]

    def top_languages(self, texts: Sequence[str]) -> list[tuple[str, float] | None]:
        """The language of each text as a whole and its nats a character, all scored in one call."""
        if not self.models.langs:
            return [None] * len(texts)
        s, n = self.models.score([WORD.findall(t.lower()) for t in texts])
        return [(self.models.langs[k], -x / max(1.0, size)) for k, x, size in zip(s.argmax(axis=1), s.max(axis=1), n)]

    def suspects(self, text: str, top: tuple[str, float] | None = None) -> tuple[list[str], list[str], set[str]]:
        """Runs with a character that is no letter of the text's languages, or that read badly; the languages; those characters."""
        others = {c for c in set(text) if c > "\x7f"}
        if not others or not self.models.langs:
            return [], [], set()
        whole, _ = top or self.top_languages([text])[0]
        # most texts hold nothing out of place, which their characters' kinds tell at once
        kinds = self._kinds
        mask = rare = 0
        alphabet = self.alphabets[whole]
        for c in others:
            kind = kinds.get(c)
            if kind is None:
                kind = kinds[c] = self._kind(c)
            if kind == 2 and c in alphabet:
                continue
            rare += kind == 16
            mask |= kind
        strange = self._stretches(text, [r for r in _SCRIPTS if any(r[0] <= c <= r[1] for c in others)]) if mask & 4 else set()
        if not mask & 35 and rare < 3 and not strange:
            return [], [whole], set()
        odd = {c for c in others if self._odd(c)}
        latin = {c for c in others if kinds[c] == 2}
        han = [c for c in others if "一" <= c <= "龥"]
        if han and (rare := [c for c in han if not _level1(c)]) and len(rare) >= 3 and len(rare) * 3 > len(han):
            odd.update(rare)
        if not odd and not strange and latin <= self.alphabets[whole] and others.isdisjoint(_AMID):
            return [], [whole], set()
        langs = self.languages(text)
        usual = frozenset().union(*(self.alphabets[x] for x in langs)) if langs else frozenset()
        foreign = (latin - usual) | odd
        runs = list(dict.fromkeys(_OTHER.findall(text)))
        out = [r for r in runs if not foreign.isdisjoint(r) or _BETWEEN.search(r)]
        if strange:
            bad = [r for r in runs if not strange.isdisjoint(WORD.findall(r.lower()))]
            out = list(dict.fromkeys(out + bad))
            foreign = foreign | {c for r in bad for c in r if c > "\x7f" and c not in _SIGNS}
        return out, langs, foreign

    def _stretches(self, text: str, scripts: list[tuple[str, str]]) -> set[str]:
        """Words of the stretches that read badly, of each script by itself, so that a second language doesn't count. Each stretch is
        held against the limit alone, so that the rest of the text doesn't hide it."""
        out: set[str] = set()
        lines = [WORD.findall(line) for line in text.lower().split("\n")]
        for a, b in scripts:
            each = [own for line in lines if (own := [w for w in line if a <= w[0] <= b])]
            if not each:
                continue
            every = [w for own in each for w in own]
            s, n = self.models.each(every)
            sums, sizes = np.zeros((len(every) + 1, s.shape[1])), np.zeros(len(every) + 1)
            np.cumsum(s, axis=0, out=sums[1:])
            np.cumsum(n, out=sizes[1:])
            counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            last = np.repeat(np.cumsum(counts), counts)
            at = np.arange(len(every))
            # whole stretches, and from the start of a line what it has
            at = at[(at + STRETCH <= last) | (at == last - np.repeat(counts, counts))]
            end = np.minimum(at + STRETCH, last[at])
            size = sizes[end] - sizes[at]
            bad = (size >= SHORT) & ((sums[at] - sums[end]).min(axis=1) > SUSPECT * size)
            out.update(w for i, j in zip(at[bad], end[bad]) for w in every[i:j])
        return out

    def repair(self, text: str | None, top: tuple[str, float] | None = None) -> tuple[str | None, bool, list[str]]:
        """(text as far as restored, whether any of it was garbled, layers taken off). Null and ASCII text is never garbled."""
        if text is None or text.isascii():
            return text, False, []
        lost = bool(_LOST.search(text))
        suspects, langs, foreign = self.suspects(text, top)
        if not suspects:
            return text, lost, []
        origin, origin_cost = text, self.total(text)
        best = (text, origin_cost, ())
        trail: tuple[str, ...] = ()
        while True:  # each layer is shorter than the one before, but for one of a legacy encoding
            step = self._layer(text, suspects, langs, foreign, any(not x.startswith("utf-8") for x in trail))
            if step is None or step[0] == text:
                break
            text, name = step
            trail = (*trail, name)
            cost = self.total(text)
            if cost < best[1]:
                best = (text, cost, trail)
            suspects, langs, foreign = self.suspects(text)
            if not suspects:
                break
        fixed, cost, trail = best
        if trail and origin_cost - cost >= LEAST:
            return fixed, True, list(trail)
        return origin, lost or self._broken(origin, langs), []

    def repair_all(self, texts: Sequence[str | None]) -> list[tuple[str | None, bool, list[str]]]:
        """repair() of each text; the texts' languages are found in one call."""
        at = [i for i, t in enumerate(texts) if t is not None and not t.isascii()]
        top = dict(zip(at, self.top_languages([texts[i] for i in at])))
        return [self.repair(t, top.get(i)) for i, t in enumerate(texts)]

    def _broken(self, text: str, langs: list[str]) -> bool:
        """Wrong beyond repair: control characters, or whole UTF-8 sequences of a common mistake that were cut."""
        if re.search("[\x80-\x84\x86-\x9f]|â€", text):
            return True
        han = [c for c in set(text) if "一" <= c <= "龥" and not _level1(c)]
        return len(han) >= 3 and any(_double_traces(text, e, lambda c: not self._odd(c)) for e in WIDE)

    def _layer(self, text: str, suspects: list[str], langs: list[str], foreign: set[str], legacy: bool = False) -> tuple[str, str] | None:
        """The one re-decoding that brings the cost down most. legacy: a layer of another encoding than UTF-8 is off already."""
        before = self.total(text)
        # encodings that decode any of the runs that look wrong are compared on the whole text, with what lies under them. What one
        # leaves as it is doesn't count against it: legitimate odd characters may stand beside a garbled stretch
        probe = "\n".join(suspects)
        others = {c for c in set(probe) if c > "\x7f"}
        out_of_place = sum(map(probe.count, foreign))
        plausible = lambda c: not self._odd(c)
        best: tuple[float, str, str] | None = None
        found: list[tuple[float, str, str, bool]] = []
        priced: dict[str, float] = {}
        for wrong in READ_AS:
            lead, tail = _utf8_parts(wrong)
            if others.isdisjoint(lead) or others.isdisjoint(tail) and " " not in text:
                continue
            to, count = _undo_utf8(probe, wrong, plausible)
            if not count:
                continue
            taken = len(probe) - len(to) + count
            to, count = _undo_utf8(text, wrong, plausible)
            if not count:
                continue
            cost = priced.get(to)
            if cost is None:
                cost = priced[to] = self.total(to)
            # a layer counts with what the one below it would give
            for second in dict.fromkeys((wrong, "cp1252", "latin-1", "mac-roman", "cp437")):
                lead, tail = _utf8_parts(second)
                if lead.isdisjoint(to) or tail.isdisjoint(to):
                    continue
                under, more = _undo_utf8(to, second, plausible)
                if more * 3 >= count:
                    if under not in priced:
                        priced[under] = self.total(under)
                    cost = min(cost, priced[under])
            found.append((cost, to, f"utf-8 read as {wrong}", taken * 5 >= out_of_place * 4))
        if any("⺀" <= c <= "鿿" for c in foreign):
            for wrong in WIDE:
                to, count = _undo_utf8_double(text, wrong, plausible)
                if count:
                    found.append((self.total(to) - 3.0 * count, to, f"utf-8 read as {wrong}", True))
        if found:
            cost, to, name, most = min(found, key=lambda x: x[0])
            if cost < before - 2:
                if most and cost < 0.5 * before or legacy:
                    return to, name
                best = (before - cost, to, name)
        if legacy:  # one such layer is all there is
            return None
        usual = frozenset().union(*(self.alphabets[x] for x in langs)) if langs else frozenset()
        old = self.cost(suspects)
        # a run is turned if the map knows all its letters out of place, so what else is odd in the text says nothing
        place = {r: frozenset(c for c in r if c in foreign) for r in suspects}
        every = frozenset().union(*place.values())
        maps = []
        for wrong in READ_AS:
            if every.isdisjoint(_bytes_of(wrong)):
                continue
            for right in SINGLE:
                known = self._maps(wrong, right)
                if known and (runs := [r for r, own in place.items() if own and own <= known[1]]):
                    maps.append((-sum(len(place[r]) for r in runs), len(maps), known[0], f"{right} read as {wrong}", runs))
        seen: set[tuple] = set()
        turns = []
        for _, _, map_, name, runs in sorted(maps, key=lambda x: x[:2]):
            turned = {r: b for r in runs if (b := self._turn(r, map_, usual)) is not None}
            key = tuple(turned.items())
            if turned and key not in seen:
                seen.add(key)
                turns.append((map_, name, turned))
        new = self.cost([b for *_, turned in turns for b in turned.values()])
        for map_, name, turned in turns:
            turned = {a: b for a, b in turned.items() if old[a] - new[b] > 1}
            gain = sum(old[a] - new[b] for a, b in turned.items())
            if gain < LEAST or gain <= (best[0] if best else 0):
                continue
            # a name that loses a letter to a dash or quote shows nothing
            if not any(x != y and (y.isalpha() or not x.isalpha()) for a, b in turned.items() for x, y in zip(a, b)):
                continue
            other = [b for b in turned.values() if any(c > "ͯ" and c.isalpha() for c in b)]
            if other:
                # words of one script are all turned or none in a line, and small letters aren't followed by capitals
                if sum(any(x.islower() and y.isupper() for x, y in zip(b, b[1:])) for b in other) * 3 > len(other) or not self._whole_lines(text, turned):
                    continue
                s, n = self.models.score([WORD.findall(b.lower()) for b in other])
                if n.sum() < 8 or -s.sum(axis=0).max() > 4.0 * n.sum():
                    continue
            elif len(turned) == 1 or name.rsplit(" ", 1)[1] not in COMMON:
                # foreign names aren't garbled because other letters would be usual ones: words must come
                s, n = self.models.score([WORD.findall(b.lower()) for b in turned.values()])
                if -s.max(axis=1).sum() > 4.0 * n.sum():
                    continue
            # other words that the same mistake made of the languages' letters
            more = {}
            for r in dict.fromkeys(_OTHER.findall(text)):
                if r in turned or (b := r.translate(map_)) == r or any(map(self._odd, b)):
                    continue
                own = [c for c in b if c.isalpha()]
                if all(c < "\x80" or c in usual for c in own) or other and all(c > "ͯ" for c in own):
                    more[r] = b
            if more:
                was, now = self.cost(list(more)), self.cost(list(more.values()))
                turned.update((r, b) for r, b in more.items() if was[r] - now[b] > 2)
            best = (gain, _OTHER.sub(lambda m: turned.get(m[0], m[0]), text), name)
        if _LONG.search(text):
            shown = frozenset(c for m in _LONG.finditer(text) for c in m[0] if c > "\x7f")
            for wrong in READ_AS_DOUBLE:
                if len(shown & _bytes_of(wrong).keys()) * 2 < len(shown):
                    continue  # characters this reading can't show
                for right in DOUBLE:
                    to, count = _undo_double(text, wrong, right)
                    if count:
                        known = sum(1.0 if c in self.models.seen else 0.3 if _level1(c) else -1.0 for c in to if c > "぀")
                        gain = before - self.total(to) + known
                        if gain > (best[0] if best else 12) and known > 0:
                            best = (gain, to, f"{right} read as {wrong}")
        return (best[1], best[2]) if best else None

    def _whole_lines(self, text: str, turned: dict[str, str]) -> bool:
        """Whether at least half of the letters of a non-Latin script that stand in lines with a turned run belong to turned runs."""
        of = {i for r, to in turned.items() for i, (a, b) in enumerate(_SCRIPTS) if any(a <= x <= b and x != y for x, y in zip(r, to))}
        if not of:
            return True
        own = every = 0
        for line in text.split("\n"):
            runs = _OTHER.findall(line)
            if any(r in turned for r in runs):
                for r in runs:
                    n = sum(any(_SCRIPTS[i][0] <= c <= _SCRIPTS[i][1] for i in of) for c in r)
                    every += n
                    own += n if r in turned else 0
        return own * 2 >= every

    def _maps(self, wrong: str, right: str) -> tuple[dict[int, str], frozenset[str]] | None:
        """The character map of an encoding read as another, and the characters it gives something plausible for."""
        key = (wrong, right)
        if key not in self._known:
            map_ = _single_map(wrong, right) if wrong != right else None
            self._known[key] = map_ and (map_, frozenset(chr(c) for c, to in map_.items() if not self._odd(to)))
        return self._known[key]

    def _turn(self, run: str, map_: dict[int, str], usual: frozenset[str]) -> str | None:
        """The run under a character map, if what changes was out of place and what comes fits the text's languages or is one other script."""
        to = run.translate(map_)
        if to == run or len(to) != len(run):
            return None
        last = len(run) - 1
        letters = other = 0
        for i, (a, b) in enumerate(zip(run, to)):
            if b.isalpha() or b > "ͯ" and not b.isascii() and b not in _SIGNS:
                letters += 1
                other += b > "ͯ"
            if a == b:
                continue
            if self._odd(b) and not self._odd(a):
                return None
            if b > "ͯ" and (b.isalpha() or "\u0e00" <= b <= "\u0e5b"):
                continue
            if a in usual and a not in _SIGNS:
                return None
            if b.isalpha():
                if b not in usual:
                    return None
            elif b == "’":
                continue
            elif b in _OPENERS and (i == 0 or not run[i - 1].isalnum()) or b in _CLOSERS and (i == last or not run[i + 1].isalnum()) and (i > 0 or b in "—–"):
                continue
            else:
                return None
        if other and (other < letters or any(c.isascii() and c.isalpha() for c in run) or sum(a != b for a, b in zip(run, to)) < 2):
            return None
        return to


#: What text of two bytes a character looks like: long runs, few ASCII letters.
_LONG = re.compile(r"[\x80-⹿](?:[0-9}{|\[\]@-_]?[\x80-⹿]){3}")


def fitted(spark, sf_dir: str, calibrate: bool = False) -> CharModels:
    """Models of all samples. Tasks count the words, so the driver gets each word of a language once and no texts; calibration holds
    out texts and needs them there."""
    rows = table(spark, sf_dir, "language_samples", "lang", "text").where("text <> '' and lang <> ''")
    if calibrate:
        return CharModels.fit([(r[0], r[1]) for r in rows.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for samples in batches:
            for lang, texts in samples.groupby("lang")["text"]:
                words, letters = inventory(unicodedata.normalize("NFC", t) for t in texts)
                yield pd.DataFrame([(lang, True, w, n) for w, n in words.items()] + [(lang, False, c, 1) for c in letters], columns=["lang", "is_word", "item", "n"])

    types: dict[str, Counter] = defaultdict(Counter)
    letters: dict[str, set[str]] = defaultdict(set)
    for lang, is_word, item, n in rows.mapInPandas(run, "lang string, is_word boolean, item string, n long").groupBy("lang", "is_word", "item").agg(F.sum("n")).collect():
        if is_word:
            types[lang][item] = n
        else:
            letters[lang].add(item)
    return CharModels.of_counts(types, letters)


def repair_garbled(df: DataFrame, text: str, models: CharModels, out: str = "repair") -> DataFrame:
    """Adds STRUCT<text, garbled BOOLEAN, layers ARRAY<STRING>>. The models, under two MB with the samples at hand, travel with the
    function. ASCII and null texts don't leave the JVM. Empty text is not garbled."""
    repairer = Repairer(models)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = repairer.repair_all([None if t is None or t != t else t for t in texts])
            yield pd.DataFrame(rows, columns=["text", "garbled", "layers"])

    udf = F.pandas_udf(run, "struct<text:string,garbled:boolean,layers:array<string>>").asNondeterministic()
    plain = F.struct(F.col(text).alias("text"), F.lit(False).alias("garbled"), F.array().cast("array<string>").alias("layers"))
    other = F.octet_length(text) > F.length(text)
    return df.withColumn(out, F.when(other, udf(F.when(other, F.col(text)))).otherwise(plain))


def p8_found(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return repair_garbled(documents, "text", fitted(spark, sf_dir)).where("repair.garbled").select("doc_id")


def p8_restored(spark, sf_dir: str) -> DataFrame:
    """Garbled documents with their text as far as it could be restored and the layers taken off."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = repair_garbled(documents, "text", fitted(spark, sf_dir)).where("repair.garbled")
    return rows.select("doc_id", F.col("repair.text").alias("restored_text"), F.array_join("repair.layers", "; ").alias("layers"))
