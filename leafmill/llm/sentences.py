"""Problem 4: sentence boundaries in all scripts.

Characters are tagged boundary or inside by a linear-chain model decoded with Viterbi. Only characters where a sentence can end have
a choice (a closing mark with its quotes and brackets; a gap in Thai; any character of Chinese or Japanese in a block without closing
marks), so the chain runs over those; all others are inside with certainty. Emissions are learned weights of the characters, the
words and their shapes on both sides; transitions are learned weights of a tag after the one before, by the distance between them.
Nothing else decides: there is no list of abbreviations and no rule at decoding time.

Training is an averaged structured perceptron on partly labelled text: the ends of samples are boundaries, and where the orthography
shows it (a small letter, a digit or a comma follows; a known beginning of a sample follows) the tag is known; the other places are
latent and take the tags the model itself finds best among those that agree with the known ones. Samples of Thai, Chinese and
Japanese are used once more with their marks stripped, the boundaries the marks showed kept as labels.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import table
from .markup import unescape

#: At most so many sample rows, pages (about, chosen by a hash of their ids) and paragraphs of these are read to train on.
TRAIN_ROWS, TRAIN_PAGES, TRAIN_PARAGRAPHS = 5000, 800, 3000

#: By how much a known tag is to outweigh the wrong one.
MARGIN = 8.0
#: Scores a task remembers.
KEPT = 200_000
#: Turns over the samples.
ROUNDS = 12

_END = re.compile(r"(?:[!?…؟।॥。！？｡]|\.(?![^\s.!?…\"'”’»“)\]」』›,،;:]))+(?:[.!?…؟]*)(?:[\"'”’“)\]」』›]|\s?»)*|(?<=[Ͱ-Ͽἀ-῿])[;;](?:[\"'”’)\]]|\s?»)*(?=\s|$|[,—–-])")
_SHOWN = re.compile(r"\S")
#: What no word before a mark goes over, besides white space.
_STOP = frozenset("\"'“”„«»‹›()[]¿¡—–/")
_TOKEN = re.compile(r"[^\s\"'“”„«»‹›()\[\]¿¡—–/,;:!?…]+")
_NEXT = re.compile(r"\s*([\"'“„«‹(\[¿¡「『—–-]*)\s*(.?)", re.S)
_OPEN = "“„«‹「『\""
_THAI = re.compile(r"[฀-๿]")
_GAP = re.compile(r"\s+")
#: Scripts without spaces; the next two write closing marks, which a block may lack.
_EAST = re.compile(r"[぀-ヿ一-鿿]")
_UNSPACED = re.compile(r"[฀-๿぀-ヿ一-鿿]")
_CLOSERS = "\"'”’“)]」』›»   \n"
_STRONG = frozenset("!?؟！？;;")
_FULL = frozenset("।॥。｡")
#: A word is a usual beginning if at least one in so many of its occurrences begins a sample.
OFTEN = 8
#: Transitions have weights of their own up to each of these distances: letters between two candidates, the gap left out.
_STEPS = (1,)


def _case(c: str) -> str:
    return "end" if not c else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "plain" if c.isalpha() else "other"


def _shape(word: str) -> str:
    """Kinds of the word's characters, runs of one kind once, and its length up to four."""
    kinds = "".join("d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else "." if c == "." else "x" for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)[:6] + str(min(len(word), 5))


def _step(distance: int) -> int:
    return sum(distance > s for s in _STEPS)


def _word_before(text: str, since: int, at: int) -> str:
    i = at
    while i > since and text[i - 1] not in _STOP and not text[i - 1].isspace():
        i -= 1
    return text[i:at]


def _distance(text: str, last: int, start: int) -> int:
    return start - last - text[last : last + 1].isspace()


def start_key(text: str, at: int) -> str:
    """What tells the beginning of a sentence at a place: its first word, or the first two characters where no spaces are written."""
    m = _NEXT.match(text, at)
    at = m.end() - len(m[2])
    if _UNSPACED.match(text, at):
        return text[at : at + (4 if _THAI.match(text, at) else 2)]
    w = _TOKEN.match(text, at)
    return w[0] if w else ""


class Lexicon:
    """What the training text shows of words: beginnings of its samples, and how often a word stands before a period or without one,
    and in small letters. Bounded as the training text is."""

    def __init__(self) -> None:
        self.starts: Counter = Counter()
        self.dotted: Counter = Counter()
        self.bare: Counter = Counter()

    def add(self, text: str, sign: int = 1) -> None:
        if key := start_key(text, 0):
            self.starts[key] += sign
        for m in _TOKEN.finditer(text):
            w = m[0]
            dots = w.endswith(".") and m.end() < len(text.rstrip())
            (self.dotted if dots else self.bare)[w.rstrip(".").lower() if dots else w.rstrip(".")] += sign

    def bare_of(self, word: str) -> str:
        """Whether a word before a period is also written without one: 'yes', 'no', or 'new' where it is in no training text."""
        n = self.bare[word] + (self.bare[word.lower()] if word.lower() != word else 0)
        return "yes" if n > 0 else "no" if self.dotted[word.lower()] > 0 else "new"

    def next_of(self, key: str) -> str:
        """Whether a word begins samples often for how often it occurs ('start'), or is also written small, or begins few or none."""
        if not key:
            return "none"
        begins, low = self.starts[key], key.lower()
        if begins > 0 and begins * OFTEN >= self.bare[key] + self.dotted[low]:
            return "start"
        return "small" if low != key and self.bare[low] > 0 else "rare" if begins > 0 else "other"


class Look(NamedTuple):
    """What the emissions look at around a mark."""

    mark: str  # with its closers
    next: str  # the sign right behind, '' for a letter or digit
    opener: str
    case: str
    key: str
    word: str  # before the mark
    digits: str  # 'True' or 'False' of the word before that, '' where there is none
    quoted: bool


def _look(text: str, start: int, end: int, since: int) -> Look:
    """Around the candidate text[start:end], a mark with its closers, in a sentence begun at since."""
    mark = text[start:end]
    n = _NEXT.match(text, end)
    after = text[end : end + 1]
    at = n.end() - len(n[2])
    if _UNSPACED.match(text, at):
        key = text[at : at + (4 if _THAI.match(text, at) else 2)]
    else:
        w = _TOKEN.match(text, at)
        key = w[0] if w else ""
    word = digits = ""
    if mark == ".":
        word = _word_before(text, since, start)
        gap = start - len(word)
        while gap > since and (text[gap - 1].isspace() or text[gap - 1] in _STOP):
            gap -= 1
        if before := _word_before(text, since, gap):
            digits = str(before.isdigit())
    quoted = False
    if len(mark) > 1 and (closers := mark[len(mark.rstrip(_CLOSERS)) :]) and closers.strip("   \n)]"):
        head = _SHOWN.search(text, since, start)
        quoted = bool(head) and head[0] in _OPEN
    return Look(mark, "" if after.isalnum() else after, n[1], _case(n[2]), key, word, digits, quoted)


def _features(look: Look, known: Lexicon) -> list[str]:
    """Emission features of a mark."""
    mark, after, opener, case, key, word, digits, quoted = look
    last = mark.rstrip(_CLOSERS)
    closers = mark[len(last) :]
    kind = "s" if any(x in _STRONG for x in last) else "f" if any(x in _FULL for x in last) else "e" if "…" in last or ".." in last else "p"
    begins = known.next_of(key)
    out = [
        f"m={kind}|{case}",
        f"m2={last[:2]}|{bool(closers)}|{case}",
        f"q={quoted}|{kind}|{case}|{opener[:1]}",
        f"c={closers[:1]}|{case}|{after}",
        f"o={opener[:1]}|{kind}|{case}",
        f"k={key if not _UNSPACED.match(key) else key[:1]}|{quoted}",
    ]
    if quoted or kind != "p":
        out.append(f"n={quoted}|{kind}|{begins}")
    if kind == "p" and not closers:
        bare, shape, low = known.bare_of(word), _shape(word), word.lower()
        out += [f"w={low}", f"w2={low}|{case}|{begins}", f"b={bare}|{case}|{begins}", f"s={shape}|{case}", f"s2={bare}|{shape}|{case}|{begins}", f"l={len(word)}|{bare}", f"v={'.' in word}|{case}", f"d={digits}|{low}|{case}"]
    return out


def _gap_features(text: str, start: int, end: int, known: Lexicon) -> list[str]:
    """Of a place without a mark: the characters on both sides, alone and joined to words."""
    a, b = text[max(0, start - 1) : start], text[end : end + 1]
    kind = "g" if end > start else "t"
    begins = known.next_of(start_key(text, end))
    out = [f"{kind}={_case(a)}|{_case(b)}", f"{kind}n={begins}|{_case(a)}", f"{kind}q={a if not a.isalnum() else ''}|{b if not b.isalnum() else ''}"]
    out += [f"{kind}<{text[max(0, start - k) : start]}" for k in (1, 2, 3, 4)]
    out += [f"{kind}>{a.isdigit()}|{text[end : end + k]}" for k in (1, 2, 3, 4, 6, 8)]
    if kind == "t":
        out.append(f"tt={a}{b}")
    return out


class Tagger:
    """weights: of the features for a boundary, against one without. turn: of a tag after the one before at a distance,
    turn[distance][before][tag]."""

    def __init__(self, weights: Mapping[str, float], turn: Sequence[Sequence[Sequence[float]]], known: Lexicon) -> None:
        self.weights, self.turn, self.known = weights, turn, known
        self._scores: dict[object, float] = {}

    def score(self, text: str, start: int, end: int, mark: bool, since: int) -> float:
        """Weight of a boundary at a place, remembered for places that look alike. Only for a tagger that no longer learns."""
        look = _look(text, start, end, since) if mark else (text[max(0, start - 4) : start], end > start, text[end : end + 8], start_key(text, end), text[max(0, start - 1) : start])
        s = self._scores.get(look)
        if s is None:
            if len(self._scores) >= KEPT:
                self._scores.clear()
            features = _features(look, self.known) if mark else _gap_features(text, start, end, self.known)
            s = self._scores[look] = sum(self.weights.get(x, 0.0) for x in features)
        return s

    def candidates(self, text: str) -> list[tuple[int, int, bool]]:
        """Places where a sentence can end: (start, end, whether it is a mark)."""
        size = len(text.rstrip())
        out = [(m.start(), m.end(), True) for m in _END.finditer(text)]
        if _THAI.search(text):
            taken = {e for _, e, _ in out}
            out += [(m.start(), m.end(), False) for m in _GAP.finditer(text) if m.start() not in taken and 0 < m.start() and m.end() < size and _thai_beside(text, m.start(), m.end())]
            out.sort()
        elif _EAST.search(text) and not any(e < size for _, e, _ in out):  # a block without marks
            out += [(m.start(), m.start(), False) for m in re.finditer(r"(?<=[぀-ヿ一-鿿ー々])(?=[぀-ヿ一-鿿])", text)]
            out.sort()
        return [x for x in out if x[1] < size]

    def emission(self, text: str, start: int, end: int, mark: bool, since: int) -> list[str]:
        return _features(_look(text, start, end, since), self.known) if mark else _gap_features(text, start, end, self.known)

    def decode(self, text: str, places: Sequence[tuple[int, int, bool]], told: Sequence[bool | None] = (), force: bool = False, memo: dict | None = None) -> list[bool]:
        """Viterbi over the places: their tags. told: known tags, which are favoured against by MARGIN, or with force obeyed.
        A state is the last tag; it carries where its open sentence began, which the emissions look at."""
        weights, turn = self.weights, self.turn
        best: list[tuple[float, int, tuple | None] | None] = [None, (0.0, 0, None)]
        last = 0
        for i, (start, end, mark) in enumerate(places):
            row = turn[_step(_distance(text, last, start))]
            new: list[tuple[float, int, tuple | None] | None] = [None, None]
            known = told[i] if i < len(told) else None
            scores: dict[int, float] = {}
            for tag, state in enumerate(best):
                if state is None:
                    continue
                score, since, path = state
                at = since if mark else -1
                s = scores.get(at)
                if s is None:
                    if memo is None:
                        s = self.score(text, start, end, mark, since)
                    else:
                        f = memo.get((i, at))
                        if f is None:
                            f = memo[i, at] = self.emission(text, start, end, mark, since)
                        s = sum(weights.get(x, 0.0) for x in f)
                    scores[at] = s
                for to in (0, 1):
                    value = score + (s if to else -s) + row[tag][to]
                    if known is not None and known != bool(to):
                        value += -1e9 if force else MARGIN
                    if new[to] is None or value > new[to][0]:
                        new[to] = (value, end if to else since, (path, to))
            best, last = new, end
        path = max((s for s in best if s is not None), key=lambda s: s[0])[2]
        out = []
        while path is not None:
            path, to = path
            out.append(bool(to))
        return out[::-1]

    def ends(self, text: str) -> list[int]:
        """Where sentences end; the last is the end of the text without the white space behind it."""
        places = self.candidates(text)
        return [e if mark else s for (s, e, mark), tag in zip(places, self.decode(text, places)) if tag] + [len(text.rstrip())]

    def split(self, text: str) -> list[str]:
        out, at = [], 0
        for end in self.ends(text):
            if piece := text[at:end].strip():
                out.append(piece)
            at = end
        return out


def _thai_beside(text: str, start: int, end: int) -> bool:
    """Whether the nearest letters on either side of a gap are Thai, whatever digits and signs lie between."""
    i = start - 1
    while i >= 0 and not text[i].isalpha() and not _THAI.match(text[i]):
        i -= 1
    j = end
    while j < len(text) and not text[j].isalpha() and not _THAI.match(text[j]):
        j += 1
    return i >= 0 and bool(_THAI.match(text[i])) or j < len(text) and bool(_THAI.match(text[j]))


#: Marks of an unpunctuated script's samples, without the period inside a number.
_BARE = re.compile(r"[!?…؟।॥。！？｡,،，、;:：；\"'“”‘’«»‹›「」『』()\[\]]|(?<!\d)\.|\.(?!\d)")


def stripped(text: str, shown: Sequence[int] = ()) -> tuple[str, set[int]]:
    """A text of a script without spaces with its marks stripped, and where the boundaries lie then that lay at shown. Thai gets a gap
    where a mark was, Chinese and Japanese none. Other texts stay as they are."""
    if not _UNSPACED.search(text):
        return text, set(shown)
    thai = bool(_THAI.search(text))
    at_mark, out, kept = set(shown), "", set()
    for at, c in enumerate(text):
        if at in at_mark:
            out = out.rstrip()
            kept.add(len(out))
            out += "" if c.isspace() or not thai else " "
        if not _BARE.match(text, at):
            out += c
    return out.rstrip(), kept - {0, len(out.rstrip())}


def _told(text: str, start: int, end: int, mark: bool, known: Lexicon) -> bool | None:
    """What the orthography alone shows of a place inside a training text: a boundary, none, or nothing."""
    n = _NEXT.match(text, end)
    opener, c = n[1], n[2]
    case = _case(c)
    key = start_key(text, end)
    begins = known.starts[key] > 1 and known.next_of(key) == "start"
    if not mark:
        a = text[start - 1 : start]
        if case in ("digit", "other") and not opener or a in "“„«(":
            return False
        if begins:
            return True
        return False if a.isdigit() else None
    kind = text[start:end]
    if case == "lower" or case == "digit" and kind == "." or text[end : end + 1] in (",", "،", "，", "、", ";", ":"):
        return False
    closed = len(kind.rstrip("\"'”’“」』›»")) < len(kind)
    spoken = closed and case == "plain" and not opener  # who speaks may follow a quotation
    if spoken and any(x in _STRONG for x in kind):
        return False  # the words naming the speaker belong to the quotation
    if opener[:1] in ("—", "–", "-") and case != "upper":
        return False
    if kind == "." and case in ("upper", "plain", "digit") and not opener and known.next_of(key) in ("other", "rare"):
        word = _word_before(text, 0, start)
        if word and (word.isdigit() or known.bare_of(word) == "no"):
            return False  # a word that is only written with its period, before one that begins no sentence
    if (case == "upper" or case == "plain") and not spoken and (any(x in _STRONG or x in _FULL for x in kind) or begins):
        return True
    return None


def train(samples: Sequence[str], paragraphs: Sequence[str] = (), rounds: int = ROUNDS) -> Tagger:
    """Averaged structured perceptron with latent tags where the text doesn't show them. samples and paragraphs each begin and end
    with a sentence; they are joined in pairs, so that every joint is a known boundary."""
    every = [t.strip() for t in dict.fromkeys([*sorted(set(filter(None, samples))), *paragraphs]) if t and t.strip()]
    known = Lexicon()
    for t in every:
        known.add(t)
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    steps = range(len(_STEPS) + 1)
    turn, turns = [[[0.0, 0.0], [0.0, 0.0]] for _ in steps], [[[0.0, 0.0], [0.0, 0.0]] for _ in steps]
    tagger = Tagger(weights, turn, known)
    # neighbours of a script are joined, with a gap where the script writes one
    every.sort(key=lambda t: bool(_UNSPACED.search(t)) + bool(_THAI.search(t)))
    rows = []

    def add(text: str, sure: set[int]) -> None:
        places = tagger.candidates(text)
        told = [True if (e if mark else s) in sure else (_told(text, s, e, mark, known)) for s, e, mark in places]
        memo: dict = {}
        for t in texts:
            known.add(t, -1)  # a text's own words and beginning tell nothing of it
        for i, (s, e, mark) in enumerate(places):
            for since in {0, *(b for _, b, _ in places[:i])} if i < 6 else ():
                memo[i, since if mark else -1] = tagger.emission(text, s, e, mark, since)
        for t in texts:
            known.add(t)
        rows.append((text, places, told, memo))

    for a, b in zip(every, every[1:] + every[:1]):
        texts = (a, b) if a != b else (a,)
        glue = "" if _EAST.search(a) and _EAST.search(b) else " "
        add(a + glue + b, {len(a)})
        if _UNSPACED.search(a) and _UNSPACED.search(b):
            shown = {e if mark else s for s, e, mark in tagger.candidates(a + glue + b) if (e if mark else s) == len(a) or mark and _told(a + glue + b, s, e, mark, known)}
            bare, kept = stripped(a + glue + b, sorted(shown | {len(a)}))
            places = tagger.candidates(bare)
            if _EAST.search(bare) and not _THAI.search(bare):  # all but the known boundaries are inside
                rows.append((bare, places, [(e if mark else s) in kept for s, e, mark in places], {}))
            else:
                add(bare, kept)
    order = random.Random(4)
    now = 1
    for _ in range(rounds):
        order.shuffle(rows)
        wrong = 0
        for text, places, told, memo in rows:
            if not places:
                continue
            guess = tagger.decode(text, places, told, memo=memo)
            right = tagger.decode(text, places, told, force=True, memo=memo)
            if guess != right:
                wrong += 1
                for tags, d in ((right, 1.0), (guess, -1.0)):
                    since = last = 0
                    before = 1
                    for i, ((start, end, mark), tag) in enumerate(zip(places, tags)):
                        sign = d if tag else -d
                        for x in memo.get((i, since if mark else -1)) or tagger.emission(text, start, end, mark, since):
                            weights[x] += sign
                            total[x] += now * sign
                        k = _step(_distance(text, last, start))
                        turn[k][before][tag] += d
                        turns[k][before][tag] += now * d
                        since, last, before = end if tag else since, end, int(tag)
            now += 1
        if not wrong:
            break
    final = {x: w - total[x] / now for x, w in weights.items() if w or total[x]}
    return Tagger(final, [[[w - t / now for w, t in zip(*two)] for two in zip(*both)] for both in zip(turn, turns)], known)


def trained(spark, sf_dir: str) -> Tagger:
    """Trained on the clean samples and the paragraphs of a bounded sample of pages, about TRAIN_PAGES chosen by a hash of their ids,
    so the choice is the same in every run. A paragraph begins and ends with a sentence; nothing else is known of it."""
    rows = table(spark, sf_dir, "language_samples", "text").where("text is not null").limit(TRAIN_ROWS).collect()
    pages = _pages(spark, sf_dir).where("source is not null")
    share = TRAIN_PAGES / max(1, pages.count())
    chosen = pages.where(F.pmod(F.xxhash64("field_name", "job_id"), F.lit(1_000_003)) < share * 1_000_003).limit(2 * TRAIN_PAGES).select("job_id", "source").collect()
    texts = [t for r in sorted(chosen) for t in paragraphs(r[1])]
    return train([r[0] for r in rows], texts[:TRAIN_PARAGRAPHS])


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|/)?)>|<[!?][^<>]*>", re.S)
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul template script style title head noscript".split())
_SKIPPED = frozenset("nav script template style title noscript svg".split())
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def paragraphs(page: str | None) -> list[str]:
    """Texts of the page's p elements in order, references decoded: those shown and with a letter or digit. A p without end tag ends
    at the next block's start or its parent's end. Null or empty pages have none."""
    if not page:
        return []
    out: list[str] = []
    parts: list[str] | None = None
    skip, level, pos, n = None, 0, 0, len(page)

    def close() -> None:
        nonlocal parts
        if parts is not None:
            text = unescape("".join(parts))
            if any(map(str.isalnum, text)):
                out.append(text)
            parts = None

    while m := _TAG.search(page, pos):
        start, end = m.span()
        if parts is not None and not skip and start > pos:
            parts.append(page[pos:start])
        pos = end
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip:
            if tag == skip:
                level += -1 if closing else not m[3].endswith("/")
                if level <= 0:
                    skip = None
            elif skip == "p" and not closing and tag in _BLOCKS or closing and skip == "p" and tag in _BLOCKS:
                skip, pos = None, start
            continue
        if closing:
            if tag in _BLOCKS:
                close()
            continue
        hidden = bool(m[3]) and tag not in _VOID and bool(_HIDDEN.search(m[3]))
        if tag in _BLOCKS:
            close()
        if tag in _SKIPPED or hidden:
            if tag in ("script", "style", "title"):
                c = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
                pos = c.end() if c else n
            else:
                skip, level = tag, 1
        elif tag == "p":
            parts = []
        elif tag == "br" and parts is not None:
            parts.append("\n")
    if parts is not None and not skip:
        parts.append(page[pos:])
    close()
    return out


def _sentence_ends(page: str | None, tagger: Tagger) -> list[dict]:
    out = []
    for block, text in enumerate(paragraphs(page), 1):
        at = count = 0
        for end in tagger.ends(text):
            more = sum(map(str.isalnum, text[at:end]))
            at = end
            if more:
                count += more
                out.append({"block_no": block, "end_pos": count})
    return out


def sentence_ends(df: DataFrame, page: str, tagger: Tagger, out: str = "ends") -> DataFrame:
    """Adds ARRAY<STRUCT<block_no, end_pos>>; the model travels with the function, bounded as its training text is. Null and empty
    pages give an empty array; a column named out is replaced, others pass through."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([_sentence_ends(p, tagger) for p in pages], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<struct<block_no:int,end_pos:int>>").asNondeterministic()(F.col(page)))


def _pages(spark, sf_dir: str) -> DataFrame:
    unicode, ar = (table(spark, sf_dir, name, F.lit(f"{name}.source").alias("field_name"), "job_id", "source") for name in ("unicode_jobs", "ar_jobs"))
    return unicode.unionByName(ar)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Copies of a re-delivered page are tagged alike; one of them is kept by its id, so no text is shuffled."""
    rows = sentence_ends(_pages(spark, sf_dir), "source", trained(spark, sf_dir)).select("field_name", "job_id", "ends")
    return rows.dropDuplicates(["field_name", "job_id"]).select("field_name", "job_id", F.explode("ends").alias("e")).select("field_name", "job_id", "e.block_no", "e.end_pos")


def p4_sentences(spark, sf_dir: str) -> DataFrame:
    """The sentences themselves."""
    tagger = trained(spark, sf_dir)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([[{"block_no": b, "sentence_no": k, "sentence": s} for b, t in enumerate(paragraphs(p), 1) for k, s in enumerate(tagger.split(t), 1)] for p in pages], dtype=object)

    cut = F.pandas_udf(run, "array<struct<block_no:int,sentence_no:int,sentence:string>>").asNondeterministic()
    rows = _pages(spark, sf_dir).select("field_name", "job_id", cut("source").alias("all")).dropDuplicates(["field_name", "job_id"])
    return rows.select("field_name", "job_id", F.explode("all").alias("s")).select("field_name", "job_id", "s.*")
