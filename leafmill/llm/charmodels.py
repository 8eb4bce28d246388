"""Interpolated Kneser-Ney character language models, one per language, in sorted hash arrays.

Models see words with their edges, so the score of a text is the sum of its words' scores and a word is scored once per task.
All languages share one array of n-gram hashes for each order; its rows hold the log probability in every language, with the
discounts of all lower orders already interpolated. An n-gram in no array is backed off through a second array of contexts.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence

import numpy as np

ORDER = 5
#: Code points an unseen character is drawn from.
OPEN = 20_000
#: Words kept with their scores by one task; beyond that the memory starts anew.
KEPT = 200_000
#: Runs of letters and marks: anything but white space, digits, ASCII signs and general punctuation.
WORD = re.compile(r"[^\s\d!-@\[-`{-~«»“”„‚‘’‹›…—–‐-―、。，！？：；（）「」『』【】《》¡¿।॥؟،؛·•ㆍ  ​-‏⁠﻿­]+")
#: Folds that are held out in turn.
FOLDS = 3
_BOS, _EOS = 2, 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def inventory(texts: Iterable[str]) -> tuple[Counter, set[str]]:
    """The words of texts with how often they come, and the characters, as they stand and small."""
    types, letters = Counter(), set()
    for text in texts:
        types.update(words(text))
        letters.update(text, text.lower())
    return types, letters


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from n - 1 on."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - n + 1, n + 1, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * _PRIME
            h ^= h >> np.uint64(29)
    return h


class _Memory:
    """Scores of the words seen by this process."""

    def __init__(self, langs: int) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, langs), dtype=np.float32)
        self.sizes = np.zeros(1024, dtype=np.int32)


#: Memories of the last models a worker process had, so that its next task starts with the words of the one before.
_LIVE: dict[str, _Memory] = {}


class CharModels:
    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        self.grams: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoffs: list[np.ndarray] = []
        self.unseen = np.zeros(len(langs), dtype=np.float32)
        #: What held-out text costs, by language: mean nats a character, its variance between texts and within them for one character,
        #: and how many standard deviations above the mean are still accepted.
        self.mean, self.between, self.within = (np.ones(len(langs)) for _ in range(3))
        self.reach = np.full(len(langs), 1e9)
        #: Shares of held-out text of the language rejected, and of other languages' text accepted as it.
        self.false_rejects, self.false_accepts = np.zeros(len(langs)), np.zeros(len(langs))
        #: By what the scores, over the root of the length, are divided for a confidence.
        self.temper = 1.0
        self.seen: frozenset[str] = frozenset()
        self.alphabets: dict[str, frozenset[str]] = {}
        self.key = ""
        self._memory = _Memory(len(langs))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if not self.key or self.key not in _LIVE:
            while len(_LIVE) >= 4:
                _LIVE.pop(next(iter(_LIVE)))
            _LIVE[self.key] = _Memory(len(self.langs))
        self._memory = _LIVE[self.key] if self.key else _Memory(len(self.langs))

    @staticmethod
    def fit(samples: Iterable[tuple[str, str]], calibrate: bool = True) -> "CharModels":
        """samples: (language, clean text). Without calibration nothing is rejected."""
        texts: dict[str, list[str]] = defaultdict(list)
        for lang, text in sorted((a, b) for a, b in samples if a and b):
            texts[lang].append(unicodedata.normalize("NFC", text))
        models = CharModels._fit(texts)
        if calibrate:
            models._calibrate(texts)
        return models._signed()

    @staticmethod
    def of_counts(types: dict[str, Counter], letters: dict[str, set[str]]) -> "CharModels":
        """What fit() gives without calibration, from each language's words with how often they come, and its characters (inventory())."""
        return CharModels._counted(types, letters)._signed()

    def _signed(self) -> "CharModels":
        digest = hashlib.sha256("\0".join(self.langs).encode())
        for arrays in (self.grams, self.logs):
            for x in arrays:
                digest.update(x.tobytes())
        self.key = digest.hexdigest()
        return self

    def _calibrate(self, texts: dict[str, list[str]]) -> None:
        """Rejection limits and confidence from held-out folds. A fold's texts are scored by models of the others: under their own
        language, and, that one left out, under the best of the rest, which is what text of an unknown language gets."""
        k = len(self.langs)
        own, other, sharp = [[] for _ in range(k)], [[] for _ in range(k)], []
        for fold in range(FOLDS):
            part = CharModels._fit({a: [t for i, t in enumerate(b) if i % FOLDS != fold] or b for a, b in texts.items()})
            held = [(at, w) for at, lang in enumerate(self.langs) for i, t in enumerate(texts[lang]) if i % FOLDS == fold and (w := words(t))]
            if not held:
                continue
            at = np.array([x[0] for x in held])
            s, n = part.score([x[1] for x in held])
            row = np.arange(len(at))
            sharp.append((s, n, at))
            rest = s.copy()
            rest[row, at] = -np.inf
            best = rest.argmax(axis=1)
            for i in range(len(at)):
                own[at[i]].append((-s[i, at[i]] / n[i], n[i]))
                if k > 1:
                    other[best[i]].append((-s[i, best[i]] / n[i], n[i]))
        for lang in range(k):
            if not own[lang]:
                continue
            x, n = np.array(own[lang]).T
            self.mean[lang] = mean = np.average(x, weights=n)
            # (x - mean)² is about between + within / n
            a = np.stack([np.ones_like(n), 1 / n], axis=1)
            self.between[lang], self.within[lang] = np.maximum(np.linalg.lstsq(a, (x - mean) ** 2, rcond=None)[0] if len(x) > 2 else (0.0, 0.0), [(0.05 * mean) ** 2, 0.25])
            z = (x - mean) / np.sqrt(self.between[lang] + self.within[lang] / n)
            top = max(np.quantile(z, 0.99), 1.0)
            self.reach[lang] = 2 * top  # where no other language comes near
            if other[lang]:
                y, m = np.array(other[lang]).T
                far = (y - mean) / np.sqrt(self.between[lang] + self.within[lang] / m)
                # where the shares of own text rejected and of other text accepted are least in sum, three quarters through the widest gap, as
                # whole domains are missing in what was held out
                steps = np.unique(np.concatenate([z, far, [2 * top]]))
                wrong = np.array([np.mean(z > x) + np.mean(far <= x) for x in steps[:-1]])
                least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
                at = least[np.diff(steps)[least].argmax()]
                self.reach[lang] = (steps[at] + 3 * steps[at + 1]) / 4
                self.false_accepts[lang] = np.mean(far <= self.reach[lang])
            self.false_rejects[lang] = np.mean(z > self.reach[lang])
        if sharp:
            s, n, at = (np.concatenate([x[i] for x in sharp]) for i in range(3))
            scaled = (s - s.max(axis=1, keepdims=True)) / np.sqrt(n)[:, None]

            def loss(temper: float) -> float:
                p = scaled / temper
                return float(np.mean(np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(at)), at]))

            self.temper = min((0.05 * 1.25**i for i in range(24)), key=loss)

    def accepted(self, lang: np.ndarray | int, n: np.ndarray | float) -> np.ndarray:
        """Most nats a text of n characters may cost to be of the language."""
        n = np.maximum(n, 1.0)
        return n * (self.mean[lang] + self.reach[lang] * np.sqrt(self.between[lang] + self.within[lang] / n))

    def confidence(self, score: np.ndarray, n: float) -> np.ndarray:
        """Share of each language, from the scores of one text of n characters."""
        p = np.exp((score - score.max()) / (np.sqrt(max(1.0, n)) * self.temper))
        return p / p.sum()

    @staticmethod
    def _fit(texts: dict[str, list[str]]) -> "CharModels":
        both = {lang: inventory(own) for lang, own in texts.items()}
        return CharModels._counted({lang: types for lang, (types, _) in both.items()}, {lang: letters for lang, (_, letters) in both.items()})

    @staticmethod
    def _counted(types: dict[str, Counter], letters: dict[str, set[str]]) -> "CharModels":
        langs = sorted(letters)
        models = CharModels(langs)
        counts: list[list[Counter]] = []
        for lang in langs:
            raw = Counter()
            for w, times in types.get(lang, {}).items():
                codes = (_BOS, *map(ord, w), _EOS)
                for i in range(1, len(codes)):
                    for n in range(1, min(ORDER, i + 1) + 1):
                        raw[codes[i - n + 1 : i + 1]] += times
            own = [Counter() for _ in range(ORDER + 1)]
            for gram, c in raw.items():
                n = len(gram)
                if n == ORDER or gram[0] == _BOS:
                    own[n][gram] = c
                if n > 1:
                    own[n - 1][gram[1:]] += 1  # continuations
            for n in range(1, ORDER):  # a lower order counts continuations, where it has any
                for gram, c in raw.items():
                    if len(gram) == n and gram not in own[n]:
                        own[n][gram] = 1
            counts.append(own)
            models.alphabets[lang] = frozenset(letters[lang])
        k = len(langs)
        totals = [[Counter() for _ in range(ORDER + 1)] for _ in langs]
        kinds = [[Counter() for _ in range(ORDER + 1)] for _ in langs]
        discounts = np.zeros((k, ORDER + 1))
        for a in range(k):
            for n in range(1, ORDER + 1):
                for gram, c in counts[a][n].items():
                    totals[a][n][gram[:-1]] += c
                    kinds[a][n][gram[:-1]] += 1
                ones, twos = sum(c == 1 for c in counts[a][n].values()), sum(c == 2 for c in counts[a][n].values())
                discounts[a, n] = min(0.95, max(0.3, ones / (ones + 2 * twos) if ones else 0.5))
        union: list[set] = [set().union(*(counts[a][n] for a in range(k))) for n in range(ORDER + 1) if n] if k else [set()] * ORDER
        lower: dict[tuple, np.ndarray] = {}
        base = np.full(k, 1.0 / OPEN)
        rest = np.array([discounts[a, 1] * kinds[a][1][()] / max(1, totals[a][1][()]) for a in range(k)]) if k else base
        models.unseen = np.log(np.maximum(rest, 1e-9) * base).astype(np.float32)
        back: list[dict[tuple, np.ndarray]] = [{} for _ in range(ORDER + 1)]
        for n in range(1, ORDER + 1):
            for ctx in {g[:-1] for g in union[n - 1]}:
                back[n][ctx] = np.array([discounts[a, n] * kinds[a][n][ctx] / totals[a][n][ctx] if totals[a][n][ctx] else 1.0 for a in range(k)])
            current: dict[tuple, np.ndarray] = {}
            for gram in sorted(union[n - 1]):
                ctx = gram[:-1]
                if n == 1:
                    under = base
                else:
                    under = lower.get(gram[1:])
                    if under is None:
                        under = np.exp(models.unseen.astype(np.float64))
                p = back[n][ctx] * under
                for a in range(k):
                    if c := counts[a][n].get(gram):
                        p[a] += max(c - discounts[a, n], 0.0) / totals[a][n][ctx]
                current[gram] = p
            lower = current
            grams = list(current)
            h = _hash_rows(grams, n)
            order = np.argsort(h, kind="stable")
            models.grams.append(h[order])
            models.logs.append(np.log(np.array([current[g] for g in grams]).reshape(len(grams), k)).astype(np.float32)[order])
            if n > 1:
                ctxs = sorted(back[n])
                h = _hash_rows(ctxs, n - 1)
                order = np.argsort(h, kind="stable")
                models.contexts.append(h[order])
                models.backoffs.append(np.log(np.array([back[n][c] for c in ctxs]).reshape(len(ctxs), k)).astype(np.float32)[order])
        models.seen = frozenset().union(*models.alphabets.values()) if k else frozenset()
        return models

    def _raw(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each token in each language, and its length with the end mark."""
        k = len(self.langs)
        text = "\x02" + "\x03\x02".join(tokens) + "\x03"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        begin = codes == _BOS
        first = np.flatnonzero(begin)
        place = np.arange(len(codes)) - first[np.cumsum(begin) - 1]  # 0 at the begin mark
        logs = np.tile(self.unseen, (len(codes), 1))
        for n in range(1, ORDER + 1):
            if len(codes) < n or not len(self.grams[n - 1]):
                continue
            at = np.flatnonzero(place[n - 1 :] >= max(1, n - 1)) + n - 1
            h = _hash(codes, n)[at - n + 1]
            table = self.grams[n - 1]
            i = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[i] == h
            if n > 1 and len(self.contexts[n - 2]):
                miss = at[~hit]
                if len(miss):
                    c = _hash(codes, n - 1)[miss - n + 1]
                    ctx = self.contexts[n - 2]
                    j = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                    known = ctx[j] == c
                    logs[miss[known]] += self.backoffs[n - 2][j[known]]
            logs[at[hit]] = self.logs[n - 1][i[hit]]
        logs[begin] = 0
        sums = np.add.reduceat(logs, first, axis=0) if len(first) else np.zeros((0, k), dtype=np.float32)
        return sums, np.diff(np.append(first, len(codes))) - 1

    def ids(self, tokens: Iterable[str]) -> np.ndarray:
        """Places of the tokens' scores; new tokens are scored in one go."""
        tokens = list(tokens)
        memory = self._memory
        known = memory.ids
        if len(known) > KEPT:
            known.clear()
        fresh = [t for t in dict.fromkeys(tokens) if t not in known]
        if fresh:
            need = len(known) + len(fresh)
            if need > len(memory.sizes):
                size = max(need, 2 * len(memory.sizes))
                memory.scores = np.resize(memory.scores, (size, len(self.langs)))
                memory.sizes = np.resize(memory.sizes, size)
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                s, n = self._raw(part)
                base = len(known)
                memory.scores[base : base + len(part)] = s
                memory.sizes[base : base + len(part)] = n
                known.update(zip(part, range(base, base + len(part))))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def each(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its length in characters."""
        at = self.ids(tokens)
        return self._memory.scores[at], self._memory.sizes[at]

    def score(self, segments: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each segment (a list of words) in each language, and its length in characters."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        out, length = np.zeros((len(segments), len(self.langs)), dtype=np.float64), np.zeros(len(segments))
        full = np.flatnonzero(sizes)
        if len(full) and self.langs:
            at = self.ids([w for s in segments for w in s])
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            out[full] = np.add.reduceat(self._memory.scores[at], starts, axis=0)
            length[full] = np.add.reduceat(self._memory.sizes[at], starts)
        return out, length


def _hash_rows(grams: list[tuple], n: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, dtype=np.uint64)
    codes = np.array(grams, dtype=np.uint64).reshape(-1)
    return _hash(codes, n)[::n] if n > 1 else _hash(codes, 1)
