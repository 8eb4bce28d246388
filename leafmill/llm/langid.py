"""Problem 1: the languages of a text and of its stretches, with a confidence.

A text is first repaired and freed of markup, then cut in sentences. Each sentence gets the language whose character model
(interpolated Kneser-Ney) gives the lowest cross-entropy a character, unless that is over the limit
for its length, which held-out text of the language and of left-out languages sets.
A stretch is a run of sentences in one language; a sentence the models can't tell takes the language of its surroundings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import table
from .charmodels import WORD, CharModels
from .garbled import Repairer, fitted
from .markup import parse
from .rough import rough_sentences

#: At most so many sample rows are read to fit the refined models again.
TRAIN_ROWS = 5000
#: Nats between the best and the second language from which a sentence counts as sure.
SURE = 6.0
#: Sentences from which a language is present beside another.
LEAST = 2
#: A sentence counts for another than the text's main language if it fits that by so many nats a character better.
APART = 0.2
#: Bracketed and quoted phrases are left out of a sentence if its frame alone is told by so many nats.
FRAME = 15.0
#: Labelled documents of each language that refine the models, at most about; no text over so many characters.
LABELLED, LABELLED_SIZE = 60, 4000
_MAYBE_MARKUP = re.compile(r"[<&`*_~$\\{#=\[]|''|--|^\s*(?:[-+•>|]|\d+[.)])", re.M)
_QUOTED = re.compile(r"[“„«‹「『\"(（][^“”„«»「」『』\"()（）]*[”“»›」』\")）]")

#: Codes of three letters and names that mean one of the two-letter codes.
_CODES = {
    "eng": "en", "ron": "ro", "rum": "ro", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "ell": "el", "gre": "el", "ara": "ar", "hin": "hi", "tha": "th", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja",
    "english": "en", "romanian": "ro", "french": "fr", "german": "de", "spanish": "es", "italian": "it", "portuguese": "pt", "russian": "ru", "greek": "el", "arabic": "ar", "hindi": "hi", "thai": "th", "chinese": "zh", "japanese": "ja", "jp": "ja", "cn": "zh", "gr": "el",
    "română": "ro", "romana": "ro", "français": "fr", "deutsch": "de", "español": "es", "italiano": "it", "português": "pt", "русский": "ru", "ελληνικά": "el", "العربية": "ar", "हिन्दी": "hi", "ไทย": "th", "中文": "zh", "日本語": "ja",
}
_PLACEHOLDERS = frozenset("und unknown n/a na none null - -- ? xx xxx mul mis zxx unk undefined undetermined other tbd auto any root nil . unspecified missing no_lang nolang default".split())


def label_code(label: str | None) -> str | None:
    """Two-letter code a label names, whatever its case, region or code length; None where it names none."""
    if label is None:
        return None
    low = label.strip().lower()
    if not low or low in _PLACEHOLDERS:
        return None
    head = re.split(r"[-_@. ]", low)[0]
    if head in _PLACEHOLDERS or not head:
        return None
    return _CODES.get(low) or _CODES.get(head) or head


class Stretch(NamedTuple):
    lang: str
    confidence: float
    sentences: int
    text: str


class Identifier:
    def __init__(self, models: CharModels, clean: CharModels | None = None) -> None:
        """models tell languages; clean, those of the clean samples alone, tell garbled text."""
        self.models = models
        self.repairer = Repairer(clean or models)

    def read(self, texts: Sequence[str | None], repair: Sequence[bool]) -> list[tuple[list[str], str | None, np.ndarray, np.ndarray]]:
        """Of each text its sentences, the page's lang, and the sentences' scores and sizes. Where asked, a text that looks garbled in
        its own language is repaired and read again."""
        cut = [self.sentences(t) if t else ([], None) for t in texts]
        scores = self._parted(cut, self.scored([c[0] for c in cut]))
        again: dict[int, str] = {}
        langs = self.models.langs
        for i, (t, r) in enumerate(zip(texts, repair)):
            if r and t and langs and not t.isascii():
                s, n = scores[i]
                top = None
                if len(n) and (size := n.sum()):
                    total = s.sum(axis=0)
                    k = int(total.argmax())
                    top = (langs[k], -total[k] / size)
                fixed, garbled, _ = self.repairer.repair(t, top)
                if garbled and fixed != t:
                    again[i] = fixed
        if again:
            new = [self.sentences(t) for t in again.values()]
            for i, c, x in zip(again, new, self._parted(new, self.scored([c[0] for c in new]))):
                cut[i], scores[i] = c, x
        return [(*c, *x) for c, x in zip(cut, scores)]

    def _parted(self, cut: list[tuple[list[str], str | None]], scores: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Parts sentences that are beyond every limit as a whole where two languages meet in them, as a heading without a mark runs into
        the sentence after it: at the word that leaves two parts, each within the limit of its own language. cut is changed in place."""
        if len(self.models.langs) < 2:
            return scores
        out = []
        for (sentences, _), (s, n) in zip(cut, scores):
            if len(n):
                top = s.argmax(axis=1)
                bad = np.flatnonzero((n > 0) & (-s[np.arange(len(n)), top] > self.models.accepted(top, n)))
                for i in bad[::-1]:
                    if parts := self._part(sentences[i]):
                        texts, ps, pn = parts
                        sentences[i : i + 1] = texts
                        s, n = np.concatenate([s[:i], ps, s[i + 1 :]]), np.concatenate([n[:i], pn, n[i + 1 :]])
            out.append((s, n))
        return out

    def _part(self, sentence: str) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        found = list(WORD.finditer(sentence))
        if len(found) < 2:
            return None
        s, n = self.models.each([m[0].lower() for m in found])
        head, size = np.cumsum(s, axis=0, dtype=np.float64)[:-1], np.cumsum(n)[:-1]
        rest, left = s.sum(axis=0) - head, n.sum() - size
        at = int((head.max(axis=1) + rest.max(axis=1)).argmax())
        scores, sizes = np.stack([head[at], rest[at]]), np.array([size[at], left[at]], dtype=np.float64)
        top = scores.argmax(axis=1)
        if top[0] == top[1] or (-scores[[0, 1], top] > self.models.accepted(top, sizes)).any():
            return None
        place = found[at + 1].start()
        return [sentence[:place], sentence[place:]], scores, sizes

    def sentences(self, text: str) -> tuple[list[str], str | None]:
        """Sentences, headings and items of the content; the html element's lang."""
        lang = None
        if _MAYBE_MARKUP.search(text):
            page = parse(text)
            lang = page.lang
            blocks = [body for kind, body in page.blocks if kind in ("text", "heading", "list_item") and body]
        else:
            blocks = [" ".join(b.split("\n")) for b in re.split(r"\n\s*\n", text)]
        out = []
        for b in blocks:
            out += rough_sentences(b)
        return out, lang

    def scored(self, texts: Sequence[Sequence[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and sizes of the sentences of each text, all in one call. Where the words outside quotes and brackets tell the
        language by themselves, they alone count."""
        every = [s for t in texts for s in t]
        s, n = self.models.score([WORD.findall(x.lower()) for x in every])
        at = [i for i, x in enumerate(every) if _QUOTED.search(x)]
        if at and s.shape[1] > 1:
            frames = [WORD.findall(_QUOTED.sub(" ", every[i]).lower()) for i in at]
            fs, fn = self.models.score(frames)
            top = np.partition(fs, -2, axis=1)
            clear = (top[:, -1] - top[:, -2] >= FRAME) & (fn >= 14)
            where = np.array(at)[clear]
            s[where], n[where] = fs[clear], fn[clear]
        out, start = [], 0
        for t in texts:
            out.append((s[start : start + len(t)], n[start : start + len(t)]))
            start += len(t)
        return out

    def present_all(self, scores: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[list[str]]:
        """Languages present in each text: all its sure sentences, or LEAST of them, are in it. A text without sure sentences is of
        the language it fits best as a whole, if that is within the limits."""
        langs = self.models.langs
        if not langs or not scores:
            return [[] for _ in scores]
        s, n = np.concatenate([x[0] for x in scores]), np.concatenate([x[1] for x in scores])
        if not len(n):
            return [[] for _ in scores]
        if len(langs) > 1:
            order = np.argpartition(-s, 1, axis=1)[:, :2]
            pair = np.take_along_axis(s, order, 1)
            first = pair[:, 0] >= pair[:, 1]
            top, best, gap = np.where(first, order[:, 0], order[:, 1]), pair.max(axis=1), np.abs(pair[:, 0] - pair[:, 1])
        else:
            top, best, gap = np.zeros(len(n), int), s[:, 0], np.full(len(n), np.inf)
        sure = (gap >= SURE) & (n > 3) & (-best <= self.models.accepted(top, n))
        out, at = [], 0
        for own_s, own_n in scores:
            end = at + len(own_n)
            own = top[at:end][sure[at:end]]
            if not len(own):
                whole = own_s.sum(axis=0) if len(own_n) else None
                k = int(whole.argmax()) if whole is not None else 0
                out.append([langs[k]] if whole is not None and own_n.any() and -whole[k] <= self.models.accepted(k, own_n.sum()) else [])
            elif (own == own[0]).all():
                out.append([langs[own[0]]])
            else:
                keep = sure[at:end]
                sizes = np.bincount(own, weights=own_n[keep], minlength=len(langs))
                main = int(sizes.argmax())
                near = (own != main) & (best[at:end][keep] - own_s[keep, main] < APART * own_n[keep])
                counts = np.bincount(own[~near], minlength=len(langs))
                found = [k for k in range(len(langs)) if counts[k] >= LEAST]
                if not found and (counts > 0).sum() == 1:
                    found = [main]
                out.append([langs[k] for k in found])
            at = end
        return out

    def stretches(self, sentences: Sequence[str], s: np.ndarray, n: np.ndarray) -> list[Stretch]:
        """Runs of sentences in one language. confidence: the language's share of the likelihood, tempered by
        length and as held-out text shows; 'und' where the cost is beyond the language's limit at that length."""
        langs = self.models.langs
        if not len(n) or not n.any() or not langs:
            return []
        total = s.sum(axis=0)
        main = int(total.argmax())
        runs: list[list] = []
        for i in range(len(n)):
            if n[i] == 0:
                k = runs[-1][0] if runs else main
            else:
                k = int(s[i].argmax())
                rest = np.delete(s[i], k)
                if len(rest) and s[i, k] - rest.max() < SURE:
                    k = runs[-1][0] if runs else main
            if runs and runs[-1][0] == k:
                runs[-1][1].append(i)
            else:
                runs.append([k, [i]])
        out = []
        for k, at in runs:
            score, size = s[at].sum(axis=0), n[at].sum()
            if size and -score[k] > self.models.accepted(k, size):
                out.append(Stretch("und", 0.0, len(at), "".join(sentences[i] for i in at)))
                continue
            out.append(Stretch(langs[k], float(self.models.confidence(score, size)[k]), len(at), "".join(sentences[i] for i in at)))
        return out


_FIELDS = ("documents.lang", "keep_jobs.prepared.language", "ar_jobs.prepared.sourceLanguage", "unicode_jobs.source")


def _records(spark, sf_dir: str) -> DataFrame:
    """field_name, record_id, label, text, own: own is true where the page's lang attribute is the label."""
    documents = table(spark, sf_dir, "documents", F.lit(_FIELDS[0]).alias("field_name"), F.col("doc_id").alias("record_id"), F.col("lang").alias("label"), "text")
    keep = table(spark, sf_dir, "keep_jobs", F.lit(_FIELDS[1]).alias("field_name"), F.col("job_id").alias("record_id"), F.col("prepared.language").alias("label"), F.col("source").alias("text"))
    ar = table(spark, sf_dir, "ar_jobs", F.lit(_FIELDS[2]).alias("field_name"), F.col("job_id").alias("record_id"), F.col("prepared.sourceLanguage").alias("label"), F.col("source").alias("text"))
    uni = table(spark, sf_dir, "unicode_jobs", F.lit(_FIELDS[3]).alias("field_name"), F.col("job_id").alias("record_id"), F.lit(None).cast("string").alias("label"), F.col("source").alias("text"))
    return documents.unionByName(keep).unionByName(ar).unionByName(uni)


def refined(spark, sf_dir: str) -> Identifier:
    """Models of the clean samples, fitted again with the sure sentences of a bounded sample of labelled documents: about LABELLED of
    each language, chosen by a hash of their ids, so the choice is the same in every run. Only the counts are over all rows."""
    clean = fitted(spark, sf_dir)  # reads the labelled sample, where all that is sure is wanted
    samples = [(r[0], r[1]) for r in table(spark, sf_dir, "language_samples", "lang", "text").where("text is not null and lang is not null").limit(TRAIN_ROWS).collect()]
    names = [c for c, to in [*_CODES.items(), *((x, x) for x in clean.langs)] if to in clean.langs]
    code = F.lower(F.substring_index(F.translate(F.trim("lang"), "_", "-"), "-", 1))
    rows = table(spark, sf_dir, "documents", "doc_id", code.alias("code"), "text").where(F.col("code").isin(names) & (F.length("text") <= LABELLED_SIZE))
    counts = {r[0]: r[1] for r in rows.groupBy("code").count().collect()}
    by: dict[str, int] = {}
    for c, k in counts.items():
        by[_CODES.get(c, c)] = by.get(_CODES.get(c, c), 0) + k
    if not by:
        return Identifier(fitted(spark, sf_dir, calibrate=True))
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0).alias("u")
    share = F.create_map(*[F.lit(x) for c in counts for x in (c, min(1.0, LABELLED / by[_CODES.get(c, c)]))])
    chosen = rows.where(u < share[F.col("code")]).select("doc_id", "code", "text").limit(4 * LABELLED * len(clean.langs)).collect()
    first = Identifier(clean)
    for r, (sentences, _, s, n) in zip(chosen, first.read([r[2] for r in chosen], [True] * len(chosen))):
        k = clean.langs.index(_CODES.get(r[1], r[1]))
        for text, x, size in zip(sentences, s, n):
            if size > 8 and x.argmax() == k and x[k] - np.partition(x, -2)[-2] >= 2 * SURE:
                samples.append((clean.langs[k], text))
    return Identifier(CharModels.fit(samples), clean)


def label_cases(df: DataFrame, own: Identifier, out: str = "langs") -> DataFrame:
    """df(field_name, label, text, ...) with out: the languages present where the label is missing or names none of them, or where
    there are two; else null. Null and empty texts and texts of no language give null. Copies of a row give equal results."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, labels, texts in batches:
            read = own.read([t if isinstance(t, str) else None for t in texts], [name == _FIELDS[0] for name in names])
            rows = []
            for name, label, (_, lang, _, _), found in zip(names, labels, read, own.present_all([x[2:] for x in read])):
                code = label_code(lang if name == _FIELDS[3] else None if label is None or label != label else label)
                rows.append(found if found and (len(found) > 1 or code not in found) else None)
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<string>").asNondeterministic()("field_name", "label", "text"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Re-delivered jobs are judged alike and fall together in the distinct, which moves ids only."""
    rows = label_cases(_records(spark, sf_dir), refined(spark, sf_dir)).where("langs is not null")
    return rows.select("field_name", "record_id", F.explode("langs").alias("lang")).distinct()


def p1_stretches(spark, sf_dir: str) -> DataFrame:
    """Every stretch of every record with its language and confidence; 'und' where no language fits."""
    own = refined(spark, sf_dir)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, texts in batches:
            read = own.read([t if isinstance(t, str) else None for t in texts], [name == _FIELDS[0] for name in names])
            yield pd.Series([[{"stretch_no": i, "lang": x.lang, "confidence": round(x.confidence, 6), "sentences": x.sentences, "characters": len(x.text)} for i, x in enumerate(own.stretches(c, s, n), 1)] for c, _, s, n in read], dtype=object)

    rows = F.pandas_udf(run, "array<struct<stretch_no:int,lang:string,confidence:double,sentences:int,characters:int>>").asNondeterministic()
    return _records(spark, sf_dir).select("field_name", "record_id", F.explode(rows("field_name", "text")).alias("s")).select("field_name", "record_id", "s.*").distinct()
