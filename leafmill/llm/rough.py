"""Quick sentence counts for problem 1, by the writing conventions alone. Problem 4 has a learned model (sentences.py) instead."""

from __future__ import annotations

import re

#: Abbreviations that a name, number or word follows; they end no sentence. Lower case, without the last period.
LEADING = frozenset(
    "dr mr mrs ms mx prof st hr hrn fr frl herr mme mlle mm m me sr sra srta d dña dl dna dr sig sig.ra dott ing rev gen col capt lt sgt hon jr sen rep pres no nos nr n num núm núms fig figs abb tab vol vols v bd p pp pg pág págs pag pagg s ss seite cf cfr vgl conf ref"
    " ch cap kap sec sect art alin lit str strada al bd bl sc et ap c ca cca circa env approx ex ed eds trad bros bzw z d.h i.e e.g p.ex p.e z.b u.a d h t"
    " т с стр рис табл гл ср см напр проф акад им ул д кв п пп тов г-н г-жа т.е"
    " κ κα κος σ σελ σσ εικ αρ αριθ πρβλ βλ τ τόμ π.χ π δρ καθ"
    " डॉ श्री क्र सं पृ प्रो ص ج د ل م رقم أ".split()
)
#: Abbreviations that can stand last in a sentence: they end one before an upper-case letter.
CLOSING = frozenset("etc usw ecc etc.a p.m a.m ltd inc co corp plc gmbh ag jr sr κ.λπ κ.ά κλπ χλμ км км.ч т.д т.п др г гг км км2 м см руб إلخ الخ كم कि.मी km cm kg uhr mio mld u.s u.k".split())

#: Last four letters of the longer abbreviations.
_TAILS = frozenset(w[-4:] for w in LEADING | CLOSING if len(w) >= 4)

_END = re.compile(r"(?:[!?…؟।॥。！？｡]|\.(?![^\s.!?…\"'”’»“)\]」』›,،;:]))+(?:[.!?…؟]*)(?:[\"'”’“)\]」』›]|\s?»)*|(?<=[Ͱ-Ͽἀ-῿])[;;](?:[\"'”’)\]]|\s?»)*(?=\s|$|[,—–-])")
_WORD = re.compile(r"[^\s\"'“”„«»‹›()\[\]¿¡—–/]+$")
_NEXT = re.compile(r"\s*([\"'“„«‹(\[¿¡「『—–-]*)\s*(.?)", re.S)
_OPEN, _CLOSE = "“„«‹「『\"", "”“»›」』\""
_THAI = re.compile(r"[฀-๿]")
_STRONG = frozenset("!?؟！？;;")
_FULL = frozenset("।॥。｡")


def _case(c: str) -> str:
    return "end" if not c else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "plain" if c.isalpha() else "other"


def _convention(text: str, start: int, end: int, since: int) -> tuple:
    """What the writing conventions say of the candidate text[start:end], a mark with its closers, in a sentence begun at since;
    and what they look at."""
    mark = text[start:end]
    last = mark.rstrip("\"'”’“)]」』›»   \n")
    closers = mark[len(last) :]
    n = _NEXT.match(text, end)
    opener, c = n[1], n[2]
    case = _case(c)
    gap = n.end() - len(c) - len(opener) > end
    w = _WORD.search(text, max(since, start - 24), start)
    word = w[0] if w else ""
    low = word.lower().lstrip("(")
    head = text[since:start].lstrip()
    quoted = bool(closers.strip("   \n)]")) and head[:1] in _OPEN and head[:1] != ""
    strong = any(x in _STRONG for x in last)
    full = any(x in _FULL for x in last)
    if case == "end" and not opener.strip("—–-"):
        label = True
    elif case == "lower" or (opener[:1] in "—–-" and opener and case != "upper"):
        label = False
    elif text[end : end + 1] in (",", "،", "，", "、", ";", ":"):
        label = False
    elif quoted and (strong or full) and case == "plain" and not opener:
        label = full and not strong and c != "と"
    elif quoted and strong and opener[:1] in ("—", "–", "-"):
        label = False
    elif closers.startswith(("」", "』")) and c == "と":
        label = False
    elif strong or full:
        label = True
    elif "…" in last or last.endswith(".."):
        label = case in ("upper", "plain") and gap
    elif closers:
        label = True
    elif low in CLOSING or (low in ("д", "п", "др") and re.search(r"т\.\s*$", text[max(0, start - 5) : start - 1])):
        digit_before = bool(re.search(r"\d\s*$", text[max(0, start - len(word) - 4) : max(0, start - len(word))]))
        label = case in ("upper", "digit") and low not in ("sr", "jr") if low != "г" else digit_before and case == "upper"
        if case == "plain":
            label = bool(re.match(r"[؀-ۿ]", low)) and low not in ("كم",)
    elif low in LEADING:
        label = False
    elif len(low) == 1 and word.isalpha():
        label = False
    elif re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]{1,3}", word):
        label = False
    elif re.fullmatch(r"\d{1,2}", word) and case == "upper" and re.search(r"(?:\b(?:am|im|der|die|das|dem|den|des|vom|zum|bis)\s+)\d{1,2}$", text[max(0, start - 12) : start]):
        label = False
    else:
        label = case != "other" or opener != ""
    return label, last, closers, opener, c, case, word, low, quoted, strong, full


def _plain_word(end: str) -> bool:
    """Whether the four characters before a period end a word or year that is no abbreviation."""
    if end.isalpha():
        return end.lower() not in _TAILS
    if end.isdigit():
        return len(end) == 4
    end = end[end.rfind(" ") + 1 :]
    return len(end) > 1 and end.isalpha() and end.lower() not in LEADING and end.lower() not in CLOSING


def rough_sentences(text: str) -> list[str]:
    """Sentences by the conventions alone, for counting; Thai is cut at its gaps between letters."""
    out, at = [], 0
    for m in _END.finditer(text):
        start, end = m.span()
        mark = text[start]
        after = text[end + 1 : end + 2] if text[end : end + 1] == " " else ""
        if after.islower():
            known = False
        elif end - start == 1 and mark in "。！？।؟" and not text[end : end + 1].islower():
            known = True
        elif end - start == 1 and after.isupper() and (mark in "!?" or _plain_word(text[max(0, start - 4) : start])):
            known = True  # a plain word, its mark, a space, an upper-case letter
        else:
            known = _convention(text, start, end, at)[0]
        if known:
            out.append(text[at:end])
            at = end
    if at < len(text):
        out.append(text[at:])
    if not text.isascii() and _THAI.search(text):
        out = [y for x in out for y in (re.split(r"(?<=[฀-๿])\s+(?=[฀-๿])", x) if _THAI.search(x) else [x])]
    return out
