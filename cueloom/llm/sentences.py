"""Sentence boundaries across languages and scripts.

Segmentation rules stand in ordered tables: each rule has patterns for what precedes a
position and what follows, asks for signs of the position, and says whether a sentence
ends there. For each position after end marks and at line breaks the tables of its script's
cascade are asked in turn (abbreviations of all languages, those of the passage's language,
then the script's own), and the first rule that fits decides. No table is asked where the
candidate patterns alone decide: inside quotations and brackets and after item numbers (no
end), at blank lines, after polite particles in Thai and after sentence-final verb forms
before a space where marks are missing (an end).

Defined results: null, empty and blank texts have no sentences; every non-blank
character belongs to exactly one sentence; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations never at a sentence's end, by language, that are words in no other.
ABBREVIATIONS = {
    "en": ["mr", "mrs", "ms", "dr", "prof", "st", "mt", "messrs", "vs", "cf", "approx", "viz", "i.e", "e.g"],
    "de": ["fr", "dipl", "ing", "bzw", "inkl", "exkl", "ca", "evtl", "ggf", "vgl", "zzgl", "bspw", "z. b", "d. h", "z.b", "d.h", "u. a", "o. ä"],
    "fr": ["m", "mme", "mmes", "mlle", "mgr", "av", "apr", "p. ex", "boul", "c.-à-d"],
    "es": ["sr", "sra", "srta", "sres", "dra", "lic", "arq", "d", "dña", "p. ej", "avda"],
    "hi": ["डॉ", "श्री", "श्रीमती", "पृ", "प्रो", "सं"],
    "ar": ["د", "أ", "م", "ص", "ج", "ت"],
    "th": ["ดร", "น", "พ.ศ", "ค.ศ", "นพ", "รศ", "ผศ"],
}
# Abbreviations of one language that are words or units in this or another one. Those of
# TITLES count where written with a capital, as do German days where a date or other days stand beside.
ONLY_IN = {"de": ["sog"], "fr": ["me", "env"], "es": []}
TITLES = {"en": ["rev", "gen", "col", "capt", "lt", "sgt", "hon"], "de": ["hr"], "fr": ["mm"], "es": ["gen", "col"]}
ONLY_IN_MAY_END = {"es": ["ud", "uds"]}
DAYS = "mo|di|mi|do|fr|sa|so"
MONTHS = "jan|feb|mär|apr|mai|jun|jul|aug|sep|okt|nov|dez"
# Frequent words that tell the language of a passage.
STOP_WORDS = {
    "en": "the a an and of to in is are was were that this it for on with as at by from be has have had not you we they he she my our your will would who what why nobody half all there good sounds do me i let to him them".split(),
    "de": "der die das den dem des ein eine einen einem und ist sind war nicht zu mit auf für von im am wir ich sie er es wird hat haben noch auch nur wer was warum niemand unsere unser passt so schon dann bis oder bei nach mir uns".split(),
    "fr": "le la les un une des du de et est sont était ne pas que qui pour dans sur avec au aux ce cette il elle nous vous je on mais ou pourquoi personne tout a avant après notre".split(),
    "es": "el la los las un una unos unas de del y es son era no que por para en con al se lo su sus nos yo ella ellos pero o qué quién nadie todo esta este hasta nuestra vamos más".split(),
}
# Abbreviations that stand before a number.
BEFORE_NUMBER = ["no", "nos", "nr", "nrn", "núm", "num", "fig", "figs", "sec", "sect", "ch", "chap", "vol", "art", "abs", "p", "pp", "pág", "pag", "págs", "s", "abb", "kap", "ver", "v", "ext", "ref", "line", "approx", "ca", "env", "पृ", "ص"]
# Abbreviations that may end a sentence, if a capital follows.
MAY_END = ["etc", "usw", "u.s", "u.k", "ltd", "inc", "co", "corp", "jr", "sr.", "al", "a.m", "p.m", "a. m", "p. m", "sat", "sun", "mon", "tue", "wed", "thu", "fri", "gmbh", "e.v"]
# Words that carry a sentence on after an ellipsis, an exclamation or a quotation.
CARRY_ON = {
    "latin": "and but or then so puis et mais ou und oder aber dann y e o u pero luego said says asked shouted cried whispered sagte fragte rief a dit cria dijo gritó preguntó contestó demanda répondit".split(),
    "zh": "然后 最后 结果 终于 于是 但 却 才 就 接着 又 并 而 便 有人 说 问 后来".split(),
    "ja": "と って なんて".split(),
    "ko": "하고 라고 이라고 라며 하며 라는 이라는 결국 고".split(),
    "hi": "और फिर लेकिन पर तो कहकर".split(),
    "ar": "ثم و فـ لكن أو".split(),
}

# More characters than any pattern of a rule can ask for before the mark it ends with; a test compares them.
LOOK_BACK = 40
# Columns from which a line without an end mark counts as wrapped rather than ended; wide characters take two.
WRAP_WIDTH = 40
_CLOSE = "\"”’»“」』）)\\]】〉》"
_OPEN = "\"“„«‹「『（(\\[【〈《¿¡‘"
# Signs that open a quotation or bracket and those that can close it.
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", '"': '"'}
_QUOTE_SIGNS = re.compile(r"[“„«「『\"（(\[]")
_PAIR_SIGNS = re.compile(r"[“”„«»「」『』（）()\[\]\"]|\n[ \t\r　]*(?:\n\s*)?")
_THAI = re.compile(r"[฀-๿]")
_MARKS = r"[.!?…。．｡！？।॥؟۔]+"
_CANDIDATE = re.compile(rf"{_MARKS}(?:\s?»|[{_CLOSE}]+)*|\n[ \t\r　]*(?:\n\s*)?")
_CANDIDATE_THAI = re.compile(rf"{_MARKS}(?:\s?»|[{_CLOSE}]+)*|(?:ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ)(?=[ \t　])|\n[ \t\r　]*(?:\n\s*)?")
_FORMS_JA = r"(?:ました|ません|ます|ですか|です|でした|ましょう|ください|ますか|たぶん|ですね|だ|である)"
_CANDIDATE_OPEN = re.compile(rf"{_MARKS}(?:\s?»|[{_CLOSE}]+)*|(?:{_FORMS_JA}|니다|세요|어요|아요|나요|까요|네요|지요|죠)(?=[ 　]+[^\s(（\[])|\n[ \t\r　]*(?:\n\s*)?")
_KANA_HANGUL = re.compile(r"[ぁ-ヿ가-힣]")
_HEAD = re.compile(
    r"[ \t　]*(?:[*•‣·▪◦–—-][ \t　]|・|[(（]\d{1,3}[)）]|\d{1,3}[.)．）、][ \t　]|[①-⑳]|#{1,6}[ \t]|[\[(（]?\d{1,2}[:：]\d{2}(?:[:：]\d{2})?(?:[.,]\d+)?[\])）]?(?=\s|$)|>{1,3}[ \t]|<v[ .]|(?:SPEAKER|Speaker|speaker|SPK|spk|話者|发言人|화자)[ _-]?\d+[ \t]*[:：]|(?:[^\W\d_][^\W\d_.'’-]*[ 　]?){1,3}[:：](?=\s|[^\x00-\x7f]|[A-Za-z]))"
)
_NUMBER_HEAD = re.compile(r"[ \t　]*(?:[(（]?\d{1,3}[.)．）、]|[\[(（]?\d{1,2}[:：]\d{2})")
_NAME_HEAD = re.compile(r"[ \t　]*(?:[^\W\d_][^\W\d_.'’-]*[ 　]?){1,3}[:：]")
_NUMBERED_LABEL = re.compile(r"[ \t　]*(?:SPEAKER|SPK|話者|发言人|화자)[ _-]?\d", re.I)
_LIST_HEAD = re.compile(r"[ \t　]*(?:[*•‣·▪◦–—-][ \t　]|・|[(（]?\d{1,3}[.)．）、][ \t　]|[①-⑳]|[\[(（]?\d{1,2}[:：]\d{2})")
_PARTICLE_END = re.compile(r"(?:ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ)\Z")
_ITEM_AT_END = re.compile(r"(?:^|\n)[ \t　]*(?:\d{1,3}|[A-Za-z])[.)．]\Z")
_END_OF_LINE = re.compile(rf"[.!?…。．！？।॥؟۔](?:\s?»|[{_CLOSE}])*[ \t　]*\Z")
_SPACE = re.compile(r"[ \t　]*\n?[ \t　]*")
_WORD = re.compile(r"[^\W\d_]+")


# What is known of a position besides its text; rules ask for these signs or their absence.
CLOSED, SPACED, LOWER, DOT, DOTS, LONG, ASKS, STOPS, BRACKET, ELLIPSIS, INTRODUCED, NEXT_LOWER, NEXT_ALPHA, NEXT_ALNUM, TRAILING, HEAD, ENDED, WIDE, FRESH, PARTICLE = (1 << i for i in range(20))
# CLOSED: by a quotation sign or bracket. LOWER: the text has no capitals. DOT: the mark is a full stop, DOTS: it has more
# or none. LONG: a full stop after a word longer than any abbreviation. ASKS, STOPS: ? or !; those or a full stop.
# INTRODUCED: the quotation follows a colon or comma. TRAILING: the mark begins with dots. From HEAD on they are of line breaks.


class Rule(NamedTuple):
    """One row of a segmentation table: whether a sentence ends at a position that it fits."""

    ends: bool
    mask: int  # the signs that matter
    signs: int  # those of them that must be there
    before: re.Pattern[str] | None  # searched in the characters up to the position, anchored at its end
    after: re.Pattern[str] | None  # matched from the position
    then: re.Pattern[str] | None  # matched from the next character that is not blank
    line: re.Pattern[str] | None  # matched from the start of the line


def _rule(ends: bool, before: str = "", after: str | re.Pattern[str] = "", case: bool = False, then: str | re.Pattern[str] = "", line: str | re.Pattern[str] = "", on: int = 0, off: int = 0) -> Rule:
    return Rule(ends, on | off, on, re.compile(rf"(?:{before})\Z", (0 if case else re.I) | re.S) if before else None, *(re.compile(x) if x else None for x in (after, then, line)))


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))


_EDGE = r"(?<![\w])"
_CARRY_LATIN = re.compile(rf"\s+(?:{_any(CARRY_ON['latin'])})(?!\w)", re.I)
_CARRY_JA_QUOTE = re.compile(r"と|って|なんて|は(?!い)|が|を|に|の|で|も(?!ち|う)")
_CARRY_JA_DOTS = re.compile(r"たぶん|おそらく|きっと|かも|と(?!て)|って")
_CARRY_CJK = re.compile(rf"[ 　]?(?:{_any(CARRY_ON['zh'])})")

# Tables, asked in this order; each is a list of rules whose first match decides.
GENERAL_NO_BREAK = [
    _rule(False, r"(?<!\d )(?<!\d)(?<![\w])[A-Za-zÀ-ɏ][.]", r"\s*\S"),  # initials and one-letter abbreviations, but not units after a number
    _rule(False, rf"{_EDGE}(?:{_any([a for v in ABBREVIATIONS.values() for a in v])})[.]", r"\s"),
    _rule(False, rf"{_EDGE}(?:{_any(BEFORE_NUMBER)})[.]", r"\s*\d"),
    _rule(False, r"(?<![\w])(?:dem|der|den|des|das|die|am|im|zum|zur|vom|beim|seit|bis)\s\d{1,4}[.]", r"\s+[A-ZÄÖÜ]"),  # German ordinals
]
# Tables of one Latin language, asked if the passage is in it, for texts with capitals and without.
def _language_table(lang: str, lower: bool) -> list[Rule]:
    table = []
    # A title needs its capital unless the text has none at all.
    if titles := TITLES.get(lang):
        table.append(_rule(False, rf"(?<!\d )(?<!\d){_EDGE}(?:{_any(titles if lower else [w.capitalize() for w in titles] + [w.upper() for w in titles if w == 'mm'])})[.]", r"\s+[^\W\d_]" if lower else r"\s+[^\W\d_a-z]", case=not lower))
    if words := ONLY_IN.get(lang):
        table.append(_rule(False, rf"{_EDGE}(?:{_any(words)})[.]", r"\s"))
    if words := ONLY_IN_MAY_END.get(lang):
        table.append(_rule(False, rf"{_EDGE}(?:{_any(words)})[.]", r"\s" if lower else r"\s+[^\W\d_A-ZÀ-ÖØ-Þ]"))
    if lang == "de":
        days = DAYS if lower else "|".join(d.capitalize() for d in DAYS.split("|"))
        table += [
            _rule(False, rf"{_EDGE}(?:{days})[.]?\s*(?:und|oder|bis|[,/–-])\s*(?:{days})[.]", r"\s+[^\W\d_A-ZÄÖÜ]|\s+\d", case=not lower),
            _rule(False, rf"{_EDGE}(?:[Aa]m|[Vv]om|[Bb]is|[Aa]b|[Ss]eit|[Jj]eden|[Nn]ächsten|[Dd]iesen|[Kk]ommenden|[Ll]etzten)\s(?:{days})[.]", r"\s+[^\W\d_A-ZÄÖÜ]|\s+\d", case=not lower),
            _rule(False, rf"{_EDGE}(?:{days})[.]", rf"\s+(?:(?:und|oder|bis)\s|[/–-]\s?)(?:{days})\b|\s+(?:den\s)?\d{{1,2}}(?:[.:]\s?\d|[.]?\s(?i:{MONTHS}|uhr))", case=not lower),
        ]
    return table


LANGUAGE_NO_BREAK = {lang: (_language_table(lang, False), _language_table(lang, True)) for lang in STOP_WORDS}
_ONE_LANGUAGE = re.compile(rf"{_EDGE}(?:{_any([w for t in (ONLY_IN, TITLES, ONLY_IN_MAY_END) for v in t.values() for w in v] + DAYS.split('|'))})[.]\Z", re.I)
_STOP_SETS = {lang: frozenset(words) for lang, words in STOP_WORDS.items()}
GLUED = [
    _rule(True, r"[^\W\d_A-Z]{2,}[.!?…]+", r"[A-ZÀ-ÖØ-Þ¿¡„«][^\W\d_A-Z]|[A-ZÀÉ]['’]", case=True),  # the space after the mark is missing
    _rule(True, r"\d[.!?…]+", r"[A-ZÀ-ÖØ-Þ][a-zß-ÿ]+[ ,.]", case=True),
    _rule(False, r"[.]", r"[A-Za-z0-9_@/\\-]"),  # decimals, file names, addresses
]
MAY_END_TABLE = [_rule(False, rf"{_EDGE}(?:{_any(MAY_END)})[.]", r"\s+[^\W\d_A-ZÀ-ÖØ-Þ]|\s*[,;:]")]
MAY_END_LOWER = [_rule(False, rf"{_EDGE}(?:{_any([w for w in MAY_END if w not in ('etc', 'usw')])})[.]", r"\s|\s*[,;:]")]
_QUICK = re.compile(r"[^\W\d_]{7,}[.]\Z")  # longer than any abbreviation of the tables
_MARKS_BEFORE = r"[.!?…。．｡！？।॥؟۔]+"

# Tables of scripts and of line breaks: a cascade holds tables, each with the signs it needs and must not see. The table of
# the passage's language is looked up where LANGUAGE stands.
LANGUAGE: list[Rule] = []
ANY_SCRIPT = [_rule(True, then=r"\Z", off=NEXT_ALNUM), _rule(False, then=r"[,;:、，；：]", off=NEXT_ALNUM)]
HANGUL = [
    _rule(False, on=CLOSED, off=SPACED),
    _rule(False, then=_any(CARRY_ON["ko"]), on=CLOSED),
    _rule(True, rf"[다요까죠네군]{_MARKS_BEFORE}", on=TRAILING, off=CLOSED),
    _rule(False, on=TRAILING, off=CLOSED),
    _rule(True, rf"[다요까죠네군]{_MARKS_BEFORE}", on=DOT, off=SPACED),
    _rule(False, on=DOT, off=SPACED),
    _rule(True),
]
KANA_HAN = [
    _rule(True, on=CLOSED | BRACKET | SPACED | STOPS),
    _rule(False, on=CLOSED | BRACKET),
    _rule(False, then=_CARRY_JA_DOTS, on=ELLIPSIS),
    _rule(False, after=_CARRY_CJK, on=ELLIPSIS),
    _rule(True, on=ELLIPSIS),
    _rule(False, then=_CARRY_JA_QUOTE, on=CLOSED),
    _rule(False, then=_any(CARRY_ON["ja"]), on=ASKS, off=CLOSED),
    _rule(True, then=r"[ぁ-ん]"),
    _rule(False, after=_CARRY_CJK, then=r"[一-鿿]", on=CLOSED),
    _rule(True, then=r"[一-鿿]", on=CLOSED | INTRODUCED),
    _rule(False, then=r"[一-鿿]", on=CLOSED | ASKS),
    _rule(True, then=r"[一-鿿]", on=CLOSED),
    _rule(True, r"[⺀-\U0010ffff].", on=DOT, off=SPACED),
    _rule(False, on=DOT, off=SPACED),  # Dr.テルマス, Ver.2
    _rule(True),
]
DEVANAGARI = [_rule(False, then=_any(CARRY_ON["hi"]), on=CLOSED), _rule(True)]
ARABIC = [_rule(False, then=r"ثم|وقال|لكن", on=CLOSED), _rule(True)]
THAI = [_rule(False, on=DOT), _rule(True)]
LATIN = [
    _rule(False, on=DOT | DOTS | NEXT_LOWER, off=CLOSED | SPACED),
    _rule(True, on=DOT | DOTS, off=CLOSED | SPACED),
    _rule(True, on=NEXT_ALPHA, off=DOT | CLOSED | SPACED | NEXT_LOWER),
    _rule(True, then=r"[¿¡«„“]", off=DOT | CLOSED | SPACED),
    _rule(False, off=DOT | CLOSED | SPACED),
    _rule(False, on=CLOSED | NEXT_ALNUM, off=SPACED),
    _rule(False, then=r"[a-zß-ÿ]", off=LOWER),
    _rule(False, after=_CARRY_LATIN, then=r"[a-zß-ÿ]", on=CLOSED),
    _rule(False, after=_CARRY_LATIN, then=r"[a-zß-ÿ]", off=DOT),
    _rule(False, after=_CARRY_LATIN, then=r"[a-zß-ÿ]", on=DOTS),
    _rule(True, then=r"[a-zß-ÿ]"),
    _rule(False, on=CLOSED | BRACKET, off=STOPS | ELLIPSIS),
    _rule(True),
]
# A number or a word with a colon at the head of the next line may be an item's or a speaker's, or the wrapped line's next
# word: it is the latter where a wide line without an end mark stands before that is no item, or has no label, itself.
LINE_HEADS = [
    _rule(True, on=HEAD | ENDED),
    _rule(True, on=HEAD | PARTICLE),
    _rule(True, on=HEAD, off=WIDE),
    _rule(True, after=_NUMBER_HEAD, line=_LIST_HEAD, on=HEAD | FRESH),
    _rule(False, after=_NUMBER_HEAD, on=HEAD),
    _rule(True, after=_NUMBERED_LABEL, on=HEAD),
    _rule(True, after=_NAME_HEAD, line=_HEAD, on=HEAD | FRESH),
    _rule(False, after=_NAME_HEAD, on=HEAD),
    _rule(True, on=HEAD),
]
LINE_ENDS = [_rule(True, on=ENDED), _rule(False, on=WIDE), _rule(True)]

Cascade = list[tuple[int, int, list[Rule]]]


def _after(on: int, off: int, *tables: list[Rule]) -> Cascade:
    return [(on | off, on, table) for table in tables]


CASCADES: dict[str, Cascade] = {
    "hangul": [*_after(0, 0, ANY_SCRIPT), *_after(DOT, CLOSED, GENERAL_NO_BREAK, LANGUAGE), *_after(0, 0, HANGUL)],
    "kana_han": _after(0, 0, ANY_SCRIPT, KANA_HAN),
    "danda": _after(0, 0, ANY_SCRIPT, DEVANAGARI),
    "devanagari": [*_after(0, 0, ANY_SCRIPT), *_after(DOT, 0, GENERAL_NO_BREAK, LANGUAGE), *_after(0, 0, DEVANAGARI)],
    "arabic": [*_after(0, 0, ANY_SCRIPT), *_after(DOT, CLOSED, GENERAL_NO_BREAK, LANGUAGE), *_after(0, 0, ARABIC)],
    "thai": _after(0, 0, ANY_SCRIPT, GENERAL_NO_BREAK, LANGUAGE, THAI),
    "latin": [*_after(0, 0, ANY_SCRIPT), *_after(DOT, CLOSED | DOTS | LONG, GENERAL_NO_BREAK, LANGUAGE, GLUED), *_after(DOT, CLOSED | DOTS | LONG | LOWER, MAY_END_TABLE), *_after(DOT | LOWER, CLOSED | DOTS | LONG, MAY_END_LOWER), *_after(0, 0, LATIN)],
    "line_head": _after(HEAD, 0, LINE_HEADS),
    "line": [*_after(ENDED, 0, GENERAL_NO_BREAK, LANGUAGE), *_after(0, 0, LINE_ENDS)],
}


@cache
def _rules(script: str, signs: int) -> list[Rule | None]:
    """The rules of a cascade, in order, that such signs leave over; None stands for those of the passage's language."""
    return [r for mask, needed, table in CASCADES[script] if signs & mask == needed for r in ([None] if table is LANGUAGE else table) if r is None or signs & r.mask == r.signs]


def _script(nxt: str, stem: str, last: str, spaced: bool) -> str:
    """Whose tables are asked, by the characters beside the mark and the mark itself."""
    if "가" <= nxt <= "힣":
        return "hangul"
    if stem > "\u2e7f" or last in "。．｡！？" or nxt > "\u2e7f" and (last in "!?…" or last == "." and not spaced):
        return "kana_han"
    if last in "।॥":
        return "danda"
    if "\u0600" <= nxt <= "\u06ff":
        return "arabic"
    if "\u0900" <= nxt <= "\u097f":
        return "devanagari"
    return "thai" if "\u0e00" <= nxt <= "\u0e7f" else "latin"


@lru_cache(4096)
def _mark_signs(mark: str) -> tuple[str, int]:
    """The last end mark before any closing signs, and the signs that the mark gives."""
    last = mark.rstrip("\"”’»“」』）)]】〉》 \u00a0\u202f")[-1:]
    signs = CLOSED * (mark[-1] in "\"”’»“」』）)]】〉》") | BRACKET * (mark[-1] in "）)]】")
    signs |= DOT * (last == ".") | ASKS * (last in "！？!?") | STOPS * (last in "。！？.!?")
    return last, signs | ELLIPSIS * (last == "…" or mark.startswith("...")) | TRAILING * mark.startswith(("..", "…")) | DOTS * (mark.count(".") != 1)


@lru_cache(4096)
def _next_signs(nxt: str) -> int:
    return NEXT_ALNUM * nxt.isalnum() | NEXT_ALPHA * nxt.isalpha() | NEXT_LOWER * nxt.islower()


def _decide(text: str, p: int, mark: str, lower: bool, from_quote: int) -> bool:
    """Whether a sentence ends at p, where mark (end marks and closing signs) has just ended."""
    q = _SPACE.match(text, p).end()
    nxt = text[q : q + 1]
    last, signs = _mark_signs(mark)
    signs |= _next_signs(nxt)
    stem = text[p - len(mark) - 1 : p - len(mark)]
    if q > p:
        signs |= SPACED
        if last == "." and _QUICK.search(text, max(0, p - 20), p):
            signs |= LONG
    if lower:
        signs |= LOWER
    if from_quote >= 0 and text[max(0, from_quote - 1) : from_quote] in "：:，,":
        signs |= INTRODUCED
    return bool(_first(_rules(_script(nxt, stem, last, q > p), signs), text, p, q, lower, len(mark)))


def _first(rules: list[Rule | None], text: str, p: int, q: int, lower: bool, mark: int = 0, line: int = 0) -> bool | None:
    """What the first of the rules that fits p says, or None."""
    window = None
    for rule in rules:
        if rule is None:
            if (got := _first(_language_rules(text, p, lower), text, p, q, lower, mark)) is not None:
                return got
            continue
        ends, _, _, before, after, then, start = rule
        if then and not then.match(text, q) or after and not after.match(text, p) or start and not start.match(text, line):
            continue
        if before:
            if window is None:
                window = text[max(0, p - LOOK_BACK - mark) : p]
            if not before.search(window):
                continue
        return ends
    return None


def _language(text: str, p: int) -> str | None:
    """The language of the passage around p by its frequent words: of the line, else of the text near it; None if none stands out."""
    start, end = text.rfind("\n", 0, p) + 1, text.find("\n", p)
    for a, b in ((max(start, p - 160), min(end if end >= 0 else len(text), p + 80)), (max(0, p - 600), p + 600)):
        words = [w.lower() for w in _WORD.findall(text, a, b)]
        counts = sorted(((sum(w in known for w in words), lang) for lang, known in _STOP_SETS.items()), reverse=True)
        if counts[0][0] > counts[1][0]:
            return counts[0][1]
    return None


def _language_rules(text: str, p: int, lower: bool) -> list[Rule]:
    """The table of the passage's language if a word of such a table stands before p."""
    if not _ONE_LANGUAGE.search(text, max(0, p - 7), p):
        return []
    lang = _language(text, p)
    return LANGUAGE_NO_BREAK[lang][lower] if lang else []


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end of the outermost quotations and brackets, whatever their length.

    Signs are paired on a stack in one pass. Blank lines and lines that begin like an item or with a
    label end what is open; so does any line break for a square bracket. Signs without a partner
    do not count. The straight sign opens after a blank and closes after anything else, but
    where no blanks stand around it they take turns.
    """
    found: list[tuple[int, int]] = []
    held: list[tuple[str, int]] = []
    n = len(text)
    for m in _PAIR_SIGNS.finditer(text):
        at, sign = m.start(), m[0]
        if sign[0] == "\n":
            if sign.count("\n") > 1 or _HEAD.match(text, at + 1):
                held = []
            elif held:
                held = [h for h in held if h[0] != "["]
            continue
        if sign == '"':
            blank_before, blank_after = at == 0 or text[at - 1].isspace(), at + 1 == n or text[at + 1].isspace()
            closes = any(h[0] == '"' for h in held) and (not blank_before or blank_after)
            if not closes and blank_after and not blank_before:
                continue  # nothing is open
        else:
            closes = any(sign in _PAIRS[h[0]] for h in held)
        if closes:
            while True:
                opened, start = held.pop()
                if sign in _PAIRS[opened]:
                    break
            while found and found[-1][0] > start:
                found.pop()
            if opened != '"' or at > start + 1:
                found.append((start, at + 1))
        elif sign in _PAIRS and (sign != "[" or at == 0 or text[at - 1].isspace()):
            held.append((sign, at))
    return found


def _width(s: str) -> int:
    return len(s) + sum(1 for c in s if c > "\u2e7f") if not s.isascii() else len(s)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence in code points, in order; see the module's docstring."""
    if not text or text.isspace():
        return []
    lower = False
    starts = re.findall(r"[.!?]\s+([^\W\d_])", text)
    if starts:
        low = sum(1 for c in starts if c.islower())
        lower = low * 2 > sum(1 for c in starts if c.lower() != c.upper())
    spans: list[tuple[int, int]] = []
    if _QUOTE_SIGNS.search(text):
        spans = quotations(text)
    k, n_spans = 0, len(spans)
    pattern = _CANDIDATE
    if not text.isascii():
        pattern = _CANDIDATE_THAI if _THAI.search(text) else _CANDIDATE_OPEN if _KANA_HANGUL.search(text) else _CANDIDATE
    cuts: list[int] = []
    line_start, fresh = 0, True  # fresh: the line begins a sentence
    for m in pattern.finditer(text):
        a, p = m.span()
        first = text[a]
        if first == "\n":
            got = m[0]
            fresh = got.count("\n") > 1 or _breaks(text, a, line_start, fresh, lower)
            line_start = a + 1
            if fresh:
                cuts.append(a)
            continue
        while k < n_spans and spans[k][1] <= a:
            k += 1
        quote = -1
        if k < n_spans and spans[k][0] < a:
            if p < spans[k][1]:
                continue  # inside a quotation or bracket
            quote = spans[k][0]
            if p > spans[k][1] and text[spans[k][1]] in "“\"":
                p = spans[k][1]  # the next sign opens another quotation
        elif "“" in m[0] or '"' in m[0]:
            p = a + min(i for i in (m[0].find("“"), m[0].find('"')) if i >= 0)  # an opening sign
            if p == a:
                continue
        mark = text[a:p]
        if first in ".!?…。．｡！？।॥؟۔":
            if first == "." and fresh and _ITEM_AT_END.search(text[max(0, a - 8) : a + 1] if a > 8 else "\n" + text[: a + 1]):
                continue
            if _decide(text, p, mark, lower, quote):
                cuts.append(p)
        else:  # a closing verb form or particle before a space
            cuts.append(p)
    out = []
    at = 0
    for cut in [*cuts, len(text)]:
        if cut <= at:
            continue
        piece = text[at:cut]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + lead + len(body)))
        at = cut
    return out


def _breaks(text: str, a: int, line_start: int, fresh: bool, lower: bool) -> bool:
    """Whether the single line break at a ends a sentence rather than wraps the line."""
    body = text[line_start:a].rstrip()
    if not body:
        return True
    signs = FRESH * fresh | WIDE * (_width(body) >= WRAP_WIDTH) | ENDED * (_END_OF_LINE.search(body[-8:]) is not None)
    if _HEAD.match(text, a + 1):
        signs |= HEAD | PARTICLE * (_PARTICLE_END.search(body) is not None)
        return bool(_first(_rules("line_head", signs), text, a + 1, a + 1, lower, 0, line_start))
    return bool(_first(_rules("line", signs), text, line_start + len(body), a + 1, lower))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends, counts = batch.column(0), [], [], []
        for text in batch.column(1).to_pylist():
            got = sentences(text)
            counts.append(len(got))
            for s, e in got:
                starts.append(s)
                ends.append(e)
        where = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        yield pa.RecordBatch.from_arrays([ids.take(where), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_char and end_char of every sentence of every document.

    One narrow stage without a shuffle: a document never leaves its task. A row delivered
    twice gives its sentences twice. Other columns of the input are not read.
    """
    kind = dict(documents.dtypes)[key]
    return documents.where(documents[text].isNotNull()).select(documents[key].alias("doc_id"), documents[text].alias("text")).mapInArrow(_batches, f"doc_id {kind}, start_char int, end_char int")
