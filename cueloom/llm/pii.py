"""Personal information inside free text: found, typed and replaced by placeholders.

Regular expressions propose spans with a base score, checksum validators confirm
numbers, and words nearby raise or lower the score; spans that reach the threshold
count. Where spans overlap, the kind that stands first in KINDS keeps the text, so that
no part of one case counts as another. Everything works on the canonical form of the
text, which sees through disguised characters.

Defined results: null stays null, empty and blank texts hold nothing; texts of any
length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueloom.llm import names
from cueloom.llm.canonical import canonicalize
from cueloom.llm.speech import CLOCK_RE, NOBODY, SOUNDS, label_number, labelled, name_key
from cueloom.llm.turns import aliases
from cueloom.operators.ids import with_group_values
from cueloom.session import written

KINDS = ["EMAIL", "ID_NUMBER", "ADDRESS", "PHONE", "NAME"]
THRESHOLD = 0.5


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- checksums -------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The Luhn sum, as used by payment cards and the Canadian insurance number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod_97(digits: str) -> bool:
    """The French social security key: the number and its key fill a multiple of 97."""
    return len(digits) == 15 and (97 - int(digits[:13]) % 97) == int(digits[13:])


def iban(s: str) -> bool:
    """The account number check: first four signs to the end, letters as two digits, rest 1 by 97."""
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in (s[4:] + s[:4]).upper())) % 97 == 1


def chinese_id(s: str) -> bool:
    """ISO 7064 mod 11-2 over 17 digits."""
    if not regex.fullmatch(r"\d{17}[\dXx]", s):
        return False
    total = sum(int(d) * (2 ** (17 - i) % 11) for i, d in enumerate(s[:17]))
    return "10X98765432"[total % 11] == s[17].upper()


def my_number(s: str) -> bool:
    """The Japanese individual number of twelve digits."""
    if not regex.fullmatch(r"\d{12}", s):
        return False
    total = sum(int(d) * (n + 1 if n <= 6 else n - 5) for n, d in enumerate(reversed(s[:11]), 1))
    return (0 if total % 11 <= 1 else 11 - total % 11) == int(s[11])


def tax_id_de(s: str) -> bool:
    """ISO 7064 mod 11,10 over ten digits."""
    if not regex.fullmatch(r"[1-9]\d{10}", s):
        return False
    p = 10
    for d in s[:10]:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(s[10])


def dni(s: str) -> bool:
    """The control letter of a Spanish DNI or NIE."""
    m = regex.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", s.upper())
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int({"": "", "X": "0", "Y": "1", "Z": "2"}[m[1]] + m[2]) % 23] == m[3]


def korean_id(s: str) -> bool:
    """The check digit of a Korean resident number."""
    if not regex.fullmatch(r"\d{13}", s):
        return False
    total = sum(int(d) * w for d, w in zip(s, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], strict=False))
    return (11 - total % 11) % 10 == int(s[12])


_NO_SIGN = regex.compile(r"[^0-9A-Za-z]")


def _bare(s: str) -> str:
    return _NO_SIGN.sub("", s)


# ---- proposals -------------------------------------------------------------------------

# Spoken and bracketed forms of the signs in an address.
_AT_SPACED, _AT_GLUED = "at|arroba|arobase|chez|ät", "アットマーク|アット|골뱅이|艾特"
_DOT_SPACED, _DOT_GLUED = "dot|punto|point|punkt", "ドット|点|닷|쩜"
_AT = rf"(?:\s?@\s?|\s?[\[(（]\s*(?:at|@)\s*[\])）]\s?|\s+(?:{_AT_SPACED})\s+|\s?(?:{_AT_GLUED})\s?)"
_DOT = rf"(?:\.|\s?[\[(（]\s*(?:dot|\.)\s*[\])）]\s?|\s+(?:{_DOT_SPACED})\s+|\s?(?:{_DOT_GLUED})\s?)"
_EMAIL = regex.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:(?:\s+(?:{_DOT_SPACED})\s+|\s?(?:{_DOT_GLUED})\s?)[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]{{2,}})+", regex.I)
# Spellings of which each word is an ordinary one ("at this point we", "chez nous point final"):
# they need a sign or digit before, a host's last name or a word for addresses as well.
_WORDY_EMAIL = regex.compile(rf"(?P<local>\S+)\s+(?:chez\s.*|at\s.*\s(?:point|punto)\s+\S+)", regex.I)
_EMAIL_LOCAL = regex.compile(r"[._%+]|\p{L}\d|\d\p{L}")
_EMAIL_CONTEXT = regex.compile(r"mail|courriel|adresse|address|correo|dirección", regex.I)
_HOST_ENDS = frozenset("com org net edu gov info biz io eu fr ch ca uk mx example invalid test local".split())

# Words that announce an identity number.
_ID_WORDS = (
    r"SSN|social security(?: number| no\.?)?|passport(?: number| no\.?)?|(?:driv(?:er'?s|ing) )?licen[cs]e(?: number| no\.?)?|national (?:ID|insurance)(?: number| no\.?)?|tax(?:payer)? (?:ID|number)|insurance (?:number|no\.?)|identity card|ID card"
    r"|Ausweis(?:nummer)?|Personalausweis(?:nummer)?|Reisepass(?:nummer)?|Steuer-?\s?ID|Steuernummer|Sozialversicherungsnummer|Versichertennummer|Führerschein(?:nummer)?"
    r"|DNI|NIE|NIF|pasaporte|carn[eé] de conducir|permiso de conducir|(?:número de )?seguridad social|carte d['’]identité|passeport|num[ée]ro de s[ée]cu(?:rité sociale)?|sécurité sociale|NIR|permis de conduire|numéro fiscal"
    r"|マイナンバー|個人番号|(?:運転)?免許証?(?:の?番号)?|パスポート(?:の?番号)?|旅券(?:の?番号)?|保険証(?:の?番号)?|年金番号|身份证(?:号码?)?|护照(?:号码?)?|驾(?:驶|照)证?(?:号码?)?|社保(?:卡)?(?:号码?)?|주민(?:등록)?번호|여권(?:번호)?|운전면허(?:번호)?|면허번호|보험번호"
)
_ID_VALUE = r"(?:[A-Z]{1,3}[-\s]?)?\d[A-Z0-9]*(?:[-\s./]\d[A-Z0-9]*)*(?:[-\s][A-Z](?![\p{L}\d]))?"
_ID_NAMED = regex.compile(rf"(?<![A-Za-z])(?:{_ID_WORDS})(?:\s*(?:is|was|ist|lautet|est|es|number|no\.?|nr\.?|n°|番号|는|은|是|为))?\s*[はがの]?\s*[:：#]?\s*(?P<v>{_ID_VALUE})", regex.I)
_ID_SHAPES: list[tuple[regex.Pattern[str], float, Callable[[str], bool] | None]] = [
    (regex.compile(r"(?<![\d-])(?!000|666)\d{3}-\d{2}-\d{4}(?![\d-])"), 0.5, None),
    (regex.compile(r"(?<![\dA-Za-z])\d{17}[\dXx](?![\dA-Za-z])"), 0.3, chinese_id),
    (regex.compile(r"(?<!\d[ -]?)\d{4}[ -]?\d{4}[ -]?\d{4}(?![ -]?\d|-)"), 0.1, my_number),
    (regex.compile(r"(?<!\d[ -]?)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![ -]?\d)|(?<!\d[ -]?)\d{4}[ -]?\d{6}[ -]?\d{5}(?![ -]?\d)"), 0.2, luhn),
    (regex.compile(r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![\p{L}\d])"), 0.2, iban),
    (regex.compile(r"(?<![\d-])[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}(?![\d-])"), 0.3, mod_97),
    (regex.compile(r"(?<![\d-])\d{6}-[1-8]\d{6}(?![\d-])"), 0.5, korean_id),
    (regex.compile(r"(?<![\w-])(?:[XYZ]-?)?\d{7,8}-?[A-HJ-NP-TV-Z](?![\w-])"), 0.2, dni),
    (regex.compile(r"(?<![\d-])\d{2} \d{3} \d{3} \d{3}(?![\d-])"), 0.2, tax_id_de),
    (regex.compile(r"(?<!\d[ -]?)\d{3} \d{3} \d{3}(?! ?\d|-)"), 0.1, luhn),
]
_ID_CONTEXT = regex.compile(rf"(?:{_ID_WORDS})", regex.I)

# Number words and what numbers are called when they are none of a person's.
_NUMBER_WORDS = {
    "en": "zero|oh|one|two|three|four|five|six|seven|eight|nine",
    "de": "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "fr": "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "es": "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
}
_WORDED = regex.compile("|".join(rf"(?<![\p{{L}}])(?:{w})(?:[\s,.-]+(?:{w})(?![\p{{L}}])){{6,14}}" for w in _NUMBER_WORDS.values()), regex.I)
_KANA_DIGITS = regex.compile(r"(?:ゼロ|れい|まる)(?:の?(?:ゼロ|れい|まる|いち|に|さん|よん|ご|ろく|なな|しち|はち|きゅう)){8,11}")
_ZERO_KANA = re.compile("ゼロ|れい|まる")
_HAN_DIGITS = regex.compile(r"[零〇一二三四五六七八九幺两]{10,13}")
_HANGUL_DIGITS = regex.compile(r"(?:(?:공|영|일|이|삼|사|오|육|칠|팔|구)[\s에-]?){9,12}(?![가-힣])")
_PHONE = regex.compile(r"(?<![\d\p{Latin}@.:/-])(?:\+\d{1,3}[\s.-]?)?(?:\(0?\d{1,4}\)[\s.-]?)?\d{1,15}(?:[\s./−‐–-]\d{1,8}){0,5}(?![\d\p{Latin}@]|[:：]\d)")
_DATE = regex.compile(r"(?:19|20)\d{2}[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ](?:19|20)\d{2}")
_PARTED = regex.compile(r"[\s./-]")
_NOT_A_PHONE = regex.compile(r"(?:meeting|session|webinar)\s*(?:id|code|number)|ticket|invoice|order|build|version|release|case|Sitzungs?kennung|kennung|Rechnung|facture|identifiant|factura|tique|código|code|チケット|請求書|会議\s*ID|バージョン|注文|会议号|会议\s*ID|工单|发票|订单|회의\s*(?:ID|번호)|티켓|청구서|주문", regex.I)
_PHONE_CONTEXT = regex.compile(r"call|ring|phone|mobile|reach|text|dial|fax|number is|cell|erreichbar|telefon|handy|Nummer|anruf|numéro|joint|appel|téléphone|portable|teléfono|móvil|llam|número|電話|携帯|番号|かけ|つながり|切れたら|控えて|电话|手机|打|拨|号码|번호|전화|연락|주세요", regex.I)

# What streets are called.
_STREET_EN = r"street|st\.?|lane|ln\.?|road|rd\.?|avenue|ave\.?|crescent|cres\.?|drive|dr\.?|court|ct\.?|close|way|square|sq\.?|place|pl\.?|terrace|boulevard|blvd\.?|row|hill|gardens|mews|parade|walk|grove|highway|hwy\.?|circle"
_NOT_IN_STREET = r"(?:the|of|on|at|and|to|for|a|an|in|is|was|this|that|minutes?|days?|rooms?|pages?|lines?|items?|steps?|half|by|or|with|under|we|you|it)"
_ADDRESSES = [
    regex.compile(rf"(?:(?:flat|apt\.?|unit|suite|no\.?)\s*\d+[a-z]?,?\s+)?(?<![\d.,:-])\d{{1,5}}[a-z]?(?:\s+\d{{1,3}}(?:st|nd|rd|th))?(?:\s+(?!{_NOT_IN_STREET}\b)\p{{L}}[\p{{L}}'’]+){{1,3}}\s+(?:{_STREET_EN})(?![\p{{L}}])(?:,?\s*(?:apt|unit|flat|suite)\.?\s*\d+\s?[a-z]?)?(?:,?\s+(?:in\s+)?(?-i:\p{{Lu}})\p{{L}}+(?:\s+\d{{5}})?)?", regex.I),
    regex.compile(r"(?<![\p{L}])(?:(?:alte|neue|obere|untere|große|kleine|lange)[rn]?[ -])?\p{L}+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|chaussee|steig)\s+\d{1,4}\s?[a-z]?(?![\p{L}\d])(?:,?\s+(?:in\s+)?\d{5}(?:\s+\p{L}+)?)?", regex.I),
    regex.compile(r"(?<![\p{L}])(?:am|an der|an den|im|in der|auf der|auf dem|zum|zur|unter den)\s+\p{L}{4,}(?:\s+\p{L}+)?\s+\d{1,4}(?:\s?[a-z](?![\p{L}]))?,?\s+(?:in\s+)?\d{5}\s+\p{L}+", regex.I),
    regex.compile(r"\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours|passage|square|faubourg)\s+(?:\p{L}[\p{L}'’-]*\s*){1,5}(?:,?\s*\d{5}(?:\s+\p{L}[\p{L}-]*)?)?", regex.I),
    regex.compile(r"(?<![\p{L}])(?:calle|plaza|avenida|avda\.?|paseo|camino|carretera|ronda|travesía|callejón|c/)\s*(?:\p{L}+\.?\s+){1,5}?(?:n[.ºo°]*\s*)?\d{1,4}(?![\d:])(?:,?\s*\d{1,2}[ºªo]\s?[a-z]?(?![\p{L}]))?(?:,?\s*\d{5})?(?:,?\s+(?-i:\p{Lu})\p{L}+)?", regex.I),
    regex.compile(r"〒\s?\d{3}-?\d{4}(?:\s*[\p{Han}\p{Katakana}ヶー]+(?:[都道府県市区町村郡][\p{Han}\p{Katakana}\p{Hiragana}ヶー]*?)*\d+[\d丁目番地号のー−-]*)?"),
    regex.compile(r"[\p{Han}ヶ]{2,8}(?:[都道府県]\s?[\p{Han}ヶ]{1,8})?[市区町村郡]\s?[\p{Han}\p{Katakana}ヶ]{1,10}?\s?\d+(?:丁目|番地|番|号|[-−]\d+)[\d丁目番地号の−-]*(?:\s*[\p{Katakana}ー][\p{Katakana}\p{Han}ー]*\s*\d+号?)?"),
    regex.compile(r"[\p{Han}]{1,8}(?:省|市|区|县|镇|州)[\p{Han}]{1,12}?(?:路|街|道|巷|弄|大街|胡同)\d+(?:号|弄)(?:\d+(?:号|室|楼|单元|栋)){0,3}"),
    regex.compile(r"(?:[가-힣]+(?:도|시|군|구)\s+){1,3}[가-힣\d]+(?:로|길|대로)\s?\d+(?:번길)?(?:\s?\d+)?(?:,?\s*\d+(?:호|동|층))*"),
]

_LETTERS = regex.compile(r"\p{L}")
_SOUND = regex.compile("|".join(map(regex.escape, SOUNDS)), regex.I)


def _near(pattern: regex.Pattern[str], text: str, a: int, b: int, before: int, after: int) -> bool:
    return pattern.search(text[max(0, a - before) : a]) is not None or bool(after) and pattern.search(text[b : b + after]) is not None


def _plausible(label: str) -> bool:
    """Whether a label in the text can be somebody's name."""
    plain = label.strip().casefold()
    return plain not in NOBODY and plain not in names.NOT_NAMES and bool(_LETTERS.search(plain)) and not _SOUND.match(plain) and label_number(label) is None


# Cheap tests that decide which of the patterns above can match at all.
_NUMBER_TOKENS = frozenset(w for v in _NUMBER_WORDS.values() for w in v.split("|"))
_STREET_TOKENS = frozenset("street st lane ln road rd avenue ave crescent cres drive dr court ct close way square sq place pl terrace boulevard blvd row hill gardens mews parade walk grove highway hwy circle".split())
_LAND_TOKENS = frozenset("rue avenue boulevard square chemin place allée impasse quai route cours passage faubourg calle plaza avenida avda paseo camino carretera ronda travesía callejón c/".split())
_LAND_PARTS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ufer", "ring", "damm", "chaussee", "steig")
_LETTERS_ASCII = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LABEL_SIGNS = frozenset(":：>[［【<")
_DIGITS = frozenset("0123456789")
_DIGIT = re.compile("[0-9]")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
# Made of the same words as _EMAIL, so that none of its spellings is passed over.
_AT_HINT = re.compile(rf"@|\b(?:{_AT_SPACED})\b|{_AT_GLUED}", re.I)
_DOT_HINT = re.compile(rf"\.[a-z0-9-]|[\[(（]\s*(?:dot|\.)|\s(?:{_DOT_SPACED})\s|{_DOT_GLUED}", re.I)


def propose(text: str, chars: set[str]) -> list[Span]:
    """All scored proposals but names in a canonical text; chars are its characters."""
    out: list[Span] = []
    ascii_only = text.isascii()
    latin = len(chars & _LETTERS_ASCII) > 2
    low = text.lower() if latin else ""
    if _AT_HINT.search(text) and _DOT_HINT.search(text):
        for m in _EMAIL.finditer(text):
            tail = regex.split(_DOT, m[0], flags=regex.I)[-1]
            score = (0.6 if "@" not in m[0] else 0.9) - 0.5 * (not tail.isalpha())
            wordy = _WORDY_EMAIL.fullmatch(m[0])
            if wordy and not (tail.lower() in _HOST_ENDS or _EMAIL_LOCAL.search(wordy["local"]) or _near(_EMAIL_CONTEXT, text, *m.span(), 24, 0)):
                score -= 0.3
            out.append(Span(m.start(), m.end(), "EMAIL", score))
    if not chars.isdisjoint(_DIGITS):
        n_digits = len(_DIGIT.findall(text))
        _addresses(text, low, frozenset(_LETTER_RUN.findall(low)), n_digits, ascii_only, out)
        if n_digits >= 5:
            _numbers(text, n_digits, out)
    if latin:  # signs beside the first and the last word do not part here, so the pattern may match two words more
        tokens = low.replace(",", " ").replace(".", " ").replace("-", " ").split()
        if not _NUMBER_TOKENS.isdisjoint(tokens) and sum(t in _NUMBER_TOKENS for t in tokens) >= 5:
            _spoken(_WORDED, text, out)
    if not ascii_only:
        if _ZERO_KANA.search(text):
            _spoken(_KANA_DIGITS, text, out)
        if not chars.isdisjoint(_HAN_DIGIT_SET):
            _spoken(_HAN_DIGITS, text, out)
        if len(chars & _HANGUL_DIGIT_SET) >= 2:
            _spoken(_HANGUL_DIGITS, text, out)
    return out


_HAN_DIGIT_SET = frozenset("零〇一二三四五六七八九幺两")
_HANGUL_DIGIT_SET = frozenset("공영일이삼사오육칠팔구")


def _spoken(pattern: regex.Pattern[str], text: str, out: list[Span]) -> None:
    for m in pattern.finditer(text):
        out.append(Span(*m.span(), "PHONE", 0.6 - 0.9 * _near(_NOT_A_PHONE, text, *m.span(), 26, 0)))


def _addresses(text: str, low: str, words: frozenset[str], n_digits: int, ascii_only: bool, out: list[Span]) -> None:
    wanted: list[regex.Pattern[str]] = []
    if not words.isdisjoint(_STREET_TOKENS):
        wanted.append(_ADDRESSES[0])
    if low:
        if any(p in low for p in _LAND_PARTS):
            wanted.append(_ADDRESSES[1])
        if n_digits >= 6:
            wanted.append(_ADDRESSES[2])
        if not words.isdisjoint(_LAND_TOKENS) or "c/" in low:
            wanted += _ADDRESSES[3:5]
    if not ascii_only:
        if "〒" in text:
            wanted.append(_ADDRESSES[5])
        if "市" in text or "町" in text or "区" in text or "村" in text or "郡" in text:
            wanted.append(_ADDRESSES[6])
        if "路" in text or "街" in text or "道" in text or "巷" in text or "弄" in text or "胡同" in text:
            wanted.append(_ADDRESSES[7])
        if "로" in text or "길" in text:
            wanted.append(_ADDRESSES[8])
    for pattern in wanted:
        for m in pattern.finditer(text):
            out.append(Span(*m.span(), "ADDRESS", 0.8))


def _numbers(text: str, n_digits: int, out: list[Span]) -> None:
    for m in _ID_NAMED.finditer(text):
        if sum(c.isdigit() for c in m["v"]) >= 5:
            out.append(Span(m.start("v"), m.end("v"), "ID_NUMBER", 0.9))
    if n_digits < 7:
        return
    for pattern, base, check in _ID_SHAPES:
        for m in pattern.finditer(text):
            score = base + 0.4 * bool(check and check(_bare(m[0]))) + 0.4 * _near(_ID_CONTEXT, text, *m.span(), 24, 12) - 0.6 * _near(_NOT_A_PHONE, text, *m.span(), 26, 0)
            if base <= 0.1 and _near(_PHONE_CONTEXT, text, *m.span(), 14, 14):
                score -= 0.3
            out.append(Span(*m.span(), "ID_NUMBER", score))
    clocks: list[tuple[int, int]] | None = None
    for m in _PHONE.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n < 7 or n > 15:
            continue
        if clocks is None:
            clocks = [c.span() for c in CLOCK_RE.finditer(text)]
        if any(a < m.end() and m.start() < b for a, b in clocks):
            continue
        score = 0.55 if n >= 9 else 0.1
        score += 0.3 * m[0].startswith(("+", "(")) + 0.4 * _near(_PHONE_CONTEXT, text, *m.span(), 22, 18) - 0.9 * _near(_NOT_A_PHONE, text, *m.span(), 26, 0)
        if _DATE.fullmatch(m[0]):
            score -= 0.8  # a date
        if n < 9 and not _PARTED.search(m[0]):
            score -= 0.3
        out.append(Span(*m.span(), "PHONE", score))


class Label(NamedTuple):
    """A label at the head of a text: where it stands, where the text goes on, and whether its form alone makes it one."""

    start: int
    end: int
    body: int
    sure: bool


def head_label(text: str) -> Label | None:
    """The label of a canonical text that can be a name."""
    label, rest, sure = labelled(text)
    if not label or not _plausible(label):
        return None
    at = text.find(label)
    return Label(at, at + len(label), max(at, text.rfind(rest)) if rest else len(text), sure) if at >= 0 else None


def weighed(text: str, named: bool, label: Label | None, known: frozenset[str] = frozenset()) -> tuple[list[Span], list[str]]:
    """The spans of a canonical text, in order, none overlapping, and the words that would change them if they were known names.

    named says whether the label names somebody.
    """
    chars = set(text)
    scored = [s for s in propose(text, chars) if s.score >= THRESHOLD]
    if label and named:
        scored.append(Span(label.start, label.end, "NAME", 0.8))
    doubtful: list[names.Found] = []
    for f in names.propose(text, chars, label.body if label and named else 0, known):
        if f.score >= THRESHOLD:
            scored.append(Span(f.start, f.end, "NAME", f.score))
        elif f.lifted >= THRESHOLD:
            doubtful.append(f)
    if not scored and not doubtful:
        return scored, doubtful
    kept: list[Span] = []
    for s in sorted(scored, key=lambda s: (KINDS.index(s.kind), s.start - s.end, s.start)):
        if all(s.end <= k.start or k.end <= s.start for k in kept):
            kept.append(s)
    if not doubtful:
        return sorted(kept), doubtful
    # Other kinds keep their text from names, whichever are known.
    asks = dict.fromkeys(w for f in doubtful if all(f.end <= k.start or k.end <= f.start for k in kept if k.kind != "NAME") for w in f.asks)
    return sorted(kept), list(asks)


def spans_of(text: str, named: bool, label: Label | None, known: frozenset[str] = frozenset()) -> list[Span]:
    """The spans of a canonical text, in order, none overlapping; named says whether the label names somebody."""
    return weighed(text, named, label, known)[0]


def find(text: str | None, participants: frozenset[str] | None = None, known: frozenset[str] = frozenset()) -> tuple[str | None, list[Span]]:
    """The canonical text and its spans of personal information, in order, none overlapping.

    A bare label ("Linderly: ...") counts as a name if it is among the name keys of the
    participants, or if these are not known (None) and all its words begin with a capital or are in
    another script; labels whose form leaves no doubt count always.
    """
    if not text or text.isspace():
        return text, []
    plain = canonicalize(text)
    label = head_label(plain) if not _LABEL_SIGNS.isdisjoint(plain) else None
    named = label is not None and (label.sure or (name_key(plain[label.start : label.end]) in participants if participants is not None else all(w[0].isupper() or w[0] > "\u2e7f" for w in plain[label.start : label.end].split())))
    return plain, spans_of(plain, named, label, known)


def filled(plain: str, spans: list[Span]) -> str:
    """The text with every span replaced by its typed placeholder."""
    out, at = [], 0
    for s in spans:
        out += [plain[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, plain[at:]])


def redact(text: str | None, participants: frozenset[str] | None = None, known: frozenset[str] = frozenset()) -> str | None:
    """The canonical text with every span replaced by its typed placeholder."""
    plain, spans = find(text, participants, known)
    return filled(plain, spans) if spans else plain


class Ways(NamedTuple):
    """A text's canonical form, the key of its bare label, and spans and asks (as ``weighed`` has them) if that label names nobody, and if it names somebody."""

    canonical: str | None
    bare: str | None
    plain: list[Span]
    asks: list[str]
    named: list[Span] | None
    named_asks: list[str]


def both_ways(text: str | None, known: frozenset[str] = frozenset()) -> Ways:
    if not text or text.isspace():
        return Ways(text, None, [], [], None, [])
    plain = canonicalize(text)
    label = head_label(plain) if not _LABEL_SIGNS.isdisjoint(plain) else None
    if label is None or label.sure:
        return Ways(plain, None, *weighed(plain, label is not None, label, known), None, [])
    return Ways(plain, name_key(plain[label.start : label.end]), *weighed(plain, False, label, known), *weighed(plain, True, label, known))


REMEMBERED = 65_536  # texts a task need not look at again, as short replies and repeated deliveries are the same
_NAME_BIT = 1 << KINDS.index("NAME")
# Kinds as bits in order of KINDS; named is -1 where no label is in doubt. The words asked for are parted by spaces, null where there are none.
_KINDS_TYPE = T.StructType([T.StructField(c, T.IntegerType() if c in ("kinds", "named") else T.StringType()) for c in ("bare", "kinds", "named", "asks", "named_asks")])
_TEXT_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in ("bare", "plain", "named", "asks")])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(display_names: pd.Series) -> pd.Series:
    return pd.Series([sorted(names.parts_of(canonicalize(n))) for n in display_names], dtype=object)


def known_names(speaker_map: DataFrame) -> DataFrame:
    """word: every display name of all jobs and its parts, each once."""
    once = speaker_map.where(F.col("display_name").isNotNull()).select("display_name").distinct()
    return once.select(F.explode(_parts("display_name")).alias("word")).distinct()


def _answered(rows: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """tab, job_id, rec_key and each of the words in asks that is a known name; rows meet the names by word and a salt of their key."""
    asked = rows.where(F.col("asks").isNotNull()).select("tab", "job_id", "rec_key", F.explode(F.split("asks", " ")).alias("word"))
    met = with_group_values(asked, known_names(speaker_map).withColumn("_known", F.lit(True)), "word", F.pmod(F.xxhash64("rec_key"), F.lit(64)))
    return met.where("_known").drop("_known")


def _bits(spans: list[Span]) -> int:
    out = 0
    for s in spans:
        out |= 1 << KINDS.index(s.kind)
    return out


def _asked(asks: list[str], bits: int) -> str | None:
    """What to ask for where only the kinds count."""
    return " ".join(asks) if asks and not bits & _NAME_BIT else None


def _table(rows: list[tuple], kind: T.StructType) -> pa.StructArray:
    fields = list(to_arrow_schema(kind))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)


def _by_text(row_of: Callable[[str | None], tuple], kind: T.StructType):
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return _table([row_of(text) for text in texts.to_pylist()], kind)

    return run.asNondeterministic()


def _remembered(row_of: Callable[[str | None], tuple]) -> Callable[[str | None], tuple]:
    seen: dict[str | None, tuple] = {}

    def run(text: str | None) -> tuple:
        row = seen.get(text)
        if row is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            row = seen[text] = row_of(text)
        return row

    return run


def _kinds_row(text: str | None) -> tuple:
    w = both_ways(text)
    kinds, labelled = _bits(w.plain), -1 if w.named is None else _bits(w.named)
    return w.bare, kinds, labelled, _asked(w.asks, kinds), _asked(w.named_asks, labelled)


def _text_row(text: str | None, known: frozenset[str] = frozenset()) -> tuple:
    w = both_ways(text, known)
    return w.bare, filled(w.canonical, w.plain) if w.plain else w.canonical, None if w.named is None else filled(w.canonical, w.named), " ".join(dict.fromkeys(w.asks + w.named_asks)) or None


def _texts_knowing():
    """A function of a text and the words in it that are known names."""

    @F.arrow_udf(_TEXT_TYPE)
    def run(texts: pa.Array, known: pa.Array) -> pa.Array:
        return _table([_text_row(text, frozenset(words or ())) for text, words in zip(texts.to_pylist(), known.to_pylist(), strict=True)], _TEXT_TYPE)

    return run.asNondeterministic()


def records(cues: DataFrame, id_index: DataFrame) -> DataFrame:
    """tab, job_id, rec_key and text of all records of both tables."""
    a = cues.select(F.lit("cues").alias("tab"), "job_id", F.concat_ws(":", "source", "cue_index").alias("rec_key"), "text")
    b = id_index.select(F.lit("id_index").alias("tab"), "job_id", F.col("uid").alias("rec_key"), F.col("raw_text").alias("text"))
    return a.unionByName(b)


def _label_known(rows: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """Adds _known: whether the job knows the label ``bare``; rows meet the names by job, name and a salt of their key."""
    return with_group_values(rows, aliases(speaker_map).select("job_id", F.col("name").alias("bare"), F.lit(True).alias("_known")), ["job_id", "bare"], F.pmod(F.xxhash64("rec_key"), F.lit(64)))


def holding(rows: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """tab, job_id, rec_key and kind: each record and kind of personal information once.

    Bare labels at the head of a text count as names where the job's speaker map knows them,
    and words that alone are too little do where any job's does; only the records for which
    that matters are looked up.
    """
    judged = rows.select("tab", "job_id", "rec_key", _by_text(_remembered(_kinds_row), _KINDS_TYPE)("text").alias("j")).select("tab", "job_id", "rec_key", "j.*")
    # Most records hold nothing and leave here.
    judged = written(judged.where((F.col("kinds") > 0) | (F.col("named") > 0) | F.col("asks").isNotNull() | F.col("named_asks").isNotNull()))
    matters = (F.col("named") >= 0) & ((F.col("named") != F.col("kinds")) | ~F.col("asks").eqNullSafe(F.col("named_asks")))
    looked_up = _label_known(judged.where(matters), speaker_map)
    cols = ["tab", "job_id", "rec_key", "kinds", "asks"]
    settled = written(looked_up.select("tab", "job_id", "rec_key", *(F.when(F.col("_known"), F.col(n)).otherwise(F.col(p)).alias(p) for p, n in (("kinds", "named"), ("asks", "named_asks")))))
    all_rows = judged.where(~matters).select(*cols).unionByName(settled)
    kinds = all_rows.select("tab", "job_id", "rec_key", F.explode(F.array_compact(F.array(*(F.when(F.col("kinds").bitwiseAND(1 << i) > 0, k) for i, k in enumerate(KINDS))))).alias("kind"))
    lifted = _answered(all_rows, speaker_map).select("tab", "job_id", "rec_key", F.lit("NAME").alias("kind"))
    return kinds.unionByName(lifted).dropDuplicates()


def redacted(rows: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """Each record once, its text with typed placeholders; rows are tab, job_id, rec_key and text."""
    key = ["tab", "job_id", "rec_key"]
    once = rows.dropDuplicates(key)
    judged = once.select(*key, "text", _by_text(_remembered(_text_row), _TEXT_TYPE)("text").alias("t")).select(*key, F.when(F.col("t.asks").isNotNull(), F.col("text")).alias("text"), "t.*")
    judged = written(judged)
    # The few texts with words to ask for are looked at again with those that are known names.
    asked = judged.where(F.col("asks").isNotNull()).select(*key, "text")
    known = _answered(judged, speaker_map).groupBy(*key).agg(F.collect_set("word").alias("_words")).select(*(F.col(c).alias(f"_{c}") for c in key), "_words")
    met = asked.join(known.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left")
    again = written(met.select(*key, _texts_knowing()("text", "_words").alias("t")).select(*key, "t.*"))
    cols = [*key, "bare", "plain", "named"]
    made = judged.where(F.col("asks").isNull()).select(*cols).unionByName(again.select(*cols))
    looked_up = _label_known(made.where(F.col("bare").isNotNull()), speaker_map).withColumn("text", F.when(F.col("_known"), F.col("named")).otherwise(F.col("plain")))
    sure = made.where(F.col("bare").isNull()).withColumn("text", F.col("plain"))
    return sure.select(*key, "text").unionByName(looked_up.select(*key, "text"))
