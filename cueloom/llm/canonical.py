"""Visually identical text with different characters: one consistent form.

A transducer over grapheme clusters rewrites widths, detached marks, invisible
characters, unusual spaces, ligatures, radicals and look-alike letters in one pass.
Its table maps sequences of characters, some of them only in a context (a Latin word, a
katakana or a Han neighbour). It is computed once per process from Unicode's own
decompositions plus the fixed look-alike lists below, checked for conflicts, and compiled into
a trie: of the sequences that begin at a place the longest counts. Single characters come
first, then what they are composed with, so the entries need not name each pairing of both.

Defined results: null stays null; empty text stays empty; text without a suspicious
character is returned as the same object; punctuation and signs in full-width or
typographic form, circled numbers, ordinals, Greek or Cyrillic words used as such and
joiners inside an emoji stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters and the Latin letters they look like.
LATIN_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "ρ": "p", "α": "a", "τ": "t", "χ": "x", "ϲ": "c", "ϳ": "j", "ε": "e", "η": "n", "ω": "w",
}
# Han characters and the katakana they look like.
KATAKANA_LOOKALIKES = {"一": "ー", "力": "カ", "夕": "タ", "八": "ハ", "二": "ニ", "口": "ロ", "工": "エ", "卜": "ト", "千": "チ", "才": "オ", "三": "ミ", "丿": "ノ"}
# Radicals without a decomposition of their own and the characters they look like.
RADICAL_LOOKALIKES = {"⺠": "民", "⻁": "虎", "⻄": "西", "⻑": "長", "⻓": "长", "⻘": "青", "⻝": "食", "⻤": "鬼", "⻨": "麦", "⻩": "黄", "⻭": "歯", "⻯": "竜", "⻲": "亀", "⻆": "角", "⻅": "见", "⻉": "贝", "⻋": "车", "⻔": "门", "⻚": "页", "⻛": "风", "⻜": "飞", "⻢": "马", "⻥": "鱼", "⻦": "鸟"}
_NUMERAL_LIKE = "一八二千三"  # Han that also stand as numbers before katakana words

_INVISIBLE = "".join(
    chr(c) for c in [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), 0x115F, 0x1160, 0x3164, 0xFFA0]
)
_SPACES = "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")
_KANA = "ァ-ヺー・ヽヾ"


# The contexts in which an entry holds; ANY always.
ANY, LATIN, KATAKANA, HAN = "any", "latin", "katakana", "han"
HAN_LOOKALIKES = {"ー": "一", "ニ": "二", "ハ": "八"}  # fixed values: katakana and the Han they look like
_LETTER_RANGES = [(0xC0, 0x250), (0x2100, 0x2150), (0x2160, 0x2190), (0x2E80, 0x2FE0), (0xF900, 0xFB50), (0xFF10, 0xFFE0), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)]


def _letters_only(s: str) -> bool:
    return bool(s) and all(unicodedata.category(c)[0] in "LNM" for c in s)


class Table:
    """Sequences and what they become, by context; two targets for one source are an error."""

    def __init__(self) -> None:
        self.entries: dict[str, dict[str, str]] = {ANY: {}, LATIN: {}, KATAKANA: {}, HAN: {}}

    def put(self, source: str, target: str, context: str = ANY) -> None:
        if source != target and self.entries[context].setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r} ({context}): {self.entries[context][source]!r} and {target!r}")

    def check(self) -> None:
        """One application must be enough, and a longer source must agree with a shorter one that it begins with."""
        always = self.entries[ANY]
        for context, entries in self.entries.items():
            for source, target in entries.items():
                if any(c in always for c in target):
                    raise ValueError(f"{source!r} ({context}) becomes text that is itself changed: {target!r}")
                for i in range(1, len(source)):
                    short = always.get(source[:i])
                    if short is not None and unicodedata.normalize("NFC", short + source[i:]) != target and always.get(short + source[i:]) != target:
                        raise ValueError(f"{source!r} becomes {target!r}, but its beginning {source[:i]!r} becomes {short!r}")
        # A look-alike may not be changed for one reason in one context and for another everywhere.
        for context in (LATIN, KATAKANA, HAN):
            for source in self.entries[context]:
                if source in always:
                    raise ValueError(f"{source!r} has an entry for {context} and one that always holds")


def _put_singles(table: Table) -> None:
    """A letter or digit whose compatibility decomposition is <wide>, <narrow>, <font> or a ligature's <compat>, a
    radical, or a canonical singleton; invisible characters and spaces. Circled, squared, superscript and ordinal forms are left out."""
    for lo, hi in _LETTER_RANGES:
        for code in range(lo, hi):
            ch = chr(code)
            how = unicodedata.decomposition(ch)
            if not how or ch in _INVISIBLE:
                continue
            kind = how.split()[0] if how[0] == "<" else "<canonical>"
            plain = unicodedata.normalize("NFKC", ch)
            if plain == ch or not _letters_only(plain):
                continue
            ligature = kind == "<compat>" and (0xFB00 <= code < 0xFB18 or code < 0x250 and len(plain) > 1)
            if kind in ("<wide>", "<narrow>", "<font>", "<canonical>") or ligature or 0x2E80 <= code < 0x2FE0:
                table.put(ch, plain)
    for ch, plain in RADICAL_LOOKALIKES.items():
        table.put(ch, plain)
    for ch in _INVISIBLE:
        table.put(ch, "")
    for ch in _SPACES:
        table.put(ch, " ")


def _put_compositions(table: Table) -> None:
    """What a letter and its marks are composed to: every order of the marks and every step that is composed already; Hangul by its arithmetic."""
    for code in (*range(0xC0, 0x3400), *range(0x1100, 0x1200), *range(0x11000, 0x12000)):
        ch = chr(code)
        how = unicodedata.decomposition(ch)
        if not how or how[0] == "<" or " " not in how or unicodedata.normalize("NFC", ch) != ch:
            continue
        first, second = (chr(int(x, 16)) for x in how.split())
        table.put(first + second, ch)
        base, *marks = unicodedata.normalize("NFD", ch)
        for order in permutations(marks):
            whole = base + "".join(order)
            if unicodedata.normalize("NFC", whole) == ch:
                table.put(whole, ch)
        if second in "\u3099\u309a":  # the marks of kana also stand as characters of their own
            table.put(first + ("゛" if second == "\u3099" else "゜"), ch)
    for i in range(11172):
        whole, syllable = chr(0xAC00 + i), chr(0xAC00 + i - i % 28)
        lead, vowel, tail = chr(0x1100 + i // 588), chr(0x1161 + i % 588 // 28), chr(0x11A7 + i % 28) if i % 28 else ""
        table.put(lead + vowel + tail, whole)
        table.put(syllable + tail, whole)


@lru_cache(maxsize=1)
def table() -> Table:
    """The whole mapping, checked."""
    out = Table()
    _put_singles(out)
    _put_compositions(out)
    for context, pairs in ((LATIN, LATIN_LOOKALIKES), (KATAKANA, KATAKANA_LOOKALIKES), (HAN, HAN_LOOKALIKES)):
        for source, target in pairs.items():
            out.put(source, target, context)
    out.check()
    return out


def compiled(entries: dict[str, str]) -> dict:
    """A trie: nodes are dicts by character, the target of the sequence that ends at a node stands under the empty string."""
    root: dict = {}
    for source, target in entries.items():
        node = root
        for ch in source:
            node = node.setdefault(ch, {})
        node[""] = target
    return root


def transduce(text: str, trie: dict) -> str:
    """The text with the longest sequence that begins at each place replaced."""
    out, i, n = [], 0, len(text)
    while i < n:
        node, j, best, upto = trie, i, text[i], i + 1
        while j < n and (node := node.get(text[j])) is not None:
            j += 1
            if "" in node:
                best, upto = node[""], j
        out.append(best)
        i = upto
    return "".join(out)


def _as_ranges(codes: list[int]) -> str:
    """A character class of sorted code points, neighbours as ranges."""
    out, start = [], 0
    for i, c in enumerate(codes):
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{codes[start]:08X}-\\U{c:08X}")
            start = i + 1
    return "".join(out)


class Machine(NamedTuple):
    singles: dict[int, str]
    latin: dict[int, str]  # singles and look-alikes of Latin letters
    compose: dict  # trie of the sequences
    always: frozenset[str]  # characters that are suspicious wherever they stand
    beside: frozenset[str]  # those that are so beside certain neighbours only
    suspect: re.Pattern[str]  # such neighbours
    cluster: regex.Pattern[str]


@lru_cache(maxsize=1)
def _machine() -> Machine:
    t = table()
    singles = {s: d for s, d in t.entries[ANY].items() if len(s) == 1}
    sequences = {s: d for s, d in t.entries[ANY].items() if len(s) > 1}
    marks = {chr(c) for c in range(0x300, 0x370)} | {chr(c) for lo, hi in ((0x1100, 0x1200), (0xA960, 0xA97D), (0xD7B0, 0xD800)) for c in range(lo, hi)} | set("゙゚゛゜⃣")
    han = "".join(t.entries[KATAKANA])
    suspect = re.compile(rf"(?<=[{_KANA}])[{han}]|[{han}](?=[{_KANA}])|ー(?=[一-鿿])|(?<![{_KANA}])[ニハ](?=[人回枚番度つ目])")
    inv = regex.escape(_INVISIBLE)
    cluster = regex.compile(
        rf"(?P<emoji>\p{{Extended_Pictographic}}(?:[︎️]|\p{{EMod}})*(?:‍\p{{Extended_Pictographic}}(?:[︎️]|\p{{EMod}})*)*)"
        rf"|(?P<joiner>(?<=[\p{{Devanagari}}\p{{Arabic}}\p{{Bengali}}\p{{Tamil}}\p{{Malayalam}}])[‌‍](?=[\p{{Devanagari}}\p{{Arabic}}\p{{Bengali}}\p{{Tamil}}\p{{Malayalam}}]))"
        # Letters of these scripts are judged by the word they stand in.
        rf"|(?P<word>[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}](?:[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}̀-ͯ{inv}])*)"
        rf"|(?P<jamo>[가-힣]?[ᄀ-ᇿ][ᄀ-ᇿ{inv}]*)"
        rf"|(?P<like>[{han}{''.join(t.entries[HAN])}])[゙゚゛゜ﾞﾟ{inv}]*"
        rf"|(?P<kana>[\p{{Hiragana}}\p{{Katakana}}ｦ-ﾟ][゙゚゛゜ﾞﾟ{inv}]+)"
        # Any other cluster with marks, or a single character of the table; the rest is passed over.
        rf"|(?P<other>\P{{M}}[\p{{M}}‌‍]*\p{{M}}[\p{{M}}‌‍]*|[{_as_ranges(sorted(map(ord, singles)))}])",
    )
    codes = {ord(s): d for s, d in singles.items()}
    always = frozenset(singles) | frozenset(t.entries[LATIN]) | marks
    return Machine(codes, codes | {ord(s): d for s, d in t.entries[LATIN].items()}, compiled(sequences), always, frozenset(han) | frozenset(t.entries[HAN]), suspect, cluster)


def _put_together(plain: str, machine: Machine) -> str:
    """Marks joined to their letters: by the table, and what it lacks (marks that no letter has, their order) by Unicode's rule."""
    if plain.isascii():
        return plain
    made = transduce(plain, machine.compose)
    return made if unicodedata.is_normalized("NFC", made) else unicodedata.normalize("NFC", made)


def _reads_latin(word: str, latin_line: bool) -> bool:
    """Whether letters that look Latin stand for Latin ones in this word: beside Latin letters, or alone in a Latin line, but
    not beside Greek or Cyrillic ones that look like none."""
    apart = unicodedata.normalize("NFD", word)
    if not any(c in LATIN_LOOKALIKES for c in apart):
        return False
    others = [c for c in apart if c not in LATIN_LOOKALIKES and unicodedata.category(c)[0] == "L"]
    if any(ord(c) >= 0x370 and not 0x1E00 <= ord(c) < 0x1F00 for c in others):
        return False
    return bool(others) or latin_line


def _word(word: str, latin_line: bool, machine: Machine) -> str:
    if word.isascii():
        return word
    plain = word.translate(machine.singles)
    if _reads_latin(plain, latin_line):
        plain = unicodedata.normalize("NFD", plain).translate(machine.latin)
    return _put_together(plain, machine)


def _like(text: str, at: int) -> str:
    """A Han character inside a katakana word, or a katakana inside a Han word."""
    ch, after, back = text[at], text[at + 1 : at + 2], at - 1
    while back >= 0 and (text[back] in "゙゚ﾞﾟ" or text[back] in _INVISIBLE):
        back -= 1
    before = text[back] if back >= 0 else ""
    if after and after in _INVISIBLE:
        after = text[at + 1 :].lstrip(_INVISIBLE)[:1]

    def kana(c: str) -> bool:
        return bool(c) and ("ァ" <= c <= "ヺ" or c == "ー" or "ｦ" <= c <= "ﾟ" or c in KATAKANA_LOOKALIKES and c not in "千三口")

    def han(c: str) -> bool:
        return "一" <= c <= "鿿"

    pure = lambda c: bool(c) and ("ァ" <= c <= "ヺ" or c == "ー" or "ｦ" <= c <= "ﾟ")
    if ch in KATAKANA_LOOKALIKES:
        inside = kana(before) and kana(after) and (pure(before) or pure(after))
        edge = ch not in _NUMERAL_LIKE and (pure(before) and not han(after) or pure(after) and not han(before))
        tail = ch == "一" and pure(before) and (not after or after in "はがをのにでとも、。,.")
        return KATAKANA_LOOKALIKES[ch] if inside or edge or tail else ch
    if ch == "ー" and not pure(before) and not "ぁ" <= before <= "ん" and han(after):
        return "一"
    if ch in "ニハ" and not pure(before) and after and after in "人回枚番度つ目":
        return {"ニ": "二", "ハ": "八"}[ch]
    return ch


_LATIN_LETTER = re.compile("[A-Za-z]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def canonicalize(text: str | None) -> str | None:
    """The text in its one consistent form; see the module's docstring."""
    if not text or text.isascii():
        return text
    machine = _machine()
    chars = set(text)
    # Marks of any kind may stand apart from their letters, so a text passes only in composed form.
    if chars.isdisjoint(machine.always) and (chars.isdisjoint(machine.beside) or not machine.suspect.search(text)) and unicodedata.is_normalized("NFC", text):
        return text
    latin_line = len(_LATIN_LETTER.findall(text)) > 2 and not _CJK.search(text)

    def rewrite(m: regex.Match) -> str:
        kind, got = m.lastgroup, m[0]
        if kind == "word":
            return _word(got, latin_line, machine)
        if kind == "like":
            got = _like(text, m.start()) + got[1:]
            return got if len(got) == 1 else _put_together(got.translate(machine.singles), machine)
        if kind in ("emoji", "joiner"):
            return got
        if kind == "other" and len(got) > 1 and any(0x600 <= ord(c) < 0xE00 for c in got):  # joiners shape the letters of these scripts
            return _put_together("".join([c if c in "\u200c\u200d" else machine.singles.get(ord(c), c) for c in got]), machine)
        return _put_together(got.translate(machine.singles), machine)

    return machine.cluster.sub(rewrite, text)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonicalize, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """Column form of canonicalize()."""
    return _canonical(text)


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """Adds the canonical form of a text column; a clashing column of that name is replaced."""
    return df.withColumn(out, canonical_text(F.col(text)))


def disguised(cues: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Keys whose text differs from its canonical form, each once.

    Repeated deliveries of a key carry the same text and count once; null and empty
    texts are never disguised. The JVM drops plain-ASCII texts before Python sees them.
    """
    odd = cues.select(*key, F.col(text).alias("_t")).where(F.col("_t").rlike("[^\\x00-\\x7f]"))
    return odd.where(canonical_text(F.col("_t")) != F.col("_t")).select(*key).dropDuplicates(key)
