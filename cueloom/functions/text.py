"""Text normalisation and similarity kernels for matching two recordings."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hesitations taken out one after the other, in this order.
FILLERS = ["えー", "えーと", "あー", "あの", "あのー", "まあ", "まー", "うーん", "ええと", "えっと", "そのー", "なんか", "こう", "ほら"]
# Fixed value: the signs taken out, as a character class.
PUNCTUATION = "[。、．，.!！?？…～〜・\\-–—\"'「」『』（）()【】\\[\\]{}]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no such function."""
    return text.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s), na_action="ignore")


def _reader():
    """The reading converter of this process, or None where its library is missing."""
    if "kks" not in _READER:
        try:
            import pykakasi

            _READER["kks"] = pykakasi.kakasi()
        except ImportError:
            _READER["kks"] = None
    return _READER["kks"]


_READER: dict = {}


@F.pandas_udf(T.StringType())
def to_reading(text: pd.Series) -> pd.Series:
    """Hiragana reading where a converter is installed, else the text itself."""
    kks = _reader()
    if kks is None:
        return text

    def one(s: str) -> str:
        try:
            return "".join(item["hira"] for item in kks.convert(s))
        except Exception:  # the converter fails on some input; matching then uses the text
            return s

    return text.map(one, na_action="ignore")


def strip_wide(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_plain(text: Column) -> Column:
    """All steps that need no Unicode tables: case, signs, fillers, white space."""
    low = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    bare = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), FILLERS, low)
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def normalize_for_matching(text: Column, use_reading: bool = False) -> Column:
    """The form in which texts of two recordings are compared."""
    out = normalize_plain(nfkc(text))
    return to_reading(out) if use_reading else out


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of n-grams of code points; a shorter non-empty text is its own n-gram."""
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(text.isNull(), None).when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def digit_runs(text: Column) -> Column:
    """The set of maximal runs of digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\d+)"), F.lit(1)))


def digit_overlap(a: Column, b: Column) -> Column:
    """Jaccard over digit runs; 0.5 where neither text has digits."""
    x, y = digit_runs(a), digit_runs(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(0.5)).otherwise(jaccard(x, y))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio as the standard library has it; not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=float)


# Weights of n-grams, sequence and digits.
WEIGHTS = (0.5, 0.3, 0.2)


def similarity(a: Column, b: Column) -> Column:
    """The weighted similarity of two normalised texts; 0 if either is empty."""
    wj, wq, wk = WEIGHTS
    score = F.lit(wj) * jaccard(char_ngrams(a), char_ngrams(b)) + F.lit(wq) * sequence_ratio(a, b) + F.lit(wk) * digit_overlap(a, b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)
