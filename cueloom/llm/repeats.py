"""Repeated consecutive events: each run of like cues becomes one event."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import zip_longest

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.speech import key_of, name_key, said
from cueloom.llm.turns import known_labels
from cueloom.operators.runs import SLOT_MS, runs, slot_of
from cueloom.session import written


_KEYS = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "bare", "whole")])


def keys(text: str | None) -> tuple[str, str | None, str | None]:
    """What a text says in comparable form, empty for texts that say nothing; where it begins with a label whose
    form leaves open whether it is one, also the label's name key and what the text says with it."""
    what = said(text)
    if what.whole is None:
        return key_of(what.words), None, None
    return key_of(what.words), name_key(what.label), key_of(what.whole)


@F.pandas_udf(_KEYS)
def spoken_keys(texts: pd.Series) -> pd.DataFrame:
    """keys() of each text."""
    return pd.DataFrame([keys(t) for t in texts], columns=["key", "bare", "whole"])


# Evaluated once where a filter follows; the optimizer would else run it twice.
spoken_keys = spoken_keys.asNondeterministic()


def edits(a: str, b: str) -> int:
    """Edit distance with neighbouring letters swapped as one edit."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row[j] = cost
        two, one = one, row
    return one[-1]


# Characters that are numbers without being digits.
NUMERALS = frozenset("〇零一二三四五六七八九十百千万億两")


AGREEING = 7  # letters that must agree for three sounds that do not


def parts_apart(a: str, b: str) -> int:
    """How many sounds two letters differ in: 1 in an alphabet, 2 for kana, 3 for Han, and for Hangul as many of its letters as differ."""
    if "가" <= a <= "힣" and "가" <= b <= "힣":
        return sum(x != y for x, y in zip_longest(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)))
    letter = max(a, b)
    return 1 if letter < "\u2e80" else 2 if "ぁ" <= letter <= "ヿ" else 3


def other_number(a: str, b: str, at: int, x: str, y: str) -> bool:
    """Whether x in a and y in b, which begin at the same place, make different numbers in Han of the texts."""
    if x and y:
        return NUMERALS.issuperset(x + y)
    full, extra = (a, x) if x else (b, y)
    beside = {full[at - 1 : at] if at else "", full[at + len(extra) : at + len(extra) + 1]} - {"", *extra}
    return NUMERALS.issuperset(extra) and not NUMERALS.isdisjoint(beside)


def alike(a: str, b: str) -> bool:
    """Whether both keys can be one intended text with at most one letter misheard in each.

    Numbers must agree, written in digits or in Han. One edit between the keys is one misheard
    letter; two edits are one in each, if letters between them agree or one is a letter said
    twice, as two neighbouring edits are otherwise rather another word. At any length, two
    letters must agree for each one lost, doubled or swapped, and for one replaced more, the more
    sounds it carries: 3 letters of an alphabet, 5 kana, 7 Han or quite unlike Hangul. Where less is
    left in common nothing tells a misheard letter from another word.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or regex.findall(r"\d+", a) != regex.findall(r"\d+", b):
        return False
    short = min(len(a), len(b))
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    far = max(len(x), len(y))
    if far <= 2 and other_number(a, b, head, x, y):
        return False
    one, two = head + tail >= 2, head + tail >= 4
    if not x or not y:
        if far == 1:
            return one  # one letter lost or said twice
        # One letter lost here and one said twice there: the latter stands beside its like.
        full, at = (a, head) if x else (b, head)
        return far == 2 and two and (full[at] == full[at + 1] or full[at + 1 : at + 3] == full[at + 1] * 2 or at > 0 and full[at - 1] == full[at])
    if far == 1:  # one letter replaced
        return 3 * (head + tail) >= AGREEING * parts_apart(x, y)
    if len(x) == 2 and x == y[::-1]:
        return one  # two neighbours swapped
    return far >= 3 and short - 2 >= 4 and edits(x, y) <= 2


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and alike(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _differs(before: Callable[[str], Column], now: Callable[[str], Column]) -> Column:
    return before("key") != now("key")


def _close(before: Callable[[str], Column], now: Callable[[str], Column]) -> Column:
    """Whether two unequal keys can still be alike, by a bounded distance in the JVM."""
    a, b = before("key"), now("key")
    return (F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b, 4) >= 0)


def _same(before: Callable[[str], Column], now: Callable[[str], Column]) -> Column:
    return _alike(before("key"), now("key"))


def _cue_runs(cues: DataFrame, speaker_map: DataFrame, slot_ms: int, keep: list[str], least: int = 1) -> DataFrame:
    """Runs of at least so many cues over the comparable form of each."""
    slim = cues.where(F.col("start_sec").isNotNull()).select("job_id", "source", "cue_index", F.round(F.col("start_sec") * 1000).cast("long").alias("start_ms"), F.round(F.col("end_sec") * 1000).cast("long").alias("end_ms"), spoken_keys("text").alias("k"))
    slim = slim.select("job_id", "source", "cue_index", "start_ms", "end_ms", "k.*")
    says = written(slim.where((F.col("key") != "") | (F.col("whole") != "")))
    # Only cues with a doubtful label ask the speaker map.
    asked = known_labels(says.where(F.col("bare").isNotNull()), "bare", speaker_map, "_known").withColumn("key", F.when(F.col("_known").isNull(), F.col("whole")).otherwise(F.col("key")))
    cols = ["job_id", "source", "cue_index", "start_ms", "end_ms", "key"]
    all_rows = says.where(F.col("bare").isNull()).select(*cols).unionByName(asked.where(F.col("key") != "").select(*cols))
    slots = all_rows.withColumn("_slot", slot_of(F.col("start_ms"), slot_ms)).repartition("job_id", "source", "_slot")
    # Deliveries of one key carry the same content, so they are neighbours in the order that the runs need anyway.
    w = Window.partitionBy("job_id", "source", "_slot").orderBy("start_ms", "cue_index", "end_ms", "key")
    once = slots.withColumn("_before", F.lag("cue_index").over(w)).where(~F.col("_before").eqNullSafe(F.col("cue_index"))).drop("_before")
    return runs(once, ["job_id", "source"], "start_ms", ["cue_index", "end_ms", "key"], _differs, slot_ms, keep, least, _close, _same)


def cue_events(cues: DataFrame, speaker_map: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Each longest run of cues of a job and source that say the same thing, as one event.

    Columns: job_id, source, first_cue_index, last_cue_index, n, start_ms, duration_ms, said.
    A run of one is an event with n = 1. Repeated deliveries of a cue count once; cues
    without a start, and cues that say nothing, take no part; a null end counts as the start.
    Labels do not count as said where their form or the job's speaker map makes them labels.
    Extra columns of the input are ignored.
    """
    return _cue_runs(cues, speaker_map, slot_ms, ["cue_index", "end_ms", "key"]).select(
        "job_id", "source", F.col("first.cue_index").alias("first_cue_index"), F.col("last.cue_index").alias("last_cue_index"), "n",
        F.col("first.start_ms").alias("start_ms"), (F.greatest(F.coalesce("last.end_ms", "last.start_ms"), F.col("last.start_ms")) - F.col("first.start_ms")).alias("duration_ms"), F.col("first.key").alias("said"),
    )


def repeated(cues: DataFrame, speaker_map: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """The events of two cues or more: job_id, source, first_cue_index, last_cue_index."""
    found = _cue_runs(cues, speaker_map, slot_ms, ["cue_index"], 2)
    return found.select("job_id", "source", F.col("first.cue_index").alias("first_cue_index"), F.col("last.cue_index").alias("last_cue_index"))
