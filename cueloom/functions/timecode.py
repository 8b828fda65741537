"""Time codes as text and as seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timecode(ts: Column) -> Column:
    """Seconds of ``H:MM:SS.mmm`` or ``MM:SS.mmm``; a comma may stand for the point.

    Null for null, and for text of another form. Both dialects accept the short form.
    """
    plain = F.replace(F.trim(ts), F.lit(","), F.lit("."))
    parts = F.split(plain, ":")
    num = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    three = num(1) * 3600 + num(2) * 60 + num(3)
    two = num(1) * 60 + num(2)
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, two)


def format_timecode(seconds: Column, mark: str = ".") -> Column:
    """``HH:MM:SS`` and milliseconds cut off, not rounded; mark stands before them."""
    whole = F.floor(seconds).cast("long")
    ms = ((seconds % 1) * 1000).cast("int")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), whole % 60, ms)


def minutes_seconds(seconds: Column) -> Column:
    """``MM:SS`` with minutes beyond 59 where an hour has passed."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def cue_id(number: Column) -> Column:
    """``U`` and at least six digits."""
    return F.format_string("U%06d", number)


def id_number(uid: Column) -> Column:
    """The number after a leading ``U``; null where there is none."""
    return F.regexp_extract(uid, r"^U(\d+)", 1).try_cast("long")
