"""Caption files as tables: WebVTT and SubRip, one file a row on reading, one cue a row after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.text import strip_wide
from cueloom.functions.timecode import parse_timecode

_VTT_TIMES = r"^\s*(\d{1,}:\d{2}:\d{2}[.,]\d{3}|\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{1,}:\d{2}:\d{2}[.,]\d{3}|\d{2}:\d{2}[.,]\d{3})"
_SRT_TIMES = r"^\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"
_VOICE = r"(?sU)^<v\s+([^>]+)>(.*?)(?:</v>)?$"
_PREFIX = r"(?U)^(SPEAKER_\d+)\s*[:：]\s*"


def read_captions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content of each file, byte order mark dropped and line ends made uniform."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return raw.withColumn("content", clean_content(F.col("content")))


def clean_content(content: Column) -> Column:
    """File content as text mode gives it."""
    return F.regexp_replace(F.regexp_replace(content, "^\\uFEFF", ""), "\r\n?", "\n")


def split_speaker(text: Column) -> tuple[Column, Column]:
    """The speaker of a voice tag, or else of a SPEAKER_nn prefix, and the text without it.

    Names before a colon are not taken for speakers; later tags stay in the text.
    """
    tagged = text.rlike(_VOICE)
    prefixed = text.rlike(_PREFIX)
    speaker = F.when(tagged, strip_wide(F.regexp_extract(text, _VOICE, 1))).when(prefixed, F.regexp_extract(text, _PREFIX, 1))
    rest = F.when(tagged, strip_wide(F.regexp_extract(text, _VOICE, 2))).when(prefixed, strip_wide(F.regexp_replace(text, _PREFIX, ""))).otherwise(text)
    return speaker, rest


def _blocks(captions: DataFrame, keys: list[str], content: Column) -> DataFrame:
    return captions.select(*keys, F.posexplode(F.split(content, r"\n(?U)\s*\n")).alias("pos", "block")).select(*keys, "pos", F.split("block", "\n").alias("lines"))


def parse_vtt(captions: DataFrame, keys: list[str]) -> DataFrame:
    """Cues of WebVTT contents: keys, cue_index, start, end, speaker, text.

    ``captions`` has the key columns and content. Everything up to the first line that begins
    with WEBVTT is dropped; in each block the first line with an arrow holds the times, what
    stands before it is passed over, settings after the times too. Blocks without valid
    times and cues without text are dropped, and cue_index counts what is kept, from 1.
    Null or empty contents give no cue. The header may be absent. Hours may have any number of
    digits, so that recordings beyond 99 hours, which the rendering writes, are read again.
    """
    text = strip_wide(clean_content(F.col("content")))
    header = r"(?is)^(?:.*?\n)??WEBVTT[^\n]*(?:\n|$)"
    body = F.when(text.rlike(r"(?im)^WEBVTT"), F.regexp_replace(text, header, "")).otherwise(text)
    blocks = _blocks(captions, keys, body)
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True)
    cut = blocks.withColumn("_at", at).where(F.col("_at") > 0)
    cut = cut.withColumn("_times", F.element_at("lines", F.col("_at").cast("int")))
    cut = cut.where(F.col("_times").rlike(_VTT_TIMES))
    cut = cut.withColumn("_text", strip_wide(F.array_join(F.slice("lines", (F.col("_at") + 1).cast("int"), F.size("lines")), "\n")))
    speaker, rest = split_speaker(F.col("_text"))
    cues = cut.select(*keys, "pos", parse_timecode(F.regexp_extract("_times", _VTT_TIMES, 1)).alias("start"), parse_timecode(F.regexp_extract("_times", _VTT_TIMES, 2)).alias("end"), speaker.alias("speaker"), rest.alias("text"))
    order = Window.partitionBy(*keys).orderBy("pos")
    return cues.where(F.length("text") > 0).withColumn("cue_index", F.row_number().over(order)).select(*keys, "cue_index", "start", "end", "speaker", "text")


def parse_srt(captions: DataFrame, keys: list[str]) -> DataFrame:
    """Cues of SubRip contents in the same columns; cue_index is the file's own number.

    A block needs three lines, a number in the first and full times in the second; other
    blocks are dropped. A text may be empty after its speaker is taken off.
    """
    text = strip_wide(clean_content(F.col("content")))
    blocks = _blocks(captions, keys, text).where(F.size("lines") >= 3)
    number = strip_wide(F.col("lines")[0]).try_cast("int")
    cut = blocks.withColumn("cue_index", number).where(F.col("cue_index").isNotNull() & F.col("lines")[1].rlike(_SRT_TIMES))
    cut = cut.withColumn("_text", strip_wide(F.array_join(F.slice("lines", 3, F.size("lines")), "\n")))
    prefixed = F.col("_text").rlike(_PREFIX)
    return cut.select(
        *keys, "cue_index", parse_timecode(F.regexp_extract(F.col("lines")[1], _SRT_TIMES, 1)).alias("start"), parse_timecode(F.regexp_extract(F.col("lines")[1], _SRT_TIMES, 2)).alias("end"),
        F.when(prefixed, F.regexp_extract("_text", _PREFIX, 1)).alias("speaker"), F.when(prefixed, strip_wide(F.regexp_replace("_text", _PREFIX, ""))).otherwise(F.col("_text")).alias("text"),
    )
