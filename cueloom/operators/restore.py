"""From annotated chunks back to timed utterances: parse, restore times, map speakers, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.timecode import minutes_seconds
from cueloom.operators.ids import time_ranges
from cueloom.schema import CATEGORIES, LLM_OUTPUT, UTTERANCE_DEFAULTS, UTTERANCE_FIELDS

# Words that keep a short backchannel, and noise that goes when uncertain.
KEEP_WORDS = ["いいえ", "違う", "だめ", "ない", "ません", "お願い", "ください", "了解", "承知"]
NOISE = ["ごめん", "ごめんごめん", "そう", "でも", "ありがとうございました", "よいしょ", "いいっしょ", "ごちそう", "おはようございます"]
NOISE_TAIL = "。、！？ "


def parse_results(results: DataFrame) -> DataFrame:
    """Utterances of ok results: job_id, chunk_index, pos (from 0) and the utterance fields, untouched."""
    parsed = results.where(F.col("status") == "ok").select("job_id", "chunk_index", F.from_json("result", LLM_OUTPUT).alias("r"))
    return parsed.select("job_id", "chunk_index", F.posexplode("r.utterances").alias("pos", "u")).select("job_id", "chunk_index", "pos", *(F.col(f"u.{f}").alias(f) for f in UTTERANCE_FIELDS))


def with_defaults(utterances: DataFrame) -> DataFrame:
    """Missing fields get their defaults; an unknown category raises an error."""
    out = utterances
    for field, value in UTTERANCE_DEFAULTS.items():
        out = out.withColumn(field, F.coalesce(field, F.lit(value)))
    for field in ("uncertain_span_ids", "source_ids"):
        out = out.withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    bad = F.raise_error(F.concat(F.lit("unknown category: "), F.col("category"))).cast("string")
    return out.withColumn("category", F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise(bad))


def restore_times(utterances: DataFrame, id_index: DataFrame, inserts: DataFrame | None = None) -> DataFrame:
    """Adds start and end: the range of the known source ids, or that of an inserted utterance.

    Ids that are not known are passed over; without any, both stay null.
    """
    key = ["job_id", "chunk_index", "pos"]
    spans = time_ranges(utterances.select(*key, "source_ids"), id_index, key, inserts)
    out = utterances.join(spans, key, "left")
    if inserts is not None:
        own = inserts.select("job_id", F.col("uid").alias("id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        out = out.join(own, ["job_id", "id"], "left").withColumn("start", F.coalesce("start", "_s")).withColumn("end", F.coalesce("end", "_e")).drop("_s", "_e")
    return out


def missing_chunks(chunks: DataFrame, members: DataFrame, results: DataFrame) -> DataFrame:
    """Placeholder utterances of chunks without a good result, in the utterance columns."""
    open_ = chunks.join(results.where(F.col("status") == "ok").select("job_id", "chunk_index"), ["job_id", "chunk_index"], "left_anti")
    ids = members.join(open_.select("job_id", "chunk_index"), ["job_id", "chunk_index"], "left_semi").groupBy("job_id", "chunk_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "uid"))), lambda r: r["uid"]).alias("source_ids"))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    note = F.concat(F.lit("（★ チャンク"), F.col("chunk_index").cast("string"), F.lit(" 処理失敗: "), whole("time_start"), F.lit("–"), whole("time_end"), F.lit("秒）"))
    fixed = {
        "id": F.concat(F.lit("MISSING_CHUNK_"), F.col("chunk_index").cast("string")), "speaker": F.lit("SYSTEM"), "text": note, "category": F.lit("CONTENT"), "uncertain": F.lit(True), "uncertain_reason": F.lit("NONE"),
        "uncertain_span_ids": F.array().cast("array<string>"), "source": F.lit("PRIMARY"), "source_ids": F.col("source_ids"), "vtt_supplemented": F.lit(False), "edit_type": F.lit("UNRESOLVED"), "edit_note": F.lit("チャンク処理失敗"),
    }
    return open_.join(ids, ["job_id", "chunk_index"]).select("job_id", "chunk_index", F.lit(0).alias("pos"), *(fixed[f].alias(f) for f in UTTERANCE_FIELDS))


def map_speakers(utterances: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """Speakers replaced by their job's display name, others unchanged.

    ``speaker_map``: job_id, speaker_label, display_name, one row a job and label.
    """
    names = speaker_map.select("job_id", F.col("speaker_label").alias("speaker"), F.col("display_name").alias("_name"))
    return utterances.join(names, ["job_id", "speaker"], "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name").select(*utterances.columns)


def excluded_from_txt() -> Column:
    """Whether an utterance is left out of the plain text: empty backchannels and uncertain noise."""
    back = F.col("category") == "BACKCHANNEL"
    size = F.length("text")
    keep = F.lit(False)
    for w in KEEP_WORDS:
        keep |= F.col("text").contains(w)
    idle = back & (size <= 10) & ~F.col("text").rlike(r"(?U)\d") & ~keep
    bare = F.regexp_replace("text", f"[{NOISE_TAIL}]+$", "")
    return idle | F.col("uncertain") & back | F.col("uncertain") & (size <= 15) & bare.isin(NOISE)


def tagged_uncertain() -> Column:
    """Whether the plain text marks an utterance as uncertain."""
    settled = (F.col("uncertain_reason") == "AB_MISMATCH") & F.col("edit_type").isin("NORMALIZE", "VTT_SUPPLEMENT")
    return F.col("uncertain") & (F.col("uncertain_reason") != "SPEAKER_AMBIGUOUS") & ~settled


def uncertain_tag() -> Column:
    """The mark itself, with minutes and seconds where a start is known."""
    return F.when(F.col("start").isNotNull(), F.concat(F.lit(" [聞き取り不確実 "), minutes_seconds(F.col("start")), F.lit("頃]"))).otherwise(F.lit(" [聞き取り不確実]"))
