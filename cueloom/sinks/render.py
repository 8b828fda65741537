"""Transcripts as text, one line a row: plain text, SubRip, WebVTT and JSON.

Lines carry (job_id, seq, part) as their order, so files of any length are written without
gathering a job in one cell; documents() joins the lines of small jobs into one string.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import format_timecode
from cueloom.operators.ids import number_rows
from cueloom.operators.restore import excluded_from_txt, tagged_uncertain, uncertain_tag

# Names of the files.
FILE_NAMES = {"txt": "final_transcript.txt", "srt": "final_transcript.srt", "vtt": "final_transcript.vtt", "json": "final_transcript.json", "offset": "offset_report.json"}
JSON_FIELDS = ["id", "speaker", "text", "category", "uncertain", "uncertain_reason", "source", "source_ids", "vtt_supplemented", "edit_type", "edit_note", "start", "end"]


def ordered(utterances: DataFrame) -> DataFrame:
    """Adds ``seq``, the position of an utterance in its job, counted before anything is left out."""
    return number_rows(utterances, ["job_id"], ["chunk_index", "pos"], "seq", slot=F.col("chunk_index"))


def txt_lines(utterances: DataFrame) -> DataFrame:
    """job_id, seq, part, line of the plain text.

    A speaker line stands where the speaker differs from the row kept before, with an empty
    line ahead of it but for the first. The row before may lie in an earlier chunk, whose last
    kept row is handed on, so windows span one chunk each.
    """
    kept = ordered(utterances).where(~excluded_from_txt()).select("job_id", "chunk_index", "seq", "speaker", "text", "start", "uncertain", "uncertain_reason", "edit_type")
    last = kept.groupBy("job_id", "chunk_index").agg(F.max_by("speaker", "seq").alias("_s"))
    chain = Window.partitionBy("job_id").orderBy("chunk_index")
    before = last.select("job_id", "chunk_index", F.lag("_s").over(chain).alias("_before"), F.lag(F.lit(True)).over(chain).alias("_any"))
    inside = Window.partitionBy("job_id", "chunk_index").orderBy("seq")
    rows = kept.withColumn("_n", F.row_number().over(inside)).withColumn("_prev", F.lag("speaker").over(inside)).join(before, ["job_id", "chunk_index"])
    first = (F.col("_n") == 1) & F.col("_any").isNull()
    prev = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev"))
    change = first | ~F.col("speaker").eqNullSafe(prev)
    text = F.concat("text", F.when(tagged_uncertain(), uncertain_tag()).otherwise(F.lit("")))
    lines = F.array_compact(F.array(F.when(change & ~first, F.lit("")), F.when(change, F.coalesce("speaker", F.lit("")))))
    full = F.when(change, F.concat(lines, F.array(text))).otherwise(F.array(text))
    return rows.select("job_id", "seq", F.posexplode(full).alias("part", "line"))


def srt_lines(utterances: DataFrame) -> DataFrame:
    """Lines of SubRip; numbers count all utterances, those without times are left out."""
    rows = ordered(utterances).where(F.col("start").isNotNull() & F.col("end").isNotNull())
    times = F.concat(format_timecode(F.col("start"), ","), F.lit(" --> "), format_timecode(F.col("end"), ","))
    lines = F.array(F.col("seq").cast("string"), times, F.concat("speaker", F.lit(": "), F.col("text")), F.lit(""))
    return rows.select("job_id", "seq", F.posexplode(lines).alias("part", "line"))


def vtt_lines(utterances: DataFrame) -> DataFrame:
    """Lines of WebVTT; utterances without times are left out, every job has its header."""
    rows = ordered(utterances).where(F.col("start").isNotNull() & F.col("end").isNotNull())
    times = F.concat(format_timecode(F.col("start")), F.lit(" --> "), format_timecode(F.col("end")))
    lines = F.array(times, F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"), F.col("text"), F.lit("</v>")), F.lit(""))
    header = utterances.select("job_id").distinct().select("job_id", F.lit(0).alias("seq"), F.posexplode(F.array(F.lit("WEBVTT"), F.lit(""))).alias("part", "line"))
    return header.unionByName(rows.select("job_id", "seq", F.posexplode(lines).alias("part", "line")))


def json_rows(utterances: DataFrame) -> DataFrame:
    """job_id, seq and each utterance as a JSON object, nulls kept."""
    return ordered(utterances).select("job_id", "seq", F.to_json(F.struct(*JSON_FIELDS), {"ignoreNullFields": "false"}).alias("utterance"))


def json_lines(utterances: DataFrame) -> DataFrame:
    """Lines of a file of one JSON object an utterance."""
    return json_rows(utterances).select("job_id", "seq", F.lit(0).alias("part"), F.col("utterance").alias("line"))


def documents(lines: DataFrame) -> DataFrame:
    """job_id and the joined lines; for jobs whose text fits a cell."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "part", "line")))
    return lines.groupBy("job_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("document"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Writes the lines of all jobs as text files, one folder a job, in order within it."""
    ranged = lines.repartitionByRange("job_id", "seq", "part").sortWithinPartitions("job_id", "seq", "part")
    ranged.select("job_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("job_id").text(folder)


def write_job_file(lines: DataFrame, job_id: str, path: str | Path) -> None:
    """Writes one job's lines as one local file, streamed to the driver in order."""
    own = lines.where(F.col("job_id") == job_id).orderBy("seq", "part").select("line")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        for i, row in enumerate(own.toLocalIterator()):
            out.write(("\n" if i else "") + row["line"])


def json_document(rows: Iterator[str], metadata: dict) -> Iterator[str]:
    """The pieces of a job's JSON file."""
    import json

    meta = json.dumps(metadata, ensure_ascii=False, indent=2).replace("\n", "\n  ")
    yield '{\n  "metadata": ' + meta + ',\n  "utterances": ['
    for i, row in enumerate(rows):
        body = json.dumps(json.loads(row), ensure_ascii=False, indent=2).replace("\n", "\n    ")
        yield ("," if i else "") + "\n    " + body
    yield "\n  ]\n}"
