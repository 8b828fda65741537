"""Queries on annotated transcripts: validation, restoring, rendering, prompts and status."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.text import normalize_plain
from cueloom.functions.timecode import id_number
from cueloom.operators import annotate, checkpoint, chunking, ids, restore, validate
from cueloom.plans.matching import _norm_sql
from cueloom.plans.recordings import _C, CHUNKS_SQL, _chunks, cues_of
from cueloom.schema import UTTERANCE_FIELDS
from cueloom.session import cut_dir, read_table, written
from cueloom.sinks import render
from cueloom.sources.captions import parse_srt, parse_vtt

CHUNK_ROWS = 50


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_index with each entry once: job_id, uid, pos, start, end, speaker, text."""
    raw = read_table(spark, sf_dir, "id_index").dropDuplicates(["job_id", "uid"])
    end = F.when(F.col("end_sec") >= F.col("start_sec"), F.col("end_sec")).otherwise(F.col("start_sec"))
    return raw.select("job_id", "uid", F.regexp_extract("uid", r"(\d+)", 1).cast("int").alias("pos"), F.col("start_sec").alias("start"), end.alias("end"), "speaker", F.col("raw_text").alias("text"))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its entry as JSON, read again field by field, and the number of ids of its job."""
    index = _entries(spark, sf_dir)
    entry = F.from_json("entry", "id string, start double, `end` double, speaker string, raw_text string")
    out = ids.to_json(index).select("job_id", "uid", entry.alias("e")).select("job_id", "uid", "e.*")
    return ids.with_group_values(out, ids.sizes(index), "job_id", F.floor(id_number(F.col("uid")) / 65536))


def _written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks, of each the last written: job_id, chunk_index, srt_ids, context_before."""
    return read_table(spark, sf_dir, "chunks").groupBy("job_id", "chunk_index").agg(F.max_by("srt_ids", "written_at").alias("srt_ids"), F.max_by("context_before", "written_at").alias("context_before"))


def faulty_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every chunk, with one kind of fault by chunk_index mod 8; context_ids are those of context_before."""
    case = F.col("chunk_index") % 8
    before = F.coalesce(F.transform("context_before", lambda x: F.format_string("U%06d", x["cue_index"])), F.array().cast("array<string>"))
    base = _written_chunks(spark, sf_dir).select("job_id", "chunk_index", F.col("srt_ids").alias("expected_ids"), before.alias("context_ids"), case.alias("c"))
    e = F.col("expected_ids")
    last = F.size(e) - 1

    def source_ids(x, i):
        own = F.array(x)
        repeat = F.when((F.col("c") == 2) & (i == last), F.concat(own, F.slice(e, 1, 1)))
        unknown = F.when((F.col("c") == 3) & (i == 0), F.concat(own, F.array(F.lit("U999999"))))
        jump = F.when((F.col("c") == 4) & (i == 0) & (last >= 2), F.concat(own, F.slice(e, 3, 1))).when((F.col("c") == 4) & (i == 2), F.array().cast("array<string>"))
        leak = F.when((F.col("c") == 7) & (i == 0), F.concat(own, F.slice("context_ids", 1, 1)))
        return F.coalesce(repeat, unknown, jump, leak, own)

    made = F.transform(e, lambda x, i: F.struct(F.when((F.col("c") == 5) & (i == 0), F.lit("1")).otherwise(x).alias("id"), source_ids(x, i).alias("source_ids"), i.alias("i")))
    kept = F.filter(made, lambda u: (F.col("c") != 1) | (u["i"] % 3 != 2))
    utterances = F.transform(kept, lambda u: F.struct(u["id"].alias("id"), u["source_ids"].alias("source_ids")))
    return base.select("job_id", "chunk_index", "expected_ids", "context_ids", F.when(F.col("c") != 6, utterances).alias("utterances"))


def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the checks on every faulty answer."""
    out = validate.validate(faulty_outputs(spark, sf_dir))
    joined = {c: F.array_join(c, ",") for c in ("missing_ids", "duplicate_ids", "unknown_ids", "non_contiguous", "leaked_ids")}
    return out.select("job_id", "chunk_index", "passed", F.size("errors").alias("n_errors"), *(v.alias(k) for k, v in joined.items()))


def validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of every faulty answer as text."""
    out = validate.validate(faulty_outputs(spark, sf_dir))
    return out.select("job_id", "chunk_index", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def restore_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time range that the ids of every stored chunk span."""
    chunks = _written_chunks(spark, sf_dir).select("job_id", "chunk_index", F.col("srt_ids").alias("source_ids"))
    return ids.time_ranges(chunks, _entries(spark, sf_dir), ["job_id", "chunk_index"])


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An utterance for every PRIMARY cue with text, categories and doubts derived from its position."""
    cues = cues_of(spark, sf_dir).where(F.length("text") > 0)
    n = F.col("pos")
    fields = {
        "id": F.col("uid"), "speaker": F.when(F.length("speaker") > 0, F.col("speaker")).otherwise("UNKNOWN"), "text": F.col("text"), "category": F.when(F.length("text") <= 12, "BACKCHANNEL").otherwise("CONTENT"),
        "uncertain": n % 7 == 0, "uncertain_reason": F.when(n % 21 == 0, "AB_MISMATCH").when(n % 14 == 0, "SPEAKER_AMBIGUOUS").otherwise("NONE"), "uncertain_span_ids": F.array().cast("array<string>"), "source": F.lit("PRIMARY"),
        "source_ids": F.array("uid"), "vtt_supplemented": F.lit(False), "edit_type": F.when(n % 42 == 0, "NORMALIZE").otherwise("NONE"), "edit_note": F.lit(""),
    }
    own = cues.select("job_id", F.floor((n - 1) / CHUNK_ROWS).cast("int").alias("chunk_index"), n.alias("pos"), *(fields[f].alias(f) for f in UTTERANCE_FIELDS), F.when(n % 11 != 0, F.col("start")).alias("start"), F.when(n % 11 != 0, F.col("end")).alias("end"))
    return written(own)


def txt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the plain text of every job."""
    return render.txt_lines(_utterances(spark, sf_dir))


def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of SubRip of every job."""
    return render.srt_lines(_utterances(spark, sf_dir))


def vtt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of WebVTT of every job."""
    return render.vtt_lines(_utterances(spark, sf_dir))


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of every utterance, read again field by field."""
    rows = render.json_rows(_utterances(spark, sf_dir))
    back = F.from_json("utterance", "id string, speaker string, text string, category string, uncertain boolean, uncertain_reason string, source string, source_ids array<string>, vtt_supplemented boolean, edit_type string, edit_note string, start double, `end` double")
    return rows.select("job_id", "seq", back.alias("u")).select("job_id", "seq", "u.*").withColumn("source_ids", F.array_join("source_ids", ","))


def txt_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which utterances the plain text leaves out and which it marks."""
    return _utterances(spark, sf_dir).select("job_id", "id", restore.excluded_from_txt().alias("excluded"), restore.tagged_uncertain().alias("tagged"))


def vtt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues rendered to caption contents, one a chunk of rows, and parsed again."""
    return parse_vtt(_caption_files(spark, sf_dir, render.vtt_lines), ["file"]).select("file", "cue_index", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", "text")


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SubRip, whose speaker stands as a prefix of the text."""
    return parse_srt(_caption_files(spark, sf_dir, render.srt_lines), ["file"]).select("file", "cue_index", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", "text")


def _caption_files(spark: SparkSession, sf_dir: str, lines_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """file and content of rendered captions of plain texts, one file a (job, block of rows), written and read as files."""
    bare = normalize_plain(F.regexp_replace("text", "<[^>]*>", " "))
    utts = _utterances(spark, sf_dir).withColumn("text", bare).withColumn("speaker", F.lit("SPEAKER_00")).where((F.length("text") > 0) & F.col("start").isNotNull())
    file = F.concat_ws("/", "job_id", F.col("chunk_index").cast("string"))  # the block is the job of the renderer
    return render.documents(lines_of(utts.withColumn("job_id", file))).select(F.col("job_id").alias("file"), F.col("document").alias("content"))


def restored_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with missing fields, unknown ids and inserted utterances, saved, loaded, completed and given their times.

    Of each stored chunk three utterances: its first two ids with nothing else, its last id and one that no
    index knows, and an inserted one, which has times of its own in every second chunk.
    """
    e = F.col("srt_ids")
    none = F.lit(None)
    utterance = lambda uid, own, speaker, text: F.struct(uid.alias("id"), own.alias("source_ids"), speaker.cast("string").alias("speaker"), text.cast("string").alias("text"))
    made = F.array(utterance(e[0], F.slice(e, 1, 2), none, none), utterance(F.element_at(e, -1), F.array(F.element_at(e, -1), F.lit("U999999")), F.lit("SPEAKER_01"), F.lit("x")), utterance(F.lit("V_INSERT_001"), F.array().cast("array<string>"), none, F.lit("i")))
    chunks = _written_chunks(spark, sf_dir)
    answers = chunks.select("job_id", "chunk_index", F.lit("ok").alias("status"), F.to_json(F.struct(made.alias("utterances"))).alias("result"))
    table = checkpoint.CheckpointTable(spark, f"{cut_dir(spark)}/{uuid.uuid4().hex}")
    table.save(answers.withColumn("status", F.lit("error")).withColumn("result", none.cast("string")))
    table.save(answers)
    inserts = chunks.where(F.col("chunk_index") == 0).select("job_id", F.lit("V_INSERT_001").alias("uid"), F.lit(1.5).alias("start"), F.lit(2.5).alias("end"))
    utts = restore.with_defaults(restore.parse_results(table.load()))
    out = restore.restore_times(utts, _entries(spark, sf_dir), inserts)
    return out.withColumn("source_ids", F.array_join("source_ids", ",")).withColumn("uncertain_span_ids", F.array_join("uncertain_span_ids", ","))


def speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance's speaker with display names in place of labels."""
    out = restore.map_speakers(_utterances(spark, sf_dir), read_table(spark, sf_dir, "speaker_map"))
    return out.select("job_id", "id", "speaker")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks with a status derived from their number; every third is missing."""
    status = F.when(F.col("chunk_index") % 3 == 0, "ok").otherwise("error")
    return _written_chunks(spark, sf_dir).where(F.col("chunk_index") % 3 != 2).select("job_id", "chunk_index", status.alias("status"))


def completion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, failed and pending chunks of every job."""
    return checkpoint.status_counts(checkpoint.completion_status(_written_chunks(spark, sf_dir), _results(spark, sf_dir)))


def resume_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a second run still has to annotate."""
    done = _results(spark, sf_dir).where(F.col("status") == "ok").select("job_id", "chunk_index")
    return checkpoint.targets(_written_chunks(spark, sf_dir).select("job_id", "chunk_index"), done)


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of utterances, doubts and backchannels of every chunk."""
    return checkpoint.chunk_stats(_utterances(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, cues = _chunks(spark, sf_dir)
    body = chunking.members(chunks).select("job_id", "chunk_index", F.lit("BODY").alias("role"), "pos")
    ctx = chunking.contexts(chunks, cues).withColumn("pos", F.col("pos").cast("long"))
    look = cues.select("job_id", F.col("pos").cast("long").alias("pos"), "uid", "speaker", "text")
    return written(body.unionByName(ctx).join(look, ["job_id", "pos"])), chunks


def prompt_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data sections of every chunk's prompt, for one recording."""
    return annotate.prompt_bodies(_parts(spark, sf_dir)[0]).select("job_id", "chunk_index", "body")


def annotate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks annotated by merging neighbours of one speaker: utterances and ids of each."""
    parts, _ = _parts(spark, sf_dir)
    asked = annotate.prompt_bodies(parts).join(annotate.body_lines(parts), ["job_id", "chunk_index"])
    results = written(annotate.annotate(asked, "merge", dual=False, backoff=0))
    utts = restore.with_defaults(restore.parse_results(results))
    return utts.select("job_id", "chunk_index", "pos", "id", "speaker", "text", F.size("source_ids").alias("n_ids"))


QUERIES = {
    f.__name__: f
    for f in (
        index_entries, validate_chunks, validate_messages, restore_times, restored_utterances, txt_render, srt_render, vtt_render, json_export, txt_excluded, vtt_roundtrip, srt_roundtrip, speaker_names, completion_status, resume_targets, chunk_stats, prompt_body, annotate_merge,
    )
}

_STORED = "stored AS (SELECT job_id, chunk_index, max_by(srt_ids, written_at) AS e, max_by(context_before, written_at) AS cb FROM chunks GROUP BY job_id, chunk_index)"
_FAULTY = (
    "WITH "
    + _STORED
    + """, made AS (SELECT job_id, chunk_index, e, coalesce(list_transform(cb, lambda x: printf('U%06d', x.cue_index)), []) AS ctx, chunk_index % 8 AS c, len(e) AS n, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM stored),
u AS (
  SELECT *, CASE WHEN c = 5 AND i = 0 THEN '1' ELSE x END AS id,
    CASE WHEN c = 2 AND i = n - 1 THEN [x, e[1]] WHEN c = 3 AND i = 0 THEN [x, 'U999999'] WHEN c = 4 AND i = 0 AND n >= 3 THEN [x, e[3]] WHEN c = 4 AND i = 2 THEN []::VARCHAR[] WHEN c = 7 AND i = 0 AND len(ctx) > 0 THEN [x, ctx[1]] ELSE [x] END AS s
  FROM made WHERE NOT (c = 1 AND i % 3 = 2) AND c <> 6
), flat AS (SELECT job_id, chunk_index, i, unnest(s) AS sid, generate_subscripts(s, 1) AS k FROM u),
missing AS (SELECT m.job_id, m.chunk_index, string_agg(m.x, ',' ORDER BY m.i) AS ids FROM made m WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.job_id = m.job_id AND f.chunk_index = m.chunk_index AND f.sid = m.x) AND m.c <> 6 GROUP BY ALL),
dupes AS (SELECT job_id, chunk_index, string_agg(sid, ',' ORDER BY seq, ak) AS ids FROM (SELECT job_id, chunk_index, sid, min(i) AS seq, min(k) AS ak FROM flat GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
unknown AS (SELECT f.job_id, f.chunk_index, string_agg(DISTINCT f.sid, ',' ORDER BY f.sid) AS ids FROM flat f JOIN stored USING (job_id, chunk_index) WHERE NOT list_contains(e, f.sid) GROUP BY ALL),
steps AS (SELECT *, CAST(substr(sid, 2) AS BIGINT) - lag(CAST(substr(sid, 2) AS BIGINT)) OVER (PARTITION BY job_id, chunk_index, i ORDER BY k) AS d FROM flat),
leaked AS (SELECT f.job_id, f.chunk_index, string_agg(DISTINCT f.sid, ',' ORDER BY f.sid) AS ids FROM flat f JOIN made m USING (job_id, chunk_index) WHERE list_contains(m.ctx, f.sid) GROUP BY ALL),
broken AS (SELECT u.job_id, u.chunk_index, string_agg(u.id, ',' ORDER BY u.i) AS ids FROM u JOIN (SELECT DISTINCT job_id, chunk_index, i FROM steps WHERE d <> 1) b USING (job_id, chunk_index, i) GROUP BY ALL)
"""
)
_FOUND = """FROM stored s LEFT JOIN missing m USING (job_id, chunk_index) LEFT JOIN dupes d USING (job_id, chunk_index) LEFT JOIN unknown k USING (job_id, chunk_index) LEFT JOIN broken b USING (job_id, chunk_index)
LEFT JOIN leaked l USING (job_id, chunk_index)"""


def _message(what: str, ids: str) -> str:
    """The message on a list of ids joined by commas, null where there is none."""
    return f"'{what}: ' || len(string_split({ids}, ',')) || ' ids: [''' || array_to_string(string_split({ids}, ',')[1:5], ''', ''') || ''']'"


_UTTERANCES = (
    _C
    + """, u AS (
  SELECT job_id, CAST(floor((pos - 1) / 50) AS INTEGER) AS chunk_index, pos, printf('U%06d', pos) AS id, CASE WHEN speaker <> '' THEN speaker ELSE 'UNKNOWN' END AS speaker, text,
    CASE WHEN length(text) <= 12 THEN 'BACKCHANNEL' ELSE 'CONTENT' END AS category, pos % 7 = 0 AS uncertain,
    CASE WHEN pos % 21 = 0 THEN 'AB_MISMATCH' WHEN pos % 14 = 0 THEN 'SPEAKER_AMBIGUOUS' ELSE 'NONE' END AS reason, CASE WHEN pos % 42 = 0 THEN 'NORMALIZE' ELSE 'NONE' END AS edit_type,
    CASE WHEN pos % 11 <> 0 THEN start END AS start, CASE WHEN pos % 11 <> 0 THEN "end" END AS "end", CAST(row_number() OVER (PARTITION BY job_id ORDER BY pos) AS INTEGER) AS seq
  FROM c WHERE length(text) > 0
), flags AS (
  SELECT *, (category = 'BACKCHANNEL' AND length(text) <= 10 AND NOT regexp_matches(text, '[0-9０-９]') AND NOT regexp_matches(text, 'いいえ|違う|だめ|ない|ません|お願い|ください|了解|承知'))
      OR (uncertain AND category = 'BACKCHANNEL') OR (uncertain AND length(text) <= 15 AND regexp_replace(text, '[。、！？ ]+$', '') IN ('ごめん', 'ごめんごめん', 'そう', 'でも', 'ありがとうございました', 'よいしょ', 'いいっしょ', 'ごちそう', 'おはようございます')) AS excluded,
    uncertain AND reason <> 'SPEAKER_AMBIGUOUS' AND NOT (reason = 'AB_MISMATCH' AND edit_type IN ('NORMALIZE', 'VTT_SUPPLEMENT')) AS tagged
  FROM u
), timed AS (
  SELECT *, printf('%02d:%02d:%02d', CAST(trunc(start / 3600) AS BIGINT), CAST(trunc((floor(start) % 3600) / 60) AS BIGINT), CAST(floor(start) % 60 AS BIGINT)) AS sh, printf('%03d', CAST(trunc((start % 1) * 1000) AS BIGINT)) AS sm,
    printf('%02d:%02d:%02d', CAST(trunc("end" / 3600) AS BIGINT), CAST(trunc((floor("end") % 3600) / 60) AS BIGINT), CAST(floor("end") % 60 AS BIGINT)) AS eh, printf('%03d', CAST(trunc(("end" % 1) * 1000) AS BIGINT)) AS em
  FROM u WHERE start IS NOT NULL AND "end" IS NOT NULL
)
"""
)
# Neighbours of one speaker within a chunk as one utterance, as the merging annotator makes them.
MERGED_SQL = """, line AS (
  SELECT k.job_id, k.chunk_index, c.pos AS p, c.start, c."end", CASE WHEN c.speaker <> '' THEN c.speaker ELSE 'UNKNOWN' END AS who, coalesce(c.text, '') AS t FROM chunk k JOIN c ON c.job_id = k.job_id AND c.pos BETWEEN k.first_pos AND k.last_pos
), turn AS (SELECT *, who <> lag(who, 1, '') OVER (PARTITION BY job_id, chunk_index ORDER BY p) AS new FROM line),
nth AS (SELECT *, CAST(sum(new::INT) OVER (PARTITION BY job_id, chunk_index ORDER BY p) - 1 AS INTEGER) AS pos FROM turn),
merged AS (
  SELECT job_id, chunk_index, pos, printf('U%06d', min(p)) AS id, any_value(who) AS speaker, string_agg(t, ' ' ORDER BY p) AS text, CAST(count(*) AS INTEGER) AS n_ids, min(start) AS start, max("end") AS "end" FROM nth GROUP BY job_id, chunk_index, pos
)
"""
_SPREAD = "SELECT job_id, seq, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS part, unnest(lines) AS line FROM l"
ORACLES = {
    "validate_chunks": _FAULTY
    + """SELECT s.job_id, s.chunk_index, (m.ids IS NULL AND d.ids IS NULL AND k.ids IS NULL AND s.chunk_index % 8 NOT IN (5, 6)) AS passed,
  CAST((m.ids IS NOT NULL)::INT + (d.ids IS NOT NULL)::INT + (k.ids IS NOT NULL)::INT + (s.chunk_index % 8 IN (5, 6))::INT AS INTEGER) AS n_errors,
  coalesce(m.ids, '') AS missing_ids, coalesce(d.ids, '') AS duplicate_ids, coalesce(k.ids, '') AS unknown_ids, coalesce(b.ids, '') AS non_contiguous, coalesce(l.ids, '') AS leaked_ids
""" + _FOUND,
    "validate_messages": _FAULTY + f"""SELECT s.job_id, s.chunk_index,
  CASE WHEN s.chunk_index % 8 = 6 THEN 'no utterances' ELSE concat_ws('; ', CASE WHEN s.chunk_index % 8 = 5 THEN 'invalid id format: 1' END, {_message('missing', 'm.ids')}, {_message('duplicate', 'd.ids')}, {_message('unknown', 'k.ids')}) END AS errors,
  concat_ws('; ', 'non-contiguous source_ids: ' || replace(b.ids, ',', '; non-contiguous source_ids: '), {_message('context leak', 'l.ids')}) AS warnings
""" + _FOUND,
    "index_entries": """WITH e AS (SELECT DISTINCT job_id, uid, start_sec AS start, CASE WHEN end_sec >= start_sec THEN end_sec ELSE start_sec END AS "end", speaker, raw_text FROM id_index)
SELECT job_id, uid, uid AS id, start, "end", speaker, raw_text, count(*) OVER (PARTITION BY job_id) AS size FROM e""",
    "restored_utterances": "WITH " + _STORED + """, e AS (SELECT DISTINCT job_id, uid, start_sec AS start, CASE WHEN end_sec >= start_sec THEN end_sec ELSE start_sec END AS "end" FROM id_index),
u AS (
  SELECT job_id, chunk_index, 0 AS pos, e[1] AS id, 'UNKNOWN' AS speaker, '' AS text, e[1:2] AS ids FROM stored
  UNION ALL SELECT job_id, chunk_index, 1, e[-1], 'SPEAKER_01', 'x', [e[-1], 'U999999'] FROM stored
  UNION ALL SELECT job_id, chunk_index, 2, 'V_INSERT_001', 'UNKNOWN', 'i', []::VARCHAR[] FROM stored
), x AS (SELECT job_id, chunk_index, pos, unnest(ids) AS uid FROM u), t AS (SELECT job_id, chunk_index, pos, min(start) AS start, max("end") AS "end" FROM x JOIN e USING (job_id, uid) GROUP BY ALL),
i AS (SELECT DISTINCT job_id FROM stored WHERE chunk_index = 0)
SELECT u.job_id, u.chunk_index, u.pos, u.id, u.speaker, u.text, 'CONTENT' AS category, false AS uncertain, 'NONE' AS uncertain_reason, '' AS uncertain_span_ids, 'PRIMARY' AS source, array_to_string(u.ids, ',') AS source_ids, false AS vtt_supplemented, 'NONE' AS edit_type, '' AS edit_note,
  CASE WHEN u.pos = 2 THEN CASE WHEN i.job_id IS NOT NULL THEN 1.5::DOUBLE END ELSE t.start END AS start, CASE WHEN u.pos = 2 THEN CASE WHEN i.job_id IS NOT NULL THEN 2.5::DOUBLE END ELSE t."end" END AS "end"
FROM u LEFT JOIN t USING (job_id, chunk_index, pos) LEFT JOIN i ON i.job_id = u.job_id""",
    "restore_times": "WITH " + _STORED + """, e AS (SELECT DISTINCT job_id, uid, start_sec AS start, CASE WHEN end_sec >= start_sec THEN end_sec ELSE start_sec END AS "end" FROM id_index),
x AS (SELECT job_id, chunk_index, unnest(e) AS uid FROM stored)
SELECT job_id, chunk_index, min(start) AS start, max("end") AS "end" FROM x JOIN e USING (job_id, uid) GROUP BY job_id, chunk_index""",
    "txt_render": _UTTERANCES
    + """, kept AS (SELECT *, lag(speaker) OVER (PARTITION BY job_id ORDER BY seq) AS ps, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM flags WHERE NOT excluded),
marked AS (SELECT *, text || CASE WHEN NOT tagged THEN '' WHEN start IS NULL THEN ' [聞き取り不確実]' ELSE ' [聞き取り不確実 ' || printf('%02d:%02d', CAST(trunc(floor(start) / 60) AS BIGINT), CAST(floor(start) % 60 AS BIGINT)) || '頃]' END AS t FROM kept),
l AS (SELECT job_id, seq, CASE WHEN n = 1 THEN [speaker, t] WHEN speaker <> ps THEN ['', speaker, t] ELSE [t] END AS lines FROM marked)
""" + _SPREAD,
    "srt_render": _UTTERANCES + ", l AS (SELECT job_id, seq, [CAST(seq AS VARCHAR), sh || ',' || sm || ' --> ' || eh || ',' || em, speaker || ': ' || text, ''] AS lines FROM timed)\n" + _SPREAD,
    "vtt_render": _UTTERANCES
    + ", l AS (SELECT job_id, seq, [sh || '.' || sm || ' --> ' || eh || '.' || em, '<v ' || speaker || '>' || text || '</v>', ''] AS lines FROM timed UNION ALL SELECT DISTINCT job_id, 0, ['WEBVTT', ''] FROM u)\n" + _SPREAD,
    "json_export": _UTTERANCES + "SELECT job_id, seq, id, speaker, text, category, uncertain, reason AS uncertain_reason, 'PRIMARY' AS source, id AS source_ids, false AS vtt_supplemented, edit_type, '' AS edit_note, start, \"end\" FROM u",
    "txt_excluded": _UTTERANCES + "SELECT job_id, id, excluded, tagged FROM flags",
    "vtt_roundtrip": _UTTERANCES
    + f""", b AS (SELECT *, {_norm_sql("regexp_replace(text, '<[^>]*>', ' ', 'g')")} AS t FROM timed)
SELECT job_id || '/' || chunk_index AS file, CAST(row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY seq) AS INTEGER) AS cue_index,
  round(floor(start) + CAST(sm AS DOUBLE) / 1000, 3) AS start, round(floor("end") + CAST(em AS DOUBLE) / 1000, 3) AS "end", 'SPEAKER_00' AS speaker, t AS text FROM b WHERE t <> ''""",
    "srt_roundtrip": _UTTERANCES
    + f""", b AS (SELECT *, {_norm_sql("regexp_replace(text, '<[^>]*>', ' ', 'g')")} AS t FROM timed)
SELECT job_id || '/' || chunk_index AS file, CAST(row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY seq) AS INTEGER) AS cue_index,
  round(floor(start) + CAST(sm AS DOUBLE) / 1000, 3) AS start, round(floor("end") + CAST(em AS DOUBLE) / 1000, 3) AS "end", 'SPEAKER_00' AS speaker, t AS text FROM b WHERE t <> ''""",
    "annotate_merge": _C + CHUNKS_SQL + MERGED_SQL + """SELECT job_id, chunk_index, pos, id, speaker, text, n_ids FROM merged""",
    "speaker_names": _UTTERANCES + "SELECT u.job_id, u.id, coalesce(m.display_name, u.speaker) AS speaker FROM u LEFT JOIN speaker_map m ON m.job_id = u.job_id AND m.speaker_label = u.speaker",
    "completion_status": "WITH " + _STORED + """
SELECT job_id, count(*) FILTER (WHERE chunk_index % 3 = 0) AS completed, count(*) FILTER (WHERE chunk_index % 3 = 1) AS failed, count(*) FILTER (WHERE chunk_index % 3 = 2) AS pending FROM stored GROUP BY job_id""",
    "resume_targets": "WITH " + _STORED + "SELECT job_id, chunk_index FROM stored WHERE chunk_index % 3 <> 0",
    "chunk_stats": _UTTERANCES + "SELECT job_id, chunk_index, count(*) AS utterances, count(*) FILTER (WHERE uncertain) AS uncertain, count(*) FILTER (WHERE reason = 'AB_MISMATCH') AS ab_mismatch, count(*) FILTER (WHERE category = 'BACKCHANNEL') AS backchannel FROM u GROUP BY job_id, chunk_index",
    "prompt_body": _C + CHUNKS_SQL + f""", lasts AS (SELECT job_id, max(chunk_index) AS m FROM chunk GROUP BY job_id),
parts AS (
  SELECT k.job_id, k.chunk_index, 'BODY' AS role, c.pos, '[' || printf('U%06d', c.pos) || '] ' AS head, c.speaker, c.text FROM chunk k JOIN c ON c.job_id = k.job_id AND c.pos BETWEEN k.first_pos AND k.last_pos
  UNION ALL SELECT k.job_id, k.chunk_index, 'CTX_BEFORE', c.pos, '[CTX] ', c.speaker, c.text FROM chunk k JOIN c ON c.job_id = k.job_id AND k.chunk_index > 0 AND c.pos < k.first_pos AND c.start >= greatest(0, k.time_start - 15)
  UNION ALL SELECT k.job_id, k.chunk_index, 'CTX_AFTER', c.pos, '[CTX] ', c.speaker, c.text FROM chunk k JOIN lasts USING (job_id) JOIN c ON c.job_id = k.job_id AND k.chunk_index < lasts.m AND c.pos > k.last_pos AND c."end" <= k.time_end + 15
), g AS (
  SELECT job_id, chunk_index, role, string_agg(head || CASE WHEN speaker <> '' THEN speaker ELSE 'UNKNOWN' END || ': ' || coalesce(text, ''), chr(10) ORDER BY pos) AS t FROM parts GROUP BY job_id, chunk_index, role
), w AS (SELECT job_id, chunk_index, max(CASE WHEN role = 'CTX_BEFORE' THEN t END) AS b, max(CASE WHEN role = 'BODY' THEN t END) AS m, max(CASE WHEN role = 'CTX_AFTER' THEN t END) AS a FROM g GROUP BY job_id, chunk_index)
SELECT job_id, chunk_index, concat_ws(chr(10), chr(10) || '{annotate.HEAD_BEFORE}' || chr(10) || b, chr(10) || '{annotate.HEAD_PRIMARY}' || chr(10) || m, chr(10) || '{annotate.HEAD_AFTER}' || chr(10) || a) AS body FROM w""",
}
ORACLES = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLES.items()}
