"""Queries on the whole merge of all jobs in one plan, and on its side files."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.config import DEFAULTS, deep_merge
from cueloom.operators import annotate, checkpoint
from cueloom.plans import engine
from cueloom.plans.recordings import _C, CHUNKS_SQL, cues_of, cues_sql
from cueloom.plans.transcripts import MERGED_SQL
from cueloom.session import cut_dir, read_table, written
from cueloom.sources import side

OFFSET_SEC = 12.5


def _ready(spark: SparkSession, sf_dir: str, **offset: Any) -> engine.Prepared:
    """All jobs prepared for annotation, both recordings."""
    config = deep_merge(DEFAULTS, {"offset": offset})
    return engine.prepare(read_table(spark, sf_dir, "jobs").select("job_id"), written(cues_of(spark, sf_dir)), written(cues_of(spark, sf_dir, "ZOOM")), config)


def _saved(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Results by way of a checkpoint table."""
    table = checkpoint.CheckpointTable(spark, f"{cut_dir(spark)}/{uuid.uuid4().hex}")
    table.save(results)
    return table.load()


def prompt_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prompt of every chunk for two recordings, ZOOM set back by 12.5 seconds, as it is sent."""
    ready = _ready(spark, sf_dir, mode="manual", manual_offset_sec=OFFSET_SEC)
    sent = annotate.annotate(engine.prompts(ready), "identity", save_prompt=True, backoff=0)
    return sent.select("job_id", "chunk_index", F.col("prompts")[0].alias("prompt"))


def checkpoint_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checkpoint of every chunk says of its making."""
    ready = _ready(spark, sf_dir, mode="manual", manual_offset_sec=OFFSET_SEC)
    answers = written(annotate.annotate(engine.prompts(ready), "merge", backoff=0))
    saved = _saved(spark, checkpoint.with_meta(answers, ready.chunks, ready.parts, ready.offsets, "merge", "none"))
    return saved.select("job_id", "chunk_index", "status", "chunk_time_range.*", "input_counts.*", "api_provider", "api_model", "offset_applied_sec", "id_validation.passed", "id_validation.retries")


def _merged(spark: SparkSession, sf_dir: str, ready: engine.Prepared, mode: str, answered: Any = True) -> DataFrame:
    asked = engine.prompts(ready).where(answered) if answered is not True else engine.prompts(ready)
    results = _saved(spark, annotate.annotate(asked, "merge", backoff=0))
    out = engine.finalize(ready, results, read_table(spark, sf_dir, "speaker_map"), mode)
    return out.select("job_id", "chunk_index", "pos", "id", "speaker", "text", "uncertain", "edit_type", "start", "end", F.size("source_ids").alias("n_ids"))


def merged_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs from cues to utterances with times and names, by way of checkpoints; every chunk must be complete."""
    return _merged(spark, sf_dir, _ready(spark, sf_dir, mode="manual", manual_offset_sec=OFFSET_SEC), "strict")


def merged_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every job's own offset searched; utterances are those of the primary recording all the same."""
    return _merged(spark, sf_dir, _ready(spark, sf_dir), "strict")


def merged_partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every third chunk has no answer and a placeholder stands for it."""
    return _merged(spark, sf_dir, _ready(spark, sf_dir, mode="skip"), "best_effort", F.col("chunk_index") % 3 != 1)


class Unsteady(annotate.IdentityAnnotator):
    """Forgets the last cue of chunks with an even number of cues at first, and always where it is one of five."""

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]:
        out = super().call(prompt, expected_ids, lines)
        again = annotate.HEAD_FEEDBACK in prompt
        if len(lines) % 5 == 0 or len(lines) % 2 == 0 and not again:
            out["utterances"] = out["utterances"][:-1]
        return out


def unsteady_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, retries and errors of every chunk where the annotator has to be asked again."""
    annotate.ANNOTATORS["unsteady"] = Unsteady
    ready = _ready(spark, sf_dir, mode="skip")
    saved = _saved(spark, annotate.annotate(engine.prompts(ready), "unsteady", dual=False, backoff=0))
    return saved.select("job_id", "chunk_index", "status", "retries", "error_type", "error_message", "id_validation.passed", F.array_join("errors", "; ").alias("errors"))


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of tab-separated glossaries made of the speaker maps, with comments, headers and blank lines between."""
    names = read_table(spark, sf_dir, "speaker_map")
    row = F.concat(F.lit(" "), F.col("display_name"), F.lit(" \t"), F.col("speaker_label"))
    lines = names.select("job_id", F.explode(F.array(row, F.lit("# 用語"), F.lit("用語\t読み"), F.lit("表記"), F.lit("  "))).alias("value"))
    return side.glossary_terms(lines, ["job_id"])


def speaker_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker maps of all jobs as JSON files, read again."""
    names = read_table(spark, sf_dir, "speaker_map")
    files = names.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("speaker_label", "display_name")))).alias("content"))
    return side.speaker_maps(files)


QUERIES = {f.__name__: f for f in (prompt_dual, checkpoint_meta, merged_transcript, merged_auto, merged_partly, unsteady_answers, glossary_terms, speaker_map_files)}

_ZOOM_SQL = ", " + cues_sql("ZOOM", "zr") + f""", z AS (
  SELECT job_id, greatest(0, start - {OFFSET_SEC}::DOUBLE) AS start, speaker, text, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS pos FROM zr WHERE "end" - {OFFSET_SEC}::DOUBLE > 0 AND job_id IN (SELECT job_id FROM jobs)
), ns AS (
  SELECT k.job_id, k.chunk_index, z.pos, row_number() OVER (PARTITION BY k.job_id, k.chunk_index ORDER BY abs(z.start - k.time_start), z.pos) AS a, row_number() OVER (PARTITION BY k.job_id, k.chunk_index ORDER BY abs(z.start - k.time_end), z.pos) AS e
  FROM chunk k JOIN z ON z.job_id = k.job_id
), span AS (SELECT job_id, chunk_index, max(CASE WHEN a = 1 THEN pos END) AS lo, max(CASE WHEN e = 1 THEN pos END) AS hi FROM ns GROUP BY job_id, chunk_index),
zl AS (
  SELECT s.job_id, s.chunk_index, z.pos, CASE WHEN z.speaker <> '' THEN z.speaker || ': ' ELSE '' END || coalesce(z.text, '') AS t, row_number() OVER (PARTITION BY s.job_id, s.chunk_index ORDER BY z.pos) AS n
  FROM span s JOIN z ON z.job_id = s.job_id AND z.pos BETWEEN s.lo AND s.hi
)"""
_PARTS_SQL = """, lasts AS (SELECT job_id, max(chunk_index) AS m FROM chunk GROUP BY job_id), parts AS (
  SELECT k.job_id, k.chunk_index, 'BODY' AS role, c.pos, '[' || printf('U%06d', c.pos) || '] ' || CASE WHEN c.speaker <> '' THEN c.speaker ELSE 'UNKNOWN' END || ': ' || coalesce(c.text, '') AS t
  FROM chunk k JOIN c ON c.job_id = k.job_id AND c.pos BETWEEN k.first_pos AND k.last_pos
  UNION ALL SELECT k.job_id, k.chunk_index, 'CTX_BEFORE', c.pos, '[CTX] ' || CASE WHEN c.speaker <> '' THEN c.speaker ELSE 'UNKNOWN' END || ': ' || coalesce(c.text, '')
  FROM chunk k JOIN c ON c.job_id = k.job_id AND k.chunk_index > 0 AND c.pos < k.first_pos AND c.start >= greatest(0, k.time_start - 15)
  UNION ALL SELECT k.job_id, k.chunk_index, 'CTX_AFTER', c.pos, '[CTX] ' || CASE WHEN c.speaker <> '' THEN c.speaker ELSE 'UNKNOWN' END || ': ' || coalesce(c.text, '')
  FROM chunk k JOIN lasts USING (job_id) JOIN c ON c.job_id = k.job_id AND k.chunk_index < lasts.m AND c.pos > k.last_pos AND c."end" <= k.time_end + 15
  UNION ALL SELECT job_id, chunk_index, 'ZOOM', pos, printf('[ZOOM_REF_%03d] ', n) || t FROM zl
), g AS (SELECT job_id, chunk_index, role, string_agg(t, chr(10) ORDER BY pos) AS t FROM parts GROUP BY job_id, chunk_index, role),
w AS (SELECT job_id, chunk_index, max(CASE WHEN role = 'CTX_BEFORE' THEN t END) AS b, max(CASE WHEN role = 'BODY' THEN t END) AS m, max(CASE WHEN role = 'ZOOM' THEN t END) AS z, max(CASE WHEN role = 'CTX_AFTER' THEN t END) AS a FROM g GROUP BY job_id, chunk_index)"""
_section = lambda head, c: f"chr(10) || '{head}' || chr(10) || {c}"
_NAMED_SQL = "SELECT m.job_id, m.chunk_index, m.pos, m.id, coalesce(s.display_name, m.speaker) AS speaker, m.text, false AS uncertain, 'NONE' AS edit_type, m.start, m.\"end\", m.n_ids FROM merged m LEFT JOIN speaker_map s ON s.job_id = m.job_id AND s.speaker_label = m.speaker"
ORACLES = {
    "prompt_dual": _C + CHUNKS_SQL + _ZOOM_SQL + _PARTS_SQL
    + f"""\nSELECT job_id, chunk_index, '{annotate.instruction(True)}' || chr(10) || concat_ws(chr(10), {_section(annotate.HEAD_BEFORE, 'b')}, {_section(annotate.HEAD_PRIMARY, 'm')}, {_section(annotate.HEAD_ZOOM, 'z')}, {_section(annotate.HEAD_AFTER, 'a')}) AS prompt FROM w""",
    "checkpoint_meta": _C + CHUNKS_SQL + _ZOOM_SQL + f"""
SELECT k.job_id, k.chunk_index, 'ok' AS status, k.time_start AS start_sec, k.time_end AS end_sec, k.last_pos - k.first_pos + 1 AS primary_cues, (SELECT count(*) FROM zl WHERE zl.job_id = k.job_id AND zl.chunk_index = k.chunk_index) AS zoom_cues,
  'merge' AS api_provider, 'none' AS api_model, CASE WHEN k.job_id IN (SELECT job_id FROM jobs) THEN {OFFSET_SEC}::DOUBLE END AS offset_applied_sec, true AS passed, 0 AS retries FROM chunk k""",
    "merged_transcript": _C + CHUNKS_SQL + MERGED_SQL + _NAMED_SQL,
    "merged_auto": _C + CHUNKS_SQL + MERGED_SQL + _NAMED_SQL,
    "merged_partly": _C + CHUNKS_SQL + MERGED_SQL + _NAMED_SQL + """ WHERE m.chunk_index % 3 <> 1
UNION ALL SELECT job_id, chunk_index, 0, 'MISSING_CHUNK_' || chunk_index, 'SYSTEM', '（★ チャンク' || chunk_index || ' 処理失敗: ' || printf('%.0f', time_start) || '–' || printf('%.0f', time_end) || '秒）', true, 'UNRESOLVED',
  (SELECT min(start) FROM c WHERE c.job_id = chunk.job_id AND c.pos BETWEEN first_pos AND last_pos), (SELECT max("end") FROM c WHERE c.job_id = chunk.job_id AND c.pos BETWEEN first_pos AND last_pos), CAST(last_pos - first_pos + 1 AS INTEGER)
FROM chunk WHERE chunk_index % 3 = 1""",
    "unsteady_answers": _C + CHUNKS_SQL + """, n AS (SELECT job_id, chunk_index, last_pos - first_pos + 1 AS n, 'missing: 1 ids: [''' || printf('U%06d', last_pos) || ''']' AS m FROM chunk)
SELECT job_id, chunk_index, CASE WHEN n % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n % 5 = 0 THEN 2 WHEN n % 2 = 0 THEN 1 ELSE 0 END AS retries, CASE WHEN n % 5 = 0 THEN 'ValueError' END AS error_type,
  CASE WHEN n % 5 = 0 THEN m END AS error_message, n % 5 <> 0 AS passed, CASE WHEN n % 5 = 0 THEN m ELSE '' END AS errors FROM n""",
    "glossary_terms": "SELECT job_id, trim(display_name) AS term FROM speaker_map",
    "speaker_map_files": "SELECT job_id, speaker_label, display_name FROM speaker_map",
}
ORACLES = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLES.items()}
