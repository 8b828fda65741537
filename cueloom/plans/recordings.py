"""Queries on cues: numbering, boundaries, chunks and their neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators import chunking, ids
from cueloom.session import read_table, written

HOUR_SLOT = 3600.0


def cues_of(spark: SparkSession, sf_dir: str, source: str = "PRIMARY") -> DataFrame:
    """Cues of one source, each once, numbered in order of start: job_id, pos, uid, start, end, speaker, text.

    Ends that are null or before the start count as the start.
    """
    raw = read_table(spark, sf_dir, "cues").where((F.col("source") == source) & F.col("start_sec").isNotNull())
    end = F.when(F.col("end_sec") >= F.col("start_sec"), F.col("end_sec")).otherwise(F.col("start_sec"))
    once = raw.select("job_id", "cue_index", F.col("start_sec").alias("start"), end.alias("end"), "speaker", "text").dropDuplicates(["job_id", "cue_index"])
    return ids.assign_ids(once, ["job_id"], ["start", "cue_index"], slot=F.floor(F.col("start") / HOUR_SLOT))


def cue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every PRIMARY cue."""
    return cues_of(spark, sf_dir).select("job_id", "cue_index", "pos", "uid")


def cue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap, speaker change, sentence end and tier at every PRIMARY cue."""
    out = chunking.boundaries(cues_of(spark, sf_dir), 1.2)
    return out.select("job_id", "pos", F.round("gap", 3).alias("gap"), "speaker_change", "sentence_end", "tier")


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cues = written(cues_of(spark, sf_dir))
    return written(chunking.split_into_chunks(cues)), cues


def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chunks begin."""
    return _chunks(spark, sf_dir)[0].select("job_id", "chunk_index", F.col("first_pos").cast("long").alias("first_pos"))


def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and times of every chunk."""
    return _chunks(spark, sf_dir)[0].select("job_id", "chunk_index", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"), "time_start", "time_end")


def chunk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every chunk."""
    chunks, cues = _chunks(spark, sf_dir)
    return chunking.members(chunks).withColumn("pos", F.col("pos").cast("long"))


def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping cues before and after every chunk."""
    chunks, cues = _chunks(spark, sf_dir)
    return chunking.contexts(chunks, cues).withColumn("pos", F.col("pos").cast("long"))


def chunk_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ZOOM cues that go with every chunk, on the clock as recorded."""
    chunks, _ = _chunks(spark, sf_dir)
    return chunking.secondary_slices(chunks, written(cues_of(spark, sf_dir, "ZOOM"))).withColumn("pos", F.col("pos").cast("long"))


def nearest_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every mark with a job and time, the PRIMARY cue that starts nearest, at any distance."""
    marks = read_table(spark, sf_dir, "marks").where(F.col("job_id").isNotNull() & F.col("at_sec").isNotNull()).select("mark_id", "job_id", "at_sec").distinct()
    return chunking.nearest_starts(marks, written(cues_of(spark, sf_dir)), "at_sec", "pos").select("mark_id", "job_id", F.col("pos").cast("long").alias("pos"))


QUERIES = {f.__name__: f for f in (cue_ids, cue_gaps, split_points, chunk_ranges, chunk_members, chunk_context, chunk_secondary, nearest_cue)}


def cues_sql(source: str, name: str) -> str:
    """The cues_of frame as a common table expression."""
    return f"""{name}_once AS (
  SELECT DISTINCT job_id, cue_index, start_sec AS start, CASE WHEN end_sec >= start_sec THEN end_sec ELSE start_sec END AS "end", speaker, text
  FROM cues WHERE source = '{source}' AND start_sec IS NOT NULL
), {name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start, cue_index) AS BIGINT) AS pos FROM {name}_once
)"""


GAPS_SQL = """, lagged AS (
  SELECT *, lag(pos) OVER w AS pp, lag("end") OVER w AS pe, lag(speaker) OVER w AS ps, lag(text) OVER w AS pt FROM c WINDOW w AS (PARTITION BY job_id ORDER BY pos)
), gaps AS (
  SELECT job_id, pos, start, "end", start - pe AS gap,
    coalesce(speaker <> '' AND ps <> '' AND speaker <> ps, false) AS speaker_change,
    coalesce(regexp_matches(pt, '[。.！？?][\\s\\x{3000}\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}]*$'), false) AS sentence_end, pp
  FROM lagged
), b AS (
  SELECT *, CASE WHEN pp IS NULL THEN NULL WHEN gap >= 1.2 THEN 1 WHEN speaker_change THEN 2 WHEN sentence_end THEN 3 ELSE 4 END AS tier FROM gaps
)"""
CHUNKS_SQL = (
    GAPS_SQL
    + """, total AS (SELECT job_id, max_by("end", pos) AS t FROM b GROUP BY job_id),
src AS (SELECT job_id, pos, CASE WHEN pos = 1 THEN 300.0::DOUBLE ELSE start + 300.0::DOUBLE END AS target FROM b),
near AS (
  SELECT s.job_id, s.pos, j.pos AS nxt,
    row_number() OVER (PARTITION BY s.job_id, s.pos ORDER BY CASE WHEN abs(j.start - s.target) <= 180 THEN 0 ELSE 1 END, j.tier, abs(j.start - s.target), j.pos) AS rn
  FROM src s JOIN total USING (job_id) JOIN b j ON j.job_id = s.job_id AND j.pos > s.pos AND abs(j.start - s.target) <= 300 AND s.target < total.t
), succ AS (SELECT job_id, pos, nxt FROM near WHERE rn = 1),
walked AS (
  SELECT job_id, CAST(1 AS BIGINT) AS pos FROM b WHERE pos = 1
  UNION ALL SELECT w.job_id, s.nxt FROM walked w JOIN succ s ON s.job_id = w.job_id AND s.pos = w.pos
), firsts AS (
  SELECT job_id, pos AS first_pos, CAST(row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, lead(pos) OVER (PARTITION BY job_id ORDER BY pos) AS nxt FROM walked
), chunk AS (
  SELECT f.job_id, f.chunk_index, f.first_pos, coalesce(f.nxt - 1, n.n) AS last_pos, x.start AS time_start, y."end" AS time_end
  FROM firsts f JOIN (SELECT job_id, max(pos) AS n FROM c GROUP BY job_id) n USING (job_id)
  JOIN c x ON x.job_id = f.job_id AND x.pos = f.first_pos JOIN c y ON y.job_id = f.job_id AND y.pos = coalesce(f.nxt - 1, n.n)
)"""
)
_C = "WITH RECURSIVE " + cues_sql("PRIMARY", "c")
ORACLES = {
    "cue_ids": _C + "SELECT job_id, cue_index, pos, printf('U%06d', pos) AS uid FROM c",
    "cue_gaps": _C + GAPS_SQL + "SELECT job_id, pos, round(gap, 3) AS gap, speaker_change, sentence_end, tier FROM b",
    "split_points": _C + CHUNKS_SQL + "SELECT job_id, chunk_index, first_pos FROM chunk",
    "chunk_ranges": _C + CHUNKS_SQL + "SELECT job_id, chunk_index, first_pos, last_pos, time_start, time_end FROM chunk",
    "chunk_members": _C + CHUNKS_SQL + "SELECT k.job_id, k.chunk_index, c.pos, printf('U%06d', c.pos) AS uid FROM chunk k JOIN c ON c.job_id = k.job_id AND c.pos BETWEEN k.first_pos AND k.last_pos",
    "chunk_context": _C
    + CHUNKS_SQL
    + """, lasts AS (SELECT job_id, max(chunk_index) AS m FROM chunk GROUP BY job_id)
SELECT k.job_id, k.chunk_index, 'CTX_BEFORE' AS role, c.pos FROM chunk k JOIN c ON c.job_id = k.job_id AND k.chunk_index > 0 AND c.pos < k.first_pos AND c.start >= greatest(0, k.time_start - 15)
UNION ALL SELECT k.job_id, k.chunk_index, 'CTX_AFTER', c.pos FROM chunk k JOIN lasts USING (job_id) JOIN c ON c.job_id = k.job_id AND k.chunk_index < lasts.m AND c.pos > k.last_pos AND c."end" <= k.time_end + 15""",
    "chunk_secondary": _C
    + CHUNKS_SQL
    + ", "
    + cues_sql("ZOOM", "z")
    + """, ns AS (SELECT k.job_id, k.chunk_index, z.pos, row_number() OVER (PARTITION BY k.job_id, k.chunk_index ORDER BY abs(z.start - k.time_start), z.pos) AS a, row_number() OVER (PARTITION BY k.job_id, k.chunk_index ORDER BY abs(z.start - k.time_end), z.pos) AS e
  FROM chunk k JOIN z ON z.job_id = k.job_id),
span AS (SELECT job_id, chunk_index, max(CASE WHEN a = 1 THEN pos END) AS lo, max(CASE WHEN e = 1 THEN pos END) AS hi FROM ns GROUP BY job_id, chunk_index)
SELECT s.job_id, s.chunk_index, z.pos FROM span s JOIN z ON z.job_id = s.job_id AND z.pos BETWEEN s.lo AND s.hi""",
    "nearest_cue": _C
    + """, m AS (SELECT DISTINCT mark_id, job_id, at_sec FROM marks WHERE job_id IS NOT NULL AND at_sec IS NOT NULL),
r AS (SELECT m.mark_id, m.job_id, c.pos, row_number() OVER (PARTITION BY m.mark_id, m.job_id, m.at_sec ORDER BY abs(c.start - m.at_sec), c.pos) AS rn FROM m LEFT JOIN c ON c.job_id = m.job_id)
SELECT mark_id, job_id, pos FROM r WHERE rn = 1""",
}
ORACLES = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLES.items()}
