"""Queries on the speaking periods of each speaker label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators.intervals import gaps_of, merge_intervals
from cueloom.session import read_table

ENTITY = ["job_id", "source", "speaker"]
GAP_LEAST_MS, GAP_BELOW_MS = 120_000, 3_600_000


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = read_table(spark, sf_dir, "cues").where(F.col("speaker") != "")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    slim = cues.select(*ENTITY, "cue_index", ms("start_sec").alias("lo"), ms("end_sec").alias("hi"))
    return merge_intervals(slim, ENTITY, "lo", "hi", ["cue_index"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of two cues or more, and gaps of two minutes up to an hour."""
    # Each period yields up to two rows, so the interval maps are built once.
    gap = F.col("next_from_ms") - F.col("to_ms")
    rows = F.array(
        F.when(F.col("n") >= 2, F.struct(F.lit("period").alias("kind"), "from_ms", "to_ms")),
        F.when((gap >= GAP_LEAST_MS) & (gap < GAP_BELOW_MS), F.struct(F.lit("gap").alias("kind"), F.col("to_ms").alias("from_ms"), F.col("next_from_ms").alias("to_ms"))),
    )
    return _periods(spark, sf_dir).select(*ENTITY, F.explode(F.array_compact(rows)).alias("r")).select("r.kind", *ENTITY, "r.from_ms", "r.to_ms")


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every continuous period with its number of cues and the gap after it."""
    return _periods(spark, sf_dir).select(*ENTITY, "from_ms", "to_ms", "n", (F.col("next_from_ms") - F.col("to_ms")).alias("gap_ms"))


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}

_ISLANDS = """
WITH once AS (
  SELECT DISTINCT job_id, source, speaker, cue_index, CAST(round(start_sec * 1000) AS BIGINT) AS lo, CAST(round(end_sec * 1000) AS BIGINT) AS hi
  FROM cues WHERE speaker <> '' AND job_id IS NOT NULL AND source IS NOT NULL AND end_sec >= start_sec
), marked AS (
  SELECT *, max(hi) OVER (PARTITION BY job_id, source, speaker ORDER BY lo, hi, cue_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM once
), chained AS (
  SELECT *, sum(CASE WHEN lo <= until THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, source, speaker ORDER BY lo, hi, cue_index) AS chain FROM marked
), periods AS (
  SELECT job_id, source, speaker, min(lo) AS from_ms, max(hi) AS to_ms, count(*) AS n FROM chained GROUP BY job_id, source, speaker, chain
), followed AS (
  SELECT *, lead(from_ms) OVER (PARTITION BY job_id, source, speaker ORDER BY from_ms) AS next_from_ms FROM periods
)
"""
ORACLES = {
    "p2_found": _ISLANDS
    + f"""SELECT 'period' AS kind, job_id, source, speaker, from_ms, to_ms FROM followed WHERE n >= 2
UNION ALL SELECT 'gap', job_id, source, speaker, to_ms, next_from_ms FROM followed
WHERE next_from_ms - to_ms >= {GAP_LEAST_MS} AND next_from_ms - to_ms < {GAP_BELOW_MS}""",
    "p2_periods": _ISLANDS + "SELECT job_id, source, speaker, from_ms, to_ms, n, next_from_ms - to_ms AS gap_ms FROM followed",
}
