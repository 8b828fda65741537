"""Queries of this subpackage with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import canonical, mixing, nearest, packing, pieces, pii, repeats, sentences, turns
from cueloom.session import read_table


def limit(spark: SparkSession, sf_dir: str, name: str) -> float:
    """One value of size_limits, a table of four rows at every scale."""
    return read_table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).first()["amount"]


def _ms(spark: SparkSession, sf_dir: str, name: str) -> int:
    return round(limit(spark, sf_dir, name) * 1000)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.records(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "id_index"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds personal information, by kind."""
    return pii.holding(_records(spark, sf_dir), read_table(spark, sf_dir, "speaker_map"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with typed placeholders in its text."""
    return pii.redacted(_records(spark, sf_dir), read_table(spark, sf_dir, "speaker_map"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues whose text holds a disguised character."""
    return canonical.disguised(read_table(spark, sf_dir, "cues"), ["job_id", "source", "cue_index"])


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue with its text in consistent form."""
    cues = read_table(spark, sf_dir, "cues").select("job_id", "source", "cue_index", "text").dropDuplicates(["job_id", "source", "cue_index"])
    return canonical.with_canonical(cues, "text").drop("text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two cues or more that say the same thing."""
    return repeats.repeated(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "speaker_map"))


def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as one event with count and duration."""
    return repeats.cue_events(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "speaker_map"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with the PRIMARY cue that starts nearest."""
    return nearest.marked_cues(read_table(spark, sf_dir, "marks"), read_table(spark, sf_dir, "cues"), _ms(spark, sf_dir, "mark_tolerance")).drop("distance_ms")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose body exceeds the limit."""
    limit_ms = _ms(spark, sf_dir, "piece_limit")
    out = pieces.chunk_pieces(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "id_index"), limit_ms)
    return out.where((F.col("piece_index") == 0) & (F.col("body_ms") > limit_ms)).select("job_id", "chunk_index")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk in pieces under the limit, with contexts and time ranges."""
    index = read_table(spark, sf_dir, "id_index")
    cut = pieces.chunk_pieces(read_table(spark, sf_dir, "chunks"), index, _ms(spark, sf_dir, "piece_limit"))
    return pieces.with_context(cut, index, _ms(spark, sf_dir, "piece_overlap"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns; cues that name nobody form turns of UNKNOWN."""
    out = turns.turns(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "speaker_map"))
    return out.select("job_id", "speaker_label", "first_start_ms", "last_start_ms")


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns with missing labels inferred by the model."""
    return turns.turns(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "speaker_map"), infer=True)


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every cue that says something, with its speaker and the model's certainty."""
    out = turns.labelled(read_table(spark, sf_dir, "cues"), read_table(spark, sf_dir, "speaker_map"))
    return out.withColumn("probability", F.round("probability", 4))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of a larger one."""
    return packing.pack(read_table(spark, sf_dir, "documents"), int(limit(spark, sf_dir, "pack_capacity")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and unused space of every container."""
    return packing.container_loads(p8_packed(spark, sf_dir), int(limit(spark, sf_dir, "pack_capacity")))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their number of copies."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(*mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return sentences.split_sentences(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_canonical, p4_found, p4_events, p5_found, p6_found, p6_pieces, p7_found, p7_turns, p7_lines, p8_packed, p8_containers, p9_mixture, p9_shares, p10_found)}
ORACLES = {
    "p5_found": """
WITH m AS (SELECT DISTINCT mark_id, job_id, CAST(round(at_sec * 1000) AS BIGINT) AS at FROM marks WHERE job_id IS NOT NULL AND at_sec IS NOT NULL),
c AS (SELECT DISTINCT job_id, cue_index, CAST(round(start_sec * 1000) AS BIGINT) AS t FROM cues WHERE source = 'PRIMARY' AND regexp_matches(text, '[^\\s]')),
tol AS (SELECT CAST(amount * 1000 AS BIGINT) AS ms FROM size_limits WHERE limit_name = 'mark_tolerance'),
near AS (
  SELECT m.mark_id, m.job_id, c.cue_index, row_number() OVER (PARTITION BY m.mark_id ORDER BY abs(c.t - m.at), c.t, c.cue_index) AS rn
  FROM m JOIN c ON c.job_id = m.job_id JOIN tol ON abs(c.t - m.at) <= tol.ms
)
SELECT mark_id, job_id, cue_index FROM near WHERE rn = 1""",
    "p6_found": """
WITH latest AS (SELECT job_id, chunk_index, srt_ids FROM chunks QUALIFY row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY written_at DESC NULLS LAST) = 1),
named AS (SELECT DISTINCT job_id, chunk_index, unnest(srt_ids) AS uid FROM latest),
e AS (SELECT DISTINCT job_id, uid, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS t FROM id_index),
body AS (SELECT job_id, chunk_index, coalesce(max(t), max(s)) - min(s) AS ms FROM named JOIN e USING (job_id, uid) GROUP BY job_id, chunk_index)
SELECT job_id, chunk_index FROM body WHERE ms > (SELECT amount * 1000 FROM size_limits WHERE limit_name = 'piece_limit')""",
}
