"""Matching records by nearest time: marks and the cue that starts closest to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_MS = 600_000


def nearest_in_time(left: DataFrame, right: DataFrame, entity: list[str], left_ms: str, right_ms: str, left_cols: list[str], right_cols: list[str], tolerance_ms: int, slot_ms: int = SLOT_MS) -> DataFrame:
    """Each left row with the right row of its entity that is nearest in time, if near enough.

    Both tables are put into one, sorted per entity and time; each left row sees the last
    right row before it and the next one after it, and takes the nearer (the earlier on a
    tie; of right rows at one time, the least in right_cols). Time is cut into slots so that
    no window spans a whole entity: a right row also enters the neighbouring slot that
    its tolerance reaches into, so each slot decides alone and exactly.

    Rows without entity or time take no part. Result: entity, left_cols, right_cols and
    ``distance_ms``. Repeated left rows give repeated results. No column names clash unless
    left_cols and right_cols share a name, which raises ValueError.
    """
    if set(left_cols) & set(right_cols):
        raise ValueError("left_cols and right_cols must differ")
    if tolerance_ms < 0 or slot_ms <= 2 * tolerance_ms:
        raise ValueError("slot_ms must be more than twice a tolerance of at least 0")
    known = lambda t, ms: t.where(F.col(ms).isNotNull() & F.concat(*(F.col(c).cast("string") for c in entity)).isNotNull())
    slot = lambda ms: F.floor(ms / F.lit(slot_ms))
    a = known(left, left_ms).select(*entity, F.col(left_ms).cast("long").alias("_at"), slot(F.col(left_ms)).alias("_slot"), F.struct(*left_cols).alias("_l"), F.lit(None).alias("_r"))
    b = known(right, right_ms).select(*entity, F.col(right_ms).cast("long").alias("_at"), F.struct(F.col(right_ms).cast("long").alias("_t"), *right_cols).alias("_r"))
    b = b.withColumn("_slot", F.explode(F.array_distinct(F.array(slot(F.col("_at") - tolerance_ms), slot(F.col("_at") + tolerance_ms)))))
    both = a.drop("_r").unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*entity, "_slot").orderBy("_at", "_r")
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_r", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = both.withColumn("_b", before).withColumn("_a", after).where(F.col("_l").isNotNull())
    near_b, near_a = F.col("_at") - F.col("_b._t"), F.col("_a._t") - F.col("_at")
    pick = F.when(F.col("_a").isNull() | (near_b <= near_a), F.col("_b")).otherwise(F.col("_a"))
    out = seen.withColumn("_p", pick).withColumn("distance_ms", F.abs(F.col("_p._t") - F.col("_at")))
    return out.where(F.col("distance_ms") <= tolerance_ms).select(*entity, "_l.*", *(F.col(f"_p.{c}").alias(c) for c in right_cols), "distance_ms")


def marked_cues(marks: DataFrame, cues: DataFrame, tolerance_ms: int) -> DataFrame:
    """mark_id, job_id, cue_index and distance_ms of each mark near a PRIMARY cue that has words.

    A mark written several times counts once, with its latest noted_at. A text is blank
    if it is null or only white space in the sense of Unicode.
    """
    once = marks.where(F.col("job_id").isNotNull() & F.col("at_sec").isNotNull()).groupBy("mark_id").agg(F.max_by(F.struct("job_id", "at_sec"), F.col("noted_at")).alias("m"), F.first(F.struct("job_id", "at_sec")).alias("any"))
    m = F.coalesce("m", "any")
    ms = lambda c: F.round(c * 1000).cast("long")
    left = once.select("mark_id", m["job_id"].alias("job_id"), ms(m["at_sec"]).alias("at_ms"))
    right = cues.where((F.col("source") == "PRIMARY") & F.col("text").rlike(r"(?U)\S")).select("job_id", ms(F.col("start_sec")).alias("start_ms"), "cue_index")
    return nearest_in_time(left, right, ["job_id"], "at_ms", "start_ms", ["mark_id"], ["cue_index"], tolerance_ms).select("mark_id", "job_id", "cue_index", "distance_ms")
