"""Utterance ids: dense numbering of a job's cues, and lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import cue_id

INSERT_PREFIX = "V_INSERT_"


def number_rows(rows: DataFrame, group: list[str], order: list[str], out: str = "pos", slot: Column | None = None) -> DataFrame:
    """Dense numbers from 1 in each group, in order.

    With ``slot``, an expression that never decreases along the order (such as time over an
    hour), rows are numbered slot by slot and the slots' sizes added up, so that no window
    holds a whole group; without it one window per group is used.
    """
    if slot is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    cut = rows.withColumn("_slot", slot)
    inner = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_slot").orderBy(*order)))
    sizes = cut.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [inner[c].eqNullSafe(offsets[c]) for c in (*group, "_slot")]
    joined = inner.join(offsets, same, "left").select(*(inner[c] for c in inner.columns), "_before")
    return joined.withColumn(out, (F.col("_in") + F.col("_before")).cast("int")).drop("_slot", "_in", "_before")


def with_group_values(rows: DataFrame, values: DataFrame, group: str | list[str], slot: Column) -> DataFrame:
    """Adds to each row the values of its group, of which there is one row at most; else null.

    The values are first given to every slot of rows that the group has, so that rows meet
    them by group and slot: no task gets all rows of a group. Both joins merge sorted rows
    at every size, so nothing is broadcast that grows with the data.
    """
    keys = [group] if isinstance(group, str) else group
    cut = rows.withColumn("_slot", slot)
    slots = cut.select(*keys, "_slot").distinct().join(values.hint("merge"), keys)
    return cut.join(slots.hint("merge"), [*keys, "_slot"], "left").drop("_slot")


def assign_ids(cues: DataFrame, group: list[str], order: list[str], slot: Column | None = None) -> DataFrame:
    """Adds pos (1..n in order) and uid (U and six digits or more) to each cue of a group."""
    return number_rows(cues, group, order, "pos", slot=slot).withColumn("uid", cue_id(F.col("pos")))


def time_ranges(utterances: DataFrame, id_index: DataFrame, key: list[str], inserts: DataFrame | None = None) -> DataFrame:
    """key, start and end of each utterance: the range its source_ids span.

    ``utterances``: job_id, key columns and source_ids. ``id_index``: job_id, uid, start, end.
    Unknown ids are passed over; without any known id both are null. Ids that begin with
    V_INSERT_ are looked up in ``inserts`` (same columns) instead, empty unless given.
    """
    ids = utterances.select("job_id", *[k for k in key if k != "job_id"], F.explode("source_ids").alias("uid"))
    known = id_index.select("job_id", "uid", "start", "end").where(~F.col("uid").startswith(INSERT_PREFIX))
    if inserts is not None:
        known = known.unionByName(inserts.select("job_id", "uid", "start", "end").where(F.col("uid").startswith(INSERT_PREFIX)))
    spans = ids.join(known, ["job_id", "uid"]).groupBy(*dict.fromkeys(["job_id", *key])).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans


def get_entry(id_index: DataFrame, job_id: str, uid: str) -> DataFrame:
    """The entry of one id; the filters reach the scan."""
    return id_index.where((F.col("job_id") == job_id) & (F.col("uid") == uid))


def all_ids(id_index: DataFrame) -> DataFrame:
    """Every id of every job in order of number."""
    return id_index.select("job_id", "uid", "pos").orderBy("job_id", "pos").drop("pos")


def sizes(id_index: DataFrame) -> DataFrame:
    """Number of ids of each job."""
    return id_index.groupBy("job_id").agg(F.count(F.lit(1)).alias("size"))


def to_json(id_index: DataFrame) -> DataFrame:
    """Each entry as a JSON object, nulls kept."""
    body = F.to_json(F.struct(F.col("uid").alias("id"), "start", "end", "speaker", F.col("text").alias("raw_text")), {"ignoreNullFields": "false"})
    return id_index.select("job_id", "uid", body.alias("entry"))
