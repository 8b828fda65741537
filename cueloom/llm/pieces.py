"""Splitting oversized chunks at natural boundaries, with overlap as context."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueloom.session import written

CONTEXT_SLOT_MS = 60_000
_SENTENCE_END = "。．.！？!?…"


def least_pieces(start: list[int], end: list[int], limit: int) -> int:
    """How many pieces there must be: each is filled until the next entry would exceed the limit."""
    n, since, until = 1, start[0], end[0]
    for a, b in zip(start[1:], end[1:], strict=True):
        until = max(until, b)
        if until - since > limit:
            n, since, until = n + 1, a, b
    return n


def balanced_cuts(start: list[int], end: list[int], strength: list[float], limit: int) -> list[int]:
    """First entries of the pieces after the first.

    The least number of pieces that can do gives equal targets; each is moved to the strongest
    boundary near it; when a piece still exceeds the limit, one more piece is tried, until
    every entry is a piece. A piece of one entry may exceed the limit, as entries are never cut.
    """
    n = len(start)
    lo, hi = start[0], max(end)
    if n < 2 or hi - lo <= limit:
        return []
    begin = np.asarray(start)
    power = np.asarray(strength)

    def fits(cuts: list[int]) -> bool:
        edges = [0, *cuts, n]
        return all(b - a == 1 or max(end[a:b]) - start[a] <= limit for a, b in zip(edges, edges[1:], strict=False))

    k = max(math.ceil((hi - lo) / limit), least_pieces(start, end, limit))
    while k < n:
        width = (hi - lo) / k
        cuts: list[int] = []
        for i in range(1, k):
            target = lo + i * width
            first = (cuts[-1] if cuts else 0) + 1
            a = max(first, int(np.searchsorted(begin, target - width / 3)))
            b = int(np.searchsorted(begin, target + width / 3, side="right"))
            if a >= b:
                a, b = first, min(n, first + 1) if first >= b else b
            if a >= n:
                break
            near = np.arange(a, max(b, a + 1))
            near = near[near < n]
            score = power[near] - np.abs(begin[near] - target) / width
            cuts.append(int(near[int(np.argmax(score))]))
        if fits(cuts):
            return cuts
        k += 1
    return list(range(1, n))


def _split(limit_ms: int):
    out = to_arrow_schema(T.StructType.fromDDL(_PIECE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: job_id, chunk_index, e (entries by start), body_ms, all of chunks over the limit."""
        for batch in batches:
            done: list[tuple] = []
            for job, chunk, rows, body_ms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = [r["start_ms"] for r in rows]
                end = [max(r["start_ms"], r["end_ms"]) if r["end_ms"] is not None else r["start_ms"] for r in rows]
                strength, until = [0.0], end[0]
                for i in range(1, len(rows)):
                    pause = max(0, start[i] - until) / 1000
                    change = bool(rows[i]["speaker"]) and bool(rows[i - 1]["speaker"]) and rows[i]["speaker"] != rows[i - 1]["speaker"]
                    strength.append(min(pause, 5.0) + 1.0 * change + 0.3 * rows[i - 1]["closed"])
                    until = max(until, end[i])
                edges = [0, *balanced_cuts(start, end, strength, limit_ms), len(rows)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    done.append((job, chunk, k, len(edges) - 1, [r["uid"] for r in rows[a:b]], start[a], max(end[a:b]), start[b - 1], body_ms))
            cols = list(zip(*done, strict=True)) if done else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return run


PIECE_COLUMNS = ["job_id", "chunk_index", "piece_index", "n_pieces", "srt_ids", "start_ms", "end_ms", "last_start_ms", "body_ms", "over_limit"]
_PIECE_SCHEMA = "job_id string, chunk_index int, piece_index int, n_pieces int, srt_ids array<string>, start_ms long, end_ms long, last_start_ms long, body_ms long"


def chunk_bodies(chunks: DataFrame, id_index: DataFrame) -> DataFrame:
    """job_id, chunk_index, e (the entries of a chunk by start) and body_ms, one row a chunk.

    An entry is (start_ms, pos, uid, end_ms, speaker, closed); closed says whether its text ends a sentence, so
    that texts stay where they are read. A chunk's entries are bounded by its ids.
    """
    once = chunks.groupBy("job_id", "chunk_index").agg(F.coalesce(F.max_by("srt_ids", "written_at"), F.first("srt_ids")).alias("ids"))
    named = once.select("job_id", "chunk_index", F.posexplode(F.array_distinct("ids")).alias("pos", "uid"))
    closed = F.coalesce(F.col("raw_text").rlike(rf"(?U)[{_SENTENCE_END}]\s*$"), F.lit(False)).alias("closed")
    # One delivery of an entry is as good as another.
    entry = entries(id_index, "speaker", closed).where(F.col("start_ms").isNotNull())
    met = named.join(entry, ["job_id", "uid"])
    body = met.groupBy("job_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("start_ms", "pos", "uid", "end_ms", "speaker", "closed"))).alias("e"))
    last = F.coalesce(F.array_max("e.end_ms"), F.array_max("e.start_ms"))
    return body.withColumn("body_ms", last - F.array_min("e.start_ms"))


def chunk_pieces(chunks: DataFrame, id_index: DataFrame, limit_ms: int) -> DataFrame:
    """Every chunk's pieces, in columns PIECE_COLUMNS.

    A body lasts from the least start to the greatest end of the entries named in srt_ids,
    nulls left out; repeated entries and chunks (the latest written counts) count once.
    Bodies within the limit are one piece and never leave the JVM. Entries missing from
    id_index, and chunks of which no entry has a start, give no row. The stored time_range
    is not used, as the ids are right. ``over_limit`` marks pieces that exceed the limit all the
    same, as their one entry does.
    """
    body = written(chunk_bodies(chunks, id_index))
    last = F.array_max(F.transform("e", lambda x: F.greatest(x["end_ms"], x["start_ms"])))
    small = body.where(F.col("body_ms") <= limit_ms).select(
        "job_id", "chunk_index", F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.col("e.uid").alias("srt_ids"), F.array_min("e.start_ms").alias("start_ms"), last.alias("end_ms"), F.array_max("e.start_ms").alias("last_start_ms"), "body_ms"
    )
    large = body.where(F.col("body_ms") > limit_ms).select("job_id", "chunk_index", "e", "body_ms").mapInArrow(_split(limit_ms), _PIECE_SCHEMA)
    return small.unionByName(large.select(*small.columns)).withColumn("over_limit", F.col("end_ms") - F.col("start_ms") > limit_ms)


def entries(id_index: DataFrame, *more: str | Column) -> DataFrame:
    """id_index with times in ms and the columns asked for, each entry once."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(c.replace("_sec", "_ms"))
    return id_index.select("job_id", "uid", ms("start_sec"), ms("end_sec"), *more).dropDuplicates(["job_id", "uid"])


def with_context(pieces: DataFrame, id_index: DataFrame, overlap_ms: int) -> DataFrame:
    """Pieces with a right time_range and the entries that overlap them on either side.

    context_before: entries that start up to overlap_ms before the piece; context_after:
    entries that start after the piece's last entry, up to overlap_ms after its end. Both are
    arrays of (start_sec, end_sec, uid, speaker, text) in order of start, empty where nothing is
    near. Entries meet pieces through one-minute slots, so no job is gathered whole.
    """
    slot = lambda ms: F.floor(ms / F.lit(CONTEXT_SLOT_MS))
    key = ["job_id", "chunk_index", "piece_index"]
    wants = pieces.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit("b").alias("side"), (F.col("start_ms") - overlap_ms).alias("lo"), (F.col("start_ms") - 1).alias("hi")),
                F.struct(F.lit("a").alias("side"), (F.col("last_start_ms") + 1).alias("lo"), (F.col("end_ms") + overlap_ms).alias("hi")),
            )
        ).alias("w"),
    ).select(*key, "w.*")
    wants = wants.withColumn("_slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    around = entries(id_index, "speaker", "raw_text").where(F.col("start_ms").isNotNull()).withColumn("_slot", slot(F.col("start_ms")))
    met = wants.join(around, ["job_id", "_slot"]).where(F.col("start_ms").between(F.col("lo"), F.col("hi")))
    cue = F.struct((F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "uid", "speaker", F.col("raw_text").alias("text"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, cue)))
    ctx = met.groupBy(*key).agg(side("b").alias("context_before"), side("a").alias("context_after"))
    none = F.array().cast("array<struct<start_sec:double,end_sec:double,uid:string,speaker:string,text:string>>")
    return pieces.join(ctx, key, "left").select(
        *key, "n_pieces", "srt_ids", "over_limit", F.struct((F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec")).alias("time_range"),
        F.coalesce("context_before", none).alias("context_before"), F.coalesce("context_after", none).alias("context_after"),
    )
