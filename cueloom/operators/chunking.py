"""Greedy segmentation of recordings into chunks at natural boundaries.

The next split depends only on the split before it, so segmentation is pointer chasing
on a table of successors. The table is built without comparing rows in pairs: targets
and boundaries are put in one order, and each target sees the nearest boundary of each
tier on either side. Time is cut into slots throughout; the chase first runs inside
slots, for every row by which a slot can be entered, and then over slots.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import cue_id
from cueloom.operators.grouped import map_groups
from cueloom.operators.ids import number_rows
from cueloom.session import written

SLOT_SEC = 3600.0
WALK_SLOT_SEC = 21600.0
WALK_GROWTH = 32
# The marks that end a sentence here.
SENTENCE_END = "[。.！？?]"
TIERS = {"gap": 1, "speaker": 2, "sentence": 3, "any": 4}


def boundaries(cues: DataFrame, gap_sec: float, slot_sec: float = SLOT_SEC) -> DataFrame:
    """Adds to each cue the gap to its predecessor, what changes there, and the tier (1 best).

    ``cues``: job_id, pos, start, end, speaker, text, in order of pos, starts not decreasing.
    The first cue of a job has tier null. Tiers: a pause of at least gap_sec, a change of
    speaker (both named), a sentence end before, anything.
    """
    order = Window.partitionBy("job_id", "_slot").orderBy("pos")
    rows = cues.withColumn("_slot", F.floor(F.col("pos") / 4096))
    # The predecessor of a slot's first cue comes over as one extra row a slot.
    keep = ["job_id", "pos", "end", "speaker", "text"]
    last = rows.groupBy("job_id", "_slot").agg(F.max_by(F.struct(*keep), "pos").alias("_l")).select("_l.*", (F.col("_slot") + 1).alias("_slot"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(last.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    prev = lambda c: F.lag(c).over(order)
    seen = both.withColumn("_pp", prev("pos")).withColumn("_pe", prev("end")).withColumn("_ps", prev("speaker")).withColumn("_pt", prev("text")).where(F.col("_own"))
    gap = F.col("start") - F.col("_pe")
    change = (F.coalesce(F.length("speaker"), F.lit(0)) > 0) & (F.coalesce(F.length("_ps"), F.lit(0)) > 0) & (F.col("speaker") != F.col("_ps"))
    closed = F.coalesce(F.col("_pt").rlike(rf"(?U){SENTENCE_END}\s*$"), F.lit(False))
    tier = F.when(F.col("_pp").isNull(), F.lit(None).cast("int")).when(gap >= gap_sec, 1).when(F.coalesce(change, F.lit(False)), 2).when(closed, 3).otherwise(4)
    return seen.select(*cues.columns, gap.alias("gap"), F.coalesce(change, F.lit(False)).alias("speaker_change"), closed.alias("sentence_end"), tier.alias("tier"))


def _pick(stage1: float, stage2: float, side: dict[tuple[int, str], Column], pos: Column, target: Column) -> Column:
    """The best boundary within stage1, else within stage2: least tier, then distance, then position."""
    options = []
    for tier in sorted(TIERS.values()):
        for where in ("before", "after"):
            b = side[tier, where]
            dist = F.abs(b["start"] - target)
            ok = b.isNotNull() & (dist <= max(stage1, stage2)) & (b["pos"] > pos)
            options.append(F.when(ok, F.struct((dist > stage1).alias("stage"), F.lit(tier).alias("tier"), dist.alias("dist"), b["pos"].alias("pos"), b["start"].alias("start"))))
    return F.array_min(F.array(*options))  # nulls are passed over


def successors(marked: DataFrame, target_sec: float, stage1: float, stage2: float, slot_sec: float = SLOT_SEC) -> DataFrame:
    """job_id, pos, start, next, next_start: where the chunk that begins at pos ends, null for the last.

    Position 1 stands for the start of the job, whose first target is target_sec itself. A
    boundary lies behind the row it is reached from. Rows whose target is not before the
    job's last end have no successor: that end is put as a mark into each slot that later targets can lie in.
    """
    reach = max(stage1, stage2)
    if slot_sec < 2 * reach:
        slot_sec = 2 * reach
    slot = lambda c: F.floor(c / F.lit(slot_sec))
    ends = marked.groupBy("job_id").agg(F.max_by("end", "pos").alias("_total"), slot(F.max("start") + F.lit(float(target_sec))).alias("_far"))
    ends = ends.withColumn("_slot", F.explode(F.when(slot(F.col("_total")) <= F.col("_far"), F.sequence(slot(F.col("_total")), F.col("_far"))))).select("job_id", "_slot", F.lit(2).alias("_kind"), "_total")
    first = F.col("pos") == 1
    base = marked.select("job_id", "pos", "start", F.when(first, F.lit(float(target_sec))).otherwise(F.col("start") + F.lit(float(target_sec))).alias("target"))
    sources = base.select("job_id", F.col("target").alias("_at"), slot(F.col("target")).alias("_slot"), F.lit(0).alias("_kind"), F.struct("pos", "start").alias("src"))
    cand = marked.where(F.col("tier").isNotNull()).select("job_id", F.col("start").alias("_at"), "pos", "start", "tier")
    cand = cand.withColumn("_slot", F.explode(F.sequence(slot(F.col("_at") - reach), slot(F.col("_at") + reach))))
    cand = cand.select("job_id", "_at", "_slot", F.lit(1).alias("_kind"), "tier", F.struct("pos", "start").alias("b"))
    both = sources.unionByName(cand, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    # Of boundaries at one time the first in position is seen from both sides.
    w = Window.partitionBy("job_id", "_slot")
    back = w.orderBy(F.col("_at"), F.col("_kind").desc(), F.col("b.pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.orderBy(F.col("_at").desc(), F.col("_kind").desc(), F.col("b.pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for tier in TIERS.values():
        of = F.when(F.col("tier") == tier, F.col("b"))
        both = both.withColumn(f"_b{tier}", F.last(of, ignorenulls=True).over(back)).withColumn(f"_a{tier}", F.last(of, ignorenulls=True).over(ahead))
    # Marks have no time, so they come first in the order.
    seen = both.withColumn("_total", F.max("_total").over(back)).where(F.col("_kind") == 0)
    # "Any" admits every boundary; a better tier never hides one in the wider sense.
    side = {(t, "before"): F.col(f"_b{t}") for t in TIERS.values()} | {(t, "after"): F.col(f"_a{t}") for t in TIERS.values()}
    near = _pick(stage1, stage2, side, F.col("src.pos"), F.col("_at"))
    found = seen.select("job_id", "src.pos", "src.start", F.when(F.col("_total").isNull() | (F.col("_at") < F.col("_total")), near).alias("n"))
    return found.select("job_id", "pos", "start", F.col("n.pos").alias("next"), F.col("n.start").alias("next_start"))


def _exits(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """For each row by which the slot can be entered: the first row beyond the slot, if any.

    Rows: job_id, _slot, pos, start, next, next_start, _to (the slot of next), mark, in order of
    pos. Successors lie behind. Marks say of a pos that it is an entry, once or more often.
    """
    entries = {r[2] for r in rows if r[7]}
    out: dict[int, tuple] = {}
    for _, slot, p, start, n, at, to, mark in reversed(rows):
        if not mark:
            out[p] = (start, n, at) if n is None or to != slot else (start, *out[n][1:])
    for p in entries:
        yield key[0], p, *out[p]


def _walk(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """The rows reached from those marked. Rows: job_id, ..., pos, start, next, mark in order of pos."""
    due = {r[-4] for r in rows if r[-1]}
    for *_, p, start, n, mark in rows:
        if not mark and p in due:
            yield key[0], p, start
            due.add(n)


def walk(succ: DataFrame, slot_sec: float = WALK_SLOT_SEC, growth: int = WALK_GROWTH) -> DataFrame:
    """job_id, pos and start of every row reached from position 1.

    ``succ``: job_id, pos, start, next, next_start. Inside each slot of time, each row by which the
    slot can be entered is mapped to where the walk leaves the slot; the reduced table is walked
    over slots, in longer slots again while it reaches beyond one, and the slots are then walked
    from the rows that were entered. A group holds the rows of one slot, however long its job.
    """
    slot = lambda c: F.floor(c / F.lit(slot_sec))
    rows = succ.select("job_id", slot(F.col("start")).alias("_slot"), "pos", "start", "next", "next_start", slot(F.col("next_start")).alias("_to"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    blank = [none(kinds[c]).alias(c) for c in ("start", "next", "next_start", "_to")]
    crossing = rows.where(F.col("_to") != F.col("_slot")).select("job_id", F.col("_to").alias("_slot"), F.col("next").alias("pos"), *blank)
    begins = rows.where(F.col("pos") == 1).select("job_id", "_slot", "pos", *blank)
    marks = crossing.unionByName(begins).withColumn("mark", F.lit(True))
    both = rows.withColumn("mark", F.lit(False)).unionByName(marks)
    reduced = written(map_groups(both, ["job_id", "_slot"], ["pos"], _exits, "job_id string, pos long, start double, next long, next_start double"))
    if (reduced.agg(F.max("start")).first()[0] or 0) < slot_sec * growth:
        whole = reduced.select("job_id", "pos", "start", "next", F.lit(False).alias("mark"))
        firsts = reduced.where(F.col("pos") == 1).select("job_id", "pos", none("double").alias("start"), none("long").alias("next"), F.lit(True).alias("mark"))
        reached = map_groups(whole.unionByName(firsts), ["job_id"], ["pos"], _walk, "job_id string, pos long, start double")
    else:
        reached = walk(reduced, slot_sec * growth, growth)
    entered = reached.select("job_id", slot(F.col("start")).alias("_slot"), "pos", "start", none("long").alias("next"), F.lit(True).alias("mark"))
    inner = rows.select("job_id", "_slot", F.col("pos").cast("long").alias("pos"), "start", F.col("next").cast("long").alias("next"), F.lit(False).alias("mark"))
    return map_groups(inner.unionByName(entered), ["job_id", "_slot"], ["pos"], _walk, "job_id string, pos long, start double")


def split_into_chunks(cues: DataFrame, target_sec: float = 300, stage1: float = 180, stage2: float = 300, gap_sec: float = 1.2) -> DataFrame:
    """chunks: job_id, chunk_index (from 0), first_pos, last_pos, time_start, time_end.

    ``cues``: job_id, pos, start, end, speaker, text with pos dense from 1 in order of start.
    Splits are searched within stage1 of the target and then within stage2; where neither
    has any, the rest of the job stays in its last chunk. No cues give no chunk.
    """
    marked = written(boundaries(cues, gap_sec))
    starts = walk(written(successors(marked, target_sec, stage1, stage2)))
    return ranges(starts, marked)


def ranges(starts: DataFrame, cues: DataFrame) -> DataFrame:
    """Chunk ranges from the rows at which chunks begin (job_id, pos, start).

    Chunks are numbered in slots of positions and meet their successor by number, so that
    no window holds all chunks of a job; only its last chunk asks for the job's length.
    """
    numbered = number_rows(starts, ["job_id"], ["pos"], "_k", slot=F.floor(F.col("pos") / 65536)).select("job_id", (F.col("_k") - 1).alias("chunk_index"), "pos", F.col("start").alias("time_start"))
    after = numbered.select("job_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("pos").alias("_next"))
    ends = cues.groupBy("job_id").agg(F.max("pos").alias("_n")).withColumn("_ask", F.lit(0))
    asking = numbered.join(after, ["job_id", "chunk_index"], "left").withColumn("_ask", F.when(F.col("_next").isNull(), 0).otherwise(F.col("chunk_index") + 1))
    cut = asking.join(ends, ["job_id", "_ask"], "left").select("job_id", "chunk_index", F.col("pos").alias("first_pos"), F.coalesce(F.col("_next") - 1, F.col("_n")).alias("last_pos"), "time_start")
    b = cues.select("job_id", F.col("pos").alias("last_pos"), F.col("end").alias("time_end"))
    return cut.join(b, ["job_id", "last_pos"]).select("job_id", "chunk_index", "first_pos", "last_pos", "time_start", "time_end")


def members(chunks: DataFrame) -> DataFrame:
    """job_id, chunk_index, pos, uid of the body of every chunk: positions are dense, so its range says all."""
    ids = chunks.select("job_id", "chunk_index", F.explode(F.sequence(F.col("first_pos").cast("long"), F.col("last_pos").cast("long"))).alias("pos"))
    return ids.select("job_id", "chunk_index", "pos", cue_id(F.col("pos")).alias("uid"))


def contexts(chunks: DataFrame, cues: DataFrame, overlap_sec: float = 15, slot_sec: float = 60.0) -> DataFrame:
    """job_id, chunk_index, role (CTX_BEFORE, CTX_AFTER), pos: the cues that overlap a chunk.

    Before: cues ahead of the body that start within overlap_sec of its start, but for the
    first chunk. After: cues behind the body that end within overlap_sec of its end, but for
    the last. Cues meet chunks through one-minute slots of the tested time.
    """
    more = chunks.select("job_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.lit(True).alias("_more"))
    framed = chunks.join(more, ["job_id", "chunk_index"], "left")
    slot = lambda c: F.floor(c / F.lit(slot_sec))
    lo = F.greatest(F.lit(0.0), F.col("time_start") - overlap_sec)
    before = framed.where(F.col("chunk_index") > 0).withColumn("_lo", lo).withColumn("_s", F.explode(F.sequence(slot(F.col("_lo")), F.greatest(slot(F.col("time_start")), slot(F.col("_lo"))))))
    by_start = cues.select("job_id", "pos", "start", slot(F.col("start")).alias("_s"))
    b = before.join(by_start, ["job_id", "_s"]).where((F.col("pos") < F.col("first_pos")) & (F.col("start") >= F.col("_lo"))).select("job_id", "chunk_index", F.lit("CTX_BEFORE").alias("role"), "pos")
    # A cue behind the body starts no earlier than the body's last cue, so its end lies in a bounded stretch.
    tail = cues.select("job_id", F.col("pos").alias("last_pos"), F.col("start").alias("_from"))
    after = framed.where(F.col("_more")).join(tail, ["job_id", "last_pos"]).withColumn("_hi", F.col("time_end") + overlap_sec)
    after = after.where(F.col("_hi") >= F.col("_from")).withColumn("_s", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_hi")))))
    # Only cues whose end is not before their start can be placed by start; others are placed by end.
    by_end = cues.where(F.col("end").isNotNull()).select("job_id", "pos", "end", slot(F.greatest("end", "start")).alias("_s"))
    a = after.join(by_end, ["job_id", "_s"]).where((F.col("pos") > F.col("last_pos")) & (F.col("end") <= F.col("_hi"))).select("job_id", "chunk_index", F.lit("CTX_AFTER").alias("role"), "pos")
    return b.unionByName(a)


def nearest_starts(points: DataFrame, cues: DataFrame, at: str, out: str, slot_sec: float = SLOT_SEC) -> DataFrame:
    """Adds to each point the pos of the cue of its job whose start is nearest, at any distance.

    Ties go to the first position; null where a job has no cues. A point sees the cues of its
    slot and, of every other slot, only its first and last cue, which come as one row a slot.
    """
    slot = lambda c: F.floor(c / F.lit(slot_sec))
    rows = cues.select("job_id", F.col("start").alias("_at"), F.struct(F.col("start").alias("t"), "pos").alias("_c")).withColumn("_s", slot(F.col("_at")))
    per = rows.groupBy("job_id", "_s").agg(F.max(F.struct(F.col("_c.t").alias("t"), (-F.col("_c.pos")).alias("p"))).alias("_hi"), F.min(F.struct(F.col("_c.t").alias("t"), F.col("_c.pos").alias("p"))).alias("_lo"))
    asked = points.withColumn("_s", slot(F.col(at))).select("job_id", "_s").distinct()
    edges = asked.unionByName(per, allowMissingColumns=True).groupBy("job_id", "_s").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    w = Window.partitionBy("job_id").orderBy("_s")
    edges = edges.withColumn("_pb", F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_nx", F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    marks = points.select(*points.columns, F.col(at).alias("_at"), slot(F.col(at)).alias("_s"), F.lit(0).alias("_kind"))
    both = marks.unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    win = Window.partitionBy("job_id", "_s")
    back = win.orderBy("_at", F.col("_kind").desc(), F.col("_c.pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = win.orderBy(F.col("_at").desc(), F.col("_kind").desc(), F.col("_c.pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_b", F.last("_c", ignorenulls=True).over(back)).withColumn("_a", F.last("_c", ignorenulls=True).over(ahead)).where(F.col("_kind") == 0)
    joined = seen.join(edges.select("job_id", "_s", "_pb", "_nx"), ["job_id", "_s"], "left")
    options = [F.struct(F.abs(c["t"] - F.col(at)).alias("d"), p.alias("p")) for c, p in ((F.col("_b"), F.col("_b.pos")), (F.col("_a"), F.col("_a.pos")), (F.col("_pb"), (-F.col("_pb.p"))), (F.col("_nx"), F.col("_nx.p")))]
    best = F.array_min(F.filter(F.array(*options), lambda x: x["d"].isNotNull()))["p"]
    return joined.select(*points.columns, best.alias(out))


def secondary_slices(chunks: DataFrame, secondary: DataFrame) -> DataFrame:
    """job_id, chunk_index, pos of the secondary cues that go with each chunk.

    From the cue nearest to the chunk's start to the one nearest to its end, both included;
    a cue at an edge can belong to two chunks; a reversed range is empty. Positions are dense.
    """
    a = nearest_starts(chunks.select("job_id", "chunk_index", "time_start", "time_end"), secondary, "time_start", "_from")
    b = nearest_starts(a, secondary, "time_end", "_to")
    return b.where(F.col("_from") <= F.col("_to")).select("job_id", "chunk_index", F.explode(F.sequence("_from", "_to")).alias("pos"))
