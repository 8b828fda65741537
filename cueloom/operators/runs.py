"""Runs of equal neighbours in ordered sequences, for groups of any size.

A group may hold a third of all rows, so no window spans a whole group. The order axis
is cut into slots; each slot is one small window partition. Only the fragments at slot
edges, two a slot at most, meet in a second window that joins runs reaching over an edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.session import written

SLOT_MS = 1_800_000


def slot_of(ms: Column, slot_ms: int = SLOT_MS) -> Column:
    """The slot of a time in whole milliseconds."""
    return F.floor(ms / F.lit(slot_ms))


Pair = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def runs(
    rows: DataFrame,
    group: list[str],
    order: str,
    payload: list[str],
    differs: Pair,
    slot_ms: int = SLOT_MS,
    keep: list[str] | None = None,
    least: int = 1,
    close: Pair | None = None,
    same: Pair | None = None,
) -> DataFrame:
    """One row for each longest run of neighbours that do not differ.

    ``rows``: group columns, ``order`` (BIGINT milliseconds, not null, unique in its group;
    ties are broken by payload) and payload columns; where they are partitioned by group and
    by slot_of(order) as ``_slot`` already, they are not shuffled again. ``differs(before, now)`` gets two
    accessors from column name to Column and returns whether a run ends between the rows;
    null counts as a difference. Result: group columns, ``first`` and ``last`` (structs of
    order and payload, or of order and the payload columns named in ``keep``) and ``n`` (rows of
    the run, at least ``least``). An empty table gives an empty result; a group of one row gives a run of one.

    Neighbours that differ but are ``close`` belong to one run after all if ``same`` says so, which
    may be a Python function: only close pairs reach it.

    Boundary rows alone go on: position differences between successive boundaries are
    the counts, and what precedes the next boundary is the last row of a run. Runs are
    found inside slots first. Those at a slot's edges, which carry the whole row at the edge, and
    those beside a close pair are few and meet again: in their slot, then with the slots beside.
    """
    cols = [order, *payload]
    some = [order, *(payload if keep is None else keep)]
    body = rows if "_slot" in rows.columns else rows.select(*group, *cols).withColumn("_slot", slot_of(F.col(order), slot_ms)).repartition(*group, "_slot")
    w = Window.partitionBy(*group, "_slot").orderBy(order, *payload)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda name: lambda c: F.col(f"{name}.{c}")
    part = lambda name: F.struct(*(F.col(f"{name}.{c}").alias(c) for c in some))
    full = F.struct(*cols)
    apart = F.coalesce(differs(of("_prev"), F.col), F.lit(True))
    met = F.col("_prev").isNotNull() & apart & F.coalesce(close(of("_prev"), F.col), F.lit(False)) if close else F.lit(False)
    marked = (
        body.withColumn("_prev", F.lag(full).over(w))
        .withColumn("_pos", F.row_number().over(w))
        .withColumn("_size", F.count(F.lit(1)).over(whole))
        .withColumn("_end", F.last(full).over(whole))
        .where(F.col("_prev").isNull() | apart)
        .withColumn("_met", met)
    )
    wp = Window.partitionBy(*group, "_slot").orderBy("_pos")
    nxt = F.lead("_pos").over(wp)
    frags = marked.select(
        *group, "_slot", F.struct(*some).alias("first"), F.when(nxt.isNull(), part("_end")).otherwise(F.lead(part("_prev")).over(wp)).alias("last"), (F.coalesce(nxt, F.col("_size") + 1) - F.col("_pos")).alias("n"),
        F.when(F.col("_pos") == 1, full).alias("_head"), F.when(nxt.isNull(), F.col("_end")).alias("_tail"), F.when(F.col("_met"), F.col("_prev")).alias("_was"), F.when(F.col("_met"), full).alias("_is"),
        ((F.col("_pos") == 1) | nxt.isNull() | F.col("_met") | F.coalesce(F.lead("_met").over(wp), F.lit(False))).alias("_open"),
    )
    frags = written(frags.where(F.col("_open") | (F.col("n") >= least)))
    inner = frags.where(~F.col("_open")).select(*group, "first", "last", "n")
    open_ = frags.where("_open").drop("_open")
    at = F.col(f"first.{order}")
    if same:
        inside = Window.partitionBy(*group, "_slot").orderBy(at)
        joins = F.col("_was").isNotNull() & F.coalesce(same(of("_was"), of("_is")), F.lit(False))
        chains = open_.withColumn("_joins", joins).withColumn("_chain", F.sum((~F.col("_joins")).cast("long")).over(inside))
        open_ = chains.groupBy(*group, "_slot", "_chain").agg(F.min_by("first", at).alias("first"), F.max_by("last", at).alias("last"), F.sum("n").alias("n"), F.max("_head").alias("_head"), F.max("_tail").alias("_tail")).drop("_chain")
    # Those at no edge stay alone under their own key.
    edge = F.col("_head").isNotNull() | F.col("_tail").isNotNull()
    wg = Window.partitionBy(*group, "_at").orderBy("_slot", at)
    ordered = open_.withColumn("_at", F.when(~edge, F.struct("_slot", at.alias("_o")))).withColumn("_before", F.lag("_tail").over(wg))
    apart = F.coalesce(differs(of("_before"), of("_head")), F.lit(True))
    if close and same:
        apart &= ~F.coalesce(close(of("_before"), of("_head")) & same(of("_before"), of("_head")), F.lit(False))
    ordered = ordered.withColumn("_opens", F.col("_head").isNull() | F.col("_before").isNull() | apart).withColumn("_chain", F.sum(F.col("_opens").cast("long")).over(wg))
    when = F.struct("_slot", at.alias("_o"))
    edges = ordered.groupBy(*group, "_at", "_chain").agg(F.min_by("first", when).alias("first"), F.max_by("last", when).alias("last"), F.sum("n").alias("n")).drop("_at", "_chain")
    return inner.unionByName(edges.where(F.col("n") >= least))
