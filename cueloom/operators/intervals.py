"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Each entity keeps an ordered map of disjoint intervals. An insertion finds the intervals
it overlaps by binary search, merges them and thereby updates the gaps. Interval maps
merge associatively, so a hot entity is cut along time into slots that are mapped apart;
only the outermost periods of each slot meet again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.session import written

SLOT_MS = 3_600_000


class IntervalMap:
    """Disjoint closed intervals in order, each with the number of insertions it holds."""

    __slots__ = ("lo", "hi", "n")

    def __init__(self, lo: list[int] | None = None, hi: list[int] | None = None, n: list[int] | None = None) -> None:
        self.lo, self.hi, self.n = lo or [], hi or [], n or []

    def insert(self, lo: int, hi: int, n: int = 1) -> None:
        """Adds [lo, hi]; intervals that overlap or touch it become one with it."""
        a = bisect_left(self.hi, lo)  # first that ends at lo or later
        b = bisect_right(self.lo, hi)  # first that starts after hi
        if a < b:
            lo, hi, n = min(lo, self.lo[a]), max(hi, self.hi[b - 1]), n + sum(self.n[a:b])
        self.lo[a:b], self.hi[a:b], self.n[a:b] = [lo], [hi], [n]

    def gaps(self) -> list[tuple[int, int]]:
        """Stretches between neighbours."""
        return list(zip(self.hi[:-1], self.lo[1:], strict=True))

    def take_before(self, bound: int) -> list[tuple[int, int, int]]:
        """Removes and returns the intervals that end before bound."""
        k = bisect_left(self.hi, bound)
        out = list(zip(self.lo[:k], self.hi[:k], self.n[:k], strict=True))
        del self.lo[:k], self.hi[:k], self.n[:k]
        return out


def _slot_maps(entity: list[str]):
    keys = [*entity, "_slot"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key, so one map is held at a time."""
        key, held = None, IntervalMap()
        done: list[tuple] = []

        def close() -> None:
            done.extend((*key, lo, hi, n, nxt) for lo, hi, n, nxt in zip(held.lo, held.hi, held.n, [*held.lo[1:], None], strict=True))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[*keys, "lo", "hi", "n", "nxt"])
            out["nxt"] = out["nxt"].astype("Int64")
            done.clear()
            return out

        for batch in batches:
            cols = [batch[c].tolist() for c in (*keys, "lo", "hi")]
            for row in zip(*cols, strict=True):
                if row[:-2] != key:
                    if key is not None:
                        close()
                    key, held = row[:-2], IntervalMap()
                held.insert(row[-2], row[-1])
            if len(done) >= 10_000:
                yield frame()
        if key is not None:
            close()
        if done:
            yield frame()

    return run


def merge_intervals(rows: DataFrame, entity: list[str], lo: str, hi: str, identity: list[str] | None = None, slot_ms: int = SLOT_MS) -> DataFrame:
    """Continuous periods of each entity, with the start of the period that follows.

    ``lo`` and ``hi`` are BIGINT milliseconds. Result: entity columns, ``from_ms``, ``to_ms``,
    ``n`` (intervals merged) and ``next_from_ms`` (null for an entity's last period). Intervals
    that overlap or touch form one period. Left out: rows with a null in an entity column,
    in lo or in hi, and rows that end before they start. Rows equal in entity, start and
    ``identity`` count once; without identity every row counts. Extra columns are ignored.
    """
    keep = [*entity, *(identity or [])]
    cond = F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) >= F.col(lo))
    for c in entity:
        cond &= F.col(c).isNotNull()
    cut = rows.where(cond).select(*dict.fromkeys(keep), F.col(lo).alias("lo"), F.col(hi).alias("hi")).withColumn("_slot", F.floor(F.col("lo") / slot_ms))
    keys = [*entity, "_slot"]
    cut = cut.repartition(*keys)
    if identity:
        cut = cut.dropDuplicates([*keys, "lo", *[c for c in identity if c not in keys]])
    fields = {f.name: f for f in cut.schema.fields}
    schema = T.StructType([*(T.StructField(c, fields[c].dataType) for c in keys), *(T.StructField(c, T.LongType()) for c in ("lo", "hi", "n", "nxt"))])
    periods = cut.select(*keys, "lo", "hi").sortWithinPartitions(*keys).mapInPandas(_slot_maps(entity), schema)
    periods = written(periods)  # read by several branches below; the maps are built once

    # What each slot needs to know of the others: one row a slot.
    over = Window.partitionBy(*entity).orderBy("_slot")
    slot = Window.partitionBy(*keys)
    # Every slot's first row carries the slot's summary, so only those rows meet in a window.
    held = periods.withColumn("_first", F.min("lo").over(slot)).withColumn("_max", F.max("hi").over(slot))
    summary = held.where(F.col("lo") == F.col("_first")).select(*keys, "_first", "_max")
    summary = summary.withColumn("_carry", F.max("_max").over(over.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.lead("_first").over(over)).drop("_first", "_max")
    seen = periods.join(summary, keys, "left")
    head = F.coalesce(F.col("lo") <= F.col("_carry"), F.lit(False))
    marked = seen.withColumn("_head", head).withColumn("_edge", head | F.col("nxt").isNull()).withColumn("_next", F.coalesce("nxt", "_after"))
    inner = marked.where(~F.col("_edge")).select(*entity, F.col("lo").alias("from_ms"), F.col("hi").alias("to_ms"), "n", F.col("_next").alias("next_from_ms"))
    # Periods of a slot that reach back into an earlier one are one period with it.
    edge = (
        marked.where(F.col("_edge"))
        .groupBy(*keys, "_head")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.max_by(F.col("_next"), F.col("lo")).alias("_next"))
    )
    ordered = Window.partitionBy(*entity).orderBy("_slot", "lo")
    edge = (
        edge.withColumn("_until", F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_chain", F.sum(F.when(F.col("lo") <= F.col("_until"), 0).otherwise(1)).over(ordered))
        .groupBy(*entity, "_chain")
        .agg(F.min("lo").alias("from_ms"), F.max("hi").alias("to_ms"), F.sum("n").alias("n"), F.max_by("_next", F.struct("_slot", "lo")).alias("next_from_ms"))
        .drop("_chain")
    )
    return inner.unionByName(edge.select(*inner.columns))


def gaps_of(periods: DataFrame, entity: list[str], least_ms: int = 1, below_ms: int | None = None) -> DataFrame:
    """The stretches between neighbouring periods: entity columns, from_ms, to_ms."""
    size = F.col("next_from_ms") - F.col("to_ms")
    cond = F.col("next_from_ms").isNotNull() & (size >= least_ms)
    if below_ms is not None:
        cond &= size < below_ms
    return periods.where(cond).select(*entity, F.col("to_ms").alias("from_ms"), F.col("next_from_ms").alias("to_ms"))
