"""Filling fixed-capacity containers with whole documents.

Sizes are whole tokens up to the capacity, so the instance is a histogram of at most
capacity numbers, however many documents there are. On it, reduction by dominance after
Martello and Toth fixes small sets that provably dominate every alternative, with as
many copies at once as the histogram holds; best fit packs the rest. The containers are
thus few kinds, each a pattern of sizes with a multiplicity; documents meet them by
their rank among those of equal size, without any document leaving its partition order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.tokens import TOKENIZER, cut_tokens, encoder
from cueloom.session import written

SALTS = 64
PER_SALT = 1_000_000  # more buckets where a size has more documents than so many a bucket


@dataclass
class Kind:
    """So many containers with so many documents of each size."""

    times: int
    holds: dict[int, int]

    def load(self) -> int:
        return sum(s * n for s, n in self.holds.items())


class _Sizes:
    """A multiset of sizes in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.order[bisect_left(self.order, size)]

    def largest_within(self, limit: int) -> int:
        i = bisect_right(self.order, limit)
        return self.order[i - 1] if i else 0

    def smallest_sum(self, k: int) -> int:
        """Sum of the k smallest members, or a very large number if there are fewer."""
        total = 0
        for s in self.order:
            n = min(k, self.count[s])
            total += n * s
            k -= n
            if not k:
                return total
        return 1 << 60

    def two_above(self, size: int) -> int:
        """Sum of the two smallest members above a size, very large if there are fewer."""
        i, left, total = bisect_right(self.order, size), 2, 0
        while i < len(self.order) and left:
            n = min(left, self.count[self.order[i]])
            total += n * self.order[i]
            left -= n
            i += 1
        return 1 << 60 if left else total

    def best_pair(self, limit: int) -> tuple[int, int]:
        """The two members (a >= b) with the greatest sum within the limit; zeros if none fit."""
        best, pair = 0, (0, 0)
        lo, hi = 0, bisect_right(self.order, limit) - 1
        while lo <= hi:
            a, b = self.order[hi], self.order[lo]
            if a + b > limit:
                hi -= 1
            else:
                if a + b > best and (a != b or self.count[a] > 1):
                    best, pair = a + b, (a, b)
                lo += 1
        return pair


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Kind], dict[int, int]]:
    """Containers that some best packing holds, and the sizes that remain.

    For a document of size s and the room left beside it: if nothing more fits, it stands
    alone; if one document fills the room, or only one more fits at all, the largest that
    fits goes with it; if at most two fit, the largest alone if no pair exceeds it, or it with a
    second if every other pair is dominated. Each step is applied to all equal documents.
    """
    sizes, kinds = _Sizes(counts), []
    for s in sorted(sizes.count, reverse=True):
        while sizes.count.get(s):
            room = capacity - s
            sizes.take(s, 1)  # the document itself is not its own company
            least = sizes.order[0] if sizes.order else capacity + 1
            best = sizes.largest_within(room)
            company: tuple[int, ...] | None = None
            if least > room:
                company = ()
            elif best == room or sizes.smallest_sum(2) > room:
                company = (best,)
            elif sizes.smallest_sum(3) > room:
                a, b = sizes.best_pair(room)
                if best >= a + b:
                    company = (best,)
                elif a == best and sizes.two_above(b) > room:
                    company = (a, b)
            if sizes.count.get(s):
                sizes.count[s] += 1
            else:
                sizes.count[s] = 1
                insort(sizes.order, s)
            if company is None:
                break
            need: dict[int, int] = {s: 1}
            for x in company:
                need[x] = need.get(x, 0) + 1
            # Removals only raise the sums compared above, so the step holds for every copy.
            times = min(sizes.count[x] // k for x, k in need.items())
            for x, k in need.items():
                sizes.take(x, times * k)
            kinds.append(Kind(times, need))
    return kinds, dict(sizes.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best fit in order of decreasing size, equal containers and documents taken together."""
    by_room: dict[int, list[Kind]] = {}
    rooms: list[int] = []

    def put(room: int, kind: Kind) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(kind)

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * s, Kind(full, {s: each}))
                if rest:
                    put(capacity - rest * s, Kind(1, {s: rest}))
                break
            room = rooms[i]
            kind = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                del rooms[i]
            times = min(n, kind.times)
            if times < kind.times:
                put(room, Kind(kind.times - times, dict(kind.holds)))
            kind.holds[s] = kind.holds.get(s, 0) + 1
            put(room - s, Kind(times, kind.holds))
            n -= times
    return [k for kinds in by_room.values() for k in kinds]


def pack_sizes(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Containers for a histogram of sizes between 1 and the capacity."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer containers: total size over capacity, rounded up."""
    return -(-sum(s * n for s, n in counts.items()) // capacity)


def _pieces(capacity: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            where: list[int] = []
            cols: list[list[int]] = [[], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = enc.encode_ordinary(text) if text else []
                if not tokens:
                    continue
                cut = [(0, len(tokens), 0, len(text))] if len(tokens) <= capacity else cut_tokens(tokens, capacity, path)
                for k, (a, b, c, d) in enumerate(cut):
                    where.append(i)
                    for col, v in zip(cols, (k, b - a, c, d), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.int32()) for c in cols)], ["doc_id", "piece", "tokens", "from_char", "to_char"])

    return run


def document_pieces(documents: DataFrame, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, tokens, from_char, to_char: whole documents, or the pieces of larger ones.

    A document delivered several times counts once. Null and empty texts have no tokens and
    no row.
    """
    kind = dict(documents.dtypes)["doc_id"]
    out = documents.where(F.length("text") > 0).select("doc_id", "text").mapInArrow(_pieces(capacity, path), f"doc_id {kind}, piece int, tokens int, from_char int, to_char int")
    return out.dropDuplicates(["doc_id", "piece"])


def pack(documents: DataFrame, capacity: int, path: str = TOKENIZER, salts: int = SALTS, per_salt: int = PER_SALT) -> DataFrame:
    """The container of every document: container_id, doc_id, piece, tokens, from_char, to_char.

    The driver sees the histogram of sizes, at most ``capacity`` rows; what it sends back is
    bounded by the capacity alone. Ranks among equal sizes are counted in ``salts`` buckets or more, one
    for each ``per_salt`` documents of the most frequent size, so that a size shared by a third of all
    documents is ranked by as many tasks as it needs.
    """
    items = written(document_pieces(documents, capacity, path))
    spark = items.sparkSession
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(salts, -(-max(histogram.values(), default=0) // per_salt))
    items = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    buckets = items.groupBy("tokens", "_salt").agg(F.count(F.lit(1)).alias("n"))
    rows, container, used = [], 0, dict.fromkeys(histogram, 0)
    for kind in pack_sizes(histogram, capacity):
        for size, each in kind.holds.items():
            rows.append((size, used[size], used[size] + kind.times * each, container, each))
            used[size] += kind.times * each
        container += kind.times
    places = spark.createDataFrame(rows, "tokens int, first long, until long, container long, each long")
    offset = Window.partitionBy("tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.withColumn("_before", F.coalesce(F.sum("n").over(offset), F.lit(0))).drop("n")
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy("doc_id", "piece")) - 1)
    # Both sides lie by size and bucket already, so this join moves nothing.
    ranked = ranked.join(before, ["tokens", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    put = ranked.join(F.broadcast(places), "tokens").where((F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("until")))
    return put.select((F.col("container") + F.floor((F.col("_rank") - F.col("first")) / F.col("each"))).alias("container_id"), "doc_id", "piece", "tokens", "from_char", "to_char")


def container_loads(packed: DataFrame, capacity: int) -> DataFrame:
    """container_id, n_items, tokens and unused tokens of every container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


__all__ = ["Kind", "best_fit", "container_loads", "document_pieces", "lower_bound", "pack", "pack_sizes", "reduce_by_dominance"]
