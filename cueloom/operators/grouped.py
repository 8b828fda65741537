"""Python work on many small groups without the cost of one Python call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FLUSH = 10_000


def map_groups(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fn(key, rows) of every group, its rows sorted by order, as a table of the given schema.

    Rows reach fn as tuples of the columns in their own order, nulls as None. Partitions are
    sorted by key and streamed, so one group is held at a time; groups must be bounded.
    """
    names = rows.columns
    at = [names.index(k) for k in keys]
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        done: list[tuple] = []

        def frame() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * len(out)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)
            done.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(row[i] for i in at)
                if now != key:
                    if held:
                        done.extend(fn(key, held))
                    key, held = now, []
                held.append(row)
            if len(done) >= FLUSH:
                yield frame()
        if held:
            done.extend(fn(key, held))
        yield frame()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
