"""Speaking periods as a stream: one interval map per entity in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueloom.operators.intervals import IntervalMap

_STATE = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("lo", "hi", "n")] + [T.StructField("until", T.LongType()), T.StructField("bound", T.LongType())])


def _update(names: list[str]):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lo, hi, n, until, passed = state.get if state.exists else ([], [], [], None, None)
        held = IntervalMap(list(lo), list(hi), list(n))
        rows: list[tuple] = []
        for batch in batches:
            for a, b in zip(batch["lo"].tolist(), batch["hi"].tolist(), strict=True):
                if passed is not None and a < passed:  # what it may touch has been given out
                    rows.append((*key, "late", a, b, 1))
                else:
                    held.insert(a, b)
        bound = state.getCurrentWatermarkMs()
        if bound > 0:
            for a, b, k in held.take_before(bound):
                rows.append((*key, "period", a, b, k))
                if until is not None:
                    rows.append((*key, "gap", until, a, 0))
                until = b
            passed = bound if passed is None else max(bound, passed)
        state.update((held.lo, held.hi, held.n, until, passed))
        if held.lo:
            state.setTimeoutTimestamp(max(bound + 1, held.hi[0] + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def stream_periods(rows: DataFrame, entity: list[str], lo: str, hi: str, late: str = "1 hour") -> DataFrame:
    """Periods and gaps of a stream of intervals, given out once they can no longer change.

    ``lo`` and ``hi`` are BIGINT milliseconds since the epoch. Event time is the interval's start: the watermark
    stays ``late`` behind the newest start, and no interval that starts before it is taken in.
    So a period that ended before the watermark can be touched by none that is still to come,
    however long, and is final then. An interval whose start lies before the watermark is
    dropped by Spark, or comes out with kind late where it reaches an entity that gave out
    periods up to there. Rows with a null bound, or that end before they start, take no part.
    Result: entity, kind (period, gap, late), from_ms, to_ms, n. State per entity is the map of
    open intervals and two times, as closed ones leave it.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [T.StructField(c, kinds[c]) for c in entity]
    out = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType()), T.StructField("n", T.LongType())])
    slim = rows.where(F.col(hi) >= F.col(lo)).select(*entity, F.timestamp_millis(F.col(lo)).alias("_start"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    return slim.withWatermark("_start", late).groupBy(*entity).applyInPandasWithState(_update(out.names), out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
