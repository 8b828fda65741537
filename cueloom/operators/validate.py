"""Integrity checks of annotated chunks: coverage, duplicates, unknown ids, contiguity, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.timecode import id_number
from cueloom.operators.ids import INSERT_PREFIX


def contiguous(ids: Column) -> Column:
    """Whether ids count up by one; true for none or one, and where any has no number."""
    nums = F.transform(ids, id_number)
    steps = F.forall(F.sequence(F.lit(1), F.size(nums) - 1), lambda i: F.get(nums, i) == F.get(nums, i - 1) + 1)
    return F.when((F.size(ids) <= 1) | F.exists(nums, lambda n: n.isNull()), F.lit(True)).otherwise(steps)


def first_five(ids: Column) -> Column:
    """The first five ids as they stand in messages."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(ids, 1, 5), lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]"))


def _strings(*cols: Column) -> Column:
    return F.array_compact(F.array(*cols)) if cols else F.array().cast("array<string>")


def validate(outputs: DataFrame) -> DataFrame:
    """One row a chunk: passed, errors, warnings and the ids behind them.

    ``outputs``: any key columns, expected_ids ARRAY<STRING>, utterances ARRAY<STRUCT<id, source_ids, ...>>
    (null counts as empty) and optionally context_ids ARRAY<STRING>. Result columns: the keys,
    passed, errors, warnings, missing_ids, duplicate_ids, unknown_ids, non_contiguous, leaked_ids.
    Everything is array arithmetic within the row: nothing is shuffled.
    """
    keys = [c for c in outputs.columns if c not in ("expected_ids", "utterances", "context_ids")]
    expected = F.coalesce("expected_ids", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    utts = F.col("utterances")
    empty = F.coalesce(F.size(utts) <= 0, F.lit(True))
    inserted = lambda i: i.startswith(INSERT_PREFIX)
    all_ids = F.coalesce(F.flatten(F.transform(utts, lambda u: F.coalesce(u["source_ids"], none))), none)
    rows = outputs.withColumn("_exp", expected).withColumn("_all", all_ids).withColumn("_ids", F.coalesce(F.transform(utts, lambda u: F.coalesce(u["id"], F.lit(""))), none))
    exp, got = F.col("_exp"), F.col("_all")
    missing = F.array_except(exp, got)
    counted = F.filter(got, lambda i: ~inserted(i))
    dup = F.filter(F.array_distinct(counted), lambda i: F.size(F.filter(counted, lambda x: x == i)) > 1)
    unknown = F.sort_array(F.filter(F.array_except(got, exp), lambda i: ~inserted(i)))
    bad_u = F.filter("_ids", lambda i: i.startswith("U") & ~F.array_contains(exp, i))
    bad_form = F.filter("_ids", lambda i: (F.length(i) > 0) & ~i.startswith("U") & ~inserted(i))
    broken = F.transform(F.filter(utts, lambda u: ~contiguous(F.filter(F.coalesce(u["source_ids"], none), lambda i: i.startswith("U")))), lambda u: F.coalesce(u["id"], F.lit("")))
    leaked = F.sort_array(F.array_intersect(got, F.coalesce("context_ids", none))) if "context_ids" in outputs.columns else none
    made = rows.select(
        *keys, empty.alias("_empty"), missing.alias("missing_ids"), dup.alias("duplicate_ids"), unknown.alias("unknown_ids"), F.coalesce(broken, none).alias("non_contiguous"), leaked.alias("leaked_ids"),
        F.transform(bad_u, lambda i: F.concat(F.lit("invalid id: unexpected U id "), i)).alias("_u"), F.transform(bad_form, lambda i: F.concat(F.lit("invalid id format: "), i)).alias("_f"),
    )
    message = lambda c, what: F.when(F.size(c) > 0, F.concat(F.lit(f"{what}: "), F.size(c).cast("string"), F.lit(" ids: "), first_five(F.col(c))))
    errors = F.concat("_u", "_f", _strings(message("missing_ids", "missing"), message("duplicate_ids", "duplicate"), message("unknown_ids", "unknown")))
    warnings = F.concat(F.transform("non_contiguous", lambda i: F.concat(F.lit("non-contiguous source_ids: "), i)), _strings(message("leaked_ids", "context leak")))
    lists = ["missing_ids", "duplicate_ids", "unknown_ids", "non_contiguous", "leaked_ids"]
    out = made.withColumn("errors", F.when(F.col("_empty"), F.array(F.lit("no utterances"))).otherwise(errors)).withColumn("warnings", F.when(F.col("_empty"), none).otherwise(warnings))
    for c in lists:
        out = out.withColumn(c, F.when(F.col("_empty"), none).otherwise(F.col(c)))
    return out.select(*keys, (F.size("errors") == 0).alias("passed"), "errors", "warnings", *lists)
