"""The clock offset between two recordings of a job: fuzzy matches in sample windows and
robust statistics over their time differences."""

from __future__ import annotations

import difflib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import WEIGHTS, normalize_for_matching, normalize_plain
from cueloom.operators.grouped import map_groups
from cueloom.operators.ids import with_group_values
from cueloom.session import written

# Confidence limits and the drift flag.
HIGH_PAIRS, HIGH_SIGMA, MEDIUM_SIGMA, DRIFT_SEC = 5, 1.0, 2.0, 1.0
SAMPLE_WINDOWS = ["head", "mid", "tail"]

# Fields of a result and of its report.
RESULT_FIELDS = ["estimated_offset_sec", "confidence", "valid_pairs", "total_pairs_before_filter", "mad", "std_dev", "method", "sample_windows_used", "drift_detected", "drift_delta_sec", "top_candidates", "applied_offset_sec", "override", "excluded_vtt_cues"]
WINDOW_SLOT_SEC = 600.0
ROW_SLOT = 65536
_CANDIDATES = "array<struct<offset_sec:double,score:double,pair_count:int>>"


def sample_windows(cues: DataFrame, names: list[str], duration: float) -> DataFrame:
    """job_id, window, lo, hi of the sample windows of each job's primary recording.

    The length T is the end of the last cue in list order (pos). head is the first duration
    seconds, mid lies around 45 % of T, tail is the last duration seconds. Under one and a
    half durations only head is used; unknown names are passed over.
    """
    total = cues.groupBy("job_id").agg(F.max_by("end", "pos").alias("t"))
    t, half = F.col("t"), duration / 2
    lo_hi = {
        "head": (F.lit(0.0), F.least(F.lit(float(duration)), t)),
        "mid": (F.greatest(F.lit(0.0), t * 0.45 - half), F.least(t, t * 0.45 + half)),
        "tail": (F.greatest(F.lit(0.0), t - duration), t),
    }
    known = [n for n in names if n in lo_hi]
    make = lambda n: F.struct(F.lit(n).alias("window_name"), lo_hi[n][0].alias("lo"), lo_hi[n][1].alias("hi"))
    long_enough = F.array(*map(make, known)) if known else F.array().cast("array<struct<window_name:string,lo:double,hi:double>>")
    short = F.array(make("head"))
    return total.where(t.isNotNull()).select("job_id", F.explode(F.when(t < 1.5 * duration, short).otherwise(long_enough)).alias("w")).select("job_id", "w.*")


def in_windows(cues: DataFrame, windows: DataFrame) -> DataFrame:
    """Cues with each window of their job that contains them whole.

    Windows are a bounded stretch of seconds, so they are given to each slot of time they
    cover, and cues meet them by job and slot.
    """
    slot = lambda c: F.floor(c / F.lit(WINDOW_SLOT_SEC))
    cut = windows.where(F.col("lo") <= F.col("hi")).withColumn("_slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    return cues.withColumn("_slot", slot(F.col("start"))).join(cut, ["job_id", "_slot"]).where((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))).drop("_slot")


def best_match(a: str, grams: set[str], pool: list[tuple[float, str, set[str], frozenset[str]]], by_gram: dict[str, list[int]], sequence: bool, threshold: float) -> tuple[float, int]:
    """The best score and position of a text in a pool; ties go to the first.

    Shared n-grams are counted over posting lists. With them and the digits known, the score
    without its sequence part plus the whole weight of that part bounds it from above, so
    the costly ratio is taken in order of the bound and only while it can still win.
    """
    wj, wq, wk = WEIGHTS
    digits = frozenset(regex.findall(r"\d+", a))
    shared: dict[int, int] = defaultdict(int)
    for g in grams:
        for i in by_gram.get(g, ()):
            shared[i] += 1
    if threshold < wj or not sequence:  # a pair without a shared n-gram can still reach the threshold
        shared = {i: shared.get(i, 0) for i in range(len(pool))}
    bounds = []
    for i, c in shared.items():
        _, b, other, d = pool[i]
        j = c / (len(grams) + len(other) - c)
        k = 0.5 if not digits and not d else len(digits & d) / len(digits | d)
        known = (wj * j, wk * k)
        # The ratio counts matching letters twice over both lengths, so lengths bound it.
        most = 2 * min(len(a), len(b)) / (len(a) + len(b)) if sequence else 0.0
        bounds.append((wj * j + wk * k + wq * most, -i, known))
    best, where = 0.0, -1
    letters = Counter(a)
    for bound, neg, (pj, pk) in sorted(bounds, reverse=True):
        i = -neg
        if bound < max(best, threshold) - 1e-9:
            break
        if sequence:
            b = pool[i][1]
            common = sum(min(n, letters[ch]) for ch, n in Counter(b).items())
            if pj + wq * (2 * common / (len(a) + len(b))) + pk < max(best, threshold) - 1e-9:
                continue
            score = pj + wq * difflib.SequenceMatcher(None, a, b).ratio() + pk
        else:
            score = pj + pk
        if score > best or score == best and where >= 0 and i < where:
            best, where = score, i
    return best, where


def _grams(text: str, n: int = 3) -> set[str]:
    return {text} if 0 < len(text) < n else {text[i : i + n] for i in range(len(text) - n + 1)}


def _match(threshold: float, sequence: bool):
    def run(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """Rows: job_id, window_name, side, pos, start, norm, in order of pos."""
        pool, where = [], []
        for *_, one, p, s, t in rows:
            if one == 1:
                pool.append((s, t, _grams(t), frozenset(regex.findall(r"\d+", t))))
                where.append(p)
        by_gram: dict[str, list[int]] = defaultdict(list)
        for i, p in enumerate(pool):
            for g in p[2]:
                by_gram[g].append(i)
        seen: dict[str, tuple[float, int]] = {}
        for *_, one, p, s, t in rows:
            if one == 0:
                if t not in seen:
                    seen[t] = best_match(t, _grams(t), pool, by_gram, sequence, threshold)
                score, i = seen[t]
                if i >= 0 and score >= threshold:
                    yield *key, p, where[i], score, pool[i][0] - s

    return run


_MATCHES = "job_id string, window_name string, pos long, secondary_pos long, score double, delta double"


def match_windows(primary: DataFrame, secondary: DataFrame, windows: DataFrame, threshold: float, margin: float, max_offset: float, use_reading: bool = False, sequence: bool = True, compatibility: bool = True) -> DataFrame:
    """The best secondary cue for every primary cue of every sample window.

    Both sides: job_id, pos, start, end, text. Result: job_id, window, pos, secondary_pos,
    score, delta (secondary start less primary start). A secondary cue is searched within
    max_offset and margin around the window; score 0 never matches; the limit on the
    difference holds after the best match is chosen. Windows and search ranges are bounded
    in seconds, so each (job, window) is a small group however long its job.
    """
    norm = (lambda c: normalize_for_matching(c, use_reading)) if compatibility else normalize_plain
    cols = ["job_id", "window_name", F.lit(0).alias("side"), "pos", "start", norm(F.col("text")).alias("norm")]
    left = in_windows(primary, windows).select(*cols)
    around = windows.select("job_id", "window_name", F.greatest(F.lit(0.0), F.col("lo") - max_offset - margin).alias("lo"), (F.col("hi") + max_offset + margin).alias("hi"))
    right = in_windows(secondary, around).select(*cols[:2], F.lit(1).alias("side"), *cols[3:])
    both = left.unionByName(right).where(F.length("norm") > 0)
    found = map_groups(both, ["job_id", "window_name"], ["pos"], _match(threshold, sequence), _MATCHES)
    return found.where(F.abs("delta") <= max_offset)


def robust_stats(deltas: DataFrame, mad_k: float, min_pairs: int) -> DataFrame:
    """One row a job: median, mad, valid pairs after the outlier filter, offset, sigma, confidence, drift.

    ``deltas``: job_id, window, delta. The filter keeps what lies within mad_k deviations of
    the median; it keeps all where the deviation is 0 or nothing would remain. Drift compares
    the medians of tail and head over all deltas. The deltas of a job come from three windows of
    bounded length, so they are gathered once and all else is array arithmetic within the row.
    """
    med = lambda a: F.try_divide(F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int")), F.lit(2.0))
    part = lambda name: F.sort_array(F.collect_list(F.when(F.col("window_name") == name, F.col("delta"))))
    rows = deltas.groupBy("job_id").agg(F.sort_array(F.collect_list("delta")).alias("_all"), part("head").alias("_h"), part("tail").alias("_t"))
    rows = rows.withColumn("median", med(F.col("_all"))).withColumn("total_pairs", F.size("_all"))
    rows = rows.withColumn("mad", med(F.array_sort(F.transform("_all", lambda d: F.abs(d - F.col("median"))))))
    rows = rows.withColumn("_in", F.filter("_all", lambda d: (F.col("mad") == 0) | (F.abs(d - F.col("median")) <= mad_k * F.col("mad"))))
    rows = rows.withColumn("_kept", F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_all")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, d: s + f(d))
    n = F.size("_kept")
    rows = rows.withColumn("_mean", total("_kept", lambda d: d) / n)
    rows = rows.withColumn("sigma", F.when(n > 1, F.sqrt(total("_kept", lambda d: (d - F.col("_mean")) * (d - F.col("_mean"))) / (n - 1))).otherwise(F.lit(0.0)))
    drift = F.abs(med(F.col("_t")) - med(F.col("_h")))
    return rows.select("job_id", "median", "mad", "total_pairs", n.alias("valid_pairs"), med(F.col("_kept")).alias("offset"), "sigma", confidence(n, F.col("sigma"), min_pairs).alias("confidence"), drift.alias("drift"), F.coalesce(drift > DRIFT_SEC, F.lit(False)).alias("drift_detected"))


def confidence(n: Column, sigma: Column, min_pairs: int) -> Column:
    """HIGH from five pairs within a second, MEDIUM from min_pairs within two, else LOW."""
    return F.when((n >= HIGH_PAIRS) & (sigma <= HIGH_SIGMA), "HIGH").when((n >= min_pairs) & (sigma <= MEDIUM_SIGMA), "MEDIUM").otherwise("LOW")


def half_even(value: Column, digits: int) -> Column:
    """Rounds the exact binary value, as Spark's own rounding of its decimal text does not."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits) if v is not None and v == v else None).astype(float)

    return run(value)


def detect_offsets(jobs: DataFrame, primary: DataFrame, secondary: DataFrame, config: dict, sequence: bool = True, compatibility: bool = True) -> DataFrame:
    """One offset result a job: job_id and RESULT_FIELDS.

    ``jobs``: job_id of every job wanted. Modes: skip gives 0, manual the set value, both with
    HIGH confidence; auto estimates. A job without matches gets LOW confidence and zeros.
    Without ``sequence`` or ``compatibility`` the matches do without those parts.
    """
    mode = config.get("mode", "auto")
    if mode in ("skip", "manual"):
        value = 0.0 if mode == "skip" else float(config["manual_offset_sec"])
        return constant_result(jobs, mode, value, None if mode == "skip" else value)
    if mode != "auto":
        raise ValueError(f"unknown offset mode {mode!r}")
    windows = sample_windows(primary, config["sample_windows"], config["window_duration_sec"])
    deltas = match_windows(primary, secondary, windows, config["similarity_threshold"], config["vtt_search_margin_sec"], config["max_offset_sec"], config.get("use_reading_normalization", False), sequence, compatibility)
    stats = robust_stats(deltas, config["mad_k"], config["min_valid_pairs"])
    used = windows.groupBy("job_id").agg(F.collect_set("window_name").alias("_w"))  # three names at most
    order = F.array(*(F.lit(n) for n in config["sample_windows"])).cast("array<string>")
    off = F.coalesce(half_even(F.col("offset"), 3), F.lit(0.0))
    n = F.coalesce("valid_pairs", F.lit(0))
    fields = {
        "estimated_offset_sec": off, "confidence": F.coalesce("confidence", F.lit("LOW")), "valid_pairs": n, "total_pairs_before_filter": F.coalesce("total_pairs", F.lit(0)),
        "mad": F.coalesce(half_even(F.col("mad"), 4), F.lit(0.0)), "std_dev": F.coalesce(half_even(F.col("sigma"), 4), F.lit(0.0)), "method": F.lit("auto"),
        "sample_windows_used": F.filter(order, lambda x: F.array_contains(F.coalesce("_w", F.array().cast("array<string>")), x)), "drift_detected": F.coalesce("drift_detected", F.lit(False)), "drift_delta_sec": half_even(F.col("drift"), 3),
        "top_candidates": F.when(n > 0, F.array(F.struct(off.alias("offset_sec"), F.lit(0.0).alias("score"), n.alias("pair_count")))).otherwise(F.array().cast(_CANDIDATES)),
        "applied_offset_sec": off, "override": F.lit(None).cast("double"), "excluded_vtt_cues": F.lit(0).cast("long"),
    }
    full = jobs.select("job_id").distinct().join(stats, "job_id", "left").join(used, "job_id", "left")
    return full.select("job_id", *(fields[f].alias(f) for f in RESULT_FIELDS))


def constant_result(jobs: DataFrame, method: str, value: float = 0.0, override: float | None = None) -> DataFrame:
    """The same certain result for every job, as for skip, manual and a single recording."""
    fields = {
        "estimated_offset_sec": F.lit(value), "confidence": F.lit("HIGH"), "valid_pairs": F.lit(0), "total_pairs_before_filter": F.lit(0), "mad": F.lit(0.0), "std_dev": F.lit(0.0), "method": F.lit(method),
        "sample_windows_used": F.array().cast("array<string>"), "drift_detected": F.lit(False), "drift_delta_sec": F.lit(None).cast("double"), "top_candidates": F.array().cast(_CANDIDATES),
        "applied_offset_sec": F.lit(value), "override": F.lit(override).cast("double"), "excluded_vtt_cues": F.lit(0).cast("long"),
    }
    return jobs.select("job_id").distinct().select("job_id", *(fields[f].alias(f) for f in RESULT_FIELDS))


def no_secondary_result(jobs: DataFrame, method: str = "single_vtt") -> DataFrame:
    """The result of jobs without a second recording."""
    return constant_result(jobs, method)


def apply_offset(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """Cues shifted back by their job's applied_offset_sec; those that end at 0 or before drop out.

    Starts are held at 0. Jobs without an offset are not shifted.
    """
    by = F.coalesce("applied_offset_sec", F.lit(0.0))
    moved = with_group_values(cues, offsets.select("job_id", "applied_offset_sec"), "job_id", F.floor(F.col("pos") / ROW_SLOT)).withColumn("start", F.greatest(F.lit(0.0), F.col("start") - by)).withColumn("end", F.col("end") - by)
    return moved.where(F.col("end") > 0).drop("applied_offset_sec").select(*cues.columns)


def excluded_counts(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """How many cues of each job the shift drops."""
    by = F.coalesce("applied_offset_sec", F.lit(0.0))
    return with_group_values(cues, offsets.select("job_id", "applied_offset_sec"), "job_id", F.floor(F.col("pos") / ROW_SLOT)).groupBy("job_id").agg(F.count_if(F.col("end") - by <= 0).alias("excluded"))


def with_excluded(results: DataFrame, cues: DataFrame) -> DataFrame:
    """Results with the number of secondary cues that their offset drops.

    The results are written once, as they are read both here and for the count.
    """
    results = written(results)
    got = excluded_counts(cues, results)
    return results.drop("excluded_vtt_cues").join(got, "job_id", "left").withColumn("excluded_vtt_cues", F.coalesce("excluded", F.lit(0))).drop("excluded")


def report(results: DataFrame) -> DataFrame:
    """job_id and the offset report as JSON, nulls kept."""
    return results.select("job_id", F.to_json(F.struct(*RESULT_FIELDS), {"ignoreNullFields": "false"}).alias("report"))


def mad(values: np.ndarray) -> float:
    """Median absolute deviation; 0 of nothing."""
    v = np.asarray(values, dtype=float)
    return float(np.median(np.abs(v - np.median(v)))) if v.size else 0.0
