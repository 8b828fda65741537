"""Queries on text normalisation, similarity and the clock offset."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.config import DEFAULTS
from cueloom.functions import text, timecode
from cueloom.operators import offset
from cueloom.plans.recordings import _C, cues_of, cues_sql
from cueloom.session import read_table, written


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the form for matching."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.normalize_for_matching(F.col("text")).alias("normalized"))


def normalize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without compatibility composition."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.normalize_plain(F.col("text")).alias("normalized"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk contexts against the entries named before them: pairs (a, b) of the same job."""
    cues = written(cues_of(spark, sf_dir).select("job_id", "pos", text.normalize_plain(F.coalesce("text", F.lit(""))).alias("t")))
    after = cues.select("job_id", (F.col("pos") - 1).alias("pos"), F.col("t").alias("b"))
    return cues.withColumnRenamed("t", "a").join(after, ["job_id", "pos"])


def ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct 3-grams of every cue."""
    return cues_of(spark, sf_dir).select("job_id", "pos", F.size(text.char_ngrams(text.normalize_plain(F.coalesce("text", F.lit(""))))).alias("n_grams"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-gram Jaccard of every cue and the next."""
    return _neighbours(spark, sf_dir).select("job_id", "pos", F.round(text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b"))), 6).alias("jaccard"))


def digit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit-run overlap of every cue and the next."""
    return _neighbours(spark, sf_dir).select("job_id", "pos", F.round(text.digit_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def hybrid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted similarity of every cue and the next."""
    return _neighbours(spark, sf_dir).select("job_id", "pos", F.round(text.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence ratio of every cue and the next, where neither is empty."""
    pairs = _neighbours(spark, sf_dir).where((F.length("a") > 0) & (F.length("b") > 0))
    return pairs.select("job_id", "pos", F.round(text.sequence_ratio("a", "b"), 6).alias("ratio"))


def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start as a time code in both dialects, and either parsed again; the short form where the hour is 0."""
    cues = cues_of(spark, sf_dir)
    vtt, srt = timecode.format_timecode(F.col("start")), timecode.format_timecode(F.col("start"), ",")
    short = F.when(F.substring(vtt, 1, 2) == "00", F.substring(vtt, 4, 9))
    parsed = {"parsed": vtt, "parsed_srt": srt, "parsed_short": short}
    return cues.select("job_id", "pos", vtt.alias("vtt"), srt.alias("srt"), *(F.round(timecode.parse_timecode(c), 3).alias(n) for n, c in parsed.items()))


def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample windows of every job."""
    out = offset.sample_windows(cues_of(spark, sf_dir), offset.SAMPLE_WINDOWS, 300)
    return out.select("job_id", "window_name", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return written(cues_of(spark, sf_dir)), written(cues_of(spark, sf_dir, "ZOOM"))


def offset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ZOOM match of every PRIMARY cue in the sample windows, by n-grams and digits alone."""
    a, b = _sides(spark, sf_dir)
    windows = offset.sample_windows(a, offset.SAMPLE_WINDOWS, 300)
    out = offset.match_windows(a, b, windows, 0.6, 300, 600, sequence=False, compatibility=False)
    return out.select("job_id", "window_name", "pos", "secondary_pos", F.round("score", 6).alias("score"), F.round("delta", 3).alias("delta"))


def offset_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sequence ratio and compatibility composition."""
    a, b = _sides(spark, sf_dir)
    out = offset.match_windows(a, b, offset.sample_windows(a, offset.SAMPLE_WINDOWS, 300), 0.6, 300, 600)
    return out.withColumn("score", F.round("score", 6)).withColumn("delta", F.round("delta", 3))


def offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, deviation, filtered offset, confidence and drift from the n-gram matches."""
    a, b = _sides(spark, sf_dir)
    out = offset.robust_stats(offset.match_windows(a, b, offset.sample_windows(a, offset.SAMPLE_WINDOWS, 300), 0.6, 300, 600, sequence=False, compatibility=False), 3.0, 3)
    rounded = {c: F.round(c, 3) for c in ("median", "mad", "offset", "sigma", "drift")}
    return out.withColumns(rounded)


def offset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full offset result of every job."""
    a, b = _sides(spark, sf_dir)
    return flat_results(_results(spark, sf_dir, a, b))


def _results(spark: SparkSession, sf_dir: str, primary: DataFrame, secondary: DataFrame, **how: bool) -> DataFrame:
    jobs = read_table(spark, sf_dir, "jobs").select("job_id")
    return offset.with_excluded(offset.detect_offsets(jobs, primary, secondary, DEFAULTS["offset"], **how), secondary)


def flat_results(results: DataFrame) -> DataFrame:
    """Offset results with their lists as text: window names joined, candidates as offset:score:pairs."""
    names = F.array_join("sample_windows_used", ",")
    top = F.array_join(F.transform("top_candidates", lambda t: F.format_string("%.3f:%.1f:%d", t["offset_sec"], t["score"], t["pair_count"])), ",")
    return results.withColumn("sample_windows_used", names).withColumn("top_candidates", top)


def offset_results_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset result of every job from n-grams and digits alone."""
    a, b = _sides(spark, sf_dir)
    return flat_results(_results(spark, sf_dir, a, b, sequence=False, compatibility=False))


def offset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset report of every job as JSON, read again field by field."""
    a, b = _sides(spark, sf_dir)
    kinds = "estimated_offset_sec double, confidence string, valid_pairs int, total_pairs_before_filter int, mad double, std_dev double, method string, sample_windows_used array<string>, drift_detected boolean, drift_delta_sec double, "
    kinds += "top_candidates array<struct<offset_sec:double,score:double,pair_count:int>>, applied_offset_sec double, override double, excluded_vtt_cues long"
    report = offset.report(_results(spark, sf_dir, a, b)).select("job_id", F.from_json("report", kinds).alias("r"))
    return flat_results(report.select("job_id", "r.*"))


def fixed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of jobs whose offset is not searched: skipped, set to 12.5 seconds, or with one recording."""
    jobs = read_table(spark, sf_dir, "jobs")
    none = jobs.limit(0)
    skip, manual = ({"mode": m, "manual_offset_sec": 12.5} for m in ("skip", "manual"))
    made = [offset.detect_offsets(jobs, none, none, skip), offset.detect_offsets(jobs, none, none, manual), offset.no_secondary_result(jobs)]
    return flat_results(made[0].unionByName(made[1]).unionByName(made[2]))


def apply_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZOOM cues shifted by a fixed 12.5 seconds, those before 0 dropped."""
    cues = cues_of(spark, sf_dir, "ZOOM")
    fixed = offset.constant_result(read_table(spark, sf_dir, "jobs"), "manual", 12.5, 12.5)
    return offset.apply_offset(cues, fixed).select("job_id", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


QUERIES = {
    f.__name__: f
    for f in (normalize_text, normalize_plain, ngram_profile, ngram_jaccard, digit_overlap, hybrid_similarity, sequence_ratio, timecodes, sample_windows, offset_match, offset_match_full, offset_stats, offset_results, offset_results_plain, offset_report, fixed_offsets, apply_offset)
}

_SPACES = "[\\s\\x{3000}\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]+"


def _norm_sql(col: str) -> str:
    out = f"regexp_replace(lower({col}), '[。、．，.!！?？…～〜・\\-–—\"''「」『』（）()【】\\[\\]{{}}]', '', 'g')"
    for w in text.FILLERS:
        out = f"replace({out}, '{w}', '')"
    return f"trim(regexp_replace({out}, '{_SPACES}', ' ', 'g'))"


_GRAMS = "CASE WHEN length({0}) = 0 THEN []::VARCHAR[] WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct([substring({0}, i, 3) FOR i IN range(1, length({0}) - 1)]) END"
_NORMED = _C + f", t AS (SELECT job_id, pos, start, \"end\", {_norm_sql('coalesce(text, $$$$)')} AS t FROM c)".replace("$$$$", "''")
_PAIRS = _NORMED + f""", g AS (SELECT job_id, pos, t, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9０-９]+')) AS d FROM t),
p AS (SELECT a.job_id, a.pos, a.g AS ga, b.g AS gb, a.d AS da, b.d AS db FROM g a JOIN g b ON a.job_id = b.job_id AND b.pos = a.pos + 1)
"""
_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_WINDOWS = """, total AS (SELECT job_id, max_by("end", pos) AS t FROM c GROUP BY job_id),
windows AS (
  SELECT job_id, 'head' AS window_name, 0.0::DOUBLE AS lo, least(300.0::DOUBLE, t) AS hi FROM total
  UNION ALL SELECT job_id, 'mid', greatest(0.0::DOUBLE, t * 0.45::DOUBLE - 150), least(t, t * 0.45::DOUBLE + 150) FROM total WHERE t >= 450
  UNION ALL SELECT job_id, 'tail', greatest(0.0::DOUBLE, t - 300), t FROM total WHERE t >= 450
)"""
def ratio_sql(pairs: str, keys: str) -> str:
    """Common table expressions that end in ratios(keys, ratio) for pairs(keys, a, b), neither text empty.

    The longest common stretch splits a pair of stretches into those before and behind it, over and over. In
    texts from 200 characters on, frequent characters do not begin a stretch, but may extend one.
    """
    return f""", ca AS (SELECT {keys}, unnest(range(length(a))) AS i, unnest(string_split(a, '')) AS ch FROM {pairs}),
cb AS (SELECT {keys}, length(b) AS lb, unnest(range(length(b))) AS j, unnest(string_split(b, '')) AS ch FROM {pairs}),
often AS (SELECT {keys}, ch FROM cb WHERE lb >= 200 GROUP BY {keys}, ch, lb HAVING count(*) > lb // 100 + 1),
same AS MATERIALIZED (SELECT {keys}, i, j, o.ch IS NULL AS rare FROM ca JOIN cb USING ({keys}, ch) LEFT JOIN often o USING ({keys}, ch)),
seg AS (
  SELECT {keys}, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi, 0 AS size FROM {pairs}
  UNION ALL
  SELECT {keys}, unnest([alo, i + k]), unnest([i, ahi]), unnest([blo, j + k]), unnest([j, bhi]), unnest([k, 0]) FROM (
    SELECT {keys}, alo, ahi, blo, bhi, min(i) AS i, min(j) AS j, count(*) AS k, max(run) AS run FROM (
      SELECT *, sum(rare::INT) OVER (PARTITION BY {keys}, alo, blo, j - i, island, stretch) AS run FROM (
        SELECT *, i - row_number() OVER (PARTITION BY {keys}, alo, blo, j - i ORDER BY i) AS island, i - row_number() OVER (PARTITION BY {keys}, alo, blo, j - i, rare ORDER BY i) AS stretch
        FROM (SELECT {keys}, alo, ahi, blo, bhi, i, j, rare FROM seg JOIN same USING ({keys}) WHERE i >= alo AND i < ahi AND j >= blo AND j < bhi)
      )
    ) GROUP BY {keys}, alo, ahi, blo, bhi, j - i, island
  ) QUALIFY row_number() OVER (PARTITION BY {keys}, alo, blo ORDER BY run DESC, i, j) = 1
), ratios AS (SELECT {keys}, 2.0::DOUBLE * sum(size) / any_value(length(a) + length(b)) AS ratio FROM seg JOIN {pairs} USING ({keys}) GROUP BY {keys})"""


def _compatible() -> str:
    """Rows of every character with a compatibility decomposition and that decomposition, from the Unicode tables."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for code in (*range(0xA0, 0x3400), *range(0xA700, 0xAC00), *range(0xF900, 0x10000), *range(0x10780, 0x107C0), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1F100, 0x1F300), *range(0x1FBF0, 0x1FBFA)):
        full = unicodedata.normalize("NFKD", chr(code))
        if full != unicodedata.normalize("NFD", chr(code)):
            out.append(f"({quoted(chr(code))}, {quoted(full)})")
    return ", ".join(out)


def nfkc_sql(name: str, rows: str, col: str) -> str:
    """Common table expressions that end in name: the rows with col in compatibility composition."""
    return f"""{name}_n AS (SELECT *, row_number() OVER () AS _n FROM {rows}),
{name}_c AS (SELECT _n, unnest(string_split({col}, '')) AS ch, unnest(range(length({col}))) AS i FROM {name}_n WHERE regexp_matches({col}, '[^\x00-\x7f]')),
{name}_k AS (SELECT _n, nfc_normalize(string_agg(coalesce(m.dst, ch), '' ORDER BY i)) AS _t FROM {name}_c LEFT JOIN (VALUES {_compatible()}) m(src, dst) ON m.src = ch GROUP BY _n),
{name} AS (SELECT * EXCLUDE (_n, _t) REPLACE (coalesce(_t, {col}) AS {col}) FROM {name}_n LEFT JOIN {name}_k USING (_n))"""


_HYBRID = _NORMED + f""", g AS (SELECT job_id, pos, t, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9０-９]+')) AS d FROM t),
q AS (SELECT a.job_id, a.pos, a.t AS a, b.t AS b, a.g AS ga, b.g AS gb, a.d AS da, b.d AS db FROM g a JOIN g b ON a.job_id = b.job_id AND b.pos = a.pos + 1),
p AS (SELECT * FROM q WHERE a <> '' AND b <> '')""" + ratio_sql("p", "job_id, pos")
_MATCHES = (
    _C + _WINDOWS + ", " + cues_sql("ZOOM", "z")
    + f""", ta AS (SELECT job_id, pos, start, "end", {_norm_sql("coalesce(text, '')")} AS t FROM c), tb AS (SELECT job_id, pos, start, "end", {_norm_sql("coalesce(text, '')")} AS t FROM z),
ga AS (SELECT *, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9０-９]+')) AS d FROM ta WHERE t <> ''),
gb AS (SELECT *, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9０-９]+')) AS d FROM tb WHERE t <> ''),
scored AS (
  SELECT w.job_id, w.window_name, a.pos, b.pos AS secondary_pos, b.start - a.start AS delta,
    0.5::DOUBLE * (len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))))
    + 0.2::DOUBLE * (CASE WHEN len(a.d) + len(b.d) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(a.d, b.d))::DOUBLE / (len(a.d) + len(b.d) - len(list_intersect(a.d, b.d))) END) AS score
  FROM windows w JOIN ga a ON a.job_id = w.job_id AND a.start >= w.lo AND a."end" <= w.hi
  JOIN gb b ON b.job_id = w.job_id AND b.start >= greatest(0.0, w.lo - 900) AND b."end" <= w.hi + 900
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY job_id, window_name, pos ORDER BY score DESC, secondary_pos) = 1
), matches AS (SELECT job_id, window_name, pos, secondary_pos, score, delta FROM best WHERE score >= 0.6 AND abs(delta) <= 600)
"""
)
# The matches with every part of the score: of all pairs those go on whose score can still reach the threshold.
_FULL_MATCHES = (
    _C + _WINDOWS + ", " + cues_sql("ZOOM", "z") + ", " + nfkc_sql("ck", "c", "text") + ", " + nfkc_sql("zk", "z", "text")
    + f""", ta AS (SELECT job_id, pos, start, "end", {_norm_sql("coalesce(text, '')")} AS t FROM ck), tb AS (SELECT job_id, pos, start, "end", {_norm_sql("coalesce(text, '')")} AS t FROM zk),
ga AS (SELECT *, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9]+')) AS d FROM ta WHERE t <> ''),
gb AS (SELECT *, {_GRAMS.format('t')} AS g, list_distinct(regexp_extract_all(t, '[0-9]+')) AS d FROM tb WHERE t <> ''),
bounded AS (
  SELECT w.job_id, w.window_name, a.pos, b.pos AS secondary_pos, b.start - a.start AS delta, a.t AS a, b.t AS b,
    0.5::DOUBLE * (len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))) AS sj,
    0.2::DOUBLE * (CASE WHEN len(a.d) + len(b.d) = 0 THEN 0.5::DOUBLE ELSE len(list_intersect(a.d, b.d))::DOUBLE / (len(a.d) + len(b.d) - len(list_intersect(a.d, b.d))) END) AS sd
  FROM windows w JOIN ga a ON a.job_id = w.job_id AND a.start >= w.lo AND a."end" <= w.hi
  JOIN gb b ON b.job_id = w.job_id AND b.start >= greatest(0.0, w.lo - 900) AND b."end" <= w.hi + 900
), near AS MATERIALIZED (SELECT * FROM bounded WHERE sj + sd + 0.3 >= 0.59)""" + ratio_sql("near", "job_id, window_name, pos, secondary_pos") + """,
scored AS (SELECT *, sj + 0.3::DOUBLE * ratio + sd AS score FROM near JOIN ratios USING (job_id, window_name, pos, secondary_pos)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY job_id, window_name, pos ORDER BY score DESC, secondary_pos) = 1),
matches AS (SELECT job_id, window_name, pos, secondary_pos, score, delta FROM best WHERE score >= 0.6 AND abs(delta) <= 600)
"""
)
_STATS = """, med AS (SELECT job_id, median(delta) AS m, CAST(count(*) AS INTEGER) AS n, median(delta) FILTER (WHERE window_name = 'head') AS h, median(delta) FILTER (WHERE window_name = 'tail') AS t FROM matches GROUP BY job_id),
md AS (SELECT job_id, median(abs(delta - m)) AS mad FROM matches JOIN med USING (job_id) GROUP BY job_id),
k AS (SELECT x.job_id, x.delta, (md.mad = 0 OR abs(x.delta - med.m) <= 3 * md.mad) AS ok FROM matches x JOIN med USING (job_id) JOIN md USING (job_id)),
s AS (SELECT job_id, count(*) FILTER (WHERE ok) AS n, median(delta) FILTER (WHERE ok) AS off, coalesce(stddev_samp(delta) FILTER (WHERE ok), 0) AS sd FROM k GROUP BY job_id),
stats AS (
  SELECT med.job_id, med.m AS median, md.mad AS mad, med.n AS total_pairs, CAST(s.n AS INTEGER) AS valid_pairs, s.off AS "offset", s.sd AS sigma,
    CASE WHEN s.n >= 5 AND s.sd <= 1 THEN 'HIGH' WHEN s.n >= 3 AND s.sd <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, abs(med.t - med.h) AS drift, coalesce(abs(med.t - med.h) > 1, false) AS drift_detected
  FROM med JOIN md USING (job_id) JOIN s USING (job_id)
)
"""
# A number is rounded from its exact binary value by way of its text.
_RESULTS = _STATS + """, used AS (SELECT job_id, string_agg(window_name, ',' ORDER BY CASE window_name WHEN 'head' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END) AS names FROM windows GROUP BY job_id),
r AS (
  SELECT j.job_id, coalesce(CAST(printf('%.3f', s."offset") AS DOUBLE), 0.0) AS off, coalesce(s.confidence, 'LOW') AS confidence, coalesce(s.valid_pairs, 0) AS n, coalesce(s.total_pairs, 0) AS total,
    coalesce(CAST(printf('%.4f', s.mad) AS DOUBLE), 0.0) AS mad, coalesce(CAST(printf('%.4f', s.sigma) AS DOUBLE), 0.0) AS sd, coalesce(u.names, '') AS names, coalesce(s.drift_detected, false) AS dd, CAST(printf('%.3f', s.drift) AS DOUBLE) AS drift
  FROM (SELECT DISTINCT job_id FROM jobs) j LEFT JOIN stats s USING (job_id) LEFT JOIN used u USING (job_id)
)
SELECT r.job_id, off AS estimated_offset_sec, confidence, n AS valid_pairs, total AS total_pairs_before_filter, mad, sd AS std_dev, 'auto' AS method, names AS sample_windows_used, dd AS drift_detected, drift AS drift_delta_sec,
  CASE WHEN n > 0 THEN printf('%.3f:%.1f:%d', off, 0.0::DOUBLE, n) ELSE '' END AS top_candidates, off AS applied_offset_sec, CAST(NULL AS DOUBLE) AS override,
  (SELECT count(*) FROM z WHERE z.job_id = r.job_id AND z."end" - r.off <= 0) AS excluded_vtt_cues
FROM r"""
_FIXED = """SELECT job_id, {0}::DOUBLE AS estimated_offset_sec, 'HIGH' AS confidence, 0 AS valid_pairs, 0 AS total_pairs_before_filter, 0.0::DOUBLE AS mad, 0.0::DOUBLE AS std_dev, '{1}' AS method, '' AS sample_windows_used, false AS drift_detected,
  CAST(NULL AS DOUBLE) AS drift_delta_sec, '' AS top_candidates, {0}::DOUBLE AS applied_offset_sec, CAST({2} AS DOUBLE) AS override, CAST(0 AS BIGINT) AS excluded_vtt_cues FROM (SELECT DISTINCT job_id FROM jobs)"""
ORACLES = {
    "normalize_plain": f"SELECT doc_id, {_norm_sql('text')} AS normalized FROM documents",
    "ngram_profile": _NORMED + f"SELECT job_id, pos, CAST(len({_GRAMS.format('t')}) AS INTEGER) AS n_grams FROM t",
    "ngram_jaccard": _PAIRS + f"SELECT job_id, pos, round({_JACCARD.format('ga', 'gb')}, 6) AS jaccard FROM p",
    "digit_overlap": _PAIRS + f"SELECT job_id, pos, round(CASE WHEN len(da) + len(db) = 0 THEN 0.5 ELSE {_JACCARD.format('da', 'db')} END, 6) AS overlap FROM p",
    "timecodes": _C
    + """, f AS (SELECT job_id, pos, start, printf('%02d:%02d:%02d', CAST(trunc(start / 3600) AS BIGINT), CAST(trunc((floor(start) % 3600) / 60) AS BIGINT), CAST(floor(start) % 60 AS BIGINT)) AS hms, printf('%03d', CAST(trunc((start % 1) * 1000) AS BIGINT)) AS ms FROM c)
SELECT job_id, pos, hms || '.' || ms AS vtt, hms || ',' || ms AS srt, round(floor(start) + CAST(ms AS DOUBLE) / 1000, 3) AS parsed, parsed AS parsed_srt, CASE WHEN start < 3600 THEN parsed END AS parsed_short FROM f""",
    "sample_windows": _C + _WINDOWS + "SELECT job_id, window_name, round(lo, 6) AS lo, round(hi, 6) AS hi FROM windows",
    "offset_match": _MATCHES + "SELECT job_id, window_name, pos, secondary_pos, round(score, 6) AS score, round(delta, 3) AS delta FROM matches",
    "offset_stats": _MATCHES + _STATS + """SELECT job_id, round(median, 3) AS median, round(mad, 3) AS mad, total_pairs, valid_pairs, round("offset", 3) AS "offset", round(sigma, 3) AS sigma, confidence, round(drift, 3) AS drift, drift_detected FROM stats""",
    "normalize_text": "WITH " + nfkc_sql("d", "documents", "text") + f" SELECT doc_id, {_norm_sql('text')} AS normalized FROM d",
    "sequence_ratio": _HYBRID + " SELECT job_id, pos, round(ratio, 6) AS ratio FROM ratios",
    "hybrid_similarity": _HYBRID + f""" SELECT job_id, pos, round(CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * {_JACCARD.format('ga', 'gb')} + 0.3::DOUBLE * ratio + 0.2::DOUBLE * (CASE WHEN len(da) + len(db) = 0 THEN 0.5::DOUBLE ELSE {_JACCARD.format('da', 'db')} END) END, 9) AS similarity
FROM q LEFT JOIN ratios USING (job_id, pos)""",
    "offset_match_full": _FULL_MATCHES + "SELECT job_id, window_name, pos, secondary_pos, round(score, 6) AS score, round(delta, 3) AS delta FROM matches",
    "offset_results_plain": _MATCHES + _RESULTS,
    "offset_results": _FULL_MATCHES + _RESULTS,
    "offset_report": _FULL_MATCHES + _RESULTS,
    "fixed_offsets": " UNION ALL ".join([_FIXED.format("0.0", "skip", "NULL"), _FIXED.format("12.5", "manual", "12.5"), _FIXED.format("0.0", "single_vtt", "NULL")]),
    "apply_offset": "WITH " + cues_sql("ZOOM", "c") + """
SELECT job_id, pos, round(greatest(0, start - 12.5::DOUBLE), 3) AS start, round("end" - 12.5::DOUBLE, 3) AS "end" FROM c WHERE job_id IN (SELECT job_id FROM jobs) AND "end" - 12.5::DOUBLE > 0
UNION ALL SELECT job_id, pos, start, "end" FROM c WHERE job_id NOT IN (SELECT job_id FROM jobs) AND "end" > 0""",
}
ORACLES = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLES.items()}
