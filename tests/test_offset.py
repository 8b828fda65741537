import difflib
import random

import pytest

from cueloom.config import DEFAULTS
from cueloom.functions.text import WEIGHTS
from cueloom.operators import offset

SAID = ["今日は予算の話をします", "次の議題に移りましょう", "資料は三ページです", "質問はありますか", "それでは終わります"]
TIMES = [(0, 3), (3.5, 6), (7, 10), (11, 14), (15, 18)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "job_id string, pos int, start double, end double, text string")


def side(shift=0.0, job="j"):
    return [(job, i + 1, a + shift + 0.0, b + shift + 0.0, t) for i, ((a, b), t) in enumerate(zip(TIMES, SAID, strict=True))]


def detect(spark, a, b, **over):
    conf = DEFAULTS["offset"] | {"similarity_threshold": 0.5} | over
    jobs = spark.createDataFrame([("j",), ("empty",)], "job_id string")
    return {r["job_id"]: r for r in offset.detect_offsets(jobs, frame(spark, a), frame(spark, b), conf).collect()}


@pytest.mark.parametrize("shift", [0.0, 10.0, 120.0])
def test_known_offset(spark, shift):
    got = detect(spark, side(), side(shift))
    assert got["j"]["estimated_offset_sec"] == pytest.approx(shift, abs=0.01) and got["j"]["confidence"] == "HIGH"
    assert got["empty"]["confidence"] == "LOW" and got["empty"]["valid_pairs"] == 0 and got["empty"]["estimated_offset_sec"] == 0


def test_modes(spark):
    assert detect(spark, side(), side(), mode="skip")["j"]["method"] == "skip"
    got = detect(spark, side(), side(), mode="manual", manual_offset_sec=7.5)["j"]
    assert (got["estimated_offset_sec"], got["override"], got["confidence"]) == (7.5, 7.5, "HIGH")
    with pytest.raises(ValueError):
        detect(spark, side(), side(), mode="other")


def test_apply(spark):
    cues = frame(spark, [("j", 1, 2.0, 4.0, "x"), ("j", 2, 10.0, 12.0, "y"), ("j", 3, 3.0, 6.0, "z")])
    off = offset.constant_result(spark.createDataFrame([("j",)], "job_id string"), "manual", 5.0, 5.0)
    assert [(r["pos"], r["start"], r["end"]) for r in offset.apply_offset(cues, off).orderBy("pos").collect()] == [(2, 5.0, 7.0), (3, 0.0, 1.0)]
    assert offset.excluded_counts(cues, off).first()["excluded"] == 1


def test_best_match_is_exact():
    rng = random.Random(3)
    words = ["a", "b", "ab", "12", "34", " ", "xy"]
    for sequence in (True, False):
        for threshold in (0.4, 0.5, 0.6):
            for _ in range(60):
                texts = ["".join(rng.choices(words, k=rng.randint(1, 8))).strip() or "a" for _ in range(8)]
                a, rest = texts[0], texts[1:]
                pool = [(0.0, t, offset._grams(t), frozenset(__import__("regex").findall(r"\d+", t))) for t in rest]
                by_gram: dict = {}
                for i, p in enumerate(pool):
                    for g in p[2]:
                        by_gram.setdefault(g, []).append(i)
                score, where = offset.best_match(a, offset._grams(a), pool, by_gram, sequence, threshold)
                full = []
                da = frozenset(__import__("regex").findall(r"\d+", a))
                for i, (_, t, g, d) in enumerate(pool):
                    ga = offset._grams(a)
                    j, k = len(ga & g) / len(ga | g), 0.5 if not da | d else len(da & d) / len(da | d)
                    q = difflib.SequenceMatcher(None, a, t).ratio() if sequence else 0
                    full.append((WEIGHTS[0] * j + (WEIGHTS[1] * q if sequence else 0) + WEIGHTS[2] * k, -i))
                best = max(full)
                if best[0] >= threshold:
                    assert score == pytest.approx(best[0]) and pool[where][1] is not None
                    assert full[where][0] == pytest.approx(best[0])
                else:
                    assert score < threshold


def test_outliers_and_drift(spark):
    rows = [("j", "head", d) for d in (10.0, 10.1, 9.9, 10.0, 60.0)] + [("j", "tail", d) for d in (12.0, 12.1, 11.9)] + [("one", "head", 3.0)]
    got = {r["job_id"]: r for r in offset.robust_stats(spark.createDataFrame(rows, "job_id string, window_name string, delta double"), 3.0, 3).collect()}
    assert got["j"]["valid_pairs"] == 7 and got["j"]["drift_detected"] and got["j"]["drift"] == pytest.approx(2.0)
    assert got["one"]["sigma"] == 0.0 and got["one"]["confidence"] == "LOW" and not got["one"]["drift_detected"]
    assert offset.mad([]) == 0.0 and offset.mad([1, 1, 4]) == 0.0


def test_windows(spark):
    cues = frame(spark, [("long", 1, 0.0, 1.0, "x"), ("long", 2, 990.0, 1000.0, "x"), ("short", 1, 0.0, 100.0, "x")])
    got = {(r["job_id"], r["window_name"]): (r["lo"], r["hi"]) for r in offset.sample_windows(cues, ["head", "mid", "tail", "odd"], 300).collect()}
    assert got == {("long", "head"): (0, 300), ("long", "mid"): (300, 600), ("long", "tail"): (700, 1000), ("short", "head"): (0, 100)}
