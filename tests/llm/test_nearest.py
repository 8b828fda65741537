import random

import pytest

from cueloom.llm import nearest


def test_brute_force(spark):
    rng = random.Random(3)
    right = [(e, rng.randint(0, 4000), i) for i, e in enumerate(rng.choices("ab", k=120))]
    left = [(e, rng.randint(-50, 4050), i) for i, e in enumerate(rng.choices("abc", k=150))]
    a = spark.createDataFrame(left, "e string, t long, l int")
    b = spark.createDataFrame(right, "e string, t long, r int")
    want = set()
    for e, t, i in left:
        own = [(abs(t - u), u, k) for f, u, k in right if f == e and abs(t - u) <= 30]
        if own:
            want.add((e, i, min(own)[2], min(own)[0]))
    for slot in (61, 500, 10**7):
        got = nearest.nearest_in_time(a, b, ["e"], "t", "t", ["l"], ["r"], 30, slot)
        assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        nearest.nearest_in_time(a, b, ["e"], "t", "t", ["l"], ["l"], 30)
    with pytest.raises(ValueError):
        nearest.nearest_in_time(a, b, ["e"], "t", "t", ["l"], ["r"], 30, 60)


def test_marks(spark):
    marks = spark.createDataFrame([(1, "j", 10.0, "a", 1), (1, "j", 10.0, "a", 2), (2, None, 1.0, "a", 1), (3, "j", None, "a", 1), (4, "j", 99.0, "a", 1), (5, "j", 13.0, None, None)], "mark_id long, job_id string, at_sec double, note string, noted_at int")
    cues = spark.createDataFrame([("j", "PRIMARY", 1, 9.0, " 　"), ("j", "PRIMARY", 2, 13.0, "x"), ("j", "ZOOM", 3, 10.0, "x"), ("j", "PRIMARY", 4, 6.9, "y"), ("j", "PRIMARY", 5, 11.0, None)], "job_id string, source string, cue_index int, start_sec double, text string")
    assert sorted(tuple(r) for r in nearest.marked_cues(marks, cues, 3000).collect()) == [(1, "j", 2, 3000), (5, "j", 2, 0)]
    assert nearest.marked_cues(marks.limit(0), cues, 3000).count() == 0 and nearest.marked_cues(marks, cues.limit(0), 3000).count() == 0
