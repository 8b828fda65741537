import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import chunking, ids


def frame(spark, cues):
    return spark.createDataFrame(cues, "job_id string, pos int, start double, end double, speaker string, text string")


def regular(n, job="j"):
    return [(job, i + 1, i * 5.0, (i + 1) * 5 - 0.5, f"SPEAKER_0{i % 2}", f"発話{i}") for i in range(n)]


def greedy(cues, dur=300, w1=180, w2=300, gap=1.2):
    """Brute force: one split after the other over all candidates."""
    n = len(cues)
    tier = {}
    for i in range(1, n):
        a, b = cues[i - 1], cues[i]
        change = bool(a[4]) and bool(b[4]) and a[4] != b[4]
        tier[i] = 1 if b[2] - a[3] >= gap else 2 if change else 3 if (a[5] or "").rstrip()[-1:] in "。.！？?" and (a[5] or "").rstrip() else 4
    splits, at, target = [0], 0, float(dur)
    while target < cues[-1][3]:
        best = None
        for w in (w1, w2):
            c = [(tier[j], abs(cues[j][2] - target), j) for j in range(at + 1, n) if abs(cues[j][2] - target) <= w]
            if c:
                best = min(c)[2]
                break
        if best is None:
            break
        splits.append(best)
        at, target = best, cues[best][2] + dur
    return [s + 1 for s in splits]


@pytest.mark.parametrize(("n", "low", "high"), [(36, 1, 1), (360, 4, 8), (1440, 20, 28)])
def test_counts(spark, n, low, high):
    cues = frame(spark, regular(n))
    chunks = chunking.split_into_chunks(cues).orderBy("chunk_index").collect()
    assert low <= len(chunks) <= high
    assert chunks[0]["first_pos"] == 1 and chunks[-1]["last_pos"] == n
    assert all(a["last_pos"] + 1 == b["first_pos"] for a, b in zip(chunks, chunks[1:], strict=False))


def test_random_jobs_match_brute_force(spark):
    rng = random.Random(5)
    jobs = {}
    for k in range(25):
        t, cues = 0.0, []
        for i in range(rng.randint(1, 90)):
            t += rng.choice([0.0, 0.5, 1.2, 3, 40, 700]) + 0.25
            end = t + rng.randint(1, 40)
            cues.append((f"j{k}", i + 1, t, end, rng.choice(["A", "B", "", None]), rng.choice(["x", "y。", "z? ", None])))
            t = end
        jobs[f"j{k}"] = cues
    chunks = chunking.split_into_chunks(frame(spark, [c for v in jobs.values() for c in v])).collect()
    for job, cues in jobs.items():
        assert sorted(r["first_pos"] for r in chunks if r["job_id"] == job) == greedy(cues), job


def test_slotted_walk_equals_plain_walk(spark):
    cues = frame(spark, regular(900) + regular(40, "k"))
    marked = chunking.boundaries(cues, 1.2)
    succ = chunking.successors(marked, 300, 180, 300)
    plain = {tuple(r) for r in chunking.walk(succ).collect()}
    assert len(plain) > 10
    for slot_sec, growth in ((500, 32), (400, 2), (90, 3)):  # the last two walk reduced tables again
        assert plain == {tuple(r) for r in chunking.walk(succ, slot_sec, growth).collect()}


def test_job_that_ends_before_its_last_start(spark):
    """An end before the last cue's start stops the search for all later targets."""
    cues = regular(300)
    cues[-1] = (*cues[-1][:3], 700.0, *cues[-1][4:])
    got = chunking.split_into_chunks(frame(spark, cues)).collect()
    assert sorted(r["first_pos"] for r in got) == greedy(cues)


def test_context_and_members(spark):
    cues = frame(spark, regular(360))
    chunks = chunking.split_into_chunks(cues)
    ctx = chunking.contexts(chunks, cues).collect()
    assert not any(r["chunk_index"] == 0 and r["role"] == "CTX_BEFORE" for r in ctx)
    body = chunking.members(chunks).collect()
    assert sorted(r["pos"] for r in body) == list(range(1, 361))
    edges = {r["chunk_index"]: r for r in chunks.collect()}
    for r in ctx:
        c = edges[r["chunk_index"]]
        assert r["pos"] < c["first_pos"] if r["role"] == "CTX_BEFORE" else r["pos"] > c["last_pos"]


def test_empty(spark):
    none = frame(spark, [])
    assert chunking.split_into_chunks(none).count() == 0


def test_nearest_is_exact_over_slots(spark):
    rng = random.Random(2)
    starts = sorted(rng.sample(range(0, 40000), 60))
    cues = frame(spark, [("j", i + 1, float(s), s + 1.0, None, "x") for i, s in enumerate(starts)])
    points = [("j", float(p)) for p in (0, 7, 20000, 39999, 70000, *rng.sample(range(40000), 40))] + [("none", 1.0)]
    df = spark.createDataFrame(points, "job_id string, at_sec double")
    got = {(r["job_id"], r["at_sec"]): r["pos"] for r in chunking.nearest_starts(df, cues, "at_sec", "pos", 900.0).collect()}
    for job, p in points:
        want = None if job == "none" else min(range(60), key=lambda i: (abs(starts[i] - p), i)) + 1
        assert got[job, p] == want


def test_numbering_by_slots(spark):
    df = spark.createDataFrame([("a", i * 7 % 101) for i in range(101)] + [(None, 1), (None, 2)], "g string, t int")
    got = ids.number_rows(df, ["g"], ["t"], "n", slot=F.floor(F.col("t") / 10)).collect()
    assert all(r["n"] == r["t"] + 1 for r in got if r["g"] == "a") and sorted(r["n"] for r in got if r["g"] is None) == [1, 2]
