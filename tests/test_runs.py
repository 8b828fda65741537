import itertools
import random

from cueloom.operators.runs import runs


def test_runs(spark):
    rng = random.Random(8)
    rows = [(g, t * 10 + 1, rng.choice("xy")) for g in "ab" for t in rng.sample(range(400), 120)] + [("solo", 5, None)]
    df = spark.createDataFrame(rows, "g string, t long, v string")
    want = set()
    for g in ("a", "b"):
        own = sorted((t, v) for k, t, v in rows if k == g)
        for _, part in itertools.groupby(own, key=lambda x: x[1]):
            part = list(part)
            want.add((g, part[0][0], part[-1][0], len(part)))
    want.add(("solo", 5, 5, 1))
    for slot in (15, 500, 10**9):
        got = runs(df, ["g"], "t", ["v"], lambda before, now: before("v") != now("v"), slot)
        assert {(r["g"], r["first"]["t"], r["last"]["t"], r["n"]) for r in got.collect()} == want
    assert runs(df.limit(0), ["g"], "t", ["v"], lambda b, n: b("v") != n("v")).count() == 0
