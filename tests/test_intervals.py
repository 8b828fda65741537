import random

from cueloom.operators.intervals import IntervalMap, gaps_of, merge_intervals


def islands(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


def test_map():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(a := rng.randint(0, 60), a + rng.randint(0, 9)) for _ in range(rng.randint(0, 25))]
        m = IntervalMap()
        for a, b in rows:
            m.insert(a, b)
        assert list(zip(m.lo, m.hi, m.n, strict=True)) == islands(rows)
        assert m.gaps() == [(x[1], y[0]) for x, y in zip(islands(rows), islands(rows)[1:], strict=False)]


def test_slots_do_not_matter(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, (a := rng.randint(0, 3000)), a + rng.choice([0, 5, 40, 900]), "extra") for i in range(250)]
    df = spark.createDataFrame(rows, "e string, i int, lo long, hi long, n string")
    want = {(e, *x) for e in "ab" for x in islands([(r[2], r[3]) for r in rows if r[0] == e])}
    for slot in (7, 100, 10_000):
        got = merge_intervals(df, ["e"], "lo", "hi", ["i"], slot)
        assert {(r["e"], r["from_ms"], r["to_ms"], r["n"]) for r in got.collect()} == want
        gaps = {(r["e"], r["from_ms"], r["to_ms"]) for r in gaps_of(got, ["e"]).collect()}
        assert gaps == {(e, x[1], y[0]) for e in "ab" for l in [sorted(w[1:] for w in want if w[0] == e)] for x, y in zip(l, l[1:], strict=False)}


def test_dirt(spark):
    rows = [("a", 1, 0, 10), ("a", 1, 0, 10), ("a", 2, 10, 20), ("a", 3, 50, 40), ("a", 4, None, 9), ("a", 5, 5, None), (None, 6, 0, 1), ("a", 7, 30, 30)]
    df = spark.createDataFrame(rows, "e string, i int, lo long, hi long")
    assert sorted((r["from_ms"], r["to_ms"], r["n"]) for r in merge_intervals(df, ["e"], "lo", "hi", ["i"]).collect()) == [(0, 20, 2), (30, 30, 1)]
    assert merge_intervals(df.limit(0), ["e"], "lo", "hi").count() == 0
