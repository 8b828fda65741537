import math
import random

import pytest

from cueloom.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_plan():
    got = {p["source"]: p for p in mixing.plan([{"source": "a", "target_share": 0.5, "max_repeats": 1, "tokens": 1000}, {"source": "b", "target_share": 0.5, "max_repeats": 3, "tokens": 400}, {"source": "c", "target_share": 0.2, "max_repeats": 1, "tokens": None}])}
    assert got["a"]["wanted"] == got["b"]["wanted"] == 1000 and (got["b"]["whole"], got["b"]["rest"]) == (2, 200) and (got["a"]["whole"], got["a"]["rest"]) == (1, 0) and "c" not in got
    assert mixing.plan([]) == []


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, "word " * rng.randint(1, 40), s, "x") for i, s in enumerate(rng.choices("aaabbc", k=600))] + [(0, "word", "a", "x"), (1000, None, "a", "x"), (1001, "word", None, "x"), (1002, "word", "z", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("none", 0.1, 1)], TARGETS)
    got, goals = mixing.mix(df, targets)
    rows = got.collect()
    caps = {"a": 1, "b": 2, "c": 4}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    assert {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in rows)
    share = {r["source"]: r for r in mixing.shares(got, goals).collect()}
    for s, want in (("a", 0.4), ("b", 0.3), ("c", 0.3)):
        assert share[s]["actual_share"] == pytest.approx(want, abs=0.01)
    assert share["none"]["tokens"] == 0 and share["none"]["actual_share"] == 0
    assert {tuple(r) for r in mixing.mix(df, targets)[0].collect()} == {tuple(r) for r in rows}  # the same on every run


def test_inclusion_frequencies(spark):
    """300 sources of the same documents are 300 draws: sizes are fixed, frequencies those asked for."""
    rng = random.Random(2)
    sizes = [rng.choice([3, 3, 3, 10, 40, 70, 90, 300, 301, 302, 900]) for _ in range(40)]
    draws = 300
    docs = [(s * 100 + i, "word " * n, f"s{s}") for s in range(draws) for i, n in enumerate(sizes)] + [(10**6, "word " * int(sum(sizes) * 0.4), "small")]
    targets = [(f"s{s}", 1.0, 1) for s in range(draws)] + [("small", 1.0, 1)]
    got, goals = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(8), spark.createDataFrame(targets, TARGETS))
    rows = got.where("source <> 'small'").collect()
    tokens = {r["doc_id"] % 100: r["tokens"] for r in rows}
    times = {i: sum(r["doc_id"] % 100 == i for r in rows) for i in range(40)}
    assert len(tokens) == 40
    wanted = goals.where("source = 's0'").first()["wanted"]
    by_size: dict[int, list[int]] = {}
    for n in tokens.values():
        by_size.setdefault(n if n < 64 else 64 + int(math.log2(n / 64) * 16), []).append(n)
    classes = [(k, len(v), sum(v)) for k, v in by_size.items()]
    scale = mixing.scale_for(wanted, classes)
    for i, n in tokens.items():
        chance = min(1.0, scale * n**-mixing.SHORT_BIAS)
        assert abs(times[i] / draws - chance) < 4.5 * (chance * (1 - chance) / draws) ** 0.5 + 0.01, (n, times[i] / draws, chance)
    totals = {s: 0 for s in range(draws)}
    for r in rows:
        totals[r["doc_id"] // 100] += r["tokens"]
    assert max(abs(t - wanted) for t in totals.values()) <= max(tokens.values())
    assert abs(sum(totals.values()) / draws - wanted) < 0.02 * wanted


def test_sample_sizes_leave_little_over():
    rng = random.Random(4)
    for _ in range(100):
        sizes = [max(1, int(rng.lognormvariate(5, 1.3))) for _ in range(5000)]
        by: dict[int, list[int]] = {}
        for n in sizes:
            by.setdefault(n if n < 64 else 64 + int(math.log2(n / 64) * 16), []).append(n)
        classes = [(k, len(v), sum(v)) for k, v in by.items()]
        rest = rng.randint(1, sum(sizes))
        got = mixing.sample_sizes(rest, classes, mixing.scale_for(rest, classes), rng)
        assert all(0 <= got[k] <= n for k, n, _ in classes)
        assert abs(rest - sum(t / n * got[k] for k, n, t in classes)) < 0.02 * sum(sizes)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    got, goals = mixing.mix(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert got.count() == 0 and mixing.shares(got, goals).first()["actual_share"] == 0
    got, goals = mixing.mix(df, spark.createDataFrame([], TARGETS))
    assert mixing.shares(got, goals).count() == 0
