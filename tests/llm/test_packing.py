import random

import pytest

from cueloom.llm import packing
from cueloom.llm.tokens import TOKENIZER, cut_tokens, encoder


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            put(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        put(i + 1, bins)
        bins.pop()

    put(0, [])
    return best[0]


def test_reduction_is_optimal_and_packing_valid():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 8))]
        counts: dict[int, int] = {}
        for s in items:
            counts[s] = counts.get(s, 0) + 1
        kinds = packing.pack_sizes(counts, capacity)
        used: dict[int, int] = {}
        for k in kinds:
            assert 0 < k.load() <= capacity and k.times > 0
            for s, n in k.holds.items():
                used[s] = used.get(s, 0) + n * k.times
        assert used == counts
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(k.times for k in fixed) + (optimum(left, capacity) if left else 0) == (optimum(items, capacity) if items else 0)
    with pytest.raises(ValueError):
        packing.pack_sizes({11: 1}, 10)


def test_many_documents_stay_few_kinds():
    counts = {s: 10**7 // s for s in range(1, 2049)}
    kinds = packing.pack_sizes(counts, 2048)
    assert len(kinds) < 10_000 and sum(k.times for k in kinds) >= packing.lower_bound(counts, 2048)


def test_cut_is_a_round_trip():
    text = "日本語の文と english text 👩‍💻 " * 300
    tokens = encoder(TOKENIZER).encode_ordinary(text)
    cut = cut_tokens(tokens, 64)
    assert all(0 < b - a <= 64 for a, b, _, _ in cut) and [a for a, *_ in cut][1:] == [b for _, b, *_ in cut][:-1]
    assert "".join(text[c:d] for _, _, c, d in cut) == text


def test_pack(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randint(1, 60), "x") for i in range(200)] + [(0, None, "x"), (900, None, "x"), (901, "", "x"), (902, "long " * 1000, "x")]
    docs[-4] = docs[0]  # delivered twice
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, tokens string"), 100).collect()
    load: dict[int, int] = {}
    for r in out:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    whole = [r["doc_id"] for r in out if r["doc_id"] < 900]
    assert sorted(whole) == list(range(200)) and len([r for r in out if r["doc_id"] == 902]) > 5
    assert {900, 901}.isdisjoint(r["doc_id"] for r in out)
    assert len(load) <= -(-sum(load.values()) // 100) * 1.05 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), 100).count() == 0
