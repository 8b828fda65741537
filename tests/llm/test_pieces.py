import random

from cueloom.llm import pieces

INDEX = "job_id string, uid string, start_sec double, end_sec double, speaker string, raw_text string"
CHUNKS = "job_id string, chunk_index int, srt_ids array<string>, written_at int, start_ms string"


def test_cuts():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 60)
        start, t = [], 0
        for _ in range(n):
            t += rng.choice([0, 100, 900, 20_000])
            start.append(t)
        end = [s + rng.randint(0, 15_000) for s in start]
        limit = rng.choice([20_000, 60_000, 360_000])
        cuts = pieces.balanced_cuts(start, end, [rng.random() for _ in start], limit)
        edges = [0, *cuts, n]
        assert edges == sorted(set(edges))
        for a, b in zip(edges, edges[1:], strict=False):
            assert b - a == 1 or max(end[a:b]) - start[a] <= limit
        assert bool(cuts) == (n > 1 and max(end) - start[0] > limit)


def test_strong_boundary_wins():
    start = [i * 10_000 for i in range(10)]
    end = [s + 9_000 for s in start]
    power = [0.0] * 10
    power[4] = 5.0
    assert pieces.balanced_cuts(start, end, power, 60_000) == [4]


def test_chunks(spark):
    index = spark.createDataFrame([("j", f"U{i:06d}", i * 60.0, i * 60.0 + 50, "A" if i < 5 else "B", "x。") for i in range(1, 21)] + [("j", "U000001", 60.0, 110.0, "A", "x。"), ("k", "U000001", 0.0, None, None, None), ("k", "U000002", 500.0, 100.0, None, None)], INDEX)
    ids = [f"U{i:06d}" for i in range(1, 13)]
    chunks = spark.createDataFrame([("j", 0, ids, 2, "c"), ("j", 0, ids[:2], 1, "c"), ("j", 1, ids[:2] + ["U999999"], 1, "c"), ("j", 2, None, 1, "c"), ("k", 0, ["U000001", "U000002"], None, "c")], CHUNKS)
    out = pieces.chunk_pieces(chunks, index, 360_000)
    rows = out.orderBy("job_id", "chunk_index", "piece_index").collect()
    big = [r for r in rows if (r["job_id"], r["chunk_index"]) == ("j", 0)]
    assert len(big) > 1 and [i for r in big for i in r["srt_ids"]] == ids and all(r["end_ms"] - r["start_ms"] <= 360_000 for r in big)
    assert [r["n_pieces"] for r in rows if r["chunk_index"] == 1] == [1]
    assert not [r for r in rows if r["chunk_index"] == 2]
    ctx = {(r["chunk_index"], r["piece_index"]): r for r in pieces.with_context(out, index, 70_000).where("job_id = 'j'").collect()}
    first, second = ctx[0, 0], ctx[0, 1]
    assert first["context_before"] == [] and [c["uid"] for c in first["context_after"]][0] == second["srt_ids"][0]
    assert [c["uid"] for c in second["context_before"]] == [first["srt_ids"][-1]]
    assert first["time_range"]["start_sec"] == 60.0
    assert pieces.chunk_pieces(chunks.limit(0), index, 360_000).count() == 0


def test_least_count_is_not_passed_over():
    """One entry every second and a limit that 41 pieces meet, though 40 do not."""
    start = [i * 1000 for i in range(410)]
    end = [s + 1000 for s in start]
    cuts = pieces.balanced_cuts(start, end, [0.0] * 410, 10_000)
    assert len(cuts) + 1 == 41


def test_entry_over_the_limit_is_marked(spark):
    index = spark.createDataFrame([("j", "U000001", 0.0, 900.0, "A", None), ("j", "U000002", 901.0, 950.0, "A", "x")], INDEX)
    chunks = spark.createDataFrame([("j", 0, ["U000001", "U000002"], 1, "c")], CHUNKS)
    got = pieces.chunk_pieces(chunks, index, 360_000).orderBy("piece_index").collect()
    assert [(r["srt_ids"], r["over_limit"]) for r in got] == [(["U000001"], True), (["U000002"], False)]
