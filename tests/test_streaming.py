import random

from cueloom.operators.intervals import gaps_of, merge_intervals
from cueloom.streaming import ingest, intervals

START = 1_700_000_000_000


def run_stream(spark, folder, name, batches, late):
    """All rows that come out; (who, from, to) in seconds, a micro-batch each list."""
    schema = "who string, lo long, hi long"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    found = intervals.stream_periods(source, ["who"], "lo", "hi", late)
    for i, rows in enumerate(batches):
        spark.createDataFrame([(w, START + a * 1000, START + b * 1000) for w, a, b in rows], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = found.writeStream.outputMode("append").format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(str(folder / "out")).collect()
    return sorted((r["who"], r["kind"], (r["from_ms"] - START) // 1000, (r["to_ms"] - START) // 1000, r["n"]) for r in out)


def test_interval_that_reaches_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("x", 0, 10)], [("y", 13, 14)], [("x", 5, 25)], [("y", 90, 91)], [("x", 300, 301)], [("y", 400, 401)]]
    got = run_stream(spark, tmp_path, "back", batches, "10 seconds")
    assert ("x", "period", 0, 25, 2) in got and not any(r[:3] == ("x", "period", 0) and r[3] != 25 for r in got)


def test_periods_equal_batch_result(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for who in "xyz":
        t = 0
        for _ in range(60):
            t += rng.choice([0, 1, 2, 5, 60])
            rows.append((who, t, t + rng.choice([0, 1, 3, 40, 200])))
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 50))  # late by less than the watermark allows
    batches = [rows[i : i + 45] for i in range(0, len(rows), 45)]
    batches += [[("end", 10_000, 10_001)], [("end", 20_000, 20_001)], [("end", 30_000, 30_001)]]
    (tmp_path / "in").mkdir()
    got = [r for r in run_stream(spark, tmp_path, "all", batches, "60 seconds") if r[0] != "end"]
    whole = merge_intervals(spark.createDataFrame(rows, "who string, lo long, hi long"), ["who"], "lo", "hi")
    want = [(r["who"], "period", r["from_ms"], r["to_ms"], r["n"]) for r in whole.collect()] + [(r["who"], "gap", r["from_ms"], r["to_ms"], 0) for r in gaps_of(whole, ["who"]).collect()]
    assert got == sorted(want)


def test_ingest(spark, tmp_path):
    src = tmp_path / "in"
    (src / "job1").mkdir(parents=True)
    (src / "job1" / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi\n")
    for _ in range(2):
        ingest.ingest(ingest.caption_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
