from cueloom.operators.grouped import map_groups


def test_groups_reach_over_batches(spark):
    rows = [(g, i, None if i % 3 else i, [str(i)]) for g in ("a", "b", None) for i in range(25)]
    df = spark.createDataFrame(rows, "g string, i int, v long, s array<string>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = map_groups(df, ["g"], ["i"], lambda key, held: [(key[0], len(held), [r[1] for r in held], held[1][2])], "g string, n long, i array<int>, v long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r["g"] or "", r["n"], r["i"], r["v"]) for r in got) == [(g, 25, list(range(25)), None) for g in ("", "a", "b")]
    assert map_groups(df.limit(0), ["g"], ["i"], lambda key, held: [(None, 0, [], 0)], "g string, n long, i array<int>, v long").count() == 0
