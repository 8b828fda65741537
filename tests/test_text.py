import difflib
import math

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text, timecode


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["o"] for r in df.withColumn("o", expr(F.col("t"))).orderBy("i").collect()]


def test_normalize(spark):
    got = col(spark, ["今日は会議です。", "えー、今日は", "今日　　は", "ＡＢＣ", "えーと話", "あのー、こうえん", None, ""], text.normalize_for_matching)
    assert got[0] == "今日は会議です" and got[1] == "今日は" or got[1] == ",今日は"
    assert got[2] == "今日 は" and got[3] == "abc"
    assert got[4] == "と話"  # fillers go one after the other, as substrings
    assert got[6] is None and got[7] == ""


def test_ngrams_and_jaccard(spark):
    assert [sorted(x) for x in col(spark, ["abcde", "ab", "", "aaaa"], text.char_ngrams)] == [["abc", "bcd", "cde"], ["ab"], [], ["aaa"]]
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["a"]), (["a"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_similarity(spark):
    df = spark.createDataFrame([("会議を始めます", "会議を始めます"), ("item 12 is open", "item 13 is open"), ("", "x"), ("tide", "diet"), ("diet", "tide")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.9) and got[2] == 0.0
    assert got[3] != got[4]  # the ratio is not symmetric
    a, b = "item 12 is open", "item 13 is open"
    ga, gb = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    want = 0.5 * len(ga & gb) / len(ga | gb) + 0.3 * difflib.SequenceMatcher(None, a, b).ratio()
    assert got[1] == pytest.approx(want)


def test_reading_falls_back_to_text(spark):
    assert col(spark, ["会議", None], text.to_reading) == ["会議", None] or text._reader() is not None


def test_timecodes(spark):
    got = col(spark, ["00:01:23.456", "01:23.456", "01:23,456", "00:00:00,000", "x", None, "100:00:00.000"], timecode.parse_timecode)
    assert got[:4] == pytest.approx([83.456, 83.456, 83.456, 0.0]) and got[4] is None and got[5] is None and got[6] == 360000.0
    assert col(spark, [1.001, 3661.5, 0.0, 359999.999], timecode.format_timecode, "double") == [f"{int(s // 3600):02d}:{int(s % 3600 // 60):02d}:{int(s % 60):02d}.{int((s % 1) * 1000):03d}" for s in (1.001, 3661.5, 0.0, 359999.999)]
    assert col(spark, [59.9, 3700.2], timecode.minutes_seconds, "double") == ["00:59", "61:40"]
    assert col(spark, ["U12x", "U000007", "V_INSERT_1", "x", None], timecode.id_number) == [12, 7, None, None, None]
    assert math.isclose(1.0, 1.0)
