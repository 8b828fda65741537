import json

import pytest
from pyspark.sql import functions as F

from cueloom.sources import captions, side

VTT = "﻿WEBVTT - title\r\n\r\nNOTE a remark\r\n\r\n1\r\n00:00:01.000 --> 00:00:03.000 align:start\r\n<v SPEAKER_00>こんにちは</v>\r\n\r\n2\r\n00:05,500 --> 00:07,000\r\nSPEAKER_01：二行目\r\nつづき\r\n\r\n3\r\n00:00:08.000 --> 00:00:09.000\r\n\r\n4\r\nbad --> 00:00:09.000\r\nx\r\n\r\n100:00:00.000 --> 100:00:01.000\r\nTanaka: いいえ\r\n"


def rows(spark, content, parse=captions.parse_vtt):
    df = spark.createDataFrame([("a", content)], "k string, content string")
    return [tuple(r)[1:] for r in parse(df, ["k"]).orderBy("cue_index").collect()]


def test_vtt(spark):
    assert rows(spark, VTT) == [(1, 1.0, 3.0, "SPEAKER_00", "こんにちは"), (2, 5.5, 7.0, "SPEAKER_01", "二行目\nつづき"), (3, 360000.0, 360001.0, None, "Tanaka: いいえ")]


def test_srt_style_through_vtt(spark):
    text = "1\n00:00:01,000 --> 00:00:03,000\nSPEAKER_00: はい\n\n2\n00:00:04,000 --> 00:00:06,000\nSPEAKER_01: いいえ\n"
    assert rows(spark, text) == [(1, 1.0, 3.0, "SPEAKER_00", "はい"), (2, 4.0, 6.0, "SPEAKER_01", "いいえ")]


def test_two_voice_tags_and_empty(spark):
    assert rows(spark, "WEBVTT\n\n00:01.000 --> 00:02.000\n<v A>x</v><v B>y</v>\n")[0][3:] == ("A", "x</v><v B>y")
    assert rows(spark, "") == [] and rows(spark, None) == [] and rows(spark, "WEBVTT") == []


def test_srt(spark):
    text = "7\n00:00:01,000 --> 00:00:02,000\nSPEAKER_03: x\n\nq\n00:00:01,000 --> 00:00:02,000\nx\n\n8\n00:01,000 --> 00:02,000\nx\n\n9\n00:00:03.000 --> 00:00:04.000\nSPEAKER_01:\n"
    assert rows(spark, text, captions.parse_srt) == [(7, 1.0, 2.0, "SPEAKER_03", "x"), (9, 3.0, 4.0, "SPEAKER_01", "")]


def test_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes(VTT.encode())
    got = captions.read_captions(spark, str(tmp_path / "a.vtt"))
    assert captions.parse_vtt(got, ["path"]).count() == 3
    assert "\r" not in got.first()["content"] and not got.first()["content"].startswith("﻿")


def test_side_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("# c\n表記\tよみ\n東京\tとうきょう\n\n用語\n 大阪 \tおおさか\n", encoding="utf-8")
    assert side.read_glossary(spark, str(tmp_path / "g.tsv")) == {"用語": ["東京", "大阪"]}
    (tmp_path / "e.tsv").write_text("# only\n", encoding="utf-8")
    assert side.read_glossary(spark, str(tmp_path / "e.tsv")) is None and side.read_glossary(spark, str(tmp_path / "no")) is None
    (tmp_path / "d.json").write_text(json.dumps(["a", "b"]))
    assert side.read_dictionary(tmp_path / "d.json") == ["a", "b"] and side.read_dictionary(tmp_path / "no") is None
    assert side.read_context_prompt(tmp_path) is None
    (tmp_path / "context_prompt.md").write_text(" m \n")
    assert side.read_context_prompt(tmp_path) == "m"
    assert side.read_speaker_map(None) == {} and side.read_speaker_map(tmp_path / "no") == {}
    with pytest.raises(ValueError):
        side.glossary_file_terms(tmp_path / "e.tsv")
    df = spark.createDataFrame([("j", "a\tb"), ("j", "#x"), ("j", " "), ("j", "表記")], "job string, value string")
    assert [r["term"] for r in side.glossary_terms(df, ["job"]).select(F.col("term")).collect()] == ["a"]
