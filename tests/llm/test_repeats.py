import random

from cueloom.llm import repeats
from cueloom.llm.speech import said, said_key

SCHEMA = "job_id string, source string, cue_index int, start_sec double, end_sec double, speaker string, text string, n string"


def names(spark):
    return spark.createDataFrame([("j", "SPEAKER_00", "Marek Linderly")], "job_id string, speaker_label string, display_name string")


def test_labels_count_if_the_job_knows_them(spark):
    rows = [("j", "P", 1, 0.0, 2.0, None, "Linderly: who comes?", "x"), ("j", "P", 2, 3.0, 4.0, None, "Who comes?", "x"), ("j", "P", 3, 5.0, 6.0, None, "Question: who comes?", "x"), ("j", "P", 4, 7.0, 8.0, None, "[Linderly] Question: who comes", "x")]
    got = repeats.repeated(spark.createDataFrame(rows, SCHEMA), names(spark)).collect()
    assert sorted(tuple(r)[2:] for r in got) == [(1, 2), (3, 4)]


def test_what_is_said():
    assert said_key("[16:03] SPEAKER_00 : Hmm") == "" and said_key("♪ ♪") == "" and said_key(None) == "" and said_key("えー…") == ""
    assert said_key("The uhm overseas Office. [laughter]") == said_key("SPEAKER_01: the overseas office (8:57)")
    assert said("<v A B>hi</v>") == ("A B", "hi", None) and said(">> Linderly: hi").label == "Linderly"
    assert said("Item 31 is closed.").words == "Item 31 is closed."


def test_alike():
    a = "theclientsidesentbackthemissingchunk"
    assert repeats.alike(a, a.replace("back", "bac")) and repeats.alike(a, a.replace("back", "bcak")) and repeats.alike(a.replace("client", "cient"), a.replace("chunk", "chunnk"))
    assert not repeats.alike("item31isclosed", "item32isclosed") and not repeats.alike("진행자는초안을확인했습니다", "진행자는안건을확인했습니다") and not repeats.alike("没错", "没问题")
    assert repeats.edits("abcd", "abdc") == 1 and repeats.edits("", "ab") == 2


def test_runs(spark):
    rows = [
        ("j", "P", 1, 0.0, 2.0, "A", "Right.", "x"), ("j", "P", 2, 3.0, 4.0, "B", "SPEAKER_01: right", "x"), ("j", "P", 2, 3.0, 4.0, "B", "SPEAKER_01: right", "x"), ("j", "P", 3, 5.0, 5.5, "B", "um...", "x"), ("j", "P", 4, 6.0, None, "B", "Rigt.", "x"),
        ("j", "P", 9, 7.0, 8.0, "B", "Item 1 is closed", "x"), ("j", "P", 5, 9.0, 10.0, "B", "Item 2 is closed", "x"), ("j", "P", 6, None, 10.0, "B", "Item 2 is closed", "x"), ("j", "Z", 1, 1.0, 2.0, None, "Right.", "x"), (None, "P", 1, 1.0, 2.0, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in repeats.repeated(df, names(spark)).collect()] == [("j", "P", 1, 4)]
    event = repeats.cue_events(df, names(spark)).where("n = 3").first()
    assert (event["start_ms"], event["duration_ms"]) == (0, 6000)
    assert repeats.repeated(df.limit(0), names(spark)).count() == 0


def test_slots_do_not_matter(spark):
    rng = random.Random(6)
    rows = [("j", "P", i, i * 7.0, i * 7.0 + 2, None, rng.choice(["yes we can", "no we cannot"]), "x") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in repeats.repeated(df, names(spark), 10**10).collect()}
    assert whole == {tuple(r) for r in repeats.repeated(df, names(spark), 20_000).collect()} and len(whole) > 10


def test_alike_at_any_length():
    for a, b in (("hello", "hallo"), ("hello", "helo"), ("right", "rihgt"), ("okay", "okey"), ("分かりました", "分かりまし"), ("一行ずつ比べました", "行一ずつ比べました"), ("一行ずつ比べました", "一一行ずつ比べました"), ("三回目ですが", "回目ですが"), ("좋습니다", "종습니다"), ("진행자는초안을확인했습니다", "진행자는초안을확민했습니다")):
        assert repeats.alike(a, b) and repeats.alike(b, a), (a, b)
    for a, b in (("ja", "na"), ("no", "so"), ("三人です", "二人です"), ("二十人います", "二十一人います"), ("二三人います", "三二人います"), ("좋습니다", "맞습니다"), ("そうです", "どうです"), ("没错的", "没用的"), ("会議は三時から始まりますので", "会議は二時から始まりますので"), ("abcd", "xycd"), ("", "a"), ("a", "")):
        assert not repeats.alike(a, b) and not repeats.alike(b, a), (a, b)
    words = "the overseas office sent it back"
    for n in range(1, 7):  # what is accepted does not hang on a length
        short = "".join(words.split()[:n])
        assert repeats.alike(short, short.replace("h", "n", 1)) == (len(short) > 3), short
