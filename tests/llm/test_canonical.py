import unicodedata

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from cueloom.llm import canonical
from cueloom.llm.canonical import canonicalize


def test_cases():
    changed = {
        "ＡＢＣ１２": "ABC12", "ﾃﾞｰﾀ": "データ", "ﬁle": "file", "résumé": "résumé", "が": "が", "한": "한", "a​b­c": "abc", "a b c": "a b c", "⽤語": "用語",
        "сlosing": "closing", "Rіght on": "Right on", "デ一タ": "データ", "モニ夕ー": "モニター", "アー力イブ": "アーカイブ", "リ八ーサル": "リハーサル", "𝐀𝐛": "Ab", "ポ一ト": "ポート",
    }
    for raw, plain in changed.items():
        assert canonicalize(raw) == plain, raw
    for same in ["「えっ？！」（仮）：％＠", "①と②", "1º 2ª", "λとΔ", "Заря", "👩‍💻 ok", "レビュー待ちの一覧", "二人目のチーム", "“a” – ‘b’…", "", "café", "二チームで", "データ一覧", "हिस्‍सा"]:
        assert canonicalize(same) == same, same
    assert canonicalize(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_one_pass_is_enough(text):
    once = canonicalize(text)
    assert canonicalize(once) == once


def test_long_text():
    assert canonicalize("あ" * 200_000 + "ﾃ") == "あ" * 200_000 + "テ"


def test_column(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "x"), (1, "ＡＢ", "y"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (5, "語", "x")], "k int, text string, canonical string")
    assert sorted(r["k"] for r in canonical.disguised(df, ["k"]).collect()) == [1]
    assert canonical.with_canonical(df, "text").where("k = 1").first()["canonical"] == "AB"
    assert canonical.disguised(df.limit(0), ["k"]).count() == 0


def test_marks_come_out_alike_whatever_else_stands_in_the_text():
    for apart, joined in (("न\u093c", "\u0929"), ("o\u0302", "ô")):
        got = {canonical.canonicalize(before + apart + "x")[-2:] for before in ("", "Ａ", "\u200b", "か\u3099", "①Ａ")}
        assert got == {joined + "x"}


def test_table_is_checked():
    def fails(*entries):
        table = canonical.Table()
        for source, target, context in entries:
            table.put(source, target, context)
        table.check()

    with pytest.raises(ValueError, match="two targets"):
        fails(("Ａ", "A", "any"), ("Ａ", "B", "any"))
    with pytest.raises(ValueError, match="itself changed"):
        fails(("Ａ", "B", "any"), ("B", "C", "any"))
    with pytest.raises(ValueError, match="beginning"):
        fails(("xy", "z", "any"), ("xyv", "q", "any"))
    with pytest.raises(ValueError, match="always holds"):
        fails(("а", "a", "latin"), ("а", "b", "any"))
    assert canonical.table() is canonical.table()


def test_longest_sequence_counts():
    trie = canonical.compiled({"a": "1", "ab": "2", "abcd": "3", "bc": "4"})
    for text, want in (("abcd", "3"), ("abc", "2c"), ("abab", "22"), ("aabcx", "12cx"), ("bca", "41"), ("", ""), ("x", "x")):
        assert canonical.transduce(text, trie) == want


def test_table_composes_as_unicode_does():
    trie = canonical._machine().compose
    for code in (*range(0xC0, 0x2000), *range(0x3040, 0x3100), *range(0xAC00, 0xD7A4, 13)):
        ch = chr(code)
        if unicodedata.normalize("NFC", ch) == ch and not unicodedata.decomposition(ch).startswith("<"):
            assert canonical.transduce(unicodedata.normalize("NFD", ch), trie) == ch, hex(code)
    for raw, plain in (("ệ", "ệ"), ("Ａ́", "Á"), ("ｶ゙", "ガ"), ("かﾞ", "が"), ("か゛", "が"), ("ᄒ​ᅡᆫ", "한"), ("デ一​タ", "データ"), ("モニ夕゙", "モニダ"), ("á̧", "á̧")):
        assert canonicalize(raw) == plain, raw
