import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from cueloom.llm import sentences as tables
from cueloom.llm.sentences import sentences, split_sentences

CASES = [
    ["Dr. Ostrell moved the summary to p. 12 of the binder.", "See sec. 13.4.2 for it et al. in the annex."], ["They waited... and then it came back at 3.5 percent.", "Was it \"Ready? Go!\" or just a test?", "The host only said, \"Keep it.\"", "The U.S. line dropped, so we left."],
    ["Wir nahmen z. B. die Liste auf S. 15 heraus.", "„Wir hören hier auf. Der Rest kann warten“, sagte die Leitung.", "Seit dem 21. Treffen liegt das Protokoll im Schrank.", "Mikrofone, Kabel usw.", "Laut Abs. 6 Nr. 18 gehört es dazu."],
    ["La Dra. Quirantes y D. Belmar lo guardaron hasta las 15.30 h.", "La Sra. Telmas (¿quién más?) mira.", "¿Por qué lo perdimos?", "¡Esperen! gritó la cabina, y volvió."], ["L'hôte a dit : « Gardons le fichier. »", "M. Valbrisset a relu, cf. p. 13 du dossier.", "On attend... puis il revient."],
    ["「ここで止めます。残りは後にします。」と司会が言いました。", "えっ！？という声が出て、回りました。", "会場（第1会議室。二階です）で配りました。", "受け取りました…たぶん。"], ["主持人说：“先到这里。剩下的以后再说。”然后收起了。", "大家等了很久……最后还是来了！", "会场（7号楼。二层）里发了表。", "主持人只说：“留着。”", "第17天之前能好吗？"],
    ["진행자가 \"여기서 멈춥시다. 나머지는 나중에 하죠.\"라고 하며 덮었습니다.", "한참 기다리다가... 결국 받았습니다.", "네.", "Ver. 29.2에서 교체했습니다."], ["मेज़बान ने कहा, \"यहीं रुकते हैं। बाकी बाद में।\" और बंद किया।", "डॉ. नीलवंशी ने मसौदा पृ. 8 पर रखा।"],
    ["قال المضيف: \"نتوقف هنا. الباقي لاحقا.\" ثم أغلق الملف.", "وضع د. سهيل المسرد في ص. 27 من الملف.", "لماذا ضاع مرة أخرى؟"], ["พิธีกรพูดว่า \"พอแค่นี้ ที่เหลือไว้ก่อน\" แล้วปิดรายงานค่ะ", "ดร. อรุณไพร ส่งรายงาน เวลา 18.30 น. ค่ะ", "ภายใน 96 นาทีนะคะ"],
]


@pytest.mark.parametrize("want", CASES)
def test_one_paragraph(want):
    joint = "" if any("぀" <= c <= "鿿" for c in want[0]) else " "
    text = joint.join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize(
    "want",
    [
        ["Sounds good to me.", "Step 37 is next."], ["Das passt so.", "Schritt 37 ist fertig."], ["das passt so.", "die liste ist fertig.", "der rest ist hier."], ["Vamos a ver.", "El punto 14 está cerrado."], ["That will do.", "Nobody asked."],
        ["Wir haben den Saal am Mo. oder Di. noch frei.", "Das reicht."], ["Die Runde ist am Do. 14 Uhr im Saal."], ["C'est pour Me. Valbrisset et les autres."], ["The file of Gen. Thornquay is in the binder."], ["Es el último gen.", "La sesión es larga."], ["Gracias a Ud.", "La sesión es larga."],
    ],
)
def test_words_that_are_abbreviations_elsewhere(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize(
    ("script", "text"),
    [("latin", "One is here. Two is there."), ("latin", "Ready? Go!"), ("kana_han", "終わりました。次です。"), ("hangul", "끝났습니다. 다음입니다."), ("danda", "यह है। वह है।"), ("devanagari", "यह है? वह है।"), ("arabic", "لماذا ضاع؟ ضاع مرة."), ("thai", "พร้อมไหม? ไปกัน"), ("line", "First line\nsecond line"), ("line_head", "First line\n* second line")],
)
def test_first_rule_of_the_scripts_tables_decides(monkeypatch, script, text):
    assert len(sentences(text)) == 2
    monkeypatch.setitem(tables.CASCADES, script, [(0, 0, [tables._rule(False)]), *tables.CASCADES[script]])
    tables._rules.cache_clear()
    try:
        assert len(sentences(text)) == 1
    finally:
        tables._rules.cache_clear()


def test_dots_at_the_start():
    assert len(sentences("…하고 갔습니다.")) == 1


def test_lines():
    text = "Decisions\n\n* First item\n(7) Second item.\n\n12:06 hello there\n12:07 bye\n\nSPEAKER_01: A line that is wrapped at a width of sixty or so and\ngoes on here. Next one.The glued one.\nLinderly: short\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Decisions", "* First item", "(7) Second item.", "12:06 hello there", "12:07 bye", "SPEAKER_01: A line that is wrapped at a width of sixty or so and\ngoes on here.", "Next one.", "The glued one.", "Linderly: short"]
    lower = "the host only said, \"keep it.\" the night shift left in room 3. dr. ostrell came... and stayed."
    assert [lower[a:b] for a, b in sentences(lower)] == ["the host only said, \"keep it.\"", "the night shift left in room 3.", "dr. ostrell came... and stayed."]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 .!?…。！？\n\t\"“”„«»「」（）()。कहा।ครับค่ะ 다요.:؟*-")), max_size=80))
def test_every_character_once(text):
    at = 0
    for a, b in sentences(text):
        assert at <= a < b and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_column(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, " \n "), (5, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as start_char")
    assert sorted(tuple(r) for r in split_sentences(df).collect()) == [(1, 0, 4), (1, 5, 9), (5, 0, 100_000)]
    assert split_sentences(df.limit(0)).count() == 0


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


def test_words_that_are_abbreviations_elsewhere():
    for text in ("I told you so. Then he left the room.", "Please give it to me. We will check it.", "Yes, I do. The plan is fine.", "Das passt so. Schritt 37 ist fertig."):
        assert len(cut(text)) == 2, text


def test_quotations_of_any_length():
    for n in (3, 30, 3000):
        for a, b in ("“”", "„“", "«»", "「」", '""', "()"):
            inside = " ".join(f"Number {i} is here." for i in range(n))
            assert len(cut(f"Then {a}{inside}{b} was read. The end.")) == 2, (n, a)
    wrapped = "She said “we have looked at every single item of the list\nand found. That none of them is missing at all in the end\nso we go on” and left. The end."
    assert len(cut(wrapped)) == 2
    assert len(cut("He (who else. came. The door was open. Nobody asked.")) == 3  # never closed
    assert len(cut("A “B is. C is.\n\nD is. E is” f.")) > 3  # a blank line ends it
    assert tables.quotations('say "a (b) c" and (x [y] z)') == [(4, 13), (18, 27)]
    assert tables.quotations('a" b') == [] and tables.quotations("") == []


def test_rules_look_back_far_enough():
    import re

    parse = re._parser
    both_tables = [t for c in tables.CASCADES.values() for _, _, t in c if t] + [t for both in tables.LANGUAGE_NO_BREAK.values() for t in both]
    for rule in (r for t in both_tables for r in t if r.before):
        bounded = rule.before.pattern.replace(tables._MARKS_BEFORE, "").replace("[.!?…]+", "").replace(r"\s*", r"\s?").replace("{2,}", "{2}")
        assert parse.parse(bounded, rule.before.flags).getwidth()[1] <= tables.LOOK_BACK, rule.before.pattern


def test_order_of_rules_decides():
    text = "We met Dr. Smith. He left."
    assert len(cut(text)) == 2
    table = tables.GENERAL_NO_BREAK
    first = tables.Rule(True, 0, 0, None, None, None, None)
    table.insert(0, first)
    tables._rules.cache_clear()
    try:
        assert len(cut(text)) == 3
        table.remove(first)
        table.append(first)  # behind the rule of abbreviations it changes nothing
        tables._rules.cache_clear()
        assert len(cut(text)) == 2
    finally:
        table.remove(first)
        tables._rules.cache_clear()
