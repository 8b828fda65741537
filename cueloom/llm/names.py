"""People's names inside free text, by what stands around them.

Candidates are words in the shape of a name; titles and honorifics, words before and after
that speak of a person, brackets behind a person word and lists of names raise their
score, words that are something else lower it. No single sign is enough but a title, an
honorific or an introduction.

Lists of names: the fixed ones below and the parts of all display names (parts_of). These are
as many as there are people, so a text need not have them at hand: every candidate says which
words would have to be known names, and what its score were then.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import regex

from cueloom.llm.speech import SOUNDS

# Frequent given names in Latin script.
GIVEN = frozenset(
    "adam alan alice alina ana andrea andreas angela anita anja anna anne antonio arthur barbara ben bernd brian camille carla carlos carmen carol caroline catherine charles charlotte chris christian christine claire clara claudia daniel david diana diego elena elisabeth elizabeth emily emma eric eva "
    "felix fernando florian francisco frank franz friedrich gabriel george gerd hannah hans heike heinz helen henry ines ingrid isabel jack jacques james jan jana jean jennifer jens jessica joan johanna john jonas jorge jose josé juan julia julie jürgen karin karl kate katharina kevin klaus laura lena "
    "leon linda lisa louis louise lucas lucia luis lukas manuel marc marco margaret maria marie mario mark markus marta martin mary matthias maya michael miguel mike monica nadia nancy nicolas nicole nina noah olga oliver pablo patrick paul paula pedro peter petra philip pierre priya rachel ralf raul "
    "richard robert rosa ruth sabine samuel sandra sara sarah sebastian simon sofia sophie stefan stephan stephen steve steven susan susanne sven thomas tim tom uwe victor vincent walter werner william wolfgang yuki akira haruto hiroshi kenji sakura takashi yuko wei ming jing min-jun jisoo".split()
)
# Frequent family names in Han and Hangul.
FAMILY_JA = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 岡本 金子 藤原 三浦 中野 原田 中川 松田 竹内 小野 田村 中山 和田 石田 上田 森田 柴田 酒井 工藤 横山 宮崎 宮本 内田 高木 安藤 谷口 大野 丸山 今井 高田 藤本 武田 村田 上野 杉山 増田 平野 大塚 久保 松井 小島 岩崎 桜井 野口 松尾 野村 木下 菊地 佐野 大西 杉本 新井".split()
FAMILY_ZH = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤凌柳颜")
FAMILY_KO = frozenset("김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용빙팽")
# Titles and honorifics.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|Herr|Herrn|Frau|Hr|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Don|Doña|Dra|Señor|Señora|Ing)"
_HON_JA = r"(?:さん|様|さま|くん|君|ちゃん|先生|課長|部長|社長|主任|係長|氏)"
_HON_ZH = r"(?:先生|女士|老师|经理|主任|总监|博士|教授)"
_HON_KO = r"(?:씨|님|팀장|과장|부장|대리|선생님|교수님)"
# Words with a capital or in Han that are not people: groups, offices, times, places, products, things of a meeting.
NOT_NAMES = frozenset(
    "the a an at dot me our my your his her its their this that these those we you they it he she who what when where why how yes no not nobody everyone someone somebody anybody whoever half all both please thanks today yesterday tomorrow tonight now then there here also however maybe god "
    "host co-host note notes item items action agenda todo todos update question questions answer answers summary remember decision decisions result results next step steps project team group board panel office desk finance sales marketing legal support engineering product design operations hr it security research accounting procurement management "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december christmas easter english german french spanish japanese chinese korean berlin london paris madrid tokyo munich vienna zurich rome new york europe asia america germany france spain japan china korea "
    "google slack zoom teams excel word outlook spark windows linux docker kubernetes github internet wifi english option version ticket invoice meeting channel email mail phone mute und oder aber der die das den dem ein eine einer wir sie er es ich ihr heute morgen gestern montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "ergebnis frage antwort beschluss niemand jemand alle alles jeder schritt vertrieb einkauf rechnung sitzung protokoll le la les un une des on nous vous il elle ils elles je tu personne quelqu'un équipe groupe point question décision réunion lundi mardi mercredi jeudi vendredi el los las una unos nosotros ella ellos alguien nadie todos equipo grupo punto pregunta reunión lunes martes miércoles jueves viernes".split()
)
NOT_NAMES_HAN = "会議 資料 議事 録音 録画 会場 担当 全員 参加 主催 事務 経理 営業 開発 総務 人事 広報 法務 司会 書記 議長 進行 音声 画面 予算 日程 顧客 客様 皆様 奥様 神様 自分 相手 弊社 御社 当社 本社 支社 各社 各位 東京 大阪 京都 名古屋 今日 明日 昨日 今回 次回 前回 以上 以下 任意 必須 参考 省略 予定 未定 確認 検討 重要 注意 結果 決定 質問 回答 意見 問題 時間 午前 午後 受付 部屋 電話 番号 内容 説明 原稿 下書 字幕 用語 編集 校正 班 係 側 系统 会议 录音 大家 我们 他们 主持 记录 财务 客户 时间 问题 文件 今天 明天 笑 拍手 掌声 音乐".split()
# Words before a name, and behind one, that speak of a person. Weak ones need more.
_LEFT = regex.compile(
    r"(?:(?<![\p{L}])(?:wait(?:ing)? for|ask(?:ed|ing)?|tell|told|call(?:ed)?|met|thank(?:s| you)?,?|dear|hello|hi|hey|that (?:was|is)|(?:spoke|spoken|speaking|talked|talking|met|meeting) (?:with|to)|it (?:was|is)|so|i think|email(?:ed)?|invited?"
    r"|warten (?:noch )?auf|das (?:war|ist)|danke,?|fragen sie|fragt?e?|ich glaube,?|gesprochen mit|mein name ist|attend (?:encore )?|merci,?|je crois que|bonjour,?|parlé (?:à|avec)|de antes era|gracias,?|creo que|hola,?|falta|hablé con)|c['’](?:était|est))\s*$", regex.I)
_LEFT_WEAK = regex.compile(r"(?<![\p{L}])(?:with|from|by|to|and|this is|i am|i'm|mit|von|avec|par|con|por|de parte de)\s+$", regex.I)
_INTRODUCES = regex.compile(r"(?<![\p{L}])(?:my name is|ich hei(?:ß|ss)e|je m['’]appelle|me llamo|mein name ist)\s+$", regex.I)
_RIGHT = regex.compile(
    r"\s+(?:speaking|talking|on the (?:line|phone|call)|and i\b|who\b|will(?: not)?\b|won['’]t\b|would\b|said\b|says\b|asked\b|asks\b|thinks\b|wants\b|called\b|calls\b|told\b|wrote\b|joined\b|joins\b|has\b|is\b|was\b|to \p{Ll}+|about\b|for the\b|if\b|whether\b"
    r"|hat\b|ist\b|wird\b|sagt\b|sagte\b|kommt\b|kam\b|meint\b|fragt\b|fragte\b|nach\b|wegen\b|tout\b|qui\b|est\b|va\b|pense\b|demande\b|a (?:dit|le|la|les|un|une)\b|todavía\b|aún\b|tiene\b|es\b|está\b|dice\b|dijo\b|va\b|quiere\b)"
    r"|,\s*(?:go|please|over|that|can|could|would|will|nicht|bitte|können|allez|continuez|vous|siga|sigue|por favor|puede|s['’]il)(?![\p{L}])", regex.I)
_RIGHT_END = regex.compile(r"\s*(?:[.!?。]|$)")
_PERSON_WORD = regex.compile(
    r"(?<![\p{L}])(?:lead|leader|manager|host|chair|speaker|colleague|volunteer|member|team|group|desk|side|shift|crew|panel|call|room|proofreader|interpreter|editor|guest|leitung|gruppe|team|schicht|seite|büro|raum|mitglied|sprecher(?:in)?|kolleg(?:e|in)|freiwillige|runde|panel|équipe|groupe|personne|salle|bénévole|collègue|responsable|côté|équipe de nuit|titres|nuit|archives"
    r"|equipo|grupo|panel|voluntari[oa]|colega|sala|mesa|turno|cabina|técnica|responsable|nadie|niemand|nobody|client|cliente|kunde|kundenseite|office|bureau|oficina|reviewer|half|hälfte|moitié|mitad|corner|one|person)\s*$", regex.I)
_CLAUSE = regex.compile(r"(?:^|[.!?,;:>\])）、。]\s*)$")
_W = rf"(?!(?i:{_TITLE})(?:\.\s?|\s)\p{{Lu}})\p{{Lu}}[\p{{L}}'’-]+"
_CANDIDATE = regex.compile(rf"(?<![\p{{L}}\d@./_&-])(?:(?P<t>(?i:{_TITLE}))(?:\.\s?|\s))?(?P<n>{_W}(?:\s(?:(?:de la|de|del|van|von|da|di)\s)?{_W}){{0,2}})(?![\p{{L}}\d@])")
# In texts without capitals a name needs words on both sides, or a title.
_CANDIDATE_LOWER = regex.compile(rf"(?<![\p{{L}}\d'’@./_&-])(?:(?P<t>{_TITLE.lower()})(?:\.\s?|\s))?(?P<n>\p{{Ll}}[\p{{L}}'’-]{{2,}}(?:\s\p{{Ll}}[\p{{L}}'’-]{{2,}})?)(?![\p{{L}}\d@])")
_SOUND = regex.compile("|".join(map(regex.escape, SOUNDS)), regex.I)
_CAPITAL_WORDS = re.compile("(?:[^\\W\\d_]['’])?[A-ZÀ-ÖØ-Þ][^\\W\\d_]*")
_WORD = regex.compile(r"[\p{L}'’-]+")
_ELIDED = regex.compile(r"(?:[cdjlmnst]|qu)['’]", regex.I)
# Words that stand between a person and what they do, where a text has no capitals.
_VERBS = frozenset("asked ask called call told tell said says thinks wants wrote joined and or with from by to for about who will would has is was met so i think thank thanks danke merci gracias around".split())
# Without one of these no candidate can reach the threshold.
_TRIGGER = regex.compile(rf"(?<!\p{{L}})(?i:{_TITLE})(?:\.\s?|\s)\p{{L}}|\p{{Lu}}[\p{{L}}'’-]+\s(?:(?:de la|de|del|van|von|da|di)\s)?\p{{Lu}}|(?i:{_LEFT.pattern[:-4]})\s*\p{{Lu}}|(?i:{_INTRODUCES.pattern[:-1]})|(?<!\p{{L}})\p{{Lu}}[\p{{L}}'’-]+(?i:{_RIGHT.pattern})")
_TRIGGER_LOWER = regex.compile(rf"(?<!\p{{L}}){_TITLE.lower()}(?:\.\s?|\s)\p{{L}}|{_LEFT.pattern[:-1]}", regex.I)
_FIRST_WORDS = NOT_NAMES | frozenset("so um uh well okay right hmm äh ähm also und dann heute danke merci gracias bonjour hola hi hello dear thank yes ja nein oui non sí falta wait waiting warten creo je merci fragen mein meine meinen unser unsere euer ihre mon ma mes notre votre nos vos mi mis tu su nuestro nuestra ask note text call ring send nur wer mais puis et y pero entonces that's it's let's i i'm i'll".split())

_KANJI = r"[\p{Han}ヶ々]"
_JA_HONORED = regex.compile(rf"(?<![\p{{Han}}お御ご])(?P<n>(?P<s>{_KANJI}{{2,6}}(?:[ 　][\p{{Han}}々]{{1,3}})?){_HON_JA})(?!\p{{Han}})")
_JA_RIGHT = r"(?:と申し|といいます|と言います|と私|だと思|の担当|がまだ|[がはも](?:来|入|言|話|発言|参加|欠席|遅刻|遅れ|到着|退室|出席|質問|説明|帰|休)|に(?:渡|聞|頼|お願い|連絡|伝え|任せ|相談)|、(?:続き|どうぞ|お願い|いかが|聞こえ|すみません)|の(?:意見|発言|提案|番(?!号)))"
_JA_PLAIN = regex.compile(rf"(?<![\p{{Han}}ヶ々])(?P<n>{_KANJI}{{2,6}}(?:[ 　][\p{{Han}}々]{{1,3}})?)(?={_JA_RIGHT})")
_JA_LEFT = regex.compile(r"(?:^|[、。！？!?\s>:：）)\]］「]|は|が|と)$")
_JA_OFFICE = regex.compile(r"[者員側班係組部課室社会長所証]$")
_JA_HONOR = re.compile(_HON_JA)
_KANA = re.compile(r"[ぁ-ヺ]")
_HANGUL = re.compile(r"[가-힣]")
_JA_TRIGGER = re.compile(_JA_RIGHT)
_ZH_LEAD = r"(?:还在等|在等|刚才是|才是|谢谢|感谢|请问|问问|我叫|我是|这是|联系|通知|告诉|邀请|是|和|跟|给|请|找|问)"
_ZH_HONORED = regex.compile(rf"(?:(?<!\p{{Han}})|(?<={_ZH_LEAD})|(?<=[的，。]))(?P<n>(?P<s>\p{{Han}}{{1,4}}?){_HON_ZH})")
_ZH_BEFORE = regex.compile(rf"{_ZH_LEAD}$")
_ZH_PLAIN = regex.compile(rf"{_ZH_LEAD}(?P<n>\p{{Han}}{{2,4}}?)(?=在讲|在说|说|来了|[，,。.！!？?\s]|$)")
_KO_HONORED = regex.compile(rf"(?<![가-힣])(?P<n>(?P<s>[가-힣]{{2,4}})\s?{_HON_KO})(?![가-힣]*님)")
_KO_PLAIN = regex.compile(r"(?:아직|목소리는|이름은|저는)\s(?P<n>[가-힣]{3,4})(?=\s?(?:안\s|같|입니다|이에요|라고|님|씨))|(?<![가-힣])(?P<n>[가-힣]{3,4})(?=입니다만|라고 합니다)")
# Without one of these no pattern of a script can match.
_KO_TRIGGER = re.compile(r"씨|님|팀장|과장|부장|대리|(?:아직|목소리는|이름은|저는)\s|입니다만|라고 합니다")
_ZH_TRIGGER = re.compile(f"{_HON_ZH}|{_ZH_LEAD}")
_BRACKETED = regex.compile(r"[(（]\s*(?P<n>[^()（）\d@]{2,32}?)\s*[)）]")
_LATIN_NAME = regex.compile(rf"(?:(?i:{_TITLE})\.?\s)?[\p{{Latin}}][\p{{Latin}}'’-]{{2,}}(?:\s[\p{{Latin}}][\p{{Latin}}'’-]{{2,}}){{0,2}}")
_HAN_NAME = regex.compile(rf"(?P<s>{_KANJI}{{2,7}}(?:[ 　][\p{{Han}}々]{{1,3}})?)(?P<h>{_HON_JA})?|(?P<s>[가-힣]{{3,4}})(?P<h>\s?(?:씨|님|팀장|과장|부장))?")
_TITLE_HEAD = regex.compile(rf"^{_TITLE}\.?\s", regex.I)
_KO_NOT = frozenset("여러분 선생 고객 누구 사용자 참석자 담당자 진행자 관리자 대표 팀원".split())
_FAMILY_JA = tuple(FAMILY_JA)
_SPACE = regex.compile(r"[\s　]")


_CAPITALS = frozenset(map(chr, (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))))
_SMALL = frozenset("abcdefghijklmnopqrstuvwxyz")


class Found(NamedTuple):
    """A candidate and its score; lifted is what the score were if one of the words in asks were a known name."""

    start: int
    end: int
    score: float
    lifted: float
    asks: tuple[str, ...]


def parts_of(name: str | None) -> set[str]:
    """A name and, where spaces part it, its parts, in comparable form."""
    if not name:
        return set()
    parts = regex.split(r"[\s　・]+", name.strip().casefold())
    return {"".join(parts), *(p for p in parts if len(p) > 1)} - {""}


def _weighed(score: Callable[[bool], float], listed: bool, asks: tuple[str, ...], known: frozenset[str]) -> tuple[float, float, tuple[str, ...]]:
    """Score, lifted and asks of a candidate; score takes whether a list of names has it, listed says that a fixed one does."""
    if listed or not known.isdisjoint(asks):
        sure = score(True)
        return sure, sure, ()
    return score(False), score(True), asks


def _asks(words: list[str]) -> tuple[str, ...]:
    return (*words, "".join(words)) if len(words) > 1 else tuple(words)


def _asks_han(name: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a fixed list has a name in Han or Hangul, and what to ask for else: the name and its first signs."""
    plain = _SPACE.sub("", name)
    return plain.startswith(_FAMILY_JA), (plain, *(plain[:i] for i in range(2, min(len(plain), 5))))


def _ordinary_han(name: str) -> bool:
    return any(w in name for w in NOT_NAMES_HAN)


def _trimmed(text: str, a: int, b: int) -> int:
    """Where a candidate begins once words and elisions that only stand with a capital at a sentence's head are left out."""
    while a < b:
        m = _WORD.match(text, a, b)
        if not m:
            return b
        word = m[0].casefold()
        if word in _FIRST_WORDS or word.rstrip("'’s") in _FIRST_WORDS:
            a = m.end() + 1
        elif elided := _ELIDED.match(m[0]):
            a += elided.end()
            if not text[a : a + 1].isupper():
                a = m.end() + 1
        else:
            return a
    return b


def _score(text: str, a: int, b: int, known: frozenset[str], titled: bool, lower: bool) -> tuple[float, float, tuple[str, ...]]:
    before = text[max(0, a - 28) : a]
    left = _LEFT.search(before) is not None
    if lower and not titled and not left:
        return 0.0, 0.0, ()
    words = text[a:b].casefold().split()
    right, introduced = _RIGHT.match(text, b) is not None, _INTRODUCES.search(before) is not None
    more = 0.15 * (_LEFT_WEAK.search(before) is not None) if not left else 0.2 * (not right and _RIGHT_END.match(text, b) is not None)
    other = any(w in NOT_NAMES or lower and w in _VERBS for w in words) or _SOUND.match(words[0]) is not None

    def score(listed: bool) -> float:
        if lower and not titled and not (right or listed):
            return 0.0
        return 0.55 * titled + 0.3 * (len(words) > 1) + 0.4 * listed + 0.3 * left + 0.3 * right + 0.6 * introduced + more - 0.6 * other

    return _weighed(score, not GIVEN.isdisjoint(words), _asks(words), known)


def _latin(text: str, start: int, lower: bool, known: frozenset[str]) -> Iterator[Found]:
    if lower:
        if not _TRIGGER_LOWER.search(text, start):
            return
        for m in _CANDIDATE_LOWER.finditer(text, start, overlapped=True):
            a, b = m.span("n")
            titled = m["t"] is not None and _firm(text, m, lower)
            for end in {b, a + len(m["n"].split()[0])}:
                yield Found(m.start("t") if titled else a, end, *_score(text, a, end, known, titled, True))
        return
    # Words that are never part of a name need no look at what stands around them.
    if all(w.lower() in _FIRST_WORDS for w in _CAPITAL_WORDS.findall(text, start)) or not _TRIGGER.search(text, start):
        return
    at = start
    while m := _CANDIDATE.search(text, at):
        a, b = m.span("n")
        titled = m["t"] is not None and _firm(text, m, lower)
        head = a if titled else _trimmed(text, a, b)
        if a < head < b:
            at = head  # what is left may begin with a title
            continue
        at = b
        if head < b:
            yield Found(m.start("t") if titled else a, b, *_score(text, a, b, known, titled, False))


def _firm(text: str, m: regex.Match, lower: bool) -> bool:
    """Short titles are also words and initials, so they need their dot or case."""
    t = m["t"]
    return len(t) > 2 or text[m.end("t")] == "." or t in ("Mr", "Ms", "Dr", "Sr", "Hr") or lower and t in ("mr", "ms", "dr", "sr")


def _cjk(text: str, start: int, known: frozenset[str]) -> Iterator[Found]:
    if _HANGUL.search(text, start):
        if _KO_TRIGGER.search(text, start):
            for m in _KO_HONORED.finditer(text, start):
                yield Found(*m.span("n"), *_weighed(lambda listed, s=m["s"]: 0.35 + 0.25 * (s[0] in FAMILY_KO) + 0.4 * listed - 0.6 * (s in _KO_NOT), False, (m["s"],), known))
            for m in _KO_PLAIN.finditer(text, start):
                yield Found(*m.span("n"), *_weighed(lambda listed, n=m["n"]: 0.3 + 0.3 * (n[0] in FAMILY_KO) + 0.4 * listed - 0.6 * (n in _KO_NOT), False, (m["n"],), known))
    elif _KANA.search(text, start):
        if _JA_HONOR.search(text, start):
            for m in _JA_HONORED.finditer(text, start):
                ordinary = _ordinary_han(m["n"])
                yield Found(*m.span("n"), *_weighed(lambda listed, ordinary=ordinary: 0.6 + 0.4 * listed - 0.6 * ordinary, *_asks_han(m["s"]), known))
        if _JA_TRIGGER.search(text, start):
            for m in _JA_PLAIN.finditer(text, start):
                a, b = m.span("n")
                office = _JA_OFFICE.search(m["n"]) is not None
                left = _JA_LEFT.search(text[max(0, a - 4) : a]) is not None
                ordinary = _ordinary_han(m["n"])
                yield Found(a, b, *_weighed(lambda listed, left=left, ordinary=ordinary, office=office: 0.35 + 0.2 * left + 0.4 * listed - 0.6 * (ordinary or office and not listed), *_asks_han(m["n"]), known))
    elif _ZH_TRIGGER.search(text, start):
        for m in _ZH_HONORED.finditer(text, start):
            before, ordinary = _ZH_BEFORE.search(text[max(0, m.start() - 3) : m.start()]) is not None, _ordinary_han(m["s"])
            yield Found(*m.span("n"), *_weighed(lambda listed, s=m["s"], before=before, ordinary=ordinary: 0.4 + 0.2 * before + 0.3 * (s[0] in FAMILY_ZH) + 0.4 * listed - 0.6 * ordinary, False, (m["s"],), known))
        for m in _ZH_PLAIN.finditer(text, start):
            ordinary = _ordinary_han(m["n"])
            yield Found(*m.span("n"), *_weighed(lambda listed, n=m["n"], ordinary=ordinary: 0.3 + 0.3 * (n[0] in FAMILY_ZH) + 0.4 * listed - 0.6 * ordinary, False, (m["n"],), known))


def _in_brackets(text: str, start: int, lower: bool, known: frozenset[str]) -> Iterator[Found]:
    for m in _BRACKETED.finditer(text, start):
        got = m["n"]
        if _SOUND.match(got):
            continue
        if _LATIN_NAME.fullmatch(got) and (lower or all(w[0].isupper() for w in got.split())):
            bare = _TITLE_HEAD.sub("", got)
            words = bare.casefold().split()
            person, other = _PERSON_WORD.search(text[max(0, m.start() - 24) : m.start()]) is not None, any(w in NOT_NAMES for w in words)
            score = lambda listed, n=len(words), titled=bare != got, person=person, other=other: 0.3 + 0.3 * (n > 1) + 0.5 * titled + 0.4 * listed + 0.3 * person - 0.6 * other
            yield Found(*m.span("n"), *_weighed(score, not GIVEN.isdisjoint(words), _asks(words), known))
        elif han := _HAN_NAME.fullmatch(got):
            name = han["s"]
            score = lambda listed, honored=han["h"] is not None, other=_ordinary_han(name) or name in _KO_NOT: 0.5 + 0.4 * honored + 0.4 * listed - 0.6 * other
            yield Found(*m.span("n"), *_weighed(score, *_asks_han(name), known))


def propose(text: str, chars: set[str], start: int = 0, known: frozenset[str] = frozenset()) -> list[Found]:
    """Scored names in a canonical text from start on; chars are its characters."""
    out: list[Found] = []
    lower = chars.isdisjoint(_CAPITALS)
    if not lower or not chars.isdisjoint(_SMALL):
        out.extend(_latin(text, start, lower, known))
    if chars and max(chars) > "\u2e7f":
        out.extend(_cjk(text, start, known))
    if "(" in chars or "（" in chars:
        out.extend(_in_brackets(text, start, lower, known))
    return out
