"""What a cue says, apart from how it was delivered: labels, clock readings, sound
annotations and fillers are taken off a canonical text.

All functions take and return plain Python values; the operators call them on whole
Arrow batches. Null and empty texts say nothing.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

from cueloom.llm.canonical import canonicalize

# Hesitation words, as whole tokens.
FILLERS = ["um", "uhm", "umm", "uh", "uhh", "er", "erm", "hmm", "hm", "mhm", "äh", "ähm", "öh", "öhm", "euh", "heu", "hum", "eh", "eeh", "em", "ehm", "えー", "えーと", "えーっと", "えと", "えっと", "ええと", "あのー", "あの", "うーん", "うーんと", "そのー", "まあ", "まー", "嗯", "呃", "唔", "음", "어", "으음", "저기"]
# Words found in sound annotations, as they begin.
SOUNDS = ["laugh", "applau", "clap", "cough", "sigh", "noise", "music", "crosstalk", "cross talk", "inaudible", "unintelligible", "silence", "phone ring", "door", "typing", "static", "background", "cheer", "sneez", "breath", "beep", "rire", "toux", "bruit", "musique", "aplau", "risa", "tosse", "suena", "tos", "ruido", "música", "gelächter", "lachen", "husten", "geräusch", "musik", "beifall", "klatschen", "笑", "拍手", "咳", "雑音", "音楽", "無音", "ノイズ", "掌声", "噪音", "音乐", "咳嗽", "웃음", "박수", "기침", "소음", "잡음", "음악"]

_SOUND = "|".join(sorted(map(regex.escape, SOUNDS), key=len, reverse=True))
_SOUND_RE = regex.compile(rf"(?:{_SOUND})", regex.I)
_CLOCK = r"\d{1,3}[:：]\d{2}(?:[:：]\d{2})?(?:[.,]\d{1,3})?"
CLOCK_RE = regex.compile(rf"[\[(（［【]\s*{_CLOCK}\s*[\])）］】]|(?<![\d:：.])\d{{1,3}}[:：]\d{{2}}[:：]\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:：])|^\s*\d{{1,3}}[:：]\d{{2}}(?=\s)")
NOTE_RE = regex.compile(rf"[\[［【](?!\s*(?:at|dot)\s*[\]］】])[\p{{L}}\p{{M}}\s'’-]{{1,40}}[\]］】]|[(（]\s*(?:{_SOUND})[^()（）]{{0,30}}[)）]|<(?!/?v\b)[\p{{L}}\p{{M}}\s/]{{1,30}}>|\*[\p{{L}}\s]{{1,30}}\*|[♪♫♬]", regex.I)
_ALL_FILLERS = "|".join(sorted(map(regex.escape, FILLERS), key=len, reverse=True))
FILLER_RE = regex.compile(rf"(?:(?<=^|[\s、。，,.…!！?？「『(（:：>\]]))(?:{_ALL_FILLERS})(?=$|[\s、。，,.…!！?？」』)）:：~～-])", regex.I)
_NUMBERED = r"(?:speaker|spk|話者|发言人|화자)[\s_＿-]*\d{1,3}"
NUMBERED_RE = regex.compile(rf"^\s*(?:speaker|spk|話者|发言人|화자)[\s_＿-]*0*(\d{{1,3}})\s*$", regex.I)
_LABEL_RE = regex.compile(
    rf"\s*(?:<v[\s.]+(?P<tag>[^>]{{1,60}})>"
    rf"|>{{1,3}}\s*(?P<arrow>[^:：<>\[\]]{{1,40}}?)\s*[:：]"
    rf"|[\[［【](?P<bracket>(?!\s*(?:at|dot)\s*[\]］】])[\p{{L}}\p{{M}}\d\s.'’()_-]{{1,40}})[\]］】]\s*[:：]?"
    rf"|(?P<number>{_NUMBERED})\s*[:：]"
    rf"|(?P<name>[\p{{L}}][\p{{L}}\p{{M}}.'’ ()_-]{{0,38}}?)\s*[:：](?!//))",
    regex.I,
)
_HOST = regex.compile(r"\s*[(（]\s*(?:host|ホスト|主持人?|co-?host|me)\s*[)）]\s*$", regex.I)
_HONORIFIC = regex.compile(r"(?:\s*(?:さん|様|くん|君|ちゃん|先生|課長|部長|社長|氏|씨|님|팀장|先生|女士|老师|经理))$")
NOBODY = {"", "?", "??", "-", "unknown", "unk", "不明", "n/a", "none", "speaker"}


class Said(NamedTuple):
    label: str | None  # the label as written in the text, canonical
    words: str  # the text without label, clock readings, annotations and fillers
    whole: str | None = None  # the words if the label is none after all; null where the label's form leaves no doubt


def name_key(label: str | None) -> str:
    """A label or display name in comparable form: no case, spaces, host mark or honorific."""
    if not label:
        return ""
    plain = _HOST.sub("", canonicalize(label) or "").strip()
    plain = _HONORIFIC.sub("", plain)
    return regex.sub(r"[\s　・]+", "", plain).casefold()


def label_number(label: str | None) -> int | None:
    """The number of a generic label such as SPEAKER_07, spk_7 or 話者7."""
    m = NUMBERED_RE.match(canonicalize(label) or "") if label else None
    return int(m[1]) if m else None


def split_label(text: str, known=None) -> tuple[str | None, str]:
    """The label at the head of a canonical text and the text after it."""
    label, rest, _ = labelled(text, known)
    return label, rest


def labelled(text: str, known=None) -> tuple[str | None, str, bool]:
    """The label at the head of a canonical text, the text after it and whether its form alone makes it a label.

    Clock readings and annotations before the label are passed over. Voice tags, arrows
    and numbered labels always count; a bare or bracketed name counts if known(name)
    says so. Without known, a bare name may be one if it has one to three words, and a bracket if it
    does not begin with a word for a sound: a heading or a remark looks the same.
    """
    label, rest, sure = None, text, True
    while True:
        head = rest.lstrip()
        m = CLOCK_RE.match(head)
        if m:
            rest = head[m.end() :]
            continue
        m = _LABEL_RE.match(head)
        if m and label is None:
            kind, got = m.lastgroup, m[m.lastgroup].strip()
            if kind in ("name", "bracket"):
                if known:
                    fits = known(got)
                else:
                    fits = len(got.split()) <= 3 and (kind == "name" or not _SOUND_RE.match(got))
                if not fits:
                    m = None
            if m:
                label, rest, sure = got, head[m.end() :], kind not in ("name", "bracket") or bool(known) or NUMBERED_RE.match(got) is not None
                if kind == "tag":
                    rest = regex.sub(r"</v>\s*$", "", rest)
                continue
        m = NOTE_RE.match(head)
        if m:
            rest = head[m.end() :]
            continue
        return label, rest, sure


_CJK_FILLERS = tuple(f for f in FILLERS if not f[0].isascii() and f[0] > "\u2e7f")
_LATIN_FILLERS = frozenset(f for f in FILLERS if f[0] < "\u0250")
_TO_SPACES = str.maketrans(dict.fromkeys("、。，,.…!！?？「」『』()（）:：<>[]~～-", " "))
_HEAD_SIGNS = frozenset(":：>[［【<(（*♪♫♬")
_NOTE_SIGNS = frozenset("[［【(（<*♪♫♬")
_SAYS = regex.compile(r"[\p{L}\p{N}\p{Extended_Pictographic}]")


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _has_filler(text: str, chars: set[str]) -> bool:
    if not text.isascii() and any(f in text for f in _CJK_FILLERS):
        return True
    return not chars.isdisjoint(_LETTERS) and not _LATIN_FILLERS.isdisjoint(text.lower().translate(_TO_SPACES).split())


@lru_cache(32768)  # short replies and repeated deliveries are the same text again
def said(text: str | None, known=None) -> Said:
    """Label and words of a cue text; both empty for a text that says nothing."""
    if not text:
        return Said(None, "")
    plain = canonicalize(text)
    chars = set(plain)
    label, rest, sure = labelled(plain, known) if not chars.isdisjoint(_HEAD_SIGNS) else (None, plain, True)
    return Said(label, _words(rest, chars), None if sure or label is None else _words(labelled(plain, lambda _: False)[1], chars))


def _words(rest: str, chars: set[str]) -> str:
    if ":" in chars or "：" in chars:
        rest = CLOCK_RE.sub(" ", rest)
    if "<" in chars:
        rest = rest.replace("</v>", " ")
    if not chars.isdisjoint(_NOTE_SIGNS):
        rest = NOTE_RE.sub(" ", rest)
    if _has_filler(rest, chars):
        rest = FILLER_RE.sub(" ", rest)
    rest = " ".join(rest.split()).lstrip(" ,、，.。…\u3000")
    return rest if _SAYS.search(rest) else ""


_UNSAID = regex.compile(r"[^\p{L}\p{M}\p{N}\p{So}]+")


def said_key(text: str | None, known=None) -> str:
    """The words of a cue for comparison: letters and digits only, without case."""
    return key_of(said(text, known).words)


def key_of(words: str) -> str:
    """Words for comparison."""
    return _UNSAID.sub("", words).casefold()
