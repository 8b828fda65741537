"""Annotation of chunks by a pluggable annotator: prompts, retries, validation, faults as rows."""

from __future__ import annotations

import json
import random
import time
import traceback
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section heads of a prompt.
HEAD_BEFORE = "=== 前文脈（参照のみ・出力不要） ==="
HEAD_PRIMARY = "=== 主VTT（Whisper+pyannote・処理対象） ==="
HEAD_ZOOM = "=== Zoom VTT（補助データ・参照ラベルは出力に使用禁止） ==="
HEAD_AFTER = "=== 後文脈（参照のみ・出力不要） ==="
HEAD_DICTIONARY = "=== 用語辞書（正しい表記のリスト） ==="
HEAD_FEEDBACK = "=== 【重要】前回の出力の誤り ==="
HEAD_CONTEXT = "=== この会議/インタビューの背景情報 ==="
# Sentences that mark the two kinds of instruction.
DUAL_MARK = "主VTT（Whisper+pyannote）とZoom VTT（補助データ）を統合・整形してください"
SINGLE_MARKS = ["主VTT（Whisper+pyannote）のみを整形してください", "source は常に PRIMARY を使用すること", "uncertain_reason=AB_MISMATCH は使用しないこと"]

_COMMON_RULES = [
    "対象の全IDを、いずれか一つの発話の source_ids に漏れなく一度だけ含めること。",
    "一つの発話にまとめるIDは連続していること。前後文脈のIDを出力しないこと。",
    "話者ラベルは入力のまま使い、推測で実名に置き換えないこと。",
    "category は CONTENT / BACKCHANNEL / ACK_DECISION、edit_type は NORMALIZE / VTT_SUPPLEMENT / UNRESOLVED / NONE から選ぶこと。",
    "聞き取れない箇所は補わず、uncertain を true とし uncertain_reason に理由を記すこと。",
    "意味を変えず、フィラーと言い直しだけを整えること。",
]


def instruction(dual: bool) -> str:
    """What the annotator is asked to do, for two recordings or for one."""
    if dual:
        lines = [f"{DUAL_MARK}。", *_COMMON_RULES, "主VTTに無い発話を補う場合だけ V_INSERT_ で始まるIDを用い、ZOOM_REF の参照ラベルを出力しないこと。", "両者が食い違う箇所は uncertain_reason=AB_MISMATCH とすること。"]
    else:
        lines = [f"{SINGLE_MARKS[0]}。", *_COMMON_RULES, f"{SINGLE_MARKS[1]}。V_INSERT_ のIDを作らないこと。", f"{SINGLE_MARKS[2]}。"]
    return "\n".join(lines)


def dictionary_section(dictionary: dict[str, list[str]] | list[str] | None) -> str:
    """The dictionary part of a prompt; empty without a dictionary."""
    if not dictionary:
        return ""
    lines = ["", HEAD_DICTIONARY, "会議に現れうる固有名詞の正しい表記です。誤認識を見つけた場合はこの表記に直してください。", ""]
    if isinstance(dictionary, dict):
        for name, terms in dictionary.items():
            lines.append(f"【{name}】" + ("、".join(map(str, terms)) if isinstance(terms, list) and terms else "（なし）"))
    else:
        lines += [f"- {t}" for t in dictionary]
    return "\n".join(lines)


def feedback_section(errors: list[str], dual: bool) -> str:
    """What a repeated request says about the answer before."""
    if not errors:
        return ""
    rule = "Zoom VTTの参照ラベル（ZOOM_REF_***）を含めないでください。" if dual else "新しいIDや V_INSERT_* を作成しないでください。"
    return "\n".join([HEAD_FEEDBACK, "前回の応答は次の理由で不合格でした。同じ誤りを繰り返さないでください。", *(f"- {e}" for e in errors), "", "id と source_ids には主VTTに記載された U000001 形式のIDのみを使用してください。" + rule, ""])


def _lines(role: str, line: Column) -> Column:
    """The lines of one role in order of pos, joined; null if the chunk has none."""
    rows = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("pos", line.alias("line")))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["line"]), "\n"))


def prompt_bodies(parts: DataFrame, extra: str = "") -> DataFrame:
    """job_id, chunk_index, expected_ids, body: the data sections of every chunk's prompt.

    ``parts``: job_id, chunk_index, role (BODY, ZOOM, CTX_BEFORE, CTX_AFTER), pos, uid, speaker,
    text. A chunk is bounded by its target duration, so its lines are one row. A null speaker
    is UNKNOWN, or left out for ZOOM lines, which are numbered within the chunk; no times
    are given. ``extra`` (the dictionary section) follows.
    """
    who = F.when(F.length("speaker") > 0, F.col("speaker"))
    said = F.concat(F.coalesce(who, F.lit("UNKNOWN")), F.lit(": "), F.coalesce("text", F.lit("")))
    zoom = F.sort_array(F.collect_list(F.when(F.col("role") == "ZOOM", F.struct("pos", F.concat(F.coalesce(F.concat(who, F.lit(": ")), F.lit("")), F.coalesce("text", F.lit(""))).alias("line")))))
    numbered = F.transform(zoom, lambda r, i: F.concat(F.format_string("[ZOOM_REF_%03d] ", i + 1), r["line"]))
    grouped = parts.groupBy("job_id", "chunk_index").agg(
        _lines("CTX_BEFORE", F.concat(F.lit("[CTX] "), said)).alias("before"), _lines("BODY", F.concat(F.lit("["), F.col("uid"), F.lit("] "), said)).alias("body"),
        F.when(F.size(zoom) > 0, F.array_join(numbered, "\n")).alias("zoom"), _lines("CTX_AFTER", F.concat(F.lit("[CTX] "), said)).alias("after"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "BODY", F.struct("pos", "uid")))), lambda r: r["uid"]).alias("expected_ids"),
    )
    section = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{head}\n"), F.col(c)))
    primary = F.concat(F.lit(f"\n{HEAD_PRIMARY}"), F.coalesce(F.concat(F.lit("\n"), F.col("body")), F.lit("")))
    text = F.concat_ws("\n", section(HEAD_BEFORE, "before"), primary, section(HEAD_ZOOM, "zoom"), section(HEAD_AFTER, "after"), *([F.lit(extra)] if extra else []))
    return grouped.select("job_id", "chunk_index", "expected_ids", text.alias("body"))


def build_prompt(body: str, dual: bool = True, context_prompt: str | None = None, errors: list[str] | None = None) -> str:
    """A whole prompt: feedback, context, instruction, data sections."""
    context = f"{HEAD_CONTEXT}\n{context_prompt}\n" if context_prompt else ""
    return "\n".join(p for p in (feedback_section(errors or [], dual), context, instruction(dual), body) if p)


class AnnotationError(Exception):
    """The annotator gave no answer."""


class RetryableError(AnnotationError):
    """A failure that may pass; retry_after is the least wait in seconds."""

    def __init__(self, message: str, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after


class NonRetryableError(AnnotationError):
    """A failure that will not pass."""


class Annotator(Protocol):
    """What an annotation service must offer; it is made once per partition."""

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]: ...


def classify_error(message: str) -> type[AnnotationError]:
    """Whether a service's message speaks of a passing failure."""
    low = message.lower()
    if any(w in low for w in ("429", "rate limit", "quota", "500", "503", "timeout", "deadline")):
        return RetryableError
    return NonRetryableError if any(w in low for w in ("400", "invalid")) else RetryableError


def call_with_retry(call: Callable[[], dict], max_retries: int = 3, backoff_base: float = 2, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of a call, tried max_retries times with growing waits between."""
    last: Exception | None = None
    for attempt in range(1, max_retries + 1):
        try:
            return call()
        except NonRetryableError as e:
            raise AnnotationError(str(e)) from e
        except RetryableError as e:
            last = e
            wait = backoff_base**attempt + random.random()
            sleep(max(wait, e.retry_after or 0))
    raise AnnotationError(f"no answer after {max_retries} attempts: {last}")


def _utterance(uid: str, line: dict, ids: list[str], text: str | None = None) -> dict:
    return {
        "id": uid, "speaker": line["speaker"] or "UNKNOWN", "text": text if text is not None else line["text"] or "", "category": "CONTENT", "uncertain": False, "uncertain_reason": "NONE", "uncertain_span_ids": [],
        "source": "PRIMARY", "source_ids": ids, "vtt_supplemented": False, "edit_type": "NONE", "edit_note": "",
    }


class IdentityAnnotator:
    """Every cue as its own utterance."""

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]:
        return {"utterances": [_utterance(x["uid"], x, [x["uid"]]) for x in lines]}


class MergeAnnotator:
    """Neighbouring cues of one speaker as one utterance."""

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]:
        out: list[dict] = []
        for x in lines:
            if out and out[-1]["speaker"] == (x["speaker"] or "UNKNOWN"):
                out[-1]["source_ids"].append(x["uid"])
                out[-1]["text"] += " " + (x["text"] or "")
            else:
                out.append(_utterance(x["uid"], x, [x["uid"]]))
        return {"utterances": out}


class FaultyAnnotator(IdentityAnnotator):
    """Identity with one fault, for tests: drop, repeat, unknown, jump, format, empty, fail."""

    def __init__(self, fault: str, times: int = 1 << 30) -> None:
        self.fault, self.left = fault, times

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]:
        out = super().call(prompt, expected_ids, lines)
        if self.left <= 0:
            return out
        self.left -= 1
        u = out["utterances"]
        if self.fault == "drop":
            out["utterances"] = u[:-1]
        elif self.fault == "repeat":
            u[-1]["source_ids"] = [*u[-1]["source_ids"], u[0]["id"]]
        elif self.fault == "unknown":
            u[0]["source_ids"] = [*u[0]["source_ids"], "U999999"]
        elif self.fault == "jump" and len(u) > 2:
            u[0]["source_ids"], u[2]["source_ids"] = [u[0]["id"], u[2]["id"]], []
        elif self.fault == "format":
            u[0]["id"] = "1"
        elif self.fault == "empty":
            out["utterances"] = []
        elif self.fault == "fail":
            raise RetryableError("503")
        return out


# Services by name; a service that needs the network registers itself here.
ANNOTATORS: dict[str, Callable[..., Annotator]] = {"identity": IdentityAnnotator, "merge": MergeAnnotator, "faulty": FaultyAnnotator}


def _no_network(name: str) -> Callable[..., Annotator]:
    def make(**_: Any) -> Annotator:
        raise NonRetryableError(f"provider {name} has no client here; register one in ANNOTATORS")

    return make


for _name in ("openai", "anthropic"):
    ANNOTATORS.setdefault(_name, _no_network(_name))


def annotator_factory(name: str) -> Callable[..., Annotator]:
    """What makes the annotator of a name; ValueError for a name that is not registered."""
    if name not in ANNOTATORS:
        raise ValueError(f"unknown provider {name!r}")
    return ANNOTATORS[name]


def get_annotator(name: str, **options: Any) -> Annotator:
    """The annotator of a name; ValueError for a name that is not registered."""
    return annotator_factory(name)(**options)


def check_ids(output: dict, expected: list[str]) -> list[str]:
    """The errors of an answer, as validate() finds them; needed between two calls of a retry."""
    utts = output.get("utterances") or []
    if not utts:
        return ["no utterances"]
    known, errors, all_ids = set(expected), [], []
    for u in utts:
        uid = u.get("id") or ""
        all_ids += u.get("source_ids") or []
        if uid.startswith("U") and uid not in known:
            errors.append(f"invalid id: unexpected U id {uid}")
    errors += [f"invalid id format: {i}" for i in (u.get("id") or "" for u in utts) if i and not i.startswith(("U", "V_INSERT_"))]
    got = set(all_ids)
    missing = [i for i in dict.fromkeys(expected) if i not in got]
    counted = [i for i in all_ids if not i.startswith("V_INSERT_")]
    tally = pd.Series(counted, dtype=object).value_counts()
    dup = [i for i in dict.fromkeys(counted) if tally[i] > 1]
    unknown = sorted(i for i in got - known if not i.startswith("V_INSERT_"))
    for what, ids in (("missing", missing), ("duplicate", dup), ("unknown", unknown)):
        if ids:
            errors.append(f"{what}: {len(ids)} ids: [{', '.join(repr(i) for i in ids[:5])}]")
    return errors


RESULT_SCHEMA = (
    "job_id string, chunk_index int, status string, result string, retries int, errors array<string>, error_type string, error_message string, "
    "traceback string, id_validation struct<passed:boolean,retries:int,errors:array<string>>, prompts array<string>, answers array<string>"
)
RESULT_FIELDS = [f.strip().split()[0] for f in RESULT_SCHEMA.split(", ")]


def _annotate(make: Callable[..., Annotator], options: dict, dual: bool, context_prompt: str | None, max_retries: int, validation_retries: int, backoff: float, save_prompt: bool, save_answer: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service: Annotator | None = None
        for batch in batches:
            rows = []
            for job, chunk, expected, body, lines in zip(batch["job_id"], batch["chunk_index"], batch["expected_ids"], batch["body"], batch["lines"], strict=True):
                expected = list(expected)
                todo = [dict(x) if isinstance(x, dict) else x.asDict() for x in lines]
                errors: list[str] = []
                sent: list[str] | None = [] if save_prompt else None
                got: list[str] | None = [] if save_answer else None
                checked: dict | None = None
                try:
                    for attempt in range(validation_retries + 1):
                        if service is None:
                            service = make(**options)
                        prompt = build_prompt(body, dual, context_prompt, errors)
                        if sent is not None:
                            sent.append(prompt)
                        answer = call_with_retry(lambda p=prompt, e=expected, t=todo: service.call(p, e, t), max_retries, backoff)
                        if got is not None:
                            got.append(json.dumps(answer, ensure_ascii=False))
                        errors = check_ids(answer, expected)
                        checked = {"passed": not errors, "retries": attempt, "errors": errors}
                        if not errors:
                            break
                    if errors:
                        raise ValueError("; ".join(errors))
                    rows.append((job, chunk, "ok", json.dumps(answer, ensure_ascii=False), attempt, [], None, None, None, checked, sent, got))
                except Exception as e:  # a chunk that fails is a row, never a failed task
                    rows.append((job, chunk, "error", None, checked["retries"] if checked else 0, errors, type(e).__name__, str(e), traceback.format_exc(), checked, sent, got))
            yield pd.DataFrame(rows, columns=RESULT_FIELDS)

    return run


def annotate(prompts: DataFrame, provider: str = "identity", options: dict | None = None, dual: bool = True, context_prompt: str | None = None, max_retries: int = 3, validation_retries: int = 2, backoff: float = 2, save_prompt: bool = False, save_answer: bool = False) -> DataFrame:
    """One row a chunk in RESULT_SCHEMA: status ok with the answer, or error with its reason.

    ``prompts``: job_id, chunk_index, expected_ids, body and lines (ARRAY<STRUCT<uid, speaker, text>> of
    the body in order). The service is looked up here, so that one registered on the driver reaches the
    workers. Calls to the outside happen here and nowhere else; write the result
    before it is used, so that no later action repeats them. ``prompts`` and ``answers`` of the result hold every
    attempt if asked for, else null; id_validation is null where no answer came to be checked.
    """
    spread = prompts.select("job_id", "chunk_index", "expected_ids", "body", "lines").repartition("job_id", "chunk_index")
    return spread.mapInPandas(_annotate(annotator_factory(provider), options or {}, dual, context_prompt, max_retries, validation_retries, backoff, save_prompt, save_answer), RESULT_SCHEMA)


def body_lines(parts: DataFrame) -> DataFrame:
    """job_id, chunk_index, lines: the body of every chunk as an array in order."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "uid", "speaker", "text")))
    return parts.where(F.col("role") == "BODY").groupBy("job_id", "chunk_index").agg(F.transform(rows, lambda r: F.struct(r["uid"].alias("uid"), r["speaker"].alias("speaker"), r["text"].alias("text"))).alias("lines"))


def glossary_prompt(terms: list[str], context: str | None = None) -> str:
    """The request for readings of a list of terms, answered as tab-separated lines."""
    head = ["次の用語の読みをひらがなで示してください。各行を「用語<TAB>読み」の形で出力し、説明は書かないでください。"]
    if context:
        head += ["", HEAD_CONTEXT, context]
    return "\n".join([*head, "", *terms])


__all__ = ["ANNOTATORS", "annotate", "body_lines", "build_prompt", "call_with_retry", "check_ids", "get_annotator", "glossary_prompt", "prompt_bodies"]
