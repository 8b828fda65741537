"""Annotation and text services over HTTP, with the standard library alone."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from typing import Any

from cueloom.operators.annotate import ANNOTATORS, NonRetryableError, RetryableError, classify_error
from cueloom.schema import CATEGORIES, EDIT_TYPES, UNCERTAIN_REASONS

BASE_URL = "https://generativelanguage.googleapis.com/v1beta"


def output_schema() -> dict[str, Any]:
    """The shape an answer must have, as the service takes it."""
    text, flag = {"type": "STRING"}, {"type": "BOOLEAN"}
    texts = {"type": "ARRAY", "items": text}
    one_of = lambda values: {"type": "STRING", "enum": values}
    fields = {
        "id": text, "speaker": text, "text": text, "category": one_of(CATEGORIES), "uncertain": flag, "uncertain_reason": one_of(UNCERTAIN_REASONS), "uncertain_span_ids": texts, "source": text,
        "source_ids": texts, "vtt_supplemented": flag, "edit_type": one_of(EDIT_TYPES), "edit_note": text,
    }
    return {"type": "OBJECT", "properties": {"utterances": {"type": "ARRAY", "items": {"type": "OBJECT", "properties": fields, "required": list(fields)}}}, "required": ["utterances"]}


class GoogleService:
    """Requests to a model by its public REST interface.

    The key is given or read from the environment of the process that calls, and is sent as a header. Failures are told
    apart by their status and message: passing ones may be tried again, with the wait that
    the service asks for; others end the chunk.
    """

    def __init__(self, model: str = "gemini-2.0-flash", api_key_env: str = "GEMINI_API_KEY", timeout_sec: float = 120, base_url: str = BASE_URL, api_key: str | None = None) -> None:
        self.model, self.api_key_env, self.timeout, self.base_url, self._key = model, api_key_env, timeout_sec, base_url, api_key

    def request(self, prompt: str, settings: dict[str, Any]) -> str:
        """The text that the model answers; RetryableError if it is empty."""
        key = self._key or os.environ.get(self.api_key_env)
        if not key:
            raise NonRetryableError(f"environment variable {self.api_key_env} is not set")
        body = json.dumps({"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.1, **settings}}).encode()
        call = urllib.request.Request(f"{self.base_url}/models/{self.model}:generateContent", body, {"Content-Type": "application/json", "x-goog-api-key": key})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                data = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            message = f"{e.code} {e.reason} {e.read().decode(errors='replace')[:500]}"
            kind = classify_error(message)
            wait = e.headers.get("Retry-After", "") if e.headers else ""
            raise (kind(message, float(wait) if wait.isdigit() else None) if kind is RetryableError else kind(message)) from e
        except (OSError, ValueError) as e:  # no connection, timeout, or no JSON
            raise RetryableError(f"{type(e).__name__}: {e}") from e
        parts = [p.get("text", "") for c in (data.get("candidates") or [])[:1] for p in (c.get("content") or {}).get("parts") or []]
        if not "".join(parts).strip():
            raise RetryableError("empty answer")
        return "".join(parts)

    def call(self, prompt: str, expected_ids: list[str], lines: list[dict[str, Any]]) -> dict[str, Any]:
        """The annotation of a chunk."""
        text = self.request(prompt, {"responseMimeType": "application/json", "responseSchema": output_schema()})
        try:
            answer = json.loads(text)
        except json.JSONDecodeError as e:
            raise RetryableError(f"answer is not JSON: {e}") from e
        if not isinstance(answer, dict):
            raise RetryableError("answer is not an object")
        return answer


ANNOTATORS["google"] = GoogleService
