"""Readings for a list of terms: python -m cueloom.glossary --job DIR [--provider NAME].

Reads input/glossary.txt and the context prompt of a job, asks a text service and writes
its tab-separated answer to input/glossary_confirmed.tsv for the merge to read.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path

from cueloom.operators.annotate import AnnotationError, call_with_retry, glossary_prompt
from cueloom.operators.services import BASE_URL, GoogleService
from cueloom.sources.side import glossary_file_terms, read_context_prompt


def _plain_readings(prompt: str, terms: list[str]) -> str:
    """Each term with its hiragana reading where a converter is installed, else with itself."""
    try:
        import pykakasi

        kks = pykakasi.kakasi()
        return "\n".join(f"{t}\t{''.join(x['hira'] for x in kks.convert(t))}" for t in terms)
    except ImportError:
        return "\n".join(f"{t}\t{t}" for t in terms)


def _google_readings(prompt: str, terms: list[str]) -> str:
    """The answer of the service over the network; GLOSSARY_MODEL and GLOSSARY_URL choose model and address."""
    return GoogleService(os.environ.get("GLOSSARY_MODEL", "gemini-2.5-flash"), base_url=os.environ.get("GLOSSARY_URL", BASE_URL)).request(prompt, {}).strip()


# Text services by name; one that needs the network registers itself here.
TEXT_SERVICES: dict[str, Callable[[str, list[str]], str]] = {"plain": _plain_readings, "google": _google_readings}


def generate(job_dir: str | Path, provider: str = "plain") -> Path:
    """Writes the glossary of a job and returns its path.

    ValueError without terms or for an unknown service; an empty answer is an AnnotationError.
    """
    if provider not in TEXT_SERVICES:
        raise ValueError(f"unknown provider {provider!r}")
    folder = Path(job_dir) / "input"
    terms = glossary_file_terms(folder / "glossary.txt")
    prompt = glossary_prompt(terms, read_context_prompt(folder))
    answer = call_with_retry(lambda: {"text": TEXT_SERVICES[provider](prompt, terms)})["text"]
    if not answer.strip():
        raise AnnotationError("empty answer")
    out = folder / "glossary_confirmed.tsv"
    out.write_text(answer, encoding="utf-8")
    return out


def open_in_editor(path: Path, command: str) -> bool:
    """Opens the file in an editor; a missing editor is no error."""
    try:
        return subprocess.run([command, str(path)], check=False).returncode == 0
    except OSError:
        return False


def main(argv: list[str] | None = None) -> int:
    """0 on success, 1 on an error."""
    p = argparse.ArgumentParser(prog="cueloom.glossary", description="Readings for a job's list of terms.")
    p.add_argument("--job", required=True)
    p.add_argument("--provider", default="plain")
    p.add_argument("--editor", default="code", help="command that opens the result; empty for none")
    args = p.parse_args(argv)
    try:
        made = generate(args.job, args.provider)
        print(made)
        if args.editor:
            open_in_editor(made, args.editor)
    except (OSError, ValueError, AnnotationError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
