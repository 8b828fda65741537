"""Side files of a job: glossary, dictionary, context prompt, speaker map, checkpoints."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header cells of a glossary.
GLOSSARY_HEADERS = ["", "表記", "用語"]
GLOSSARY_KEY = "用語"


def glossary_terms(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and term of each line of tab-separated glossaries (column value).

    Blank lines, comments and header lines are passed over; the term is the first field.
    """
    term = F.trim(F.regexp_replace(F.split("value", "\t")[0], r"(?U)^\s+|\s+$", ""))
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return kept.select(*keys, term.alias("term")).where(~F.col("term").isin(GLOSSARY_HEADERS))


def glossary_file_terms(path: str | Path) -> list[str]:
    """Terms of a plain list, one a line; ValueError if there are none."""
    lines = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    terms = [x for x in lines if x and not x.startswith("#")]
    if not terms:
        raise ValueError(f"no terms in {path}")
    return terms


def read_glossary(spark: SparkSession, path: str) -> dict[str, list[str]] | None:
    """The glossary of one job as a dictionary of one category; None if it holds no terms."""
    if not Path(path).exists():
        return None
    terms = [r["term"] for r in glossary_terms(spark.read.text(path), []).collect()]  # one job's word list
    return {GLOSSARY_KEY: terms} if terms else None


def read_dictionary(path: str | Path | None) -> dict[str, list[str]] | list[str] | None:
    """A dictionary file: terms by category, or a plain list; None if it is missing or holds nothing."""
    if not path or not Path(path).exists():
        return None
    return json.loads(Path(path).read_text(encoding="utf-8")) or None


def read_context_prompt(folder: str | Path) -> str | None:
    """The first of context_prompt.txt and .md that exists, stripped."""
    for name in ("context_prompt.txt", "context_prompt.md"):
        path = Path(folder) / name
        if path.exists():
            return path.read_text(encoding="utf-8").strip()
    return None


def speaker_maps(files: DataFrame) -> DataFrame:
    """job_id, speaker_label, display_name of speaker maps of many jobs: files has job_id and content (JSON)."""
    pairs = F.from_json("content", "map<string,string>")
    return files.select("job_id", F.explode(pairs).alias("speaker_label", "display_name")).where(F.col("display_name").isNotNull())


def read_speaker_map(path: str | Path | None) -> dict[str, str]:
    """Label to name; a missing path or file maps nothing."""
    if not path or not Path(path).exists():
        return {}
    return json.loads(Path(path).read_text(encoding="utf-8"))
