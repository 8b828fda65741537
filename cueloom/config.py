"""Settings of a run: defaults, layers of overrides and the paths of a job folder."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

# The defaults of every section.
DEFAULTS: dict[str, Any] = {
    "api": {"provider": "google", "model": "gemini-2.0-flash", "api_key_env": "GEMINI_API_KEY", "max_retries": 3, "max_validation_retries": 2, "backoff_base_sec": 2, "timeout_sec": 120, "rate_limit_respect": True, "include_chunk_summary": False},
    "chunking": {"target_duration_sec": 300, "search_window_stage1_sec": 180, "search_window_stage2_sec": 300, "gap_threshold_sec": 1.2, "overlap_sec": 15},
    "offset": {"mode": "auto", "manual_offset_sec": 0.0, "sample_windows": ["head", "mid", "tail"], "window_duration_sec": 300, "vtt_search_margin_sec": 300, "similarity_threshold": 0.6, "min_valid_pairs": 3, "mad_k": 3.0, "max_offset_sec": 600, "use_reading_normalization": False},
    "input": {"primary_vtt_filename": "whisper_output.vtt", "zoom_vtt_filename": "zoom_output.vtt", "use_secondary_vtt": True, "dictionary_path": None, "speaker_map_path": None},
    "output": {"formats": ["txt", "srt", "vtt", "json"], "completion_mode": "strict", "txt_mode": "clean"},
    "logging": {"log_level": "INFO", "save_prompt": False, "save_raw_response": False},
}


GIVEN = object()
# What each option of the command line sets, later rows over earlier ones: section, name and value, or the value given.
OPTION_SETTINGS: dict[str, list[tuple[str, str, Any]]] = {
    "offset_sec": [("offset", "mode", "manual"), ("offset", "manual_offset_sec", GIVEN)],
    "offset_skip": [("offset", "mode", "skip")],
    "single_vtt": [("input", "use_secondary_vtt", False), ("offset", "mode", "skip")],
    "best_effort": [("output", "completion_mode", "best_effort")],
    "debug": [("logging", "log_level", "DEBUG")],
}


def deep_merge(base: dict, override: dict) -> dict:
    """A new dict: nested dicts merge, everything else in override replaces."""
    out = copy.deepcopy(base)
    for key, value in (override or {}).items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def load_yaml(path: str | Path) -> dict:
    """The mapping in a YAML file; a missing file, or one that holds no mapping, gives {}."""
    path = Path(path)
    if not path.exists():
        return {}
    import yaml

    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    return data if isinstance(data, dict) else {}


def apply_cli_overrides(config: dict, cli: dict) -> dict:
    """The layer of command-line options: offset_sec, offset_skip, single_vtt, best_effort, debug."""
    for option, settings in OPTION_SETTINGS.items():
        given = cli.get(option)
        if given is None or given is False:
            continue
        for section, name, value in settings:
            config = deep_merge(config, {section: {name: given if value is GIVEN else value}})
    return config


def resolve_paths(config: dict, job_dir: str | Path) -> dict:
    """Where a job's files lie; optional files are relative to the job folder unless absolute."""
    job = Path(job_dir)
    inp = config["input"]
    out = {
        "job_dir": job, "input_dir": job / "input", "temp_dir": job / "working" / "temp", "logs_dir": job / "working" / "logs", "output_dir": job / "output",
        "primary_vtt": job / "input" / inp["primary_vtt_filename"], "zoom_vtt": job / "input" / inp["zoom_vtt_filename"],
    }
    return out | {name: job / inp[name] if inp.get(name) else None for name in ("dictionary_path", "speaker_map_path")}


def load_config(app_config: str | Path | None = None, job_dir: str | Path | None = None, cli: dict | None = None) -> dict:
    """Command line over job.yaml over the application's file over the defaults."""
    config = copy.deepcopy(DEFAULTS)
    if app_config is not None:
        config = deep_merge(config, load_yaml(app_config))
    if job_dir is not None:
        config = deep_merge(config, load_yaml(Path(job_dir) / "job.yaml"))
    config = apply_cli_overrides(config, cli or {})
    if job_dir is not None:
        config["_resolved"] = resolve_paths(config, job_dir)
    return config
