"""The whole merge over many jobs in one plan: parse, offset, ids, chunks, annotate, restore, render."""

from __future__ import annotations

import datetime as dt
import logging
import os
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators import annotate, checkpoint, chunking, ids, offset, restore, services  # noqa: F401 (services registers itself)
from cueloom.operators.ids import number_rows
from cueloom.session import written
from cueloom.sinks import render
from cueloom.sources import captions, side

log = logging.getLogger("cueloom")


@dataclass
class Prepared:
    """What comes before annotation, the same on every run."""

    primary: DataFrame
    secondary: DataFrame
    offsets: DataFrame
    id_index: DataFrame
    chunks: DataFrame
    parts: DataFrame


def prepare(jobs: DataFrame, primary: DataFrame, secondary: DataFrame, config: dict) -> Prepared:
    """Offset, shift, ids, chunks and the cues that belong to every chunk.

    ``primary`` and ``secondary``: job_id, pos (dense, in order), start, end, speaker, text.
    """
    dual = config["input"]["use_secondary_vtt"]
    c = config["chunking"]
    found = offset.detect_offsets(jobs, primary, secondary, config["offset"]) if dual else offset.no_secondary_result(jobs)
    offsets = written(offset.with_excluded(found, secondary))
    shifted = written(number_rows(offset.apply_offset(secondary, offsets).withColumnRenamed("pos", "_old"), ["job_id"], ["_old"], "pos", slot=F.floor(F.col("_old") / 4096)).drop("_old")) if dual else secondary.limit(0)
    index = written(primary.withColumn("uid", ids.cue_id(F.col("pos"))))
    chunks = written(chunking.split_into_chunks(primary, c["target_duration_sec"], c["search_window_stage1_sec"], c["search_window_stage2_sec"], c["gap_threshold_sec"]))
    body = chunking.members(chunks).select("job_id", "chunk_index", F.lit("BODY").alias("role"), "pos")
    around = chunking.contexts(chunks, index, c["overlap_sec"])
    cols = ["job_id", "chunk_index", "role", "pos", "uid", "speaker", "text"]
    own = body.unionByName(around.withColumn("pos", F.col("pos").cast("long"))).join(index.select("job_id", F.col("pos").cast("long").alias("pos"), "uid", "speaker", "text"), ["job_id", "pos"]).select(*cols)
    if dual:
        zoom = chunking.secondary_slices(chunks, shifted).join(shifted.select("job_id", "pos", "speaker", "text"), ["job_id", "pos"])
        own = own.unionByName(zoom.select("job_id", "chunk_index", F.lit("ZOOM").alias("role"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("string").alias("uid"), "speaker", "text"))
    return Prepared(primary, shifted, offsets, index, chunks, written(own))


def prompts(ready: Prepared, dictionary: dict | list | None = None) -> DataFrame:
    """What annotate() takes, for every chunk."""
    bodies = annotate.prompt_bodies(ready.parts, annotate.dictionary_section(dictionary))
    return bodies.join(annotate.body_lines(ready.parts), ["job_id", "chunk_index"])


def finalize(ready: Prepared, results: DataFrame, speaker_map: DataFrame | None, mode: str = "strict") -> DataFrame:
    """Utterances in order with times and names; strict mode raises if a chunk is open."""
    status = checkpoint.completion_status(ready.chunks, results)
    if mode == "strict":
        checkpoint.require_complete(status)
    utts = restore.with_defaults(restore.parse_results(results.join(ready.chunks.select("job_id", "chunk_index"), ["job_id", "chunk_index"], "left_semi")))
    if mode == "best_effort":
        members = chunking.members(ready.chunks)
        utts = utts.unionByName(restore.missing_chunks(ready.chunks, members, results))
    elif mode != "strict":
        raise ValueError(f"unknown completion mode {mode!r}")
    timed = restore.restore_times(utts, ready.id_index)
    return restore.map_speakers(timed, speaker_map) if speaker_map is not None else timed


def read_job(spark: SparkSession, job_dir: Path, config: dict) -> tuple[DataFrame, DataFrame]:
    """Primary and secondary cues of one job folder, with the checks on missing files."""
    paths = config["_resolved"]
    if not paths["primary_vtt"].exists():
        raise FileNotFoundError(paths["primary_vtt"])
    dual = config["input"]["use_secondary_vtt"]
    if dual and not paths["zoom_vtt"].exists():
        raise FileNotFoundError(paths["zoom_vtt"])
    name = job_dir.resolve().name

    def cues(path: Path) -> DataFrame:
        raw = captions.read_captions(spark, str(path)).withColumn("job_id", F.lit(name))
        return written(captions.parse_vtt(raw, ["job_id"]).withColumnRenamed("cue_index", "pos"))

    primary = cues(paths["primary_vtt"])
    if primary.isEmpty():
        raise ValueError(f"no cues in {paths['primary_vtt']}")
    return primary, cues(paths["zoom_vtt"]) if dual else primary.limit(0)


def read_jobs(spark: SparkSession, root: str, config: dict) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Primary and secondary cues and speaker maps of all job folders under root; a job's id is its folder's name."""
    inp = config["input"]

    def contents(name: str) -> DataFrame:
        raw = captions.read_captions(spark, f"{root}/*/{name}")
        depth = len(Path(name).parts) + 1
        return raw.select(F.element_at(F.split(F.url_decode("path"), "/"), -depth).alias("job_id"), "content")

    def cues(name: str) -> DataFrame:
        return written(captions.parse_vtt(contents(f"input/{name}"), ["job_id"]).withColumnRenamed("cue_index", "pos"))

    primary = cues(inp["primary_vtt_filename"])
    secondary = cues(inp["zoom_vtt_filename"]) if inp["use_secondary_vtt"] else primary.limit(0)
    names = inp.get("speaker_map_path")
    found = names and any(Path(root).glob(f"*/{names}"))
    return primary, secondary, side.speaker_maps(contents(names)) if found else None


def run_jobs(spark: SparkSession, root: str, out: str, config: dict, provider: str | None = None) -> DataFrame:
    """Merges all job folders under root in one plan and writes their results under out.

    out/offsets holds a JSON report a job, out/txt, srt, vtt and json the lines of all jobs, one
    folder a job (job_id=...), and out/chunks the checkpoints, from which a second run goes on.
    Returns completed, failed and pending chunks of every job.
    """
    primary, secondary, names = read_jobs(spark, root, config)
    dual, api, logs = config["input"]["use_secondary_vtt"], config["api"], config["logging"]
    ready = prepare(primary.select("job_id").distinct(), primary, secondary, config)
    offset.report(ready.offsets).write.mode("overwrite").partitionBy("job_id").text(f"{out}/offsets")
    table = checkpoint.CheckpointTable(spark, f"{out}/chunks")
    todo = checkpoint.targets(ready.chunks.select("job_id", "chunk_index"), table.completed())
    asked = prompts(ready).join(todo, ["job_id", "chunk_index"], "left_semi")
    service = provider or api["provider"]
    answers = annotate.annotate(asked, service, service_options(service, api), dual, None, api["max_retries"], api["max_validation_retries"], api["backoff_base_sec"], logs["save_prompt"], logs["save_raw_response"])
    table.save(checkpoint.with_meta(written(answers), ready.chunks, ready.parts, ready.offsets, service, api["model"]))
    results = table.load()
    utterances = written(finalize(ready, results, names, config["output"]["completion_mode"]))
    formats = config["output"].get("formats") or list(render.FILE_NAMES)
    for kind, lines in (("txt", render.txt_lines), ("srt", render.srt_lines), ("vtt", render.vtt_lines), ("json", render.json_lines)):
        if kind in formats:
            render.write_lines(lines(utterances), f"{out}/{kind}")
    return checkpoint.status_counts(checkpoint.completion_status(ready.chunks, results))


def service_options(service: str, api: dict) -> dict | None:
    """What a service over the network is made with; the driver's key goes to the workers with it."""
    if service != "google":
        return None
    out = {"model": api["model"], "api_key_env": api["api_key_env"], "timeout_sec": api["timeout_sec"], "api_key": os.environ.get(api["api_key_env"])}
    return out | ({"base_url": api["base_url"]} if api.get("base_url") else {})


def dump_exchanges(results: DataFrame, folder: Path) -> None:
    """Files of the prompts and raw answers that results hold, chunk by chunk; earlier attempts have their number in the name."""
    for row in results.select("chunk_index", "prompts", "answers").where(F.col("prompts").isNotNull() | F.col("answers").isNotNull()).toLocalIterator():
        for kind, suffix, texts in (("prompt", "txt", row["prompts"]), ("raw", "json", row["answers"])):
            for i, text in enumerate(texts or [], 1):
                attempt = "" if i == len(texts) else f"_try{i}"
                (folder / f"{kind}_chunk_{row['chunk_index']:03d}{attempt}.{suffix}").write_text(text, encoding="utf-8")


def run_job(spark: SparkSession, job_dir: str | Path, config: dict, clean: bool = False, selected: list[int] | None = None, provider: str | None = None, force: bool = False) -> dict:
    """Runs one job folder and writes its output files; returns the metadata.

    Annotation writes its checkpoint before anything reads it, so no call is ever repeated
    by a later action. Completed chunks are skipped on a second run.
    """
    began = time.time()
    job = Path(job_dir)
    paths = config["_resolved"]
    for folder in ("temp_dir", "logs_dir", "output_dir"):
        paths[folder].mkdir(parents=True, exist_ok=True)
    primary, secondary = read_job(spark, job, config)
    name = job.resolve().name
    jobs = spark.createDataFrame([(name,)], "job_id string")
    dual = config["input"]["use_secondary_vtt"]
    ready = prepare(jobs, primary, secondary, config)
    result = ready.offsets.first().asDict(recursive=True)
    (paths["output_dir"] / render.FILE_NAMES["offset"]).write_text(offset.report(ready.offsets).first()["report"], encoding="utf-8")
    table = checkpoint.CheckpointTable(spark, str(paths["temp_dir"] / "chunks"))
    if clean:
        table.clean()
    glossary = side.read_glossary(spark, str(paths["input_dir"] / "glossary_confirmed.tsv")) or side.read_dictionary(paths["dictionary_path"])
    context = side.read_context_prompt(paths["input_dir"])
    todo = checkpoint.targets(ready.chunks.select("job_id", "chunk_index"), table.completed(), selected, force)
    asked = prompts(ready, glossary).join(todo, ["job_id", "chunk_index"], "left_semi")
    api, logs = config["api"], config["logging"]
    service = provider or api["provider"]
    answers = annotate.annotate(asked, service, service_options(service, api), dual, context, api["max_retries"], api["max_validation_retries"], api["backoff_base_sec"], logs["save_prompt"], logs["save_raw_response"])
    # The outside is called while this is written; a join before the write could move the calls into a stage that runs twice.
    run = table.save(checkpoint.with_meta(written(answers), ready.chunks, ready.parts, ready.offsets, service, api["model"]))
    dump_exchanges(table.load().where(F.col("run_id") == run), paths["temp_dir"])
    mapping = side.read_speaker_map(paths["speaker_map_path"])
    names = spark.createDataFrame([(name, k, v) for k, v in mapping.items()], "job_id string, speaker_label string, display_name string") if mapping else None
    mode = config["output"]["completion_mode"]
    results = table.load()
    utterances = written(finalize(ready, results, names, mode))
    done = checkpoint.completion_status(ready.chunks, results).where(F.col("state") == "completed").count()
    metadata = {
        "generated_at": dt.datetime.now(dt.UTC).isoformat(), "source_primary_vtt": paths["primary_vtt"].name, "source_zoom_vtt": paths["zoom_vtt"].name if dual else None,
        "applied_offset_sec": result["applied_offset_sec"], "offset_confidence": result["confidence"], "total_chunks": ready.chunks.count(), "completed_chunks": done, "total_utterances": utterances.count(),
        "llm_provider": provider or api["provider"], "llm_model": api["model"], "completion_mode": mode, "processing_time_sec": round(time.time() - began, 1),
    }
    formats = config["output"].get("formats") or list(render.FILE_NAMES)
    for kind, lines in (("txt", render.txt_lines), ("srt", render.srt_lines), ("vtt", render.vtt_lines)):
        if kind in formats:
            render.write_job_file(lines(utterances), name, paths["output_dir"] / render.FILE_NAMES[kind])
    if "json" in formats:
        rows = (r["utterance"] for r in render.json_rows(utterances).orderBy("seq").select("utterance").toLocalIterator())
        with open(paths["output_dir"] / render.FILE_NAMES["json"], "w", encoding="utf-8") as out:
            out.writelines(render.json_document(rows, metadata))
    log.info("job %s: %s", name, metadata)
    return metadata
