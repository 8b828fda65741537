"""Checkpoints of annotated chunks as a partitioned table: save, resume, status, clean."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cueloom.operators.annotate import RESULT_SCHEMA

META_SCHEMA = "chunk_time_range struct<start_sec:double,end_sec:double>, input_counts struct<primary_cues:long,zoom_cues:long>, api_provider string, api_model string, offset_applied_sec double"
_SCHEMA = f"{RESULT_SCHEMA}, {META_SCHEMA}, saved_at timestamp, run_id string"


class CheckpointTable:
    """Chunk results in a folder that all executors share.

    Each save appends one run's rows; of a chunk's rows the latest counts, so a save never
    rewrites what is there and a lost task leaves nothing half written.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, results: DataFrame) -> str:
        """Writes results (RESULT_SCHEMA, with or without the columns of META_SCHEMA) of one run, once; returns the run's id."""
        run = uuid.uuid4().hex
        results.withColumn("saved_at", F.current_timestamp()).withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("job_id").parquet(self.path)
        return run

    def load(self) -> DataFrame:
        """The latest row of every chunk; empty where nothing was saved."""
        try:
            rows = self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], _SCHEMA)
        latest = Window.partitionBy("job_id", "chunk_index").orderBy(F.col("saved_at").desc(), F.col("run_id").desc())
        return rows.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") == 1).drop("_r")

    def completed(self) -> DataFrame:
        """job_id and chunk_index of chunks whose latest status is ok."""
        return self.load().where(F.col("status") == "ok").select("job_id", "chunk_index")

    def clean(self, jobs: list[str] | None = None) -> None:
        """Removes the checkpoints of some jobs, or of all."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for path in [base] if jobs is None else [jvm.org.apache.hadoop.fs.Path(base, f"job_id={j}") for j in jobs]:
            fs.delete(path, True)
        self.spark.catalog.refreshByPath(self.path)


def with_meta(results: DataFrame, chunks: DataFrame, parts: DataFrame, offsets: DataFrame, provider: str, model: str) -> DataFrame:
    """Results with the columns of META_SCHEMA: what each chunk was made from and by what.

    ``chunks``: job_id, chunk_index, time_start, time_end; ``parts``: job_id, chunk_index, role;
    ``offsets``: job_id, applied_offset_sec.
    """
    key = ["job_id", "chunk_index"]
    counts = parts.groupBy(*key).agg(F.struct(F.count_if(F.col("role") == "BODY").alias("primary_cues"), F.count_if(F.col("role") == "ZOOM").alias("zoom_cues")).alias("input_counts"))
    span = chunks.select(*key, F.struct(F.col("time_start").alias("start_sec"), F.col("time_end").alias("end_sec")).alias("chunk_time_range"))
    by = offsets.select("job_id", F.col("applied_offset_sec").alias("offset_applied_sec"))
    about = span.join(counts, key, "left").join(by, "job_id", "left").withColumn("api_provider", F.lit(provider)).withColumn("api_model", F.lit(model))
    return results.join(about, key, "left")


def targets(chunks: DataFrame, done: DataFrame, selected: list[int] | None = None, force: bool = False) -> DataFrame:
    """Chunks still to be annotated: the selected ones (all by default) that are not completed.

    With force, completed chunks are annotated again. An unknown index raises ValueError.
    """
    out = chunks
    if selected is not None:
        out = chunks.where(F.col("chunk_index").isin(selected))
        known = {r["chunk_index"] for r in out.select("chunk_index").distinct().collect()}  # at most as many as were asked for
        unknown = sorted(set(selected) - known)
        if unknown:
            raise ValueError(f"unknown chunks: {unknown}")
    return out if force else out.join(done, ["job_id", "chunk_index"], "left_anti")


def completion_status(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, chunk_index, state: completed, failed or pending, one row a chunk."""
    state = F.when(F.col("status") == "ok", "completed").when(F.col("status") == "error", "failed").otherwise("pending")
    return chunks.select("job_id", "chunk_index").join(results.select("job_id", "chunk_index", "status"), ["job_id", "chunk_index"], "left").select("job_id", "chunk_index", state.alias("state"))


def status_counts(status: DataFrame) -> DataFrame:
    """Per job the number of completed, failed and pending chunks."""
    return status.groupBy("job_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "pending")))


def require_complete(status: DataFrame) -> None:
    """The strict policy: RuntimeError that names the first open chunks of the first jobs."""
    open_ = status.where(F.col("state") != "completed").orderBy("job_id", "chunk_index").limit(20).collect()  # for the message only
    if open_:
        raise RuntimeError("incomplete chunks: " + ", ".join(f"{r['job_id']}/{r['chunk_index']} ({r['state']})" for r in open_))


def chunk_stats(utterances: DataFrame) -> DataFrame:
    """Per chunk: utterances, uncertain, mismatches and backchannels."""
    return utterances.groupBy("job_id", "chunk_index").agg(
        F.count(F.lit(1)).alias("utterances"), F.count_if("uncertain").alias("uncertain"), F.count_if(F.col("uncertain_reason") == "AB_MISMATCH").alias("ab_mismatch"), F.count_if(F.col("category") == "BACKCHANNEL").alias("backchannel")
    )
