"""Caption files as a stream: new files become cues of a table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueloom.sources.captions import clean_content, parse_vtt


def caption_stream(spark: SparkSession, folder: str, glob: str = "*.vtt") -> DataFrame:
    """path and content of every file that arrives in a folder or below it."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema("value string").load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), clean_content(F.col("value")).alias("content"))


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parses each batch of files and appends its cues to a Parquet folder.

    A batch is written under its own number, so a batch that is repeated after a failure
    replaces itself and no cue appears twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse_vtt(batch, ["path"]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
