"""Reports of a folder that keeps getting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cadenza.plans.analysis import analyze
from cadenza.plans.options import Options
from cadenza.sources import audio

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def watch_reports(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options(), extensions: tuple[str, ...] = ("wav", "aiff", "aif", "flac"), files_at_once: int = 64) -> StreamingQuery:
    """Analyses each new audio file of the folder once and adds its report to the Parquet table `out`, by batch.

    A batch has at most files_at_once files, so a large backlog comes in parts. A batch that is run again after a failure
    replaces its own partition of the table, so no report is there twice. The query runs until it has seen all files
    that are there, and goes on from its checkpoint when it is started anew.
    """
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    files = spark.readStream.format("binaryFile").schema(SOURCE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        reports = analyze(audio.decoded(rows.select("path", "content")), options).withColumn("batch", F.lit(number))
        reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
