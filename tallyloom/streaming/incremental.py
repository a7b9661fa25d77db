"""Streams: assignments that are synchronised as they arrive, and documents that are classified once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import shared_dir


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 100) -> DataFrame:
    """New files ``name*`` of a folder, with the schema of those that are there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", max_files).parquet(folder)


def completed_assignments(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Completed assignments, each hit and coder once within ``delay``; later repeats are for the sink to upsert."""
    return stream.where("time_finished is not null").withWatermark("time_finished", delay).dropDuplicatesWithinWatermark(["hit_id", "coder_id"])


def daily_completions(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Completions and their pay by day and coder; a day is out once the watermark has passed it."""
    windows = stream.where("time_finished is not null").withWatermark("time_finished", delay).groupBy(F.window("time_finished", "1 day"), "coder_id")
    return windows.agg(F.count("*").alias("n"), F.sum("reward").alias("reward")).select(F.col("window.start").alias("day"), "coder_id", "n", "reward")


def run_available(stream: DataFrame, mode: str, put: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """All that has arrived goes through ``put`` batch by batch; the checkpoint makes a restart go on where it was."""
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", where).foreachBatch(put).trigger(availableNow=True)
    writer.start().awaitTermination()


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given so far, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # In complete mode each batch replaces the last; else a batch that runs again replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    run_available(stream, mode, put)
    return spark.read.schema(stream.schema).parquet(f"{path}/*")


def classify_new(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], classified_path: str) -> None:
    """Documents not yet in ``classified_path`` are classified and added, batch by batch."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        try:
            done = spark.read.parquet(classified_path).where(F.col("batch") != number)
            batch = batch.join(done.select("document_id"), "document_id", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        classify(batch.dropDuplicates(["document_id"])).write.mode("overwrite").parquet(f"{classified_path}/batch={number}")

    run_available(stream, "append", put)
