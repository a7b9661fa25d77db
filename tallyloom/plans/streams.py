"""Queries that run as streams over what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental
from . import fixtures as X
from .coding import query


def _assignments(spark, d):
    e = incremental.table_stream(spark, d, "events.parquet")
    return e.select(
        (F.col("event_id") % 500).alias("hit_id"), F.col("user_id").alias("coder_id"), F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("time_finished"), F.col("value").alias("reward")
    )


@query("stream_daily_completions", "SELECT strftime(time_finished, '%Y-%m-%d') AS day, coder_id, count(*) AS n, round(sum(reward), 4) AS reward FROM assignment WHERE time_finished IS NOT NULL GROUP BY 1, 2")
def stream_daily_completions(spark, d):
    out = incremental.collected(incremental.daily_completions(_assignments(spark, d)), "complete")
    return X.rounded(out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "coder_id", "n", "reward"), digits=4)


@query("stream_completed_pairs", "SELECT DISTINCT hit_id, coder_id FROM assignment WHERE time_finished IS NOT NULL")
def stream_completed_pairs(spark, d):
    return incremental.collected(incremental.completed_assignments(_assignments(spark, d)).select("hit_id", "coder_id")).distinct()
