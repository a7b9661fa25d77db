"""Sinks, and stores of results keyed by what they were made from."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..functions.text import canonical


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder and not sc.master.startswith(("local[", "local ")) and sc.master != "local":
        raise RuntimeError("executors share no folder with this driver: set spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_frame(df: DataFrame, path: str, refresh: bool = False) -> bool:
    """A sampling frame's distinct document ids; a frame that is there stays unless ``refresh``. Says whether it was written."""
    try:
        there = df.sparkSession.read.parquet(path).limit(1).count() > 0
    except AnalysisException:
        there = False
    if there and not refresh:
        return False
    df.select("document_id").distinct().write.mode("overwrite").parquet(path)
    return True


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cache_key(name: str, params: dict, version: str = "") -> str:
    """A name for a result; equal parameters in any order give the same."""
    return hashlib.sha256("\n".join([name, version, canonical(params)]).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame], refresh: bool = False, only_existing: bool = False) -> DataFrame | None:
    """A result read from ``root/key``, or made and written there first."""
    path = f"{root.rstrip('/')}/{key}"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    if only_existing:
        return None
    df = make()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
