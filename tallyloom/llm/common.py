"""Helpers shared by the text operators: shared-folder tables, components, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text``; other columns never reach an operator."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("executors share no folder with this driver: set spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Texts that go to Python at a time.  Spark's own 10,000 rows are made for numbers; of texts they take hundreds of MB.
#: Operators that share work between the texts of a batch ask for larger ones.
BATCH_ROWS, BATCH_BYTES = 250, 2 << 20
SHARED_ROWS, SHARED_BYTES = 1000, 8 << 20

_caches: dict[str, dict] = {}


def small_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """``df`` itself; its session now sends texts to Python in batches of bounded size, unless they were smaller already.

    Spark reads these settings when a query runs, which for a lazy result is
    after the operator has returned, so they stay set.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def worker_cache(owner: str) -> dict:
    """A dictionary that stays in a worker process between tasks of one operator; those of other operators go."""
    others = [o for o in _caches if o != owner]
    for other in others:
        del _caches[other]
    if others:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: freed memory stays with the process
            pass
    return _caches.setdefault(owner, {})


class Stored:
    """A frame written as Parquet into the shared folder: it cuts lineage and outlives any executor."""

    #: Those written and not discarded, in order: whoever stores what was made of them can let them go.
    kept: list[Stored] = []

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.schema = df.schema
        Stored.kept.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def discard(self) -> None:
        if self in Stored.kept:
            Stored.kept.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_alone(make: Callable[[], DataFrame], name: str) -> Stored:
    """What ``make`` returns, stored; the tables that it was made of and that ``make`` itself wrote go."""
    before = list(Stored.kept)
    out = Stored(make(), name)
    for t in [t for t in Stored.kept if t not in before and t is not out]:
        t.discard()
    return out


class Scratch:
    """Stored frames that can go once what was made of them is stored itself."""

    def __init__(self):
        self.held: list[Stored] = []

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.held.append(Stored(df, name, codec))
        return self.held[-1].df

    def clear(self) -> None:
        for t in self.held:
            t.discard()
        self.held.clear()


def components(edges: DataFrame, max_rounds: int = 60) -> Stored:
    """Connected components of undirected ``edges(a, b)`` over longs.

    Returns a stored frame ``(node, component)``, the component being its
    smallest node, with a row for each node that has an edge.  Each round takes
    the smallest label among neighbours and then the label of that label, so
    paths halve; every step is a join or a partial aggregate, and each round is
    cut by a written table.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = Stored(both, "links")
    labels = Stored(
        links.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels"
    )
    for _ in range(max_rounds):
        old = labels.df
        near = (
            links.df.join(old.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        hooked = Stored(old.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("hop")), "hooked")
        up = hooked.df.select(F.col("node").alias("hop"), F.col("hop").alias("top"))
        jumped = Stored(hooked.df.join(up, "hop").select("node", "was", F.col("top").alias("component")), "labels")
        changed = jumped.df.where("was <> component").limit(1).count()
        for t in (labels, hooked):
            t.discard()
        labels = jumped
        if not changed:
            links.discard()
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
