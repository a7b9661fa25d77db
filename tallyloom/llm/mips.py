"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, table

#: Queries of one pass, candidates looked at together, dimensions of the first partial sum, vectors the rotation is
#: fitted on and vectors that give the first thresholds; all bound memory and none affects results.
QUERY_BLOCK, CANDIDATE_BLOCK, LEADING, FIT_ROWS, SEED_ROWS = 8192, 512, 16, 4096, 1024

FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v`` with ``v`` = floor(scale * x) as longs, where no component is null or non-finite.

    Empty vectors stay: all their products are 0.  A null ``vec_id`` takes no part.
    """
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return vectors.where(good).select(
        "vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v")
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    if len(rows) and all(len(r) == width for r in rows):
        return np.stack(rows.to_numpy()).astype(np.int64)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles hold them while all partial sums stay under 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best ``(score, vec_id)`` of each query: higher scores first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.iinfo(np.int64).max, dtype=np.int64)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def put(self, q: int, scores: np.ndarray, vecs: np.ndarray) -> None:
        other = vecs != self.ids[q]
        s, v = np.r_[self.score[q], scores[other]], np.r_[self.vec[q], vecs[other]]
        top = np.lexsort((v, -s))[: self.k]
        self.score[q], self.vec[q] = s[top], v[top]


class Pruned:
    """Candidates in descending length against one block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.rotation, self.floor = q, rotation, floor
        self.best = Best(ids, k)
        turned = q @ rotation
        self.head, self.length = turned[:, :LEADING], np.linalg.norm(q, axis=1)
        self.rest = np.linalg.norm(turned[:, LEADING:], axis=1)
        self.seen = self.computed = 0

    def look(self, vecs: np.ndarray, x: np.ndarray) -> None:
        """Bounds first; exact products only of pairs whose bound reaches the query's k-th best score."""
        least = np.maximum(self.best.least(), self.floor).astype(np.float64)
        turned = x @ self.rotation
        length = np.linalg.norm(x, axis=1)
        self.seen += len(x) * len(self.q)
        slack = 1e-9 * (1 + self.length * (length.max() if len(length) else 0))
        live = np.nonzero(self.length * (length.max() if len(length) else 0) + slack >= least)[0]
        if not len(live):
            return
        rest = np.linalg.norm(turned[:, LEADING:], axis=1)
        bound = self.head[live] @ turned[:, :LEADING].T + np.outer(self.rest[live], rest)
        may = bound + slack[live, None] >= least[live, None]
        rows = np.nonzero(may.any(axis=1))[0]
        if not len(rows):
            return
        columns = np.nonzero(may.any(axis=0))[0]
        scores = _products(self.q[live[rows]], x[columns])
        may = may[np.ix_(rows, columns)]
        self.computed += may.size
        for i, q in enumerate(live[rows]):
            keep = may[i] & (scores[i] >= max(self.best.score[q, -1], self.floor[q]))
            if keep.any():
                self.best.put(q, scores[i][keep], vecs[columns][keep])


def fit_rotation(rows: np.ndarray) -> np.ndarray:
    """Right singular vectors, strongest first: the leading products then hold most of each sum."""
    if not rows.size:
        return np.eye(rows.shape[1])
    return np.linalg.svd(rows.astype(np.float64), full_matrices=True)[2].T if len(rows) < 65 else np.linalg.eigh(rows.T.astype(np.float64) @ rows)[1][:, ::-1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` vectors of highest inner product for each query, its own id left out.

    ``vectors`` and ``queries`` have ``vec_id, v`` (arrays of longs; shorter
    ones count as padded with zeros).  Queries go in blocks of ``query_block``;
    each block is sent to all tasks, and each task runs through its vectors in
    descending length.  Thresholds start from the longest vectors of all.
    Repeated ids are rows of their own; ties go to the smaller id; fewer
    candidates than ``k`` give fewer rows; no queries give no rows.  Returns
    ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    # Each file goes by descending length, once for all blocks; the bounds hold in any order, so split or joined files do no harm.
    sized = Stored(vectors.withColumn("len", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)).sortWithinPartitions(F.desc("len")), "vectors")
    width = max(1, sized.df.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1)
    seeds = sized.df.orderBy(F.desc("len"), "vec_id").limit(SEED_ROWS).toPandas()
    fit = sized.df.orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).toPandas()
    rotation = fit_rotation(_matrix(fit["v"], width))
    asked = Stored(queries.select("vec_id", "v"), "queries")
    blocks = -(-asked.df.count() // query_block)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    numbered = asked.df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    found = None
    for block in range(blocks):
        mine = numbered.where(F.col("block") == block).toPandas()
        ids, q = mine["vec_id"].to_numpy(), _matrix(mine["v"], width)
        first = Best(ids, k)
        scores, vecs = _products(q, _matrix(seeds["v"], width)), seeds["vec_id"].to_numpy()
        for i in range(len(ids)):
            first.put(i, scores[i], vecs)
        sent = spark.sparkContext.broadcast((ids, q, rotation, first.least()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = Pruned(*sent.value, k)
            for batch in batches:
                for at in range(0, len(batch), CANDIDATE_BLOCK):
                    part = batch.iloc[at : at + CANDIDATE_BLOCK]
                    state.look(part["vec_id"].to_numpy(), _matrix(part["v"], width))
            i, j = np.nonzero(state.best.vec != np.iinfo(np.int64).max)
            yield pd.DataFrame({"query_id": state.best.ids[i], "vec_id": state.best.vec[i, j], "score": state.best.score[i, j]})

        # Stored, best k of all tasks, before the next block is collected: one block at a time is held.
        part = Stored(best(sized.df.select("vec_id", "v").mapInPandas(run, FOUND)), "found").df
        sent.destroy()
        found = part if found is None else found.union(part)
    asked.discard()
    sized.discard()
    if found is None:
        found = best(spark.createDataFrame([], FOUND))
    return found.select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
