"""Nearest neighbours over blocks of training rows."""

from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from tallyloom.operators import models, nearest


def test_neighbours_over_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    label = rng.integers(0, 3, 60).astype(float)
    df = spark.createDataFrame([(i, float(label[i]), Vectors.dense(x[i])) for i in range(60)], ["document_id", "label", "features"])
    got = {r["document_id"]: r for r in models.neighbours(df.where("document_id < 45"), df.where("document_id >= 45"), k=5, train_limit=20).collect()}
    assert len(got) == 15
    for i in range(45, 60):
        near = sorted(range(45), key=lambda j: (-(x[i] @ x[j]), j))[:5]
        values, counts = np.unique(label[near], return_counts=True)
        assert (got[i]["prediction"], got[i]["probability"]) == (values[counts.argmax()], counts.max() / 5)


def test_training_rows_come_to_the_driver_sparse(spark, monkeypatch):
    """What the driver is sent grows with the entries of vectors, not with their width; copies beyond k stay away."""
    sent = []
    for name in ("toPandas", "toArrow"):
        def seen(df, collect=getattr(DataFrame, name)):
            out = collect(df)
            sent.append(out.nbytes if hasattr(out, "nbytes") else sum(np.asarray(v).nbytes for c in out for v in out[c]))
            return out

        monkeypatch.setattr(DataFrame, name, seen)
    rows = [(i, float(i % 3 == 0), Vectors.sparse(5000, [min(i, 50), 4999], [1.0, 0.5])) for i in range(90)]
    df = spark.createDataFrame(rows, ["document_id", "label", "features"])
    got = models.neighbours(df.where("document_id < 80"), df.where("document_id >= 80"), k=5).collect()
    # Rows 50 to 54 are the first of 30 copies, and two of them are of label 1.
    assert sorted(tuple(r) for r in got) == [(i, 0.0, 0.6) for i in range(80, 90)]
    assert sum(sent) < 80 * 100


@pytest.mark.parametrize("signs", [False, True])
def test_pruned_search_equals_all_sums(signs):
    rng = np.random.default_rng(7)
    x = rng.random((2500, 40)) * (rng.random((2500, 40)) < 0.1) * (rng.choice([-1, 1], (2500, 40)) if signs else 1)
    x[rng.integers(0, 2500, 300)] = x[3]
    asked = np.r_[x[:20] * 1.1, np.zeros((2, 40)), rng.random((50, 40))]

    def sparse(v):
        row, column = np.nonzero(v)
        return nearest.Sparse(np.r_[0, np.cumsum(np.bincount(row, minlength=len(v)))], column, v[row, column])

    ids, rows, best = rng.permutation(2500), sparse(x), nearest.Best(len(asked), 5)
    for part in range(2):
        mine = np.nonzero(ids % 2 == part)[0]
        nearest.look(sparse(asked), best, nearest.block_of(rows.take(mine), ids[mine], np.zeros(len(mine)), 40), 16)
    for i, q in enumerate(asked):
        s = np.array([reduce(add, (q[c] * v[c] for c in np.nonzero(v)[0]), 0.0) for v in x])
        want = np.lexsort((ids, -s))[:5]
        assert (best.near[i] == ids[want]).all()
        assert (best.score[i] == s[want]).all()
