"""Near copies of fingerprints within a wide radius against all pairs."""

import itertools
import random

from tallyloom.llm import doc_simhash

from ..conftest import DATA


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_wide_radius_equals_all_pairs(spark):
    random.seed(12)
    base = [random.getrandbits(128) for _ in range(6)]
    fps = sorted({f"{b ^ sum(1 << k for k in random.sample(range(128), random.randint(0, 8))):032x}" for b in base for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in [*fps, *fps[:3], None, "0" * 32]], "fp string")
    fps = sorted({*fps, "0" * 32})
    for radius in (7, doc_simhash.COPY_RADIUS):
        got = {(r["fp"], r["near"]): r["distance"] for r in doc_simhash.within_radius(df, df, radius).collect()}
        want = {(a, b): bits(a, b) for a, b in itertools.permutations(fps, 2) if bits(a, b) <= radius}
        assert got == want and max(want.values()) == radius


def test_copies_of_asked_rows(spark):
    rows = doc_simhash.op9_weighted_simhash(spark, DATA).collect()
    prints = {r["fingerprint"] for r in rows}
    for r in rows:
        want = sum(0 < bits(f, r["fingerprint"]) <= doc_simhash.COPY_RADIUS for f in prints)
        assert r["n_copies"] == (want if r["doc_id"] % 20 == 0 else None)
