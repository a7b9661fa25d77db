"""SimHash near-duplicates: positional-byte postings, count filtering, verification, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Stored, components, documents, small_batches, worker_cache

BYTES = 8
#: The four 2-byte groups of a fingerprint, as masks.
GROUPS = [0xFFFF << (16 * i) for i in range(4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash64(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Majority fingerprint, signed, of a text's ``width``-word shingles; 0 without words.

    A-Z alone are lower-cased and words are split at ASCII white space, as
    ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) > width:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)), strict=False)]
    else:
        grams = [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=len(grams))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, BYTES)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str, width: int = 3, seed: int = 42) -> Column:
    """A signed 64-bit fingerprint of a text column (null: 0)."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        worker_cache("near_simhash")
        return pd.Series([simhash64(t, width, seed) for t in texts], dtype="int64")

    return run(F.col(text).cast("binary"))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def shared_bytes(xor: Column) -> Column:
    """How many of the eight positional bytes of two fingerprints agree."""
    agree = [F.when(F.shiftrightunsigned(xor, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(BYTES)]
    total = agree[0]
    for one in agree[1:]:
        total = total + one
    return total


def postings(classes: DataFrame) -> DataFrame:
    """The inverted index: each fingerprint under the bytes of two of its four 2-byte groups.

    Fingerprints within two bits differ in at most two bytes, hence in at most
    two groups, so they share at least one of these six postings.  Lists of
    single bytes would hold N/256 fingerprints each; those of four bytes stay
    short at any size.
    """
    pairs = [F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(a | b))).alias("bytes")) for k, (a, b) in enumerate(combinations(GROUPS, 2))]
    return classes.select("fp", F.explode(F.array(*pairs)).alias("k")).select("k.combo", "k.bytes", "fp")


def links(fingerprints: DataFrame, radius: int = 2, list_limit: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all within ``radius`` (at most 2) bits.

    Posting lists up to ``list_limit`` are joined with themselves: the shared
    positional bytes of each pair are tallied, pairs under the guaranteed
    ``8 - radius`` fall out and the rest are verified bit by bit.  Longer lists
    make no pairs: each member is put at itself and at every value one bit away
    within the free bytes.  Two fingerprints are within two bits exactly if
    they meet at such a value, and what meets is linked to its smallest member,
    so no link between components is lost and the work stays linear.
    """
    scratch = scratch or Scratch()
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    listed = postings(fingerprints)
    # Stored, so that the join below is one of two exchanges and a hot list's rows can be split.
    sizes = scratch.keep(listed.groupBy("combo", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    members = scratch.keep(listed.join(sizes, ["combo", "bytes"]), "postings")
    short = members.where(F.col("n") <= list_limit).select("combo", "bytes", "fp")
    xor = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["combo", "bytes"])
        .where("a < b")
        .where(shared_bytes(xor) >= BYTES - radius)
        .where(F.bit_count(xor) <= radius)
        .select("a", "b")
    )
    if not members.where(F.col("n") > list_limit).limit(1).count():
        return pairs
    flips = []
    for a, b in combinations(GROUPS, 2):
        free = [i for i in range(64) if not ((a | b) >> i) & 1]
        flips.append(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in free)))
    masks = F.array(*flips)
    spread = members.where(F.col("n") > list_limit).select("fp", F.explode(F.element_at(masks, F.col("combo") + 1)).alias("flip"))
    spread = spread.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp")
    if radius == 0:
        spread = spread.where(F.col("value") == F.col("fp"))
    met = scratch.keep(spread.distinct(), "values")
    heads = met.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    star = met.join(heads, "value").where("fp <> a")
    if radius == 1:
        # At radius 1 two values may meet two bits apart; only those one bit apart count, and each has its own value.
        star = met.join(met.where("value = fp").select("value", F.col("fp").alias("a")), "value").where("fp <> a")
    return pairs.union(star.select("a", F.col("fp").alias("b")))


def simhash_groups(docs: DataFrame, radius: int = 2, width: int = 3, list_limit: int = 64) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: ``doc_id, fp, component_id``.

    One row per input row.  Null and word-less texts have fingerprint zero and
    link like any other.  What is linked are fingerprints, so rows without an
    id, and several texts of one id, carry links too; ``component_id`` is the
    smallest id of the group, null where none of its rows has one.  An empty
    table gives no rows; other columns are ignored.
    """
    fps = Stored(small_batches(docs).select("doc_id", fingerprint_column("text", width).alias("fp")), "fps")
    classes = Stored(fps.df.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    scratch = Scratch()
    found = components(links(classes.df, radius, list_limit, scratch))
    scratch.clear()
    linked = classes.df.join(found.df.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    linked = scratch.keep(linked, "linked")
    ids = scratch.keep(linked.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    final = Stored(linked.join(ids, "component").select("fp", "component_id"), "groups")
    scratch.clear()
    for t in (classes, found):
        t.discard()
    return fps.df.join(final.df, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
