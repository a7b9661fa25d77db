"""Document fingerprints: weighted SimHash of 128 bits, and a radius search over permuted block tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Stored, documents, small_batches

BITS = 128
#: A term's weight grows with its length: short words are the ones most texts share.
FULL_LENGTH = 12
#: Bits in which fingerprints of near copies (five-word shingles of Jaccard 0.8 or more) mostly differ at most.
COPY_RADIUS = 11
#: Stored bytes of input for a range of ids, and the most ranges there are; fingerprints in a pack.
RANGE_BYTES, MOST_RANGES, PACK = 16 << 20, 20_000, 1 << 14


def weighted_simhash(text: str | None) -> bytes:
    """16 bytes: each bit has the sign of the weighted votes of the terms' hashes; all zero without terms.

    Terms are lower-cased words; a term that occurs n times weighs
    (1 + ln n) times the square of its length, up to ``FULL_LENGTH`` letters.
    """
    terms = Counter((text or "").lower().split())
    if not terms:
        return bytes(BITS // 8)
    weights = np.fromiter(((1 + math.log(n)) * min(len(t), FULL_LENGTH) ** 2 for t, n in terms.items()), dtype=np.float64, count=len(terms))
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t.encode()) for t in terms]), dtype=np.uint8).reshape(-1, BITS // 8)
    votes = np.zeros(BITS)
    for at in range(0, len(hashes), 8192):
        votes += weights[at : at + 8192] @ np.unpackbits(hashes[at : at + 8192], axis=1).astype(np.float64)
    # Equal texts meet their terms in the same order, so sums and ties are equal too.
    return np.packbits(votes * 2 > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprint_column(text: str) -> Column:
    """The fingerprint of a text column as 32 lower-case hex digits (null: all zero)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([weighted_simhash(t).hex() for t in texts], dtype=object)

    return run(F.col(text))


def blocks_of(fp: str, count: int) -> list[tuple[Column, int]]:
    """A hex fingerprint cut into ``count`` runs of digits: the value of each and its bits."""
    digits = BITS // 4
    edges = [round(i * digits / count) for i in range(count + 1)]
    return [(F.conv(F.substring(fp, a + 1, b - a), 16, -10).cast("long"), 4 * (b - a)) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _halves(fp: str) -> Column:
    return F.struct(*(F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long").alias(name) for i, name in enumerate(("hi", "lo"))))


def _packed(rows: DataFrame, name: str, keys: tuple[str, ...] = ("block", "value")) -> DataFrame:
    """Fingerprints of a key in packs of at most about ``PACK``, so that a hot key is many rows."""
    packs = max(1, -(-rows.select("fp").distinct().count() // PACK))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(packs)))
    return salted.groupBy(*keys, "salt").agg(F.collect_list("fp").alias(name)).drop("salt")


def _meet(queries: DataFrame, fingerprints: DataFrame, radius: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """Packs of queries and of fingerprints under each key of a block table: ``block, value, asked, posted``.

    There are half as many blocks as bits may differ, so of two fingerprints
    within the radius one block at least differs in one bit at most.  Each
    block has its table; queries look it up as it is and with each bit turned.
    """
    cut = blocks_of("hex", radius // 2 + 1)
    key = lambda i, value: F.struct(F.lit(i).alias("block"), value.alias("value"))
    distinct = lambda df: df.select(F.col("fp").alias("hex")).where("fp is not null").distinct()
    turned = [key(i, value.bitwiseXOR(F.lit(_signed(m)).cast("long"))) for i, (value, bits) in enumerate(cut) for m in [0, *(1 << k for k in range(bits))]]
    asked = scratch.keep(distinct(queries).select(_halves("hex").alias("fp"), F.explode(F.array(*turned)).alias("k")).select("fp", "k.*"), "asked")
    posted = distinct(fingerprints).select(_halves("hex").alias("fp"), F.explode(F.array(*(key(i, v) for i, (v, _) in enumerate(cut)))).alias("k")).select("fp", "k.*")
    posted = scratch.keep(posted.join(asked.select("block", "value").distinct(), ["block", "value"], "left_semi"), "posted")
    met = _packed(asked, "asked").join(_packed(posted, "posted"), ["block", "value"])
    return met, [bits for _, bits in cut]


def _pairs(batch: pa.RecordBatch, widths: list[int], radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(asked, near, distance)`` of the pairs of a batch of packs, each pair in the first block that differs in one bit
    at most and nowhere else; fingerprints are rows of two unsigned words."""
    lists = [batch.column(batch.schema.get_field_index(name)) for name in ("asked", "posted")]
    flat = [np.stack([x.flatten().field(h).to_numpy().view(np.uint64) for h in ("hi", "lo")], axis=1) for x in lists]
    sizes = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in lists]
    starts = [np.cumsum(n) - n for n in sizes]
    shifts = BITS - np.cumsum(widths)

    def compare(left: np.ndarray, right: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = flat[0][left], flat[1][right]
        diff = a ^ b
        distance = np.bitwise_count(diff).sum(axis=1)
        near = np.flatnonzero((distance <= radius) & (distance > 0))
        diff, block = diff[near], block[near]
        open_ = np.ones(len(near), dtype=bool)
        first = np.zeros(len(near), dtype=bool)
        for i, (width, shift) in enumerate(zip(widths, shifts, strict=True)):
            mask = ((1 << width) - 1) << int(shift)
            part = diff & np.array([mask >> 64, mask & (2**64 - 1)], dtype=np.uint64)
            close = np.bitwise_count(part).sum(axis=1) <= 1
            first |= open_ & close & (block == i)
            open_ &= ~close
        kept = near[first]
        return a[kept], b[kept], distance[kept].astype(np.int64)

    blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
    pairs = sizes[0] * sizes[1]
    for part in np.array_split(np.arange(len(pairs)), max(1, int(np.ceil(len(pairs) / 4096)))):
        small = part[pairs[part] <= 4096]
        n = pairs[small]
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(sizes[1][small], n)
        for at in range(0, max(1, len(off)), 1 << 18):
            o, w = off[at : at + (1 << 18)], wide[at : at + (1 << 18)]
            row = np.repeat(small, n)[at : at + (1 << 18)]
            yield compare(starts[0][row] + o // np.maximum(w, 1), starts[1][row] + o % np.maximum(w, 1), blocks[row])
        for row in part[pairs[part] > 4096]:
            right = starts[1][row] + np.arange(sizes[1][row])
            step = max(1, (1 << 18) // len(right))
            for left in range(0, sizes[0][row], step):
                own = starts[0][row] + np.arange(left, min(left + step, sizes[0][row]))
                yield compare(np.repeat(own, len(right)), np.tile(right, len(own)), np.full(len(own) * len(right), blocks[row]))


def _hex(halves: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in halves.astype(">u8")]


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``fp, near, distance`` of distinct fingerprints at most ``radius`` bits apart, exactly.

    Both frames have ``fp`` hex strings; equal ones count once, so copies make
    no pairs; nulls take no part.  Block tables find what may be near, see
    :func:`_meet`.  All-zero fingerprints of empty texts are one fingerprint.
    """
    met, widths = _meet(queries, fingerprints, radius, Scratch())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, near, distance in _pairs(batch, widths, radius):
                yield pa.RecordBatch.from_arrays([pa.array(_hex(asked), pa.string()), pa.array(_hex(near), pa.string()), pa.array(distance)], names=["fp", "near", "distance"])

    return small_batches(met).mapInArrow(run, "fp string, near string, distance long")


def count_within(queries: DataFrame, fingerprints: DataFrame, radii: dict[str, int]) -> Stored:
    """For each distinct query fingerprint with any, how many other fingerprints lie within each of the radii: ``fp`` and
    a count by the radius's name.  Pairs are counted where they meet and never become rows."""
    scratch = Scratch()
    most = max(radii.values())
    met, widths = _meet(queries, fingerprints, most, scratch)
    names = ["fp", *radii]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, _, distance in _pairs(batch, widths, most):
                own, at = np.unique(asked, axis=0, return_inverse=True)
                counts = [np.bincount(at.reshape(-1), weights=distance <= r, minlength=len(own)).astype(np.int64) for r in radii.values()]
                yield pa.RecordBatch.from_arrays([pa.array(_hex(own), pa.string()), *map(pa.array, counts)], names=names)

    counted = small_batches(met).mapInArrow(run, "fp string, " + ", ".join(f"{name} long" for name in radii))
    out = Stored(counted.groupBy("fp").agg(*(F.sum(name).alias(name) for name in radii)), "near")
    scratch.clear()
    return out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _row(doc_id, text: str, mine: bytes, following: str, theirs: bytes) -> tuple:
    edited = edited_text(text, following)
    changed = weighted_simhash(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine.hex(), changed.hex(), likeness(mine, changed), likeness(mine, theirs))


_NAMES = RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
_STEP = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in RESULT.split(", ")] + [("range", pa.int32()), ("edge", pa.string()), ("text", pa.binary())])


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_STEP)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STEP, strict=True)], schema=_STEP)


def ranges_of(docs: DataFrame) -> list[int]:
    """Ids that cut ``docs`` into ranges of about ``RANGE_BYTES`` of stored input, or as many as a shuffle has partitions."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(max(size // RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    share = [k / n for k in range(1, n)]
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share or [0.5], 20 * n).alias("at")).first()["at"]
    return sorted(set(got or []))


READ = "range int, doc_id long, text binary, fp binary"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses (``RESULT``).

    The next document is that of the next smaller ``doc_id``, after the last
    one the first; rows of one id go by their fingerprint, null ids come last,
    null texts count as empty.  Texts are fingerprinted where they are read and
    go through one exchange, compressed and dealt by ranges of ``doc_id``; a
    task reads its range in order and holds one text at a time.  The last row
    of a range meets the first of the next in a second, small step, of as many
    rows as there are ranges.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = np.array(ranges_of(docs), dtype=np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            ids = batch.column("doc_id")
            # Larger ids come first, so ranges count down; null ids are the last range.
            at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="right")
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at)
            columns = [pa.array(at, pa.int32()), ids, pa.array([pack(t.encode()) for t in texts], pa.binary()), pa.array(list(map(weighted_simhash, texts)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "doc_id", "text", "fp"])

    dealt = docs.mapInArrow(read, READ).repartition(len(bounds) + 2, "range").sortWithinPartitions("range", F.col("doc_id").desc_nulls_last(), "fp", "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        said = lambda z: unpack(z).decode() if z is not None else ""
        held: tuple | None = None
        blank = (None,) * (len(_NAMES) - 1)
        for batch in batches:
            out = []
            for at, doc_id, z, fp in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = said(z)
                if held is not None and held[0] == at:
                    out.append((*_row(*held[1:4], text, fp), at, None, None))
                else:
                    if held is not None:
                        out.append((held[1], *blank, held[0], "last", held[4]))
                    out.append((doc_id, *blank, at, "first", z))
                held = (at, doc_id, text, fp, z)
            yield _frame(out)
        if held is not None:
            yield _frame([(held[1], *blank, held[0], "last", held[4])])

    rows = Stored(dealt.mapInArrow(follow, f"{RESULT}, range int, edge string, text binary"), "fingerprints").df
    edges = rows.where("edge is not null").select("doc_id", "range", "edge", "text")
    order = sorted(r["range"] for r in edges.where("edge = 'first'").select("range").collect())
    steps = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "range int, next int")
    firsts = edges.where("edge = 'first'").select(F.col("range").alias("next"), F.col("text").alias("following"))
    closed = edges.where("edge = 'last'").select("doc_id", "range", "text").join(steps, "range").join(firsts, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc_id, *z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, following = (unpack(x).decode() for x in z)
                out.append((*_row(doc_id, text, weighted_simhash(text), following, weighted_simhash(following)), None, None, None))
            yield _frame(out).select(_NAMES)

    return rows.where("edge is null").select(*_NAMES).unionByName(closed.mapInArrow(close, RESULT))


def with_neighbours(fingerprinted: DataFrame, asked: Column, radius: int = 3, copies: int = COPY_RADIUS) -> DataFrame:
    """``fingerprinted`` with ``n_near`` and ``n_copies``: for rows that are asked for, how many other fingerprints of all rows lie within ``radius`` and within ``copies``; null for the rest."""
    asked = F.coalesce(asked, F.lit(False))
    prints = lambda df: df.select(F.col("fingerprint").alias("fp"))
    within = {"n_near": radius, "n_copies": copies}
    near = count_within(prints(fingerprinted.where(asked)), prints(fingerprinted), within).df.withColumnRenamed("fp", "fingerprint")
    found = fingerprinted.where(asked).join(near, "fingerprint", "left").select(*fingerprinted.columns, *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in within))
    return found.unionByName(fingerprinted.where(~asked).withColumns({name: F.lit(None).cast("long") for name in within}))


def op9_weighted_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts; rows whose id is divisible by 20 search all rows for near fingerprints."""
    return with_neighbours(edited_fingerprints(documents(spark, sf_dir)), F.col("doc_id") % 20 == 0)
