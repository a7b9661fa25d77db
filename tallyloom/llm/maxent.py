"""A hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the words before it, times
its share of the class.  The class distribution is a softmax over hashed
features: the previous word, the one before it (a skip) and both together.
Weights are learnt by gradient steps in every partition of the training texts
and averaged; counts are exact and cover all training texts.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARED_BYTES, SHARED_ROWS, Stored, documents, small_batches, worker_cache

#: Classes: the commonest words have one each, other words share the rest by their ending.
CLASSES, OWN = 32, 12
#: Buckets of each of the three feature tables; tokens of one gradient step and of one scoring batch.
BUCKETS, BATCH = 4096, 16384
#: Most words whose counts every task holds; counts of the others come by a join.
HEAD_WORDS, KEPT_WORDS = 150_000, 250_000
END = b"\n"
RATE, ADD = 0.2, 0.1


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def spelled_class(word: bytes) -> int:
    return OWN + xxhash.xxh3_64_intdigest(word[-2:]) % (CLASSES - OWN)


def count_words(texts: DataFrame) -> DataFrame:
    """``word, spelled, c`` of all texts: lower-cased words, and one end for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("maxent")
        counts: Counter = Counter()

        def frame() -> pa.RecordBatch:
            words = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(map(spelled_class, words)), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "spelled", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counts.update((text.as_py() or b"").lower().split())
                if len(counts) > 400_000:
                    yield frame()
            counts[END] += batch.num_rows
        if counts:
            yield frame()

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, spelled int, c long")
    return rows.groupBy("word", "spelled").agg(F.sum("c").alias("c"))


class Coder(dict):
    """Words to codes: rank in the head (or all ones) << 32 | class << 16 | bucket; other words are coded by spelling and kept for a while."""

    def __init__(self, head: list[bytes]):
        super().__init__()
        self.others = 0
        self.head = {w: self.code(w, i if i < OWN else None, i) for i, w in enumerate(head)}
        self.update(self.head)

    @staticmethod
    def code(word: bytes, own: int | None, rank: int = (1 << 31) - 1) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        return rank << 32 | (spelled_class(word) if own is None else own) << 16 | h % BUCKETS

    def __missing__(self, word: bytes) -> int:
        if self.others >= KEPT_WORDS:
            self.clear()
            self.update(self.head)
            self.others = 0
        code = self[word] = self.code(word, None)
        self.others += 1
        return code


TAIL = (1 << 31) - 1
def coder(head: list[bytes], name: int) -> Coder:
    kept = worker_cache("maxent")
    if name not in kept:
        kept.clear()
        kept[name] = Coder(head)
    return kept[name]


def contexts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bucket of each feature table, a column each, for tokens of texts that begin at ``begins``."""
    n = len(codes)
    bucket = (codes & 0xFFFF) + 1
    one, two = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    one[1:], two[2:] = bucket[:-1], bucket[:-2]
    one[begins] = 0
    two[begins] = 0
    after = begins + 1
    two[after[after < n]] = 0
    both = (one * 0x9E3779B1 + two * 0x85EBCA77) >> 7
    return np.stack([one % BUCKETS, BUCKETS + two % BUCKETS, 2 * BUCKETS + both % BUCKETS], axis=1)


def run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows`` that begin at ``starts``.

    Long runs are summed one by one; of the short ones all second rows are
    added at once, then all third rows, and so on.
    """
    sizes = np.diff(np.append(starts, len(rows)))
    out = rows[starts]
    for i in np.flatnonzero(sizes > 64):
        out[i] = rows[starts[i] : starts[i] + sizes[i]].sum(axis=0)
    live, k = np.flatnonzero((sizes > 1) & (sizes <= 64)), 1
    while len(live):
        out[live] += rows[starts[live] + k]
        k += 1
        live = live[sizes[live] > k]
    return out


def class_logits(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probabilities of the classes, a row for each token."""
    z = weights[at[:, 0]]
    for k in range(1, at.shape[1]):
        z += weights[at[:, k]]
    with np.errstate(over="ignore"):
        total = np.exp(z).sum(axis=1, keepdims=True)
    if len(z) and not (total.min() > 1e-30 and total.max() < 1e30):
        z -= z.max(axis=1, keepdims=True)
        total = np.exp(z).sum(axis=1, keepdims=True)
    z -= np.log(total)
    return z


def coded_batches(batches: Iterator[pa.RecordBatch], c: Coder, least: int = BATCH):
    """Codes of runs of whole texts of ``least`` tokens or more: ``(codes, begins, rows)``; rows are ``(doc_id, words)``."""
    end = c[END]
    codes: list[np.ndarray] = []
    begins: list[int] = []
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = (text.as_py() or b"").lower().split()
            got = np.fromiter(map(c.__getitem__, words), dtype=np.int64, count=len(words))
            begins.append(size)
            codes += [got, np.array([end])]
            rows.append((doc_id, words))
            size += len(words) + 1
            if size >= least:
                yield np.concatenate(codes), np.array(begins), rows
                codes, begins, rows, size = [], [], [], 0
    if rows:
        yield np.concatenate(codes), np.array(begins), rows


class Learner:
    """Gradient steps with per-weight rates on one partition's tokens."""

    def __init__(self, prior: np.ndarray):
        self.w = np.zeros((3 * BUCKETS, CLASSES), dtype=np.float32)
        self.w[:] = prior / 3
        self.grown = np.full_like(self.w, 1e-4)
        self.seen = np.zeros(3 * BUCKETS)

    def step(self, at: np.ndarray, classes: np.ndarray) -> None:
        slope = np.exp(class_logits(self.w, at))
        slope[np.arange(len(classes)), classes] -= 1
        slope /= len(classes)
        for k in range(at.shape[1]):
            # Rows of one bucket come together, then their slopes are summed run by run.
            bucket = (at[:, k] - k * BUCKETS).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            runs = bucket[order]
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            rows = runs[starts].astype(np.int64) + k * BUCKETS
            g = run_sums(slope[order], starts)
            grown = self.grown[rows] + 1e3 * g * g
            self.grown[rows] = grown
            self.w[rows] -= RATE * 31.6 * g / np.sqrt(grown)
            self.seen[rows] += np.diff(np.append(starts, len(runs)))


def learn(texts: DataFrame, head: list[bytes], prior: np.ndarray, name: int) -> np.ndarray:
    """Weights learnt in every partition from the same start, averaged by how often a bucket was seen."""
    columns = [f"w{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Learner(prior)
        gc.disable()  # long lists of words, and no cycles
        for codes, begins, _ in coded_batches(batches, coder(head, name)):
            at, classes = contexts(codes, begins), (codes >> 16) & 0xFFFF
            for k in range(0, len(codes), BATCH):
                model.step(at[k : k + BATCH], classes[k : k + BATCH])
        gc.enable()
        some = np.nonzero(model.seen)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(model.seen[some], pa.float64())] + [pa.array(model.w[some, k].astype(np.float64) * model.seen[some]) for k in range(CLASSES)],
            names=["bucket", "n", *columns],
        )

    schema = "bucket int, n double, " + ", ".join(f"{c} double" for c in columns)
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toPandas()
    out = np.zeros((3 * BUCKETS, CLASSES))
    out[:] = prior / 3
    if len(found):
        out[found["bucket"].to_numpy()] = found[columns].to_numpy() / found[["n"]].to_numpy()
    return out.astype(np.float32)


def head_words(counts: DataFrame, most: int) -> pd.DataFrame:
    """The commonest words, at most ``most``, commonest first: a threshold from a histogram of bounded size, then what reaches it."""
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384)
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in bins:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return pd.DataFrame({"word": [], "c": []})
    top = counts.where(level >= least).select("word", "c").toPandas()
    top["word"] = top["word"].map(bytes)
    return top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


SCORED = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.binary()))]
)
SCORED_DDL = "rid long, doc_id long, n_tokens long, known long, base double, model double, tail array<binary>"


def score_texts(docs: DataFrame, held_out: Column | None = None, head_limit: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each of ``docs(doc_id, text)``.

    Learns from rows that are not held out.  ``base_score`` is the smoothed
    unigram log10 probability, ``score`` the model's.  Null and empty texts
    are one end; repeated rows are scored each; a null id is not held out;
    without training texts every token is unknown and both scores are those of
    one class with one unseen word; an empty table gives no rows.
    """
    held = is_held_out() if held_out is None else held_out
    docs = small_batches(docs, SHARED_ROWS, SHARED_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.where(~held)
    counts = Stored(count_words(texts), "words").df
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    top = head_words(counts, head_limit)
    head, head_c = list(top["word"]), top["c"].to_numpy(dtype=np.float64)
    spelled = counts.groupBy("spelled").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in spelled:
        tokens[r["spelled"]], kinds[r["spelled"]] = r["c"], r["v"]
    for k, (w, c) in enumerate(zip(head[:OWN], head_c[:OWN], strict=True)):
        own = spelled_class(w)
        tokens[own] -= c
        kinds[own] -= 1
        tokens[k], kinds[k] = c, 1
    share = np.log10(tokens + ADD * (kinds + 1))
    prior = np.log((tokens + 1) / (tokens + 1).sum())
    name = xxhash.xxh3_64_intdigest(b"\n".join(head) + prior.tobytes())
    sent = docs.sparkSession.sparkContext.broadcast((head, np.log10(head_c + ADD)))
    weights = learn(texts, head, prior, name) if n else np.tile(prior / 3, (3 * BUCKETS, 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = sent.value
        c, rid = coder(words, name), TaskContext.get().partitionId() << 33
        logs = np.append(logs, 0.0)
        gc.disable()
        for codes, begins, rows in coded_batches(batches, c):
            rank, classes = codes >> 32, (codes >> 16) & 0xFFFF
            at = contexts(codes, begins)
            model = np.empty(len(codes))
            for k in range(0, len(codes), BATCH):
                z = class_logits(weights, at[k : k + BATCH])
                model[k : k + BATCH] = z[np.arange(len(z)), classes[k : k + BATCH]]
            in_tail = rank == TAIL
            base = logs[np.where(in_tail, len(logs) - 1, rank)]
            model = model / np.log(10) + base - share[classes]
            tails, where = [], np.nonzero(in_tail)[0]
            cuts = np.searchsorted(where, begins)
            for i, (_, said) in enumerate(rows):
                mine = where[cuts[i] : cuts[i + 1] if i + 1 < len(cuts) else len(where)] - begins[i]
                tails.append([said[j] if j < len(said) else END for j in mine.tolist()])
            sizes = np.diff(np.append(begins, len(codes)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(rows))),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((~in_tail).astype(np.int64), begins)),
                    pa.array(np.add.reduceat(base, begins)),
                    pa.array(np.add.reduceat(model, begins)),
                    pa.array(tails, pa.list_(pa.binary())),
                ],
                schema=SCORED,
            )
            rid += len(rows)
        gc.enable()

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCORED_DDL)
    rows = Stored(scored, "scored").df
    rare = rows.select("rid", F.explode("tail").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    of = rare.join(counts.select("word", "c"), "word", "left")
    logc = F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)) * F.col("times")
    more = of.groupBy("rid").agg(F.sum(logc).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("found"))
    out = rows.drop("tail").join(more, "rid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    return out.select(
        "doc_id",
        (is_held_out() if held_out is None else held_out).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(n + ADD * (v + 1))))).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
