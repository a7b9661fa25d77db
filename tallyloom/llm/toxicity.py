"""Toxicity: a noisy-channel restoration of obfuscated words, and a classifier of the restored text.

Leetspeak, spaced-out letters and stretched letters make a lattice of what a
token may stand for.  A character trigram model of the corpus decides by
Viterbi which reading is likeliest; the classifier sees the restored text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches, table, worker_cache

#: Bounds of what is fitted: labelled rows that the classifier learns from, and features that it keeps.
LABELLED_ROWS, FEATURES = 40_000, 2_000
#: Tokens that a worker remembers, up to a length; longer ones are worked out each time.
KEPT_TOKENS, KEPT_LENGTH = 100_000, 40

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
#: Signs that may stand between spaced-out letters.
BETWEEN = ".-_*"
EDGE = 0
SYMBOLS = {c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
OTHER = 27
SIZE = 28
#: Log-probabilities of the channel: a sign for a letter, a sign for itself, a stretched letter that was double, a double
#: letter that was single, a sign put between.
SWAPPED, ITSELF, STRETCHED, DROPPED, PUT = math.log(0.3), math.log(0.02), math.log(0.2), math.log(0.02), math.log(0.3)
JOINED = math.log(0.05)
LEAD = re.compile(r"[^\w@$!|+]*")
LETTER, SIGN, TRIPLE = re.compile("[a-zß-ÿ]"), re.compile("[0-9@$!|+]"), re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?:[^\W_][.\-_*]+){2,}[^\W_]")


def core_of(token: str) -> str:
    """A token without the marks around it, in time linear in its length."""
    start, end = LEAD.match(token).end(), len(token)
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in "_@$"):
        end -= 1
    return token[start:end]


def suspect(core: str) -> bool:
    """Whether a token may be obfuscated: letters and signs mixed, a letter three times in a row, or letters set apart."""
    return bool((LETTER.search(core) and SIGN.search(core)) or TRIPLE.search(core) or SPACED.fullmatch(core))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


# --- the character model ---------------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams within words of all ``docs``, as an array of SIZE**3; letters beyond a-z are one symbol."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        code = np.full(0x110000 + 1, -1, dtype=np.int8)
        code[[ord(c) for c in SYMBOLS]] = list(SYMBOLS.values())
        code[32] = EDGE
        worker_cache("toxicity")
        for texts in (b["text"].iloc[at : at + 250] for b in batches for at in range(0, len(b), 250)):
            words: Counter = Counter()
            for text in texts:
                if text:
                    words.update(text.lower().split())
            if not words:
                continue
            kept = [w for w in words if w.isalpha()]
            times = np.fromiter((words[w] for w in kept), dtype=np.int64, count=len(kept))
            sizes = np.fromiter(map(len, kept), dtype=np.int64, count=len(kept))
            chars = np.frombuffer(("  " + "  ".join(kept) + "  ").encode("utf-32-le"), dtype=np.uint32)
            symbols = np.where(code[chars] >= 0, code[chars], OTHER).astype(np.int64)
            weight = np.repeat(times, sizes + 2)
            n = len(weight)
            # Position i of the flat text, after its two leading blanks, is predicted from the two before it; the second blank of a gap stays out.
            key = symbols[:n] * SIZE * SIZE + symbols[1 : n + 1] * SIZE + symbols[2 : n + 2]
            ends = np.cumsum(sizes + 2) - 1
            weight[ends] = 0
            total += np.bincount(key, weights=weight, minlength=SIZE**3).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"key": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["key"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c], trigrams backed by bigrams and letters."""
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    return np.log((tri + 10 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 10))


class Restorer:
    """Restores single tokens and runs of single letters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.kept: dict[str, str] = {}

    def score(self, word: str) -> float:
        a = b = EDGE
        total = 0.0
        for c in [*(SYMBOLS.get(x, OTHER) for x in word), EDGE]:
            total += self.model[a][b][c]
            a, b = b, c
        return total

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one sign, what it may stand for, with the channel's log-probability."""
        out, at = [], 0
        while at < len(token):
            sign, n = token[at], 1
            while at + n < len(token) and token[at + n] == sign:
                n += 1
            at += n
            if sign in LEET:
                arcs = [(x * k, SWAPPED) for x in LEET[sign] for k in ((1,) if n == 1 else (1, 2))] + [(sign * n, n * ITSELF)]
            elif sign in BETWEEN:
                arcs = [("", n * PUT)]
            else:
                arcs = [(sign, 0.0 if n != 2 else DROPPED)] + ([(sign * 2, 0.0 if n == 2 else STRETCHED)] if n > 1 else [])
            out.append(arcs)
        return out

    def decode(self, token: str) -> str:
        """The likeliest reading of a token of any length, by Viterbi over the last two symbols; of equal ones the first met."""
        best: dict = {(EDGE, EDGE): (0.0, None)}
        for arcs in self.lattice(token):
            then: dict = {}
            for (a, b), (score, path) in best.items():
                for letters, cost in arcs:
                    x, y, total = a, b, score + cost
                    for c in letters:
                        s = SYMBOLS.get(c, OTHER)
                        total += self.model[x][y][s]
                        x, y = y, s
                    old = then.get((x, y))
                    if old is None or total > old[0]:
                        then[x, y] = (total, (path, letters))
            best = then
        path = max(((score + self.model[a][b][EDGE], k, path) for k, ((a, b), (score, path)) in enumerate(best.items())), key=lambda x: x[:2])[2]
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def token(self, token: str) -> str:
        known = self.kept.get(token)
        if known is None:
            core = core_of(token)
            known = self.decode(core) if core and suspect(core) else core or token
            if len(token) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_TOKENS:
                    self.kept.clear()
                self.kept[token] = known
        return known

    def text(self, text: str) -> str:
        """A text of lower-cased, restored words with one space between them."""
        tokens = text.lower().split()
        out = list(map(self.token, tokens))
        if any(map(_single, out)):
            out = self.joined(out)
        return " ".join(out)

    def joined(self, tokens: list[str]) -> list[str]:
        """Runs of three or more single letters become a word where the model finds that likelier."""
        out, run = [], []
        for t in [*tokens, "  "]:
            if len(t) == 1 and (t.isalpha() or t in LEET):
                run.append(t)
                continue
            if len(run) >= 3:
                word = self.decode("".join(run))
                apart = sum(map(self.score, run))
                out += [word] if self.score(word) + JOINED > apart else run
            else:
                out += run
            run = []
            out.append(t)
        return out[:-1]


def _single(t: str) -> bool:
    return len(t) == 1


class Channel:
    """A character model as bytes that go to workers, each of which keeps one :class:`Restorer` of it."""

    def __init__(self, model: np.ndarray):
        self.packed = model.astype(np.float32).tobytes()
        self.name = xxhash.xxh3_64_intdigest(self.packed)

    def restorer(self) -> Restorer:
        kept = worker_cache("toxicity")
        if kept.get("channel") != self.name:
            kept["channel"], kept["restorer"] = self.name, Restorer(np.frombuffer(self.packed, dtype=np.float32).reshape(SIZE, SIZE, SIZE).astype(float))
        return kept["restorer"]


def restored(text: str, channel: Channel) -> Column:
    """The restored text of a column (null: empty)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        r = channel.restorer()
        return pd.Series(["" if t is None else r.text(t) for t in texts], dtype=object)

    return run(F.col(text))


# --- the classifier --------------------------------------------------------------------------------------------------


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of how it begins."""
    digest = xxhash.xxh3_64_intdigest
    parts = [word] + [f"{k}^{word[:k]}" for k in (4, 5) if len(word) > k]
    return tuple(digest(p.encode("utf-8", "replace")) - (1 << 63) for p in parts)


def document_features(text: str) -> set[int]:
    return set().union(*map(features_of, set(text.split())))


def count_features(sample: DataFrame) -> DataFrame:
    """In how many toxic and other texts of ``sample(said, toxic)`` each feature is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def frame() -> pd.DataFrame:
            every = list(counts[0].keys() | counts[1].keys())
            out = pd.DataFrame({"feature": np.array(every, dtype=np.int64), "clean": [counts[0][f] for f in every], "toxic": [counts[1][f] for f in every]})
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["said"], batch["toxic"], strict=True):
                counts[int(toxic)].update(document_features(text))
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield frame()
        yield frame()

    rows = sample.select("said", "toxic").mapInPandas(run, "feature long, clean long, toxic long")
    return rows.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, size: int, start: np.ndarray, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model over sets of features, the last one the bias; classes weigh alike."""
    w = np.append(start, 0.0)
    if not len(y):
        return w
    flat = np.concatenate([np.append(r, size) for r in rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    grown = np.full(size + 1, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[flat], minlength=len(rows)), -30, 30)))
        slope = np.bincount(flat, weights=((p - y) * share)[row], minlength=size + 1) + decay * w
        grown += slope**2
        w -= 0.5 * slope / np.sqrt(grown)
    return w


def restored_and_scored(text: str, channel: Channel, weights: dict[int, float], bias: float) -> Column:
    """``said``, the restored text, and ``score``, the probability that it is toxic, in one step."""
    name = hash(tuple(sorted(weights.items())))

    @F.pandas_udf("said string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        r, kept = channel.restorer(), worker_cache("toxicity")
        if kept.get("weights") != name:
            kept["weights"], kept["live"] = name, {}
        known: dict[str, tuple] = kept["live"]

        def live(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                found = tuple(f for f in features_of(word) if f in weights)
                if len(word) <= KEPT_LENGTH:
                    if len(known) >= KEPT_TOKENS:
                        known.clear()
                    known[word] = found
            return found

        said, out = [], []
        for text in texts:
            said.append("" if text is None else r.text(text))
            total = bias + sum(weights[f] for f in set().union(*filter(None, map(live, set(said[-1].split())))))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        return pd.DataFrame({"said": pd.Series(said, dtype=object), "score": pd.Series(out, dtype="float64")})

    return run(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, features: int = FEATURES) -> DataFrame:
    """``docs`` with ``said`` (the restored text), ``held_out``, ``score`` and ``predicted``.

    ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.  The character model
    counts all texts that are not held out.  The classifier learns from at most
    ``labelled_rows`` labelled, not held out rows, chosen by a hash of their id:
    which features tell the classes apart, then logistic weights.  Null texts
    are empty; repeated labels of an id count as toxic if one is; rows without
    a label are scored like others; without labels every score is 0; a null id
    is not held out and never learnt from; of rows that repeat an id the least
    text is learnt from.  Columns named like the results are replaced.
    """
    small_batches(docs)
    held = F.coalesce(is_held_out(), F.lit(False))
    channel = Channel(language_model(trigram_counts(docs.where(~held))))
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.where(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    scratch = Scratch()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    sample = scratch.keep(texts.select(restored("text", channel).alias("said"), "toxic"), "labelled")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    if not totals["n"]:
        scratch.clear()
        return docs.withColumns({"held_out": held, "said": restored("text", channel), "score": F.lit(0.0), "predicted": F.lit(0)})
    counted = scratch.keep(count_features(sample).where(F.col("clean") + F.col("toxic") >= 4), "features")
    p1, p0 = (F.col("toxic") + 0.5) / F.lit(toxic + 1.0), (F.col("clean") + 0.5) / F.lit(clean + 1.0)
    odds = F.log(p1 / p0)
    strength = F.abs(odds) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = counted.select("feature", odds.alias("odds"), strength.alias("strength")).orderBy(F.desc("strength"), "feature").limit(features).toPandas()
    place = {int(f): i for i, f in enumerate(top["feature"])}

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int64"), "at": [sorted(place[f] for f in document_features(t) if f in place) for t in batch["said"]]})

    rows = sample.mapInPandas(active, "toxic long, at array<int>").toPandas()
    scratch.clear()
    fitted = fit_logistic([np.asarray(r, dtype=np.int64) for r in rows["at"]], rows["toxic"].to_numpy(), len(place), 0.1 * top["odds"].to_numpy(dtype=float))
    weights = {f: float(fitted[i]) for f, i in place.items()}
    own = docs.drop("held_out", "said", "score", "predicted")
    made = own.withColumns({"held_out": held, "made_": restored_and_scored("text", channel, weights, float(fitted[-1]))})
    return made.select(*own.columns, "held_out", "made_.said", "made_.score", (F.col("made_.score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")
