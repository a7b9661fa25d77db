"""Repeated runs of words: exact, whatever lines they lie in or run over."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, worker_cache

#: Words of the shortest run that counts as repeated, and of the grams one of which stands for it.
RUN_WORDS, GRAM = 50, 10

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(r"[^ \t\n\r\x0b\f]+")


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``n``; a worker keeps them."""
    cache = worker_cache("repeats")
    if len(cache.get(base, ())) < n:
        cache[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 18) - 1, base, dtype=np.uint64)], dtype=np.uint64)
    return cache[base]


class Runs:
    """Hashes of any run of the given words, from sums of their hashes times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _powers(_BACK, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.back[start]
        out ^= (end - start).astype(np.uint64)
        for shift, odd in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(odd)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its least one, the last of equal ones."""
    n = len(grams) - width + 1
    value, at, reach = grams, np.arange(len(grams)), 1

    def least(step: int, length: int) -> None:
        nonlocal value, at
        later = value[step : step + length] <= value[:length]
        value, at = np.where(later, value[step : step + length], value[:length]), np.where(later, at[step : step + length], at[:length])

    while 2 * reach <= width:
        least(reach, len(value) - reach)
        reach *= 2
    if reach < width:
        least(width - reach, n)
    return at[:n]


def anchors(words: np.ndarray, run_words: int = RUN_WORDS) -> tuple[np.ndarray, ...]:
    """Stretches of a text whose windows of ``run_words`` words have the same least gram.

    ``lo`` (first window), ``n`` (windows), hash of the gram, hash of all words
    of the stretch.  Equal windows have equal least grams, wherever they are.
    """
    hashed, gram = Runs(words), min(GRAM, run_words)
    starts = np.arange(len(words) - gram + 1)
    grams = hashed(starts, starts + gram)
    at = chosen(grams, run_words - gram + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.append(lo[1:], len(at))
    return lo, hi - lo, grams[at[lo]], hashed(lo, hi - 1 + run_words)


def stretches(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of stretches ``doc_id, tk, start, end, x, y`` (first window, number of windows, hash of the gram, hash of all
    words): those whose gram two documents have; their classes of equal words; the grams with several classes; and the
    windows to hash, those of one stretch of each such class."""
    live = scratch.keep(found.groupBy("x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("x"), "live")
    placed = scratch.keep(found.select("doc_id", "tk", "start", "end", "x", "y").join(live, "x", "left_semi"), "anchored")
    classes = placed.groupBy("y").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("x").alias("x"), F.min("end").alias("n"), F.min(F.struct("doc_id", "tk", "start")).alias("at")
    )
    classes = scratch.keep(classes, "classes")
    several = scratch.keep(classes.groupBy("x").agg(F.count("*").alias("k")).where("k > 1").select("x"), "several")
    mixed = classes.join(several, "x", "left_semi")
    return placed, classes, several, mixed.select("at.doc_id", "at.tk", "at.start", F.col("n").alias("end"), F.col("y").alias("id"), "least", "most")


def runs_of(placed: DataFrame, classes: DataFrame, several: DataFrame, seen: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of words that two or more documents have: ``doc_id, tk, runs``.

    ``runs`` are structs ``lo, hi, least, most``: in the row of ``doc_id`` whose
    text has hash ``tk``, each window of the given number of words that starts
    at a word from ``lo`` to ``hi`` is in other documents too, ``least`` and
    ``most`` being the first and the last of all that have it.  Runs may overlap.

    Each text is cut into stretches by the least gram of its windows.  Only
    stretches whose gram has other stretches too are looked at; stretches equal
    in all words are one, and where a gram has several, the windows of one of
    each (``seen``) are hashed and meet.  So nothing is compared pair by pair.
    """
    seen = seen.select(F.col("id").alias("y"), "off", "w", "least", "most")
    ends = scratch.keep(seen.groupBy("w").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most"), "ends")
    fine = seen.select("y", "off", "w").join(ends, "w")
    row = F.row_number().over(Window.partitionBy("y", "least", "most").orderBy("off"))
    fine = fine.withColumn("island", F.col("off") - row).groupBy("y", "least", "most", "island").agg(F.min("off").alias("first"), F.max("off").alias("last")).drop("island")
    whole = classes.join(several, "x", "left_anti").where("least < most").select("y", "least", "most", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    parts = scratch.keep(fine.unionByName(whole), "parts")
    met = placed.select("doc_id", "tk", "start", "y").join(parts, "y")
    run = F.struct((F.col("start") + F.col("first")).alias("lo"), (F.col("start") + F.col("last")).alias("hi"), "least", "most")
    return met.groupBy("doc_id", "tk").agg(F.collect_set(run).alias("runs"))


def without_places(pieces: list[tuple], places: list[tuple[int, int]], text: str) -> list[tuple]:
    """Pieces ``(start, end, ...)`` of a text less ``places`` in order; what has no words left goes."""
    out = []
    for start, end, *rest in pieces:
        for a, b in [p for p in places if p[0] < end and p[1] > start] + [(end, end)]:
            part = text[start:a]
            kept = part.strip(" \t\n\r\x0b\f")
            if kept:
                begin = start + part.index(kept)
                out.append((begin, begin + len(kept), *rest))
            start = max(start, b)
    return out


def spans(text: str, doc_id: int, runs: list[dict], run_words: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Places in code points: disjoint ones to cut with the document that has them first, and those that are kept."""
    ends = [m.span() for m in _WORD.finditer(text)]
    cut, kept = [], []
    for r in sorted(runs, key=lambda r: (r["lo"], r["least"], r["hi"])):
        lo, hi = r["lo"], r["hi"] + run_words
        if r["least"] < doc_id:
            lo = max(lo, cut[-1][1]) if cut else lo
            if cut and cut[-1][2] == r["least"] and lo == cut[-1][1]:
                cut[-1] = (cut[-1][0], max(hi, cut[-1][1]), r["least"])
            elif lo < hi:
                cut.append((lo, hi, r["least"]))
        elif kept and lo <= kept[-1][1]:
            kept[-1] = (kept[-1][0], max(hi, kept[-1][1]))
        else:
            kept.append((lo, hi))
    place = lambda lo, hi: (ends[lo][0], ends[hi - 1][1])
    return [(*place(lo, hi), least) for lo, hi, least in cut], [place(lo, hi) for lo, hi in kept]


def removed(text: str, cuts: list[tuple]) -> str:
    """``text`` without its cuts, each with the line break or space after it; a cut that ends a line it does not begin leaves the line break."""
    kept, at = [], 0
    for start, end, *_ in cuts:
        inside = start > 0 and text[start - 1] != "\n"
        piece = text[at:start]
        if inside and end < len(text) and text[end] == "\n":
            kept.append(piece[:-1] if piece[-1:].isspace() and piece[-1:] != "\n" else piece)
            at = end
        else:
            kept.append(piece)
            at = min(len(text), end + 1)
    joined = "".join(kept) + text[at:]
    return joined[:-1] if cuts and cuts[-1][1] >= len(text) and joined[-1:].isspace() else joined


CUT = "struct<text: string, cuts: array<struct<start: long, end: long, kept_in: long>>, n_shared: long>"


def cut_column(doc_id: Column, text: Column, cuts: Column, places: Column, runs: Column, run_words: int = RUN_WORDS) -> Column:
    """Text left, cuts and number of shared passages, of lines (``cuts`` and ``places``) and runs together; null without any."""

    @F.pandas_udf(CUT)
    def run(ids: pd.Series, texts: pd.Series, lines: pd.Series, shared: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for i, t, c, p, r in zip(ids, texts, lines, shared, found, strict=True):
            c, p, r = ([] if x is None else list(x) for x in (c, p, r))
            if t is None or not (p or r):
                out.append((None, None, None))
                continue
            gone, kept = spans(t, int(i), r, run_words) if r else ([], [])
            mine = [(x["start"], x["end"], x["kept_in"]) for x in c]
            cut = without_places(gone, [x[:2] for x in mine], t)
            places = sorted({(x["start"], x["end"]) for x in p})
            n = len(places) + len(without_places(gone, places, t)) + len(without_places(kept, places, t))
            every = sorted(mine + cut)
            out.append((removed(t, every) if every else t, [{"start": a, "end": b, "kept_in": k} for a, b, k in every], n))
        return pd.DataFrame(out, columns=["text", "cuts", "n_shared"])

    return run(doc_id, text, cuts, places, runs)
