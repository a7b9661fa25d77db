"""Sampling frames and exact-size, repeatable samples.

A draw ranks rows by md5 of seed and id, so that it is the same on any
cluster; strata rank within themselves and a quota cuts each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, column: str = "document_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}_"), F.col(column).cast("string")).cast("binary"))


def keyword_flags(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``search_<name>`` for each pattern, and ``search_none`` where none matches; null text matches nothing."""
    flags = {f"search_{n}": F.coalesce(F.col(text).rlike(p), F.lit(False)) for n, p in patterns.items()}
    out = df.withColumns(flags)
    none = ~F.greatest(*(F.col(f) for f in flags)) if len(flags) > 1 else ~F.col(next(iter(flags)))
    return out.withColumn("search_none", none)


#: Draws over this size are cut by a histogram of their keys instead of one task's sort.
SORTED_DRAW = 10_000


def simple(df: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` rows without replacement, or all: those of the least keys.

    A large draw counts keys by their first four hexadecimal digits (65,536
    rows at most), takes all bins under the one where the size is reached, and
    sorts only that bin.
    """
    keyed = df.withColumn("_key", draw_key(seed))
    if size <= SORTED_DRAW:
        return keyed.orderBy("_key", "document_id").limit(size).drop("_key")
    binned = keyed.withColumn("_bin", F.substring("_key", 1, 4))
    taken, edge = 0, None
    for r in binned.groupBy("_bin").agg(F.count("*").alias("n")).orderBy("_bin").collect():
        if taken + r["n"] > size:
            edge = r["_bin"]
            break
        taken += r["n"]
    if edge is None:
        return df
    rest = binned.where(F.col("_bin") == edge).orderBy("_key", "document_id").limit(size - taken)
    return binned.where(F.col("_bin") < edge).unionByName(rest).drop("_key", "_bin")


def quotas(df: DataFrame, by: Sequence[str], size: int, strategy: str = "stratify") -> DataFrame:
    """How many rows each stratum gives: ``by..., available, quota``.

    ``stratify``: proportional by largest remainder, ties to the first stratum;
    ``stratify_even``: alike, the rest to the first strata;
    ``stratify_guaranteed``: proportional but one at least.
    """
    counts = df.groupBy(*by).agg(F.count("*").alias("available"))
    totals = counts.agg(F.sum("available").alias("N"), F.count("*").alias("H"))
    counts = counts.join(F.broadcast(totals))
    exact = F.lit(float(size)) * F.col("available") / F.col("N")
    if strategy == "stratify_even":
        order = Window.orderBy(*by)
        low = F.floor(F.lit(size) / F.col("H"))
        quota = low + F.when(F.row_number().over(order) <= F.lit(size) - low * F.col("H"), 1).otherwise(0)
        return counts.select(*by, "available", F.least(quota, "available").cast("long").alias("quota"))
    counts = counts.withColumn("low", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    short = counts.agg((F.lit(size) - F.sum("low")).alias("short"))
    counts = counts.join(F.broadcast(short))
    quota = F.col("low") + F.when(F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), *by)) <= F.col("short"), 1).otherwise(0)
    if strategy == "stratify_guaranteed":
        quota = F.greatest(quota, F.lit(1))
    elif strategy != "stratify":
        raise ValueError(f"unknown strategy {strategy!r}")
    return counts.select(*by, "available", F.least(quota, "available").cast("long").alias("quota"))


def ranked(df: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """``document_id, stratum_, rank_``: each row's place in its stratum by draw key, from 1; strata are structs of ``by``, null one of them.

    Ids alone are ranked.  Keys are cut into bins by their first hexadecimal
    digits, which are as even as md5 is: rows are ranked within bins, and the
    counts of the bins before are added.  So a stratum of any size is many tasks.
    """
    key = draw_key(seed)
    ids = df.select("document_id", F.struct(*by).alias("stratum_"), key.alias("key_"), F.substring(key, 1, 3).alias("bin_"))
    counts = ids.groupBy("stratum_", "bin_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("stratum_").orderBy("bin_")) - F.col("n_")
    counts = counts.select("stratum_", "bin_", before.alias("before_"))
    place = F.row_number().over(Window.partitionBy("stratum_", "bin_").orderBy("key_", "document_id"))
    return ids.withColumn("place_", place).join(counts, ["stratum_", "bin_"]).select("document_id", "stratum_", (F.col("before_") + F.col("place_")).alias("rank_"))


def stratified(df: DataFrame, by: Sequence[str], size: int, seed: int, strategy: str = "stratify") -> DataFrame:
    """A ranked draw within each stratum, cut at its quota.  A document is one row of ``df``."""
    wanted = quotas(df, by, size, strategy).select(F.struct(*by).alias("stratum_"), "quota")
    chosen = ranked(df, by, seed).join(wanted, "stratum_").where("rank_ <= quota").select("document_id")
    return df.join(chosen, "document_id", "left_semi")


def keyword_oversample(flagged: DataFrame, proportions: dict[str, float], size: int, seed: int) -> DataFrame:
    """Document ids: each search gives ceil(size * proportion) of its matches, the rest comes from what no search matches.

    Draws may meet in a document; what is then missing is filled up from the rest.
    """
    shares = {"search_none": 1 - sum(proportions.values())} | {f"search_{n}": p for n, p in proportions.items()}
    drawn = None
    for flag, share in shares.items():
        part = simple(flagged.where(flag).select("document_id"), -int(-round(size * share, 9) // 1), seed)
        drawn = part if drawn is None else drawn.union(part)
    return fill_up(flagged.select("document_id"), drawn.distinct(), size, seed)


def fill_up(frame: DataFrame, drawn: DataFrame, size: int, seed: int) -> DataFrame:
    """``drawn`` and as many other rows of ``frame`` as ``size`` asks for; no more than ``size`` in all."""
    drawn = drawn.select("document_id")
    have = drawn.count()
    if have >= size:
        return simple(drawn, size, seed)
    return drawn.union(simple(frame.join(drawn, "document_id", "left_anti").select("document_id"), size - have, seed))


def unsampled(frame: DataFrame, *samples: DataFrame) -> DataFrame:
    """Frame rows that none of the samples has."""
    for s in samples:
        frame = frame.join(s.select("document_id"), "document_id", "left_anti")
    return frame


def expansion_size(old_frame: int, new_frame: int, sample: int) -> int:
    """A sample's size grown as its frame has."""
    return round(sample * (1 + (new_frame - old_frame) / old_frame)) if old_frame else sample


def expand(frame: DataFrame, sample: DataFrame, by: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """``sample`` and, from each stratum, round(fraction * what it already gave) documents not yet in it."""
    have = sample.select("document_id").join(frame, "document_id").groupBy(F.struct(*by).alias("stratum_")).agg(F.bround(F.count("*") * fraction).cast("long").alias("more"))
    extra = ranked(unsampled(frame, sample), by, seed).join(have, "stratum_").where("rank_ <= more")
    return sample.select("document_id").union(extra.select("document_id"))


def in_frame(sample: DataFrame, frame: DataFrame) -> DataFrame:
    """Sample units whose document is still in the frame."""
    return sample.join(frame.select("document_id"), "document_id", "left_semi")


def folds(df: DataFrame, label: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Stratified folds 0 to k-1, shuffled by the draw key.  A document is one row of ``df``."""
    place = ranked(df, [label], seed).select("document_id", ((F.col("rank_") - 1) % k).cast("int").alias(name))
    return df.join(place, "document_id")


def fractional(size: float, n: int) -> int:
    """A sample's size: a share of the n documents if it is under one, else itself."""
    return int(n * size) if size < 1 else int(size)


def draw(frame: DataFrame, size: float | None, seed: int, strategy: str = "random", by: Sequence[str] = (), others: Sequence[DataFrame] = (), fill: bool = True) -> DataFrame:
    """Document ids of one draw: ``size`` documents, or a share of the frame's, by the strategy ``all``, ``random`` or one of
    :func:`quotas`; not those that ``others`` (samples of the project) have; with ``fill`` the rest fills up to the size."""
    left = unsampled(frame, *others)
    if strategy == "all" or size is None:
        return left.select("document_id")
    n = fractional(size, frame.count())
    if strategy == "random":
        return simple(left.select("document_id"), n, seed)
    drawn = stratified(left.select("document_id", *by), by, n, seed, strategy).select("document_id")
    return fill_up(left.select("document_id"), drawn, n, seed) if fill else drawn


def train_test(df: DataFrame, test_percent: float, seed: int) -> DataFrame:
    """``is_test`` for exactly ceil(test_percent * n) rows; the rank is taken over ids and keys alone."""
    ids = df.select("document_id")
    n = ids.agg(F.ceil(F.count("*") * F.lit(test_percent) - 1e-9).cast("long").alias("n")).first()["n"]
    chosen = simple(ids, n, seed).withColumn("is_test", F.lit(True))
    return df.join(chosen, "document_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def approved(df: DataFrame, probability: float, seed: int) -> DataFrame:
    """Rows kept with a probability, by their id alone."""
    u = F.conv(F.substring(draw_key(seed), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    return df.where(u >= 1 - probability)
