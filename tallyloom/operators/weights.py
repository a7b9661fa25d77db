"""Sampling, balancing and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strata(frame: DataFrame, sample: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and shares of each stratum in frame and sample, 0 where it is missing."""
    f = frame.groupBy(*by).agg(F.count("*").alias("frame_count"))
    s = sample.groupBy(*by).agg(F.count("*").alias("sample_count"))
    both = f.join(s, list(by), "full_outer").na.fill(0, ["frame_count", "sample_count"])
    totals = both.agg(F.sum("frame_count").alias("frame_total"), F.sum("sample_count").alias("sample_total"))
    both = both.join(F.broadcast(totals))
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return both.select(*by, "frame_count", "sample_count", share("frame_count", "frame_total").alias("frame_pct"), share("sample_count", "sample_total").alias("sample_pct"))


def poststratification(frame: DataFrame, sample: DataFrame, by: Sequence[str], name: str = "weight") -> DataFrame:
    """``sample`` with the weight (frame share) / (sample share) of its joint stratum; 1 without variables."""
    if not by:
        return sample.withColumn(name, F.lit(1.0))
    known = strata(frame, sample, by).where("sample_count > 0").select(*by, (F.col("frame_pct") / F.col("sample_pct")).alias(name))
    return sample.join(known, list(by), "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def combined(frame: DataFrame, sample: DataFrame, keyword: Sequence[str], stratified: Sequence[str], additional: Sequence[str]) -> DataFrame:
    """Keyword, strata and additional weights (null where unused), their product, and the joint weight."""
    out = sample
    for name, by in (("keyword_weight", keyword), ("strat_weight", stratified), ("additional_weight", additional)):
        out = poststratification(frame, out, by, name) if by else out.withColumn(name, F.lit(None).cast("double"))
    product = F.coalesce("keyword_weight", F.lit(1.0)) * F.coalesce("strat_weight", F.lit(1.0)) * F.coalesce("additional_weight", F.lit(1.0))
    out = out.withColumn("approx_weight", product)
    return poststratification(frame, out, [*keyword, *stratified, *additional], "weight")


def balancing(df: DataFrame, by: Sequence[str], name: str = "balancing_weight") -> DataFrame:
    """n / (K n_g) for the K joint groups, so that each weighs alike; 1 where a variable is null."""
    known = [F.col(c).isNotNull() for c in by]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    groups = df.where(whole).groupBy(*by).agg(F.count("*").alias("n_g"))
    totals = groups.agg(F.sum("n_g").alias("total"), F.count("*").alias("groups"))
    factor = groups.join(F.broadcast(totals)).select(*by, (F.col("total") / (F.col("groups") * F.col("n_g"))).alias(name))
    return df.join(factor, list(by), "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def class_balanced(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Weights scaled so that each class has the same total, that of all not changing."""
    sums = df.groupBy(label).agg(F.sum(weight).alias("w_c"))
    totals = sums.agg(F.sum("w_c").alias("w"), F.count("*").alias("k"))
    factor = sums.join(F.broadcast(totals)).select(label, (F.col("w") / F.col("k") / F.col("w_c")).alias("factor"))
    return df.join(factor, label).withColumn(weight, F.col(weight) * F.col("factor")).drop("factor")


def training_weight(sampling: str | None = None, balancing: str | None = None) -> Column:
    """The product of the weights in use, before classes are balanced."""
    out = F.lit(1.0)
    for c in (sampling, balancing):
        if c:
            out = out * F.coalesce(F.col(c), F.lit(1.0))
    return out


def weighted_moments(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: weighted mean, its error from weights alone and from residuals, and the weighted deviation."""
    m = df.agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("total"))
    out = df.join(F.broadcast(m)).groupBy("mean", "total").agg(
        F.sum(F.col(weight) ** 2 * (F.col(value) - F.col("mean")) ** 2).alias("r2"),
        F.sum(F.col(weight) * (F.col(value) - F.col("mean")) ** 2).alias("r1"),
    )
    return out.select("mean", (1 / F.sqrt("total")).alias("error"), (F.sqrt("r2") / F.col("total")).alias("calculated_error"), F.sqrt(F.col("r1") / F.col("total")).alias("sdev"))
