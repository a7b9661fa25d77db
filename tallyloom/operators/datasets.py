"""Datasets of codes at label, coder and document grain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_COLUMNS = (
    "document_id", "coder_id", "coder_name", "coder_is_mturk", "label_id", "label_value", "question_id",
    "question_name", "hit_id", "sample_name", "text", "date", "consensus_ignore",
)


def raw_codes(code: DataFrame, coder: DataFrame, label: DataFrame, question: DataFrame, document: DataFrame) -> DataFrame:
    """Codes with coder, label, question and document, ``label_id`` an int and ``label_value`` a string."""
    small = label.join(question, "question_id")
    out = code.join(coder, "coder_id").join(small, "label_id").join(document, "document_id")
    return out.select(*(F.col(c) for c in RAW_COLUMNS)).withColumns({"label_id": F.col("label_id").cast("int"), "label_value": F.col("label_value").cast("string")})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; an index is unique if none has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def document_coder(codes: DataFrame, label_ids: Sequence[int], weight: str | None = None) -> DataFrame:
    """One row per document and coder, with a count for each label.  ``label_ids`` fixes the columns, whatever the data have."""
    counts = [F.sum(F.when(F.col("label_id") == i, 1).otherwise(0)).cast("double").alias(f"label_{i}") for i in label_ids]
    extra = [F.avg(weight).alias(weight)] if weight else []
    return codes.groupBy("document_id", "coder_id").agg(*counts, F.min("coder_name").alias("coder_name"), F.max("coder_is_mturk").alias("coder_is_mturk"), *extra)


def bit_strings(codes: DataFrame, label_ids: Sequence[int]) -> DataFrame:
    """One row per document and coder; ``label_id`` has a bit for each label of all questions, in the order of their ids."""
    bits = [F.max(F.when(F.col("label_id") == i, 1).otherwise(0)).cast("string") for i in sorted(label_ids)]
    return codes.groupBy("document_id", "coder_id").agg(F.concat_ws("", *bits).alias("label_id"))


_AGGREGATES = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}


def document_aggregate(by_coder: DataFrame, how: str, labels: Sequence[str], weight: str | None = None) -> DataFrame:
    """Coders of each document aggregated by mean, median, max or min; a weight by its mean."""
    if how not in _AGGREGATES:
        raise ValueError(f"unknown aggregation {how!r}; one of {sorted(_AGGREGATES)}")
    extra = [F.avg(weight).alias(weight)] if weight else []
    return by_coder.groupBy("document_id").agg(*(_AGGREGATES[how](c).alias(c) for c in labels), *extra)


def discrete_label(labels: Sequence[str], base: str | None = None, threshold: float | None = None) -> Column:
    """The winning label's id as a string.

    The base column competes only if there is no other; ties go to the first
    column.  A threshold that is 0 or none only asks for more than 0.  Where
    the winner falls short the base wins, or nothing.
    """
    base_column = f"label_{base}" if base is not None else None
    running = [c for c in labels if c != base_column] or list(labels)
    top = F.greatest(*running) if len(running) > 1 else F.col(running[0])
    winner = reduce(lambda else_, c: F.when(F.col(c) == top, F.lit(c.rpartition("_")[2])).otherwise(else_), reversed(running), F.lit(None).cast("string"))
    enough = (top >= threshold) if threshold else (top > 0)
    return F.when(enough, winner).otherwise(F.lit(base).cast("string"))


def standardize(by_coder: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Labels as z-scores within each coder, by the sample deviation; null where that is zero or unknown."""
    moments = [f(c).alias(f"{name}_{c}") for c in labels for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    by = by_coder.groupBy(F.col("coder_id").alias("coder_")).agg(*moments)
    scores = {c: (F.col(c) - F.col(f"mean_{c}")) / F.nullif(F.col(f"std_{c}"), F.lit(0.0)) for c in labels}
    return by_coder.join(by, F.col("coder_id").eqNullSafe(F.col("coder_"))).withColumns(scores).select(*by_coder.columns)


def with_documents(df: DataFrame, document: DataFrame, columns: Sequence[str] = ("text", "date", "document_type")) -> DataFrame:
    """Document columns joined from the left; a column that is already there stays."""
    new = [c for c in columns if c not in df.columns]
    return df.join(document.select("document_id", *new), "document_id", "left")


def mode(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The commonest value by key; ties go to the least."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("top")
    return counts.groupBy(*keys).agg(first).select(*keys, F.col("top.v").alias(column))


def document_type(document: DataFrame, parents: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The first parent table, in the order given, that has each document; null if none."""
    out = document
    for name, parent in parents:
        out = out.join(parent.select("document_id").distinct().withColumn(f"in_{name}", F.lit(True)), "document_id", "left")
    kind = F.coalesce(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n, _ in parents))
    return out.withColumn("document_type", kind).drop(*(f"in_{n}" for n, _ in parents))
