"""Filters of code, coder and document datasets, and of the coding workflow.

All take and return DataFrames.  Group conditions are one partial aggregate
and a semi-join, so they shuffle small keyed rows and never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookups import holds


def _keys(df: DataFrame, values: Iterable | DataFrame, column: str) -> DataFrame:
    """Semi-join with a frame of keys, or a membership test for a literal list."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(values)))


def by_document_ids(df: DataFrame, document_ids: Iterable | DataFrame) -> DataFrame:
    return _keys(df, document_ids, "document_id")


def by_date(df: DataFrame, min_date=None, max_date=None, column: str = "date") -> DataFrame:
    """Dates from ``min_date`` to ``max_date``, both included; an empty bound is open."""
    day = F.to_date(F.col(column))
    if min_date:
        df = df.where(day >= F.lit(min_date).cast("date"))
    if max_date:
        df = df.where(day <= F.lit(max_date).cast("date"))
    return df


def by_other_dataset(df: DataFrame, other: DataFrame, value, outcome: str = "label_id") -> DataFrame:
    """Documents that another dataset (training labels or predictions) gives ``value``."""
    return by_document_ids(df, other.where(F.col(outcome) == value))


def excluding_coders(df: DataFrame, coder_names: Iterable[str]) -> DataFrame:
    return df.where(~holds(F.col("coder_name").isin(list(coder_names))))


def only_coders(df: DataFrame, coder_names: Iterable[str]) -> DataFrame:
    return df.where(F.col("coder_name").isin(list(coder_names)))


def excluding_experts(df: DataFrame) -> DataFrame:
    return df.where(F.col("coder_is_mturk"))


def excluding_crowd(df: DataFrame) -> DataFrame:
    return df.where(~F.col("coder_is_mturk"))


def coders_with_documents(df: DataFrame, min_docs: int = 10) -> DataFrame:
    """Coders with more than ``min_docs`` distinct documents (strictly more)."""
    keep = df.groupBy("coder_id").agg(F.countDistinct("document_id").alias("n")).where(F.col("n") > min_docs)
    return df.join(keep.select("coder_id"), "coder_id", "left_semi")


def coded_by_all(df: DataFrame) -> DataFrame:
    """Documents with as many distinct coders as the document with most has."""
    counts = df.groupBy("document_id").agg(F.countDistinct("coder_id").alias("n"))
    most = counts.agg(F.max("n").alias("n"))
    return df.join(counts.join(F.broadcast(most), "n").select("document_id"), "document_id", "left_semi")


def coded_at_least(df: DataFrame, min_count: int) -> DataFrame:
    """Documents with ``min_count`` rows that name a coder; a coder's several rows count each."""
    keep = df.groupBy("document_id").agg(F.count("coder_id").alias("n")).where(F.col("n") >= min_count)
    return df.join(keep.select("document_id"), "document_id", "left_semi")


def excluding_consensus_ignored(df: DataFrame) -> DataFrame:
    return df.where(~holds(F.col("consensus_ignore")))


def apply_chain(df: DataFrame, *filters: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Code, then coder, then document filters, each list in its order."""
    return reduce(DataFrame.transform, (f for group in filters for f in group), df)


def hits(
    hit: DataFrame,
    assignment: DataFrame | None = None,
    turk_only: bool = False,
    experts_only: bool = False,
    finished_only: bool = False,
    unfinished_only: bool = False,
    assignments: DataFrame | None = None,
    documents: DataFrame | None = None,
    exclude_coders: Iterable | None = None,
    filter_coders: Iterable | None = None,
) -> DataFrame:
    """HITs that meet every condition given; a HIT goes if any assignment is by an excluded coder.

    ``turk_only`` beats ``experts_only`` and ``finished_only`` beats ``unfinished_only``.
    """
    if turk_only:
        hit = hit.where("turk")
    elif experts_only:
        hit = hit.where(~holds(F.col("turk")))
    if finished_only:
        hit = hit.where("finished")
    elif unfinished_only:
        hit = hit.where(~holds(F.col("finished")))
    if documents is not None:
        hit = hit.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    if assignments is not None:
        hit = hit.join(assignments.select("hit_id").distinct(), "hit_id", "left_semi")
    if filter_coders is not None:
        hit = hit.join(assignment.where(F.col("coder_id").isin(list(filter_coders))), "hit_id", "left_semi")
    if exclude_coders is not None:
        hit = hit.join(assignment.where(F.col("coder_id").isin(list(exclude_coders))), "hit_id", "left_anti")
    return hit.distinct()


def assignments(
    assignment: DataFrame,
    hit: DataFrame | None = None,
    completed_only: bool = False,
    incomplete_only: bool = False,
    uncodeable: bool | None = None,
    turk_only: bool = False,
    experts_only: bool = False,
    filter_coders: Iterable | None = None,
    exclude_coders: Iterable | None = None,
    coder_min_hit_count: int | None = None,
) -> DataFrame:
    """Assignments that meet every condition given; completed is having a ``time_finished``. Only ``None`` leaves ``uncodeable`` open."""
    out = assignment
    if hit is not None and (turk_only or experts_only):
        out = out.join(hits(hit, turk_only=turk_only, experts_only=experts_only), "hit_id", "left_semi")
    if completed_only:
        out = out.where("time_finished is not null")
    elif incomplete_only:
        out = out.where("time_finished is null")
    if uncodeable is not None:
        out = out.where(holds(F.col("uncodeable")) == F.lit(uncodeable))
    if filter_coders is not None:
        out = out.where(F.col("coder_id").isin(list(filter_coders)))
    if exclude_coders is not None:
        out = out.where(~holds(F.col("coder_id").isin(list(exclude_coders))))
    if coder_min_hit_count:
        out = out.join(coders(assignment, coder_min_hit_count), "coder_id", "left_semi")
    return out.distinct()


def coders(assignment: DataFrame, min_hit_count: int = 0) -> DataFrame:
    """``coder_id, n_completed`` of coders with ``min_hit_count`` completed assignments or more, in one aggregate."""
    done = F.count(F.when(F.col("time_finished").isNotNull(), 1)).alias("n_completed")
    return assignment.groupBy("coder_id").agg(done).where(F.col("n_completed") >= min_hit_count)


def valid_weights(df: DataFrame, weight: str) -> DataFrame:
    """One row, ``valid``: whether weights vary or the only one is not 1."""
    n = F.countDistinct(weight)
    return df.agg(((n > 1) | ((n == 1) & (F.max(weight) != 1.0))).alias("valid"))


def qualified_coders(passed: DataFrame, tests: Iterable[str]) -> DataFrame:
    """Coders with a finished, passed assignment of every test in ``passed(coder_id, test, time_finished, passed)``."""
    wanted = sorted(set(tests))
    good = passed.where(F.col("test").isin(wanted) & F.col("time_finished").isNotNull() & F.col("passed"))
    return good.groupBy("coder_id").agg(F.countDistinct("test").alias("n")).where(F.col("n") == len(wanted)).select("coder_id")
