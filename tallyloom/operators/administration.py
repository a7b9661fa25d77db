"""Commands and guarded saves as set operations: coders, frames, samples, HITs, topics, texts that change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lookups, models, sampling, topics, workflow


def create_coder(coders: DataFrame, name: str, is_crowd: bool = False) -> DataFrame:
    """``coders(coder_id, coder_name, coder_is_mturk)`` and one more, with the next id; a name that is there changes its kind and keeps its id."""
    known = coders.agg(F.coalesce(F.max("coder_id"), F.lit(0)).alias("last"), F.max(F.when(F.col("coder_name") == name, F.col("coder_id"))).alias("own"))
    kind = coders.schema["coder_id"].dataType
    new = known.select(F.coalesce("own", F.col("last") + 1).cast(kind).alias("coder_id"), F.lit(name).alias("coder_name"), F.lit(is_crowd).alias("coder_is_mturk"))
    return workflow.upsert(coders, new, ["coder_name"]).select(*coders.columns)


def extract_frame(documents: DataFrame, conditions: dict | None = None) -> DataFrame:
    """The ids of a sampling frame: documents that meet all lookups (see :func:`lookups.lookup`)."""
    kept = documents.where(lookups.holds(lookups.all_of(conditions))) if conditions else documents
    return kept.select("document_id").distinct()


def extract_sample(frame: DataFrame, size: float | None, seed: int, strategy: str = "random", by: Sequence[str] = (), others: Sequence[DataFrame] = ()) -> DataFrame:
    """Sample units of a frame, see :func:`sampling.draw`."""
    return sampling.draw(frame, size, seed, strategy, by, others)


def create_sample_hits(units: DataFrame, existing: DataFrame, sample_id: int, num_coders: int = 1) -> DataFrame:
    """HITs for the units of a sample that have none."""
    return workflow.create_hits(units.select("document_id", F.lit(sample_id).alias("sample_id")), existing, num_coders)


def train_classifier(rows: DataFrame, model: str = "logistic_regression", label: str = "label", balanced: bool = False, weight: str | None = None, **params):
    """A fitted pipeline; with ``balanced`` classes weigh alike, times ``weight`` if there is one."""
    if balanced:
        rows, weight = balanced_weights(rows, label, weight), "balanced_weight"
    return models.pipeline(model, weight=weight, **params).fit(rows)


def apply_classifier(model, frame: DataFrame, classified: DataFrame | None = None, refresh: bool = False) -> DataFrame:
    return models.apply_to_frame(model, frame, classified, refresh)


def train_topics(frame: DataFrame, num_topics: int, anchors: Sequence[Sequence[str]] = (), **params):
    return topics.train(frame, num_topics, anchors, **params)


def balanced_weights(rows: DataFrame, label: str = "label", weight: str | None = None, out: str = "balanced_weight") -> DataFrame:
    """``rows`` with a weight that makes all classes count alike: n / (classes * n of the class), times ``weight``.  Rows without a label get none."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class_")).agg(F.count("*").alias("n_"))
    totals = counts.agg(F.sum("n_").alias("all_"), F.count("*").alias("classes_"))
    factors = counts.join(F.broadcast(totals)).select("class_", (F.col("all_") / (F.col("classes_") * F.col("n_"))).alias("factor_"))
    made = F.col("factor_") * (F.col(weight) if weight else F.lit(1.0))
    return rows.join(factors, F.col(label) == F.col("class_"), "left").withColumn(out, made).drop("class_", "factor_")


def with_holdout(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Training rows and a separate data set for testing: ``is_test``, and row keys of which the latter's begin with ``test_``."""
    key = F.col("document_id").cast("string")
    own = train.withColumns({"row_key": key, "is_test": F.lit(False)})
    return own.unionByName(holdout.withColumns({"row_key": F.concat(F.lit("test_"), key), "is_test": F.lit(True)}))


def repeated_answers(classified: DataFrame, labels: DataFrame) -> DataFrame:
    """``document_id, question_id, n`` where a document has several classifications for one question: none may be stored so."""
    rows = classified.join(labels.select("label_id", "question_id"), "label_id")
    return rows.groupBy("document_id", "question_id").agg(F.countDistinct("label_id").alias("n")).where("n > 1")


def denormalised(codes: DataFrame, assignments: DataFrame, hits: DataFrame) -> DataFrame:
    """Codes with the keys of their assignment and HIT copied down, so that later reads need no join."""
    chain = assignments.select("assignment_id", "coder_id", "hit_id").join(hits.select("hit_id", "turk"), "hit_id", "left")
    return codes.drop("coder_id", "hit_id", "turk").join(chain, "assignment_id", "left")


def frozen(documents: DataFrame, which: Column, is_frozen: bool = True) -> DataFrame:
    """Documents of which those that ``which`` is true for are frozen, or thawed; ``is_frozen`` is false where it was not known."""
    known = F.coalesce(F.col("is_frozen"), F.lit(False)) if "is_frozen" in documents.columns else F.lit(False)
    return documents.withColumn("is_frozen", F.when(lookups.holds(which), F.lit(is_frozen)).otherwise(known))


def still_valid(derived: DataFrame, before: DataFrame, after: DataFrame, allowed: bool = False) -> DataFrame:
    """Derived rows (n-grams, topics, labels) whose document still has its text.  A frozen document keeps its old text, and
    with ``allowed`` changes invalidate nothing; null texts count as empty."""
    if allowed:
        return derived
    text = lambda df, name: df.select("document_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias(name))
    changed = text(before.where(~F.coalesce("is_frozen", F.lit(False))), "old").join(text(after, "new"), "document_id").where("old <> new")
    return derived.join(changed.select("document_id"), "document_id", "left_anti")


def edited_topics(topics_: DataFrame, edits: DataFrame) -> DataFrame:
    """``topics(topic, name, label, anchors)`` after edits of the same columns, in which ``anchors`` are text between commas."""
    new = edits.withColumn("anchors", T.anchors_list(F.col("anchors")))
    return workflow.upsert(topics_, new.select(*topics_.columns), ["topic"])


def guarded(kind: str, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` if each names a plug-in that there is; else a KeyError that lists the unknown names (the first hundred)."""
    from .. import registry

    unknown = rows.where(~F.coalesce(F.col(column).isin(registry.names(kind)), F.lit(False))).select(column).distinct().limit(100).collect()
    if unknown:
        raise KeyError(f"no {kind} named {sorted(str(r[0]) for r in unknown)}")
    return rows
