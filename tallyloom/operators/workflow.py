"""The coding workflow as set operations: HITs, responses, progress, disagreement, pay."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import writers
from .lookups import holds
from .sampling import draw_key


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not among the new, and all new rows."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Configured rows that do not exist yet."""
    return wanted.join(existing.select(*keys), keys, "left_anti")


def create_hits(units: DataFrame, existing: DataFrame, num_coders: int = 1) -> DataFrame:
    """A HIT for each sample unit that has none."""
    return missing(units.select("document_id", "sample_id").distinct(), existing, ["document_id", "sample_id"]).withColumn("num_coders", F.lit(num_coders))


def completed(assignment: DataFrame) -> DataFrame:
    """Completed and all assignments, and distinct coders, by HIT."""
    done = F.col("time_finished").isNotNull()
    return assignment.groupBy("hit_id").agg(
        F.count(F.when(done, 1)).alias("n_completed"), F.count("*").alias("n_assignments"), F.count(F.when(holds(F.col("uncodeable")), 1)).alias("n_uncodeable")
    )


def finished(hit: DataFrame, assignment: DataFrame) -> DataFrame:
    """HITs with ``finished``: as many completed assignments as coders asked for."""
    n = completed(assignment).select("hit_id", "n_completed")
    return hit.join(n, "hit_id", "left").withColumn("finished", F.coalesce("n_completed", F.lit(0)) >= F.col("num_coders")).drop("n_completed")


def progress(hit: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: total, finished, available and uncodeable HITs, assignments asked for and completed."""
    by_hit = hit.join(completed(assignment), "hit_id", "left")
    done = F.coalesce("n_completed", F.lit(0))
    return by_hit.agg(
        F.count("*").alias("total_hits"), F.count(F.when(done >= F.col("num_coders"), 1)).alias("completed_hits"),
        F.count(F.when(done < F.col("num_coders"), 1)).alias("available_hits"), F.count(F.when(F.col("n_uncodeable") > 0, 1)).alias("uncodeable_hits"),
        F.sum("num_coders").cast("long").alias("total_assignments"), F.sum(done).cast("long").alias("completed_assignments"),
    )


def coder_progress(assignment: DataFrame) -> DataFrame:
    done = F.count(F.when(F.col("time_finished").isNotNull(), 1))
    return assignment.groupBy("coder_id").agg(done.alias("n_completed"), F.countDistinct("hit_id").alias("n_hits"))


def classification_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("question_id", "label_id").agg(F.count("*").alias("n"))


def disagreements(codes: DataFrame) -> DataFrame:
    """HIT and question where experts that count gave different labels, with the first coder of each label."""
    experts = codes.where(~holds(F.col("coder_is_mturk")) & ~holds(F.col("consensus_ignore")))
    firsts = experts.groupBy("hit_id", "question_id", "label_id").agg(F.min("coder_id").alias("first_coder"))
    split = firsts.groupBy("hit_id", "question_id").agg(F.count("*").alias("n")).where("n > 1").select("hit_id", "question_id")
    return firsts.join(split, ["hit_id", "question_id"], "left_semi")


def adjudicated(codes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Codes with ``consensus_ignore`` set on those that differ from the decision of their HIT and question."""
    d = decisions.select("hit_id", "question_id", F.col("label_id").alias("decided"))
    out = codes.join(d, ["hit_id", "question_id"], "left")
    return out.withColumn("consensus_ignore", holds(F.col("consensus_ignore")) | holds(F.col("decided") != F.col("label_id"))).drop("decided")


def abandoned(assignment: DataFrame, codes: DataFrame) -> DataFrame:
    """Unfinished assignments without a code."""
    return assignment.where("time_finished is null").join(codes.select("assignment_id").distinct(), "assignment_id", "left_anti")


def next_hit(hit: DataFrame, assignment: DataFrame, coder_id: int, seed: int) -> DataFrame:
    """An unfinished HIT for experts that is not yet the coder's, in a shuffled order."""
    mine = assignment.where(F.col("coder_id") == coder_id).select("hit_id").distinct()
    free = finished(hit, assignment).where("not finished and not turk").join(mine, "hit_id", "left_anti")
    return free.orderBy(draw_key(seed, "hit_id"), "hit_id").limit(1)


def response_changes(old: Column, new: Column, multiple: bool) -> tuple[Column, Column]:
    """Labels to delete and labels to add when a response replaces another; a single choice keeps the first of the new ones."""
    wanted = new if multiple else F.slice(new, 1, 1)
    return F.array_except(old, wanted), F.array_except(wanted, old)


def annual_compensation(assignment: DataFrame, year: int, include_pending: bool = False) -> DataFrame:
    """Pay by worker of assignments approved in a year, or with ``include_pending`` submitted in it and not yet approved."""
    counts = F.year("approved_at") == year
    if include_pending:
        counts = holds(counts) | (F.col("approved_at").isNull() & (F.year("submitted_at") == year))
    return assignment.where(counts).groupBy("coder_id").agg(F.sum("reward").alias("compensation"))


def block_changes(compensation: DataFrame, blocked: DataFrame, max_comp: float) -> tuple[DataFrame, DataFrame]:
    """Workers to block (at or over the limit and not blocked) and blocks that no longer hold."""
    over = compensation.where(F.col("compensation") >= max_comp).select("coder_id")
    return over.join(blocked, "coder_id", "left_anti"), blocked.join(over, "coder_id", "left_anti").select("coder_id")


def blocks_by_reason(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("reason").agg(F.array_sort(F.collect_list("coder_id")).alias("coder_ids"))


def wide_export(codes: DataFrame, questions: list[str], notes: DataFrame | None = None) -> DataFrame:
    """One row per coder and document, a column for each question with its labels joined by commas, and notes."""
    answers = codes.groupBy("coder_name", "document_id", "question_name").agg(F.array_join(F.array_sort(F.collect_set("label_value")), ",").alias("value"))
    wide = answers.groupBy("coder_name", "document_id").agg(*(F.max(F.when(F.col("question_name") == q, F.col("value"))).alias(q) for q in questions))
    return wide.join(notes, ["coder_name", "document_id"], "left") if notes is not None else wide


def dependency_chain(labels: DataFrame, max_depth: int = 32) -> DataFrame:
    """``label, ancestor, depth`` of ``labels(label, parent)``: each label's parents up to the root."""
    step = labels.where("parent is not null").select("label", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    up, out = labels.select(F.col("label").alias("ancestor"), F.col("parent").alias("next")), step
    for depth in range(2, max_depth):
        step = step.join(up, "ancestor").where("next is not null").select("label", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        if step.isEmpty():
            return out
        out = out.union(step)
    raise ValueError(f"labels depend on each other over more than {max_depth} steps")


def preview(classified: DataFrame, label, n: int = 100) -> DataFrame:
    """The first ``n`` documents of a class, surest first."""
    return classified.where(F.col("label_id") == label).orderBy(F.desc("probability"), "document_id").limit(n)


def top_ngrams(ngrams: DataFrame, n: int = 20, least: float = 0.001) -> DataFrame:
    """By topic the ``n`` heaviest n-grams of a least weight, spaces as ``_``, joined by spaces."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "ngram")
    ranked = ngrams.where(F.col("weight") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    said = F.transform(F.array_sort(F.collect_list(F.struct("r", "ngram"))), lambda x: F.replace(x["ngram"], F.lit(" "), F.lit("_")))
    return ranked.groupBy("topic").agg(F.array_join(said, " ").alias("ngrams"))


def reconcile(remote: DataFrame, local: DataFrame, key: str = "turk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remote rows without a local one, local rows without a remote one, and both joined."""
    return remote.join(local.select(key), key, "left_anti"), local.join(remote.select(key), key, "left_anti"), remote.join(local, key)


def parse_answers(xml: Column) -> Column:
    """An array of (question, text) from an answer document; an empty answer is null."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<Answer>(.*?)</Answer>"), F.lit(1))
    pick = lambda b, tag: F.nullif(F.regexp_extract(b, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))
    return F.transform(blocks, lambda b: F.struct(pick(b, "QuestionIdentifier").alias("question"), F.coalesce(pick(b, "FreeText"), pick(b, "SelectionIdentifier")).alias("answer")))


def ordering(keys: Sequence[str]) -> list[Column]:
    """Sort keys by name, ``-`` before a name for descending order; nulls come last either way, as undated work does."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def placed(df: DataFrame, keys: Sequence[str] = ("time_finished",)) -> DataFrame:
    """``df`` in the order of the keys, with ``place`` from 1; the order should be total.

    Sorting deals rows by ranges and is written once; a row's place is its
    number in its range and the counts of the ranges before, so no task sees
    all rows.
    """
    spark = df.sparkSession
    path = f"{writers.shared_dir(spark)}/placed-{uuid.uuid4().hex}"
    numbered = df.sort(*ordering(keys)).withColumn("at_", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    rows = rows.withColumn("range_", F.shiftright("at_", 33)).withColumn("in_", F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("range_").agg(F.count("*").alias("n_"))
    before = counts.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    return rows.join(before, "range_").withColumn("place", F.col("before_") + F.col("in_") + 1).drop("at_", "range_", "in_", "before_")


def any_match(df: DataFrame, keys: Sequence[str], found: Column, name: str) -> DataFrame:
    """Whether any row of each key matches; rows that are neither right nor wrong do not."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(found), F.lit(False)).alias(name))
