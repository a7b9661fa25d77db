"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and
returns a frame; all but the last return the columns of ``documents``.  Null
texts count as empty; an empty table passes as an empty table; null ids pass
the deduplicating stages as they are.  Of rows that share a ``doc_id`` the
near-duplicate stage keeps one, that of the least text, so that later stages
see each id once; the stage before it treats each row by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import stored_alone, table
from tallyloom.llm.near_simhash import simhash_groups
from tallyloom.llm.packing import digest, pack_documents
from tallyloom.llm.para_dedup import dedup_passages
from tallyloom.llm.repeats import RUN_WORDS
from tallyloom.llm.pii import find_pii, redacted
from tallyloom.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    scored = score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id; of several rows of that id the one with the least text."""
    groups = simhash_groups(docs.select("doc_id", "text"))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct("text", "lang", "source", "n_chars")
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return kept.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which nothing is left go."""
    out = dedup_passages(docs.select(*COLUMNS), run_words=RUN_WORDS)
    cut = F.coalesce(F.size("cuts") > 0, F.lit(False))
    out = out.where(~(cut & (F.trim("text") == "")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each personal-data span replaced by its kind."""
    found = find_pii(docs.select(*COLUMNS))
    some = F.size("spans") > 0
    out = found.withColumn("text", F.when(some, redacted("text", "spans")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return digest(pack_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", cut_passages),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Hashes, models and tokenizers are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if held is not None:
            held.discard()
        docs, held = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
