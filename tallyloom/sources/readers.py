"""Sources: delimited files, lexicons, configurations, word vectors, landed API pages."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from delimited text with a header; the schema is given, so nothing is read to infer it."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def lexicon_tsv(spark: SparkSession, path: str, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``category, label, words`` from lines of word, category and 0 or 1, of those with 1; ``extra`` adds words by category."""
    rows = spark.read.csv(path, sep="\t", schema="word string, category string, assoc int").where("assoc = 1").select("category", "word")
    for category, words in (extra or {}).items():
        rows = rows.union(spark.range(1).select(F.lit(category), F.explode(F.array(*map(F.lit, words)))))
    return rows.groupBy("category").agg(F.array_sort(F.collect_set("word")).alias("words")).select("category", F.initcap("category").alias("label"), "words")


def lexicon_dic(spark: SparkSession, path: str, labels: dict | None = None) -> DataFrame:
    """``category, label, words`` from a two-part dictionary file: ``%``, lines of id and name, ``%``, lines of word and ids.

    A category line starts with a number and a word line does not, so parts
    need no line order.  ``labels`` is a nested dictionary that says where a
    category stands; without a place its name is its label.
    """
    from ..functions.text import breadcrumb

    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("size(p) > 1")
    names = parts.where(F.col("p")[0].rlike(r"^\d+$")).select(F.col("p")[0].alias("id"), F.col("p")[1].alias("category"))
    words = parts.where(~F.col("p")[0].rlike(r"^\d+$")).select(F.col("p")[0].alias("word"), F.explode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("id"))
    grouped = words.join(F.broadcast(names), "id").groupBy("category").agg(F.array_sort(F.collect_set("word")).alias("words"))
    places = {c: breadcrumb(labels or {}, c) or c for c in (r["category"] for r in names.select("category").distinct().collect())}
    label = F.create_map(*(F.lit(x) for kv in places.items() for x in kv)) if places else F.create_map(F.lit(""), F.lit(""))
    return grouped.select("category", label[F.col("category")].alias("label"), "words")


def configurations(spark: SparkSession, path: str) -> dict[str, dict]:
    """JSON configurations below a folder by name; folders between become prefixes (``folder_name``)."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), "value").collect()
    root = path.rstrip("/").rpartition("/")[2]
    out = {}
    for r in rows:
        below = r["file"].split(f"/{root}/", 1)[-1].removesuffix(".json")
        out[below.replace("/", "_")] = json.loads(r["value"])
    return out


def project_tables(config: dict) -> tuple[list[tuple], list[tuple]]:
    """Question rows (name, display, prompt, priority) and label rows (question, value, label, priority, select_as_default, pointers)."""
    questions, labels = [], []
    for i, q in enumerate(config.get("questions", [])):
        questions.append((q["name"], q.get("display"), q.get("prompt"), i))
        found = q.get("labels", [])
        labels += [(q["name"], str(x["value"]), x.get("label"), len(found) - k, bool(x.get("select_as_default", False)), list(x.get("pointers", []))) for k, x in enumerate(found)]
    return questions, labels


def synced_labels(existing: DataFrame, config: DataFrame, display: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels to add and labels to delete so that a project matches its configuration; those of number questions stay."""
    keys = ["question", "value"]
    fixed = display.where("display <> 'number' or display is null").select(F.col("name").alias("question"))
    return config.join(existing.select(*keys), keys, "left_anti"), existing.join(config.select(*keys), keys, "left_anti").join(fixed, "question", "left_semi")


def word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``word, embedding`` from Parquet; the first ``limit`` by their rank."""
    df = spark.read.parquet(path)
    return df.orderBy("rank").limit(limit).select("word", "embedding") if limit else df.select("word", "embedding")


def landed_pages(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Items of API pages that were landed as JSON, a file a page, under ``key``."""
    pages = spark.read.json(path, schema=f"{key} array<{schema}>", multiLine=True)
    return pages.select(F.explode(key).alias("item")).select("item.*")


def named_sets(spark: SparkSession, sets: dict[str, Iterable[str]]) -> DataFrame:
    """``category, words`` from a dictionary."""
    return spark.createDataFrame([(k, sorted(set(v))) for k, v in sets.items()], "category string, words array<string>")
