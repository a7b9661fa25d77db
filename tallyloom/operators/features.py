"""Text features: term weights, lexicon counts, vector statistics, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(text: Column, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Lower-cased words of two characters or more, and their n-grams joined by spaces."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    low, high = ngram_range
    if (low, high) == (1, 1):
        return words

    def grams(w: Column) -> Column:
        parts = [w] if low == 1 else []
        for n in range(max(2, low), high + 1):
            last = F.greatest(F.size(w) - (n - 1), F.lit(0))
            runs = [F.slice(w, F.lit(k + 1), last) for k in range(n)]
            parts.append(F.transform(F.arrays_zip(*runs), lambda z: F.concat_ws(" ", *(z[str(k)] for k in range(n)))))  # noqa: B023
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return T._bound(words, grams)


#: Partitions over which the rows of one term are dealt when terms are joined.
SPREAD = 16


def tfidf(
    docs: DataFrame, text: str = "text", ngram_range: tuple[int, int] = (1, 1), min_df: int = 1, max_df: float = 1.0,
    max_features: int | None = None, use_idf: bool = True, sublinear_tf: bool = False, binary: bool = False, norm: bool = True,
) -> DataFrame:
    """``document_id, term, weight`` in long form.

    idf is ln((1 + n) / (1 + df)) + 1; rows have unit length; ``max_df`` is a
    share of the documents, ``max_features`` keeps the terms of most occurrences.
    """
    counts = docs.select("document_id", F.explode(tokens(F.col(text), ngram_range)).alias("term")).groupBy("document_id", "term").agg(F.count("*").cast("double").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).join(F.broadcast(n)).where(F.col("df") <= F.col("n") * max_df)
    if max_features:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    tf = F.lit(1.0) if binary else (1 + F.log("tf") if sublinear_tf else F.col("tf"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)
    # The commonest terms are in almost every document, so their rows are dealt over several partitions.
    salt = F.pmod(F.xxhash64("document_id"), F.lit(SPREAD))
    spread = terms.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    weighted = counts.withColumn("salt_", salt).join(spread, ["term", "salt_"]).select("document_id", "term", (tf * idf).alias("weight"))
    if not norm:
        return weighted
    length = weighted.groupBy("document_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    return weighted.join(length, "document_id").select("document_id", "term", (F.col("weight") / F.col("length")).alias("weight"))


def regex_counts(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    return docs.select("document_id", *(c for name, p in patterns.items() for c in T.regex_features(F.col(text), p, name)))


def ngram_sets(docs: DataFrame, categories: dict[str, Sequence[str]], text: str = "text", include_words: bool = False) -> DataFrame:
    """Matches of each lexicon category, and with ``include_words`` of each of its words."""
    columns = [T.ngram_count(F.col(text), words).alias(f"ngram__{name}") for name, words in categories.items()]
    if include_words:
        columns += [T.ngram_count(F.col(text), [w]).alias(f"ngram__{name}__{w}") for name, words in categories.items() for w in words]
    return docs.select("document_id", *columns)


def lexicon_shares(docs: DataFrame, categories: dict[str, Sequence[str]], text: str = "text") -> DataFrame:
    """``document_id, ngram_set, count, percent`` of words, in long form."""
    n = F.size(T.words_of(F.col(text)))
    sets = F.array(*(F.struct(F.lit(k).alias("ngram_set"), T.ngram_count(F.col(text), w).alias("count")) for k, w in categories.items()))
    rows = docs.select("document_id", n.alias("n"), F.explode(sets).alias("s"))
    return rows.select("document_id", "s.ngram_set", "s.count", F.coalesce(F.try_divide(F.col("s.count"), F.col("n")), F.lit(0.0)).alias("percent"))


def punctuation(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("document_id", *T.punctuation_indicators(F.col(text)))


def word_categories(lexicon: DataFrame) -> DataFrame:
    """``word, categories`` from ``category, words``."""
    return lexicon.select(F.explode("words").alias("word"), "category").groupBy("word").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def vector_stats(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """mean, max, min, sample deviation and median of each dimension by key, in long form.

    Groups may be of any size: a sketch tells between which values the median
    lies, and only the rows in between, a fiftieth of a group, are ranked.  The
    median is exact.  NaN counts as the largest value; nulls take no part.
    """
    x = vectors.select(F.col(key).alias("key_"), F.posexplode(vector).alias("dim", "x")).select("key_", "dim", F.col("x").cast("double").alias("x")).where("x is not null")
    near = F.percentile_approx("x", [0.49, 0.51], 2000)
    moments = x.groupBy("key_", "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_samp("x").alias("std"), F.count("x").alias("n"), near.alias("near"))
    same = F.col("key_").eqNullSafe(F.col("k2")) & (F.col("dim") == F.col("d2"))
    band = x.join(moments.select(F.col("key_").alias("k2"), F.col("dim").alias("d2"), "n", F.col("near")[0].alias("low"), F.col("near")[1].alias("high")), same)
    below = band.groupBy("key_", "dim").agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.first("n").alias("n"))
    inside = band.where("x >= low and x <= high").select("key_", "dim", "x")
    place = F.row_number().over(Window.partitionBy("key_", "dim").orderBy("x"))
    k2, d2 = F.col("key_").alias("k2"), F.col("dim").alias("d2")
    placed = inside.withColumn("place", place).join(below.select(k2, d2, "below", "n"), same).withColumn("place", F.col("place") + F.col("below"))
    middle = placed.where("place in (floor((n + 1) / 2), floor((n + 2) / 2))").groupBy("key_", "dim").agg(F.avg("x").alias("median"))
    out = moments.drop("n", "near").join(middle.select(k2, d2, "median"), same)
    return out.select(F.col("key_").alias(key), "dim", "mean", "max", "min", "std", "median")


def small_vector_stats(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """:func:`vector_stats` of groups that fit a task, in one step."""
    x = vectors.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(key, "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_samp("x").alias("std"), F.median("x").alias("median"))


def word_vector_features(docs: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """Statistics of the vectors of a document's words and bigrams that ``vectors(word, embedding)`` has."""
    words = docs.select("document_id", F.explode(T.words_and_bigrams(F.col(text))).alias("word"))
    return small_vector_stats(words.join(vectors, "word"), "document_id")


def topic_features(docs: DataFrame, document_topic: DataFrame, names: dict[int, str]) -> DataFrame:
    """``topic_<name>`` for each named topic, 0 where a document has no row."""
    columns = [F.max(F.when(F.col("topic") == k, F.col("value"))).alias(f"topic_{name}") for k, name in names.items() if name]
    wide = document_topic.groupBy("document_id").agg(*columns)
    return docs.select("document_id").join(wide, "document_id", "left").na.fill(0)


def field_lookups(docs: DataFrame, fields: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metadata joined by document, as doubles."""
    joined = docs.select("document_id").join(fields.select("document_id", *columns), "document_id", "left")
    return joined.withColumns({c: F.col(c).try_cast("double") for c in columns})
