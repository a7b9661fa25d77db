"""Classifiers: estimators by name, folds, cross-validation, prediction, application."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizer, Imputer, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import writers
from . import agreement, nearest


def term_stages(text: str = "text", ngrams: int = 1, min_df: float = 1.0, max_features: int = 1 << 14, out: str = "features") -> list:
    """Words (and n-grams) counted over a learnt vocabulary, smoothed idf, rows of unit length."""
    stages: list = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False)]
    columns = ["_words"]
    for n in range(2, ngrams + 1):
        stages.append(NGram(n=n, inputCol="_words", outputCol=f"_grams{n}"))
        columns.append(f"_grams{n}")
    if len(columns) > 1:
        stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(columns)}) AS _terms FROM __THIS__"))
    stages.append(CountVectorizer(inputCol="_terms" if len(columns) > 1 else "_words", outputCol="_counts", minDF=min_df, vocabSize=max_features))
    return [*stages, SmoothedIdf(inputCol="_counts", outputCol="_tfidf"), Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)]


class SmoothedIdf(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Counts times ln((1 + n) / (1 + df)) + 1, as a pipeline of Spark's own idf with one added for each term."""

    def __init__(self, inputCol: str = "_counts", outputCol: str = "_tfidf"):
        super().__init__()
        self.input, self.output = inputCol, outputCol

    def _fit(self, dataset: DataFrame) -> Model:
        from pyspark.ml.feature import IDF, ElementwiseProduct
        from pyspark.ml.linalg import Vectors

        fitted = IDF(inputCol=self.input, outputCol=self.output).fit(dataset)
        scale = Vectors.dense((fitted.idf.toArray() + 1.0).tolist())
        return ElementwiseProduct(scalingVec=scale, inputCol=self.input, outputCol=self.output)


class FourierFeatures(Transformer, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht, 2007), each from its own seed, by numpy in Arrow batches."""

    def __init__(self, inputCol: str = "features", outputCol: str = "rbf", size: int = 256, gamma: float = 1.0, seed: int = 5):
        super().__init__()
        self.input, self.output, self.size, self.gamma, self.seed = inputCol, outputCol, size, gamma, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = self.size, self.gamma, self.seed

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            rng = np.random.default_rng(seed)
            w, b = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(x @ w + b)))

        return dataset.withColumn(self.output, array_to_vector(mapped(vector_to_array(self.input))))


def classifier(name: str, binary: bool = True, weight: str | None = None, features: str = "features", label: str = "label", **params):
    """An estimator by name; those that only tell two classes apart are wrapped one-vs-rest for more."""
    common = {"featuresCol": features, "labelCol": label} | ({"weightCol": weight} if weight else {})
    made = {
        "decision_tree": lambda: DecisionTreeClassifier(impurity="gini", **common, **params),
        "random_forest": lambda: RandomForestClassifier(seed=42, **common, **params),
        "gradient_boosting": lambda: GBTClassifier(maxIter=params.pop("maxIter", 20), seed=42, **common, **params),
        "xgboost": lambda: GBTClassifier(maxDepth=params.pop("maxDepth", 6), maxIter=params.pop("maxIter", 150), seed=42, **common, **params),
        "linear_svc": lambda: LinearSVC(maxIter=params.pop("maxIter", 1000), **common, **params),
        "svc": lambda: LinearSVC(**common, **params),
        "sgd": lambda: LinearSVC(maxIter=params.pop("maxIter", 50), regParam=params.pop("regParam", 1e-4), **common, **params),
        "multinomial_nb": lambda: NaiveBayes(modelType="multinomial", **common, **params),
        "logistic_regression": lambda: LogisticRegression(**common, **params),
    }
    if name not in made:
        raise ValueError(f"unknown model {name!r}; one of {sorted(made)} or k_neighbors")
    estimator = made[name]()
    two_only = name in ("gradient_boosting", "xgboost", "linear_svc", "svc", "sgd")
    return estimator if binary or not two_only else OneVsRest(classifier=estimator, featuresCol=features, labelCol=label, **({"weightCol": weight} if weight else {}))


def pipeline(model: str = "logistic_regression", text: str = "text", rbf: bool = False, numeric: Sequence[str] = (), **params) -> Pipeline:
    """Term features, numeric features with medians for missing ones, and a classifier."""
    terms = {k: params.pop(k) for k in ("ngrams", "min_df", "max_features") if k in params}
    stages = term_stages(text, out="_terms_out" if numeric else "features", **terms)
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled), VectorAssembler(inputCols=["_terms_out", *filled], outputCol="features")]
    if rbf:
        stages.append(FourierFeatures())
    return Pipeline(stages=[*stages, classifier(model, features="rbf" if rbf else "features", **params)])


def stored(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """The frame, read from a table in the shared folder, and that table's path."""
    path = f"{writers.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`stored`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: How Parquet holds a vector: reading it so takes no conversion, and zeros stay out.
_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"

_FOUND = "document_id long, index array<int>, value array<double>, score array<double>, near array<long>, label array<double>"

#: Entries of the training rows of one block, 12 bytes each.
BLOCK_ENTRIES = 1 << 22


def _sparse(df: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """``columns, size, index, value`` of ``features``, dense ones too, and the table that holds them."""
    kept, path = stored(df.select(F.col("document_id").cast("long").alias("document_id"), *columns, "features"), "vectors")
    schema = ", ".join(f"{c} {t}" for c, t in kept.dtypes[:-1])
    rows = df.sparkSession.read.schema(f"{schema}, features {_VECTOR}").parquet(path)
    value = F.coalesce("features.values", F.array().cast("array<double>"))
    every = F.when(F.size(value) > 0, F.sequence(F.lit(0), F.size(value) - 1)).otherwise(F.array().cast("array<int>"))
    width = F.coalesce(F.col("features.size"), F.size(value))
    return rows.select("document_id", *columns, width.alias("size"), F.coalesce("features.indices", every).alias("index"), value.alias("value")), path


def neighbours(train: DataFrame, test: DataFrame, k: int = 5, block: int = 512, train_limit: int = 20_000) -> DataFrame:
    """``document_id, prediction, probability`` by the k nearest of the training rows (cosine of unit vectors).

    Training rows meet all test rows in blocks of about ``train_limit`` rows
    and ``BLOCK_ENTRIES`` entries; the driver holds one block, sparse.  Each
    round keeps the k best so far of each test row, and those of the last
    vote.  ``block`` test rows are looked at together.  Ties go to the smaller
    document id, so of equal training rows the first k are all that can count.
    """
    spark = train.sparkSession
    rows, raw = _sparse(train.withColumn("label", F.col("label").cast("double")), "label")
    first = Window.partitionBy("index", "value").orderBy("document_id", "label")
    rows, rows_path = stored(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k).drop("copy"), "vectors")
    discarded(spark, raw)
    n, entries, width = rows.agg(F.count("*"), F.sum(F.size("index")), F.max("size")).first()
    if not n:
        raise ValueError("no training rows")
    blocks = max(-(-n // train_limit), -(-entries // BLOCK_ENTRIES))
    parts = rows.withColumn("block", F.pmod(F.xxhash64("document_id"), F.lit(blocks)))
    if blocks > 1:
        # In order of blocks, so that reading one passes over the others.
        parts, by_block = stored(parts.repartition("block").sortWithinPartitions("block"), "vectors")
        discarded(spark, rows_path)
        rows_path = by_block
    asked, path = _sparse(test)
    count, widest = asked.agg(F.count("*"), F.max("size")).first()
    width = max(width, widest or 0)
    none = (F.array().cast(t).alias(c) for c, t in (("score", "array<double>"), ("near", "array<long>"), ("label", "array<double>")))
    asked = asked.select("document_id", "index", "value", *none).repartition(-(-count // 2048) or 1)
    for number in range(blocks):
        mine = parts.where(F.col("block") == number).select("document_id", "label", "index", "value").toArrow()
        if not len(mine):
            continue
        made = nearest.block_of(nearest.sparse(mine["index"], mine["value"]), mine["document_id"].to_numpy(), mine["label"].to_numpy(), width)
        del mine
        sent = spark.sparkContext.broadcast(made)
        del made

        def run(batches, sent=sent):
            for b in batches:
                document, index, value, *found = b.columns
                best = nearest.Best.read(*found, k)
                nearest.look(nearest.sparse(index, value), best, sent.value, block)
                yield pa.RecordBatch.from_arrays([document, index, value, *best.lists()], names=b.schema.names)

        # Stored before the next block is collected, so that one block at a time is held.
        asked, into = stored(asked.mapInArrow(run, _FOUND), "neighbours")
        sent.destroy()
        discarded(spark, path)
        path = into
    discarded(spark, rows_path)
    votes = F.transform(F.array_distinct("label"), lambda x: F.struct(F.size(F.filter("label", lambda y: y == x)).alias("n"), (-x).alias("less")))
    top = asked.select("document_id", F.size("label").alias("n"), F.array_max(votes).alias("top"))
    return top.select("document_id", (-F.col("top.less")).alias("prediction"), (F.col("top.n") / F.col("n")).alias("probability"))


def predicted(model: Transformer, df: DataFrame, keep: Sequence[str] = ("document_id",)) -> DataFrame:
    """``keep``, prediction and the probability of the predicted class, where the model has one."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.select(*keep, "prediction", F.array_max(vector_to_array("probability")).alias("probability"))
    return out.select(*keep, "prediction", F.lit(None).cast("double").alias("probability"))


def cross_validated(df: DataFrame, estimator: Estimator, folds: int, keep: Sequence[str] = ("document_id", "label"), fold: str = "fold") -> DataFrame:
    """Predictions of each row by the model that did not see its fold."""
    out = None
    for k in range(folds):
        part = predicted(estimator.fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), keep).withColumn(fold, F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(df: DataFrame, make: Callable[..., Estimator], grid: dict[str, Sequence], folds: int, score: Callable[[DataFrame], DataFrame]) -> tuple[dict, list[tuple[dict, float]]]:
    """The best parameters by mean score over folds, and all scores; a grid of one point is not searched."""
    points = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    if len(points) == 1:
        return points[0], []
    tried = []
    for point in points:
        rows = cross_validated(df, make(**point), folds)
        scores = [score(rows.where(F.col("fold") == k)).first()["score"] or 0.0 for k in range(folds)]
        tried.append((point, sum(scores) / folds))
    return max(tried, key=lambda t: t[1])[0], tried


def binary_report(rows: DataFrame, by: Sequence[str] = (), positive: float = 1.0, weight: str | None = None) -> DataFrame:
    """Metrics of predictions against ``label``, one row, or one for each value of ``by``; rows count by ``weight``, alike without one."""
    keys = tuple(by) or ("one",)
    pairs = rows.withColumn("one", F.lit(1)) if not by else rows
    return agreement.binary_metrics(agreement.binary_sums(pairs.select(*keys, F.col("label").alias("y1"), F.col("prediction").alias("y2"), (F.col(weight) if weight else F.lit(1.0)).alias("w")), keys, positive))


def apply_to_frame(model: Transformer, frame: DataFrame, classified: DataFrame | None = None, refresh: bool = False) -> DataFrame:
    """Predictions for documents that are not yet classified, or for all with ``refresh``; the frame comes back in either case."""
    todo = frame if refresh or classified is None else frame.join(classified.select("document_id"), "document_id", "left_anti")
    return predicted(model, todo.where("text is not null"))


def top_features(model: PipelineModel, n: int = 10) -> list[tuple[str, float]]:
    """The terms of largest weights, either sign: coefficients, importances, or differences of class log-probabilities."""
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        weights = last.coefficients.toArray()
    elif hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    else:
        theta = last.theta.toArray()
        weights = theta[-1] - theta[0]
    order = sorted(range(len(vocabulary)), key=lambda i: (-abs(weights[i]), vocabulary[i]))[:n]
    return [(vocabulary[i], float(weights[i])) for i in order]


def modal_class(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the commonest class; ties to the least."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(label)


def positive_class(df: DataFrame, base, label: str = "label") -> DataFrame:
    """The class that is not ``base`` if there are exactly two; else no row."""
    classes = df.where(F.col(label).isNotNull()).select(label).distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return classes.withColumn("n", n).where((F.col("n") == 2) & (F.col(label) != base)).select(label)


def save(model: PipelineModel, path: str, state: dict) -> None:
    """A model and its state (threshold, classes, parameters) under one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "state string").write.mode("overwrite").json(f"{path}/state")


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.json(f"{path}/state").first()["state"])
