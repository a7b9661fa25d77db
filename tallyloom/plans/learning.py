"""Queries that train models; beyond SQL, so tests check them on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, models, sampling, topics
from . import fixtures as X
from .coding import query


def _training(spark, d) -> DataFrame:
    """English labelled documents with ``label`` 1 for toxic, and stratified folds."""
    docs = X.document(spark, d).select("document_id", "text")
    rows = X.truth(spark, d).join(docs, "document_id").withColumn("label", (F.col("label_id") == 10).cast("double"))
    return sampling.folds(rows, "label", 3, 5)


def _classifier(name: str, **params) -> None:
    def run(spark, d):
        rows = _training(spark, d)
        model = models.pipeline(name, min_df=5.0, max_features=2000, **params).fit(rows.where("fold <> 0"))
        return X.rounded(models.predicted(model, rows.where("fold = 0"), ("document_id", "label")))

    query(f"classifier_{'svc_rbf' if params.get('rbf') else name}")(run)


for _name, _params in (
    ("decision_tree", {}), ("random_forest", {}), ("gradient_boosting", {"maxIter": 5}), ("xgboost", {"maxIter": 5}), ("linear_svc", {"maxIter": 20}),
    ("svc", {"rbf": True, "maxIter": 20}), ("sgd", {"maxIter": 20}), ("multinomial_nb", {}), ("logistic_regression", {"maxIter": 20}),
):
    _classifier(_name, **_params)


@query("classifier_k_neighbors")
def k_neighbors(spark, d):
    from pyspark.ml import Pipeline

    # The rows of _training: folds are dealt to ids, and texts meet them once, in the same way at any size.
    docs = X.document(spark, d).select("document_id", "text")
    coded = X.truth(spark, d).join(docs.select("document_id"), "document_id").withColumn("label", (F.col("label_id") == 10).cast("double"))
    rows, path = models.stored(docs.hint("merge").join(sampling.folds(coded, "label", 3, 5), "document_id"), "training", "zstd")
    features = Pipeline(stages=models.term_stages(min_df=5.0, max_features=2000)).fit(rows.where("fold <> 0"))
    out = models.neighbours(features.transform(rows.where("fold <> 0")), features.transform(rows.where("fold = 0")))
    models.discarded(spark, path)
    return X.rounded(out)


@query("cv_scores")
def cv_scores(spark, d):
    rows = models.cross_validated(_training(spark, d), models.pipeline("multinomial_nb", min_df=5.0, max_features=2000), 3)
    scores = models.binary_report(rows, ("fold",)).withColumn("outcome_column", F.lit("label"))
    return X.rounded(agreement.fold_average(scores))


@query("topic_model")
def topic_model(spark, d):
    frame = X.document(spark, d).select("document_id", "text")
    model = topics.train(frame, 4, [["the", "and"], ["der", "und"], ["les", "des"], ["los", "que"]], words=400, rounds=15)
    return topics.apply(model, frame)


@query("topic_irr")
def topic_irr(spark, d):
    """Agreement between a topic model and its anchors read as a dictionary."""
    frame = X.document(spark, d).select("document_id", "text")
    anchors = {0: ["the", "and"], 1: ["der", "und"]}
    model = topics.train(frame, 2, list(anchors.values()), words=200, rounds=10)
    one = topics.apply(model, frame).select("document_id", "topic", F.col("value").cast("int").alias("label_id"))
    both = agreement.as_coders(topics.anchor_codes(frame, anchors), one)
    out = None
    for k in anchors:
        part = agreement.scores_by_value(both.where(F.col("topic") == k).drop("topic"), values=[1], ordered=False).withColumn("topic", F.lit(k))
        out = part if out is None else out.unionByName(part)
    warning = F.least("coder1_mean", "coder2_mean") < 0.05
    return X.rounded(out.withColumn("warning", warning))
