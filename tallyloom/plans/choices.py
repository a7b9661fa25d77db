"""Queries of path lookups, posted forms, scorers and the search for a threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import lookups, responses, selection
from . import fixtures as X
from .coding import THRESHOLDS, query


@query("path_lookup", "SELECT document_id, coder_id, question_name AS label__question__question_name, label_value AS label__label_value, coder_name AS coder__coder_name FROM code WHERE question_name IN ('quality') AND label_value = '1' AND coder_name LIKE 'turk%'")
def path_lookup(spark, d):
    """Codes filtered by fields of their label, its question and their coder."""
    relations = {"label": (X.label(spark), "label_id"), "question": (X.question(spark), "question_id"), "coder": (X.coder(spark), "coder_id")}
    paths = ["label__question__question_name", "label__label_value", "coder__coder_name"]
    codes = lookups.follow(X.code_facts(spark, d).select("document_id", "coder_id", "label_id"), paths, relations)
    return lookups.frame_predicate(codes, {"label__question__question_name__in": ["quality"], "label__label_value": "1", "coder__coder_name__startswith": "turk"}).drop("label_id")


QUESTIONS = (
    {"question_id": 1, "name": "toxic", "display": "radio", "labels": [{"label_id": 10, "value": "1"}, {"label_id": 11, "value": "0"}]},
    {"question_id": 2, "name": "quality", "display": "radio", "labels": [{"label_id": 20, "value": "1"}, {"label_id": 21, "value": "0", "default": True}]},
    {"question_id": 3, "name": "kinds", "display": "checkbox", "multiple": True, "labels": [{"label_id": 30, "value": "none", "default": True}, {"label_id": 31, "value": "a"}, {"label_id": 32, "value": "b"}]},
    {"question_id": 4, "name": "count", "display": "number", "labels": [{"label_id": 40, "value": "0"}, {"label_id": 41, "value": "1"}]},
    {"question_id": 5, "name": "why", "display": "text", "optional": True, "labels": [{"label_id": 50, "value": "open_response"}]},
)


def form(spark, d):
    """Forms as they might be posted: a field missing, empty, of several values or with notes, by the number of the document."""
    i = F.col("doc_id")
    fields = [
        ("toxic", F.array(F.when(i % 11 == 0, "").otherwise((11 - F.col("toxic")).cast("string"))), F.lit(True)),
        ("quality", F.array((21 - F.col("quality")).cast("string")), i % 3 != 0),
        ("kinds", F.when(i % 2 == 0, F.array(F.lit("31"), F.lit("32"))).otherwise(F.array(F.lit(""))), F.lit(True)),
        ("count", F.array((i % 4).cast("string")), F.lit(True)),
        ("why", F.array(F.concat(F.lit("because "), i.cast("string"))), i % 5 == 0),
        ("why_notes", F.array(F.lit("seen")), i % 10 == 0),
        ("notes", F.array(F.lit("all")), i % 9 == 0),
        ("uncodeable", F.array((i % 7 == 0).cast("int").cast("string")), F.lit(True)),
    ]
    posted = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("chosen"), p.alias("posted")) for n, v, p in fields))).alias("f")
    return X.table(spark, d, "labels").select(i.alias("response_id"), posted).where("f.posted").select("response_id", "f.field", "f.chosen")


@query(
    "form_codes",
    """SELECT doc_id AS response_id, 1 AS question_id, CAST(11 - toxic AS INTEGER) AS label_id, CAST(toxic AS VARCHAR) AS value, NULL AS answer, NULL AS notes FROM labels WHERE doc_id % 11 <> 0
    UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN 21 ELSE 21 - quality END, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(quality AS VARCHAR) END, NULL, NULL FROM labels
    UNION ALL SELECT doc_id, 3, unnest(CASE WHEN doc_id % 2 = 0 THEN [31, 32] ELSE [30] END), unnest(CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] ELSE ['none'] END), NULL, NULL FROM labels
    UNION ALL SELECT doc_id, 4, CASE doc_id % 4 WHEN 0 THEN 40 WHEN 1 THEN 41 ELSE 0 END, CAST(doc_id % 4 AS VARCHAR), NULL, NULL FROM labels
    UNION ALL SELECT doc_id, 5, 50, 'open_response', 'because ' || doc_id, CASE WHEN doc_id % 10 = 0 THEN 'seen' END FROM labels WHERE doc_id % 5 = 0""",
    prelude=False,
)
def form_codes(spark, d):
    codes = responses.new_codes(responses.responses(form(spark, d), QUESTIONS))
    return codes.withColumn("label_id", F.coalesce("label_id", F.lit(0)))


@query("form_closed", "SELECT doc_id AS response_id, CASE WHEN doc_id % 9 = 0 THEN 'all' END AS notes, doc_id % 7 = 0 AS uncodeable, doc_id % 11 <> 0 AS finished FROM labels", prelude=False)
def form_closed(spark, d):
    posted = form(spark, d)
    return responses.closed(posted, responses.responses(posted, QUESTIONS))


@query(
    "scorers_by_name",
    """, b AS (SELECT t.label_id AS t, p.label_id AS p, probability AS q FROM truth t JOIN prediction p USING (document_id)),
    c AS (SELECT y, sum((t = y AND p = y)::INT) AS tp, sum((t = y)::INT) AS nt, sum((p = y)::INT) AS np FROM b, (VALUES (10), (11)) AS l(y) GROUP BY 1),
    m AS (SELECT y, coalesce(tp / nullif(np, 0), 0) AS pr, coalesce(tp / nullif(nt, 0), 0) AS re FROM c), n AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM m),
    s AS (SELECT 'f1' AS name, 10 AS positive, f AS score FROM n WHERE y = 10 UNION ALL SELECT 'precision', 10, pr FROM n WHERE y = 10 UNION ALL SELECT 'recall', 10, re FROM n WHERE y = 10
      UNION ALL SELECT 'f1', 0, avg(f) FROM n UNION ALL SELECT 'recall', 0, avg(re) FROM n
      UNION ALL SELECT 'brier_loss', 10, -avg(power(CASE WHEN p = 10 THEN q ELSE 1 - q END - (t = 10)::INT, 2)) FROM b
      UNION ALL SELECT 'mean_squared_error', 0, -avg(power(t - p, 2)) FROM b UNION ALL SELECT 'r2', 0, 1 - avg(power(t - p, 2)) / nullif(var_pop(t), 0) FROM b)
    SELECT name, positive, round(score, 6) AS score FROM s""",
)
def scorers_by_name(spark, d):
    both = X.truth(spark, d).withColumnRenamed("label_id", "label").join(X.prediction(spark, d).withColumnRenamed("label_id", "prediction"), "document_id")
    asked = [("f1", 10, False), ("precision", 10, False), ("recall", 10, False), ("f1", None, False), ("recall", None, False), ("brier_loss", 10, False), ("mean_squared_error", None, True), ("r2", None, True)]
    rows = [selection.scorer(n, p, r)(both).select(F.lit(n).alias("name"), F.lit(p or 0).alias("positive"), "score") for n, p, r in asked]
    return X.rounded(reduce(lambda a, b: a.unionByName(b), rows))


@query(
    "threshold_search",
    """, u AS (SELECT x::DOUBLE / 20 AS threshold FROM range(20) AS r(x)),
    v AS (SELECT threshold, document_id % 4 AS fold, t.label_id = 10 AS t, (CASE WHEN p.label_id = 11 THEN 1 - probability ELSE probability END) >= threshold AS g FROM truth t JOIN prediction p USING (document_id), u),
    b AS (SELECT threshold, fold, sum((t AND g)::INT) AS tp, sum((NOT t AND g)::INT) AS fp, sum((t AND NOT g)::INT) AS fn FROM v GROUP BY 1, 2),
    m AS (SELECT threshold, fold, least(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS s FROM b),
    z AS (SELECT threshold, least(max(s) FILTER (fold = 0), avg(s) FILTER (fold > 0)) AS s FROM m GROUP BY 1)
    SELECT threshold FROM z ORDER BY round(s, 9) DESC, threshold LIMIT 1""",
)
def threshold_search(spark, d):
    """Test rows are every fourth document, the others are dealt to three folds."""
    rows = X.prediction(spark, d).withColumn("fold", F.col("document_id") % 4)
    return selection.threshold_search(rows.where("fold = 0").drop("fold"), rows.where("fold > 0"), X.truth(spark, d), 11, 10, THRESHOLDS)
