"""Queries of commands, guarded saves and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import administration as A
from ..operators import models, sampling, workflow
from . import fixtures as X
from .coding import _draw, query


@query("created_coders", "SELECT * FROM (VALUES (1, 'coder1', false), (2, 'coder2', true), (3, 'turk1', true), (4, 'turk2', true), (5, 'coder5', false)) AS v(coder_id, coder_name, coder_is_mturk)", prelude=False)
def created_coders(spark, d):
    return A.create_coder(A.create_coder(X.coder(spark), "coder5"), "coder2", is_crowd=True)


@query(
    "command_sample_hits",
    f", f AS (SELECT DISTINCT document_id FROM document WHERE language = 'en' AND document_id >= 10), s AS (SELECT document_id FROM f ORDER BY {_draw(3)}, document_id LIMIT 60) SELECT document_id, 7 AS sample_id, 2 AS num_coders FROM s WHERE document_id % 5 <> 0",
)
def command_sample_hits(spark, d):
    """Frame, sample and HITs by the commands, less the HITs that are there."""
    frame = A.extract_frame(X.document(spark, d), {"language": "en", "document_id__gte": 10})
    existing = X.document(spark, d).where("document_id % 5 = 0").select("document_id", F.lit(7).alias("sample_id"))
    return A.create_sample_hits(A.extract_sample(frame, 60, 3), existing, 7, 2)


@query("balanced_class_weights", ", n AS (SELECT label_id, count(*) AS n, sum(count(*)) OVER () AS a, count(*) OVER () AS k FROM truth GROUP BY 1) SELECT document_id, label_id, round(a / (k * n) * (1 + document_id % 3), 6) AS balanced_weight FROM truth JOIN n USING (label_id)")
def balanced_class_weights(spark, d):
    rows = X.truth(spark, d).withColumn("w", (1 + F.col("document_id") % 3).cast("double"))
    return X.rounded(A.balanced_weights(rows, "label_id", "w").drop("w"))


@query("holdout_rows", "SELECT document_id, label_id, CASE WHEN document_id % 4 = 0 THEN 'test_' ELSE '' END || document_id AS row_key, document_id % 4 = 0 AS is_test FROM truth")
def holdout_rows(spark, d):
    truth = X.truth(spark, d)
    return A.with_holdout(truth.where("document_id % 4 <> 0"), truth.where("document_id % 4 = 0"))


@query("repeated_answers", "SELECT document_id, question_id, count(DISTINCT label_id) AS n FROM code GROUP BY 1, 2 HAVING count(DISTINCT label_id) > 1")
def repeated_answers(spark, d):
    return A.repeated_answers(X.codes(spark, d, None).select("document_id", "label_id"), X.label(spark))


@query("denormalised_codes", "SELECT assignment_id, reward, coder_id, hit_id, turk FROM assignment LEFT JOIN hit USING (hit_id)")
def denormalised_codes(spark, d):
    a = X.assignment(spark, d)
    return A.denormalised(a.select("assignment_id", "reward"), a, X.hit(spark, d)).select("assignment_id", "reward", "coder_id", "hit_id", "turk")


@query("valid_after_edit", "SELECT document_id, language FROM document WHERE document_id % 7 <> 0 OR document_id % 14 = 0")
def valid_after_edit(spark, d):
    """Derived rows after every seventh text changed, of which every other document is frozen."""
    before = A.frozen(X.document(spark, d), F.col("document_id") % 14 == 0)
    after = before.withColumn("text", F.when(F.col("document_id") % 7 == 0, F.concat(F.lit("new "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    return A.still_valid(before.select("document_id", "language"), before, after)


@query("edited_topics", "SELECT * FROM (VALUES (0, 'people', 'People', 'man, woman'), (1, 'work', 'Work', 'job, pay, boss')) AS v(topic, name, label, anchors)", prelude=False)
def edited_topics(spark, d):
    topics = spark.sql("select * from values (0, 'people', 'People', array('man', 'woman')), (1, '', '', array('job')) as v(topic, name, label, anchors)")
    edits = spark.sql("select * from values (1, 'work', 'Work', ' job, pay,, boss ') as v(topic, name, label, anchors)")
    return A.edited_topics(topics, edits).withColumn("anchors", T.anchors_text(F.col("anchors")))


@query("label_order", "SELECT * FROM (VALUES (10, 1, 1), (11, 2, 2), (20, 3, 3), (21, 4, 4)) AS v(label_id, place, priority_place)", prelude=False)
def label_order(spark, d):
    """Labels by id and by priority, the reverse of the reverse."""
    by_id = workflow.placed(X.label(spark).withColumn("priority", -F.col("label_id")), ["label_id"])
    return workflow.placed(by_id.withColumnRenamed("place", "first"), ["-priority"]).select("label_id", F.col("first").alias("place"), F.col("place").alias("priority_place"))


@query("topics_by_number", "SELECT document_type AS name, row_number() OVER (ORDER BY document_type) AS place FROM (SELECT DISTINCT document_type FROM document)")
def topics_by_number(spark, d):
    return workflow.placed(X.document(spark, d).select(F.col("document_type").alias("name")).distinct(), ["name"])


@query(
    "list_texts",
    """SELECT document_id, len(string_split(language || '|' || document_type, '|')) AS n, language || ', ' || document_type AS joined, list_filter(list_transform(string_split(' ' || language || ' ,, ' || document_type, ','), lambda x: trim(x)), lambda x: x <> '')[2] AS second,
    'b_c' AS kept, upper(language[1]) || language[2:] AS title FROM document""".replace("'b_c' AS kept", "list_extract(string_split('a_b_' || language, '_'), -1) AS suffix"),
)
def list_texts(spark, d):
    doc = X.document(spark, d)
    both = F.array("language", "document_type")
    spaced = F.concat(F.lit(" "), "language", F.lit(" ,, "), "document_type")
    return doc.select(
        "document_id", F.size(T.split_choices(F.concat_ws("|", both))).cast("long").alias("n"), T.anchors_text(both).alias("joined"), F.element_at(T.anchors_list(spaced), 2).alias("second"),
        T.column_suffix(F.concat(F.lit("a_b_"), "language")).alias("suffix"), T.title(F.col("language")).alias("title"),
    )


@query("class_of_most", "SELECT label_id, (SELECT min(label_id) FROM truth WHERE label_id <> 11) AS positive FROM truth GROUP BY 1 ORDER BY count(*) DESC, label_id LIMIT 1")
def class_of_most(spark, d):
    truth = X.truth(spark, d)
    return models.modal_class(truth, "label_id").crossJoin(models.positive_class(truth, 11, "label_id").withColumnRenamed("label_id", "positive"))


@query("expansion_size", ", n AS (SELECT count(*) AS new, (count(*) FILTER (document_id % 3 <> 0)) AS old FROM document) SELECT old, new, CAST(round_even(40 * (1 + (new - old) / old), 0) AS BIGINT) AS size FROM n")
def expansion_size(spark, d):
    new, old = (X.document(spark, d).where(c).count() for c in ("true", "document_id % 3 <> 0"))
    return spark.createDataFrame([(old, new, sampling.expansion_size(old, new, 40))], "old long, new long, size long")
