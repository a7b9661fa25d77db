"""Queries of smaller operators: adjudication, qualification, reconciliation, feature joins, stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, features, filters, sampling, workflow
from ..sources import readers, writers
from . import fixtures as X
from .coding import THRESHOLDS, _draw, query


@query("create_hits", "SELECT document_id, 1 AS sample_id, 2 AS num_coders FROM sample_unit WHERE document_id % 3 <> 0")
def create_hits(spark, d):
    units = X.sample_unit(spark, d).select("document_id", F.lit(1).alias("sample_id"))
    return workflow.create_hits(units, units.where("document_id % 3 = 0"), 2)


@query("hit_finished", ", n AS (SELECT hit_id, count(time_finished) AS done FROM assignment GROUP BY 1) SELECT hit_id, turk, num_coders, coalesce(done, 0) >= num_coders AS finished FROM hit LEFT JOIN n USING (hit_id)")
def hit_finished(spark, d):
    return workflow.finished(X.hit(spark, d), X.assignment(spark, d))


@query("abandoned_assignments", "SELECT assignment_id, coder_id FROM assignment WHERE time_finished IS NULL AND assignment_id % 2 <> 0")
def abandoned_assignments(spark, d):
    a = X.assignment(spark, d)
    return workflow.abandoned(a, a.where("assignment_id % 2 = 0")).select("assignment_id", "coder_id")


@query(
    "adjudicated_codes",
    ", k AS (SELECT hit_id, question_id, min(label_id) AS decided FROM code WHERE NOT coder_is_mturk GROUP BY 1, 2) SELECT document_id, coder_id, label_id, consensus_ignore OR coalesce(decided <> label_id, false) AS consensus_ignore FROM code LEFT JOIN k USING (hit_id, question_id)",
)
def adjudicated_codes(spark, d):
    codes = X.codes(spark, d, None)
    decided = codes.where("not coder_is_mturk").groupBy("hit_id", "question_id").agg(F.min("label_id").alias("label_id"))
    return workflow.adjudicated(codes, decided).select("document_id", "coder_id", "label_id", "consensus_ignore")


@query(
    "qualified_coders",
    ", p AS (SELECT coder_id, 't' || (hit_id % 2) AS test, time_finished, reward > 5 AS passed FROM assignment) SELECT coder_id FROM p WHERE time_finished IS NOT NULL AND passed GROUP BY 1 HAVING count(DISTINCT test) = 2",
)
def qualified_coders(spark, d):
    passed = X.assignment(spark, d).select("coder_id", F.concat(F.lit("t"), (F.col("hit_id") % 2).cast("string")).alias("test"), "time_finished", (F.col("reward") > 5).alias("passed"))
    return filters.qualified_coders(passed, ["t0", "t1"])


@query("approved_assignments", "SELECT assignment_id FROM assignment WHERE ('0x' || substr(md5('4_' || assignment_id), 1, 7))::BIGINT / 268435456.0 >= 0.75")
def approved_assignments(spark, d):
    a = X.assignment(spark, d).select(F.col("assignment_id").alias("document_id"))
    return sampling.approved(a, 0.25, 4).select(F.col("document_id").alias("assignment_id"))


@query(
    "reconcile_hits",
    """, l AS (SELECT hit_id FROM hit WHERE hit_id % 4 <> 0), r AS (SELECT hit_id FROM hit WHERE hit_id % 5 <> 0)
    SELECT hit_id, 'remote only' AS side FROM r WHERE hit_id NOT IN (SELECT hit_id FROM l) UNION ALL SELECT hit_id, 'local only' FROM l WHERE hit_id NOT IN (SELECT hit_id FROM r)
    UNION ALL SELECT hit_id, 'both' FROM l WHERE hit_id IN (SELECT hit_id FROM r)""",
)
def reconcile_hits(spark, d):
    hit = X.hit(spark, d).select("hit_id")
    parts = workflow.reconcile(hit.where("hit_id % 5 <> 0"), hit.where("hit_id % 4 <> 0"), "hit_id")
    out = [p.select("hit_id", F.lit(side).alias("side")) for p, side in zip(parts, ("remote only", "local only", "both"), strict=True)]
    return out[0].union(out[1]).union(out[2])


@query("response_changes", "SELECT document_id, CASE WHEN toxic <> quality THEN toxic::VARCHAR ELSE '' END AS gone, CASE WHEN toxic <> quality THEN quality::VARCHAR ELSE '' END AS come FROM (SELECT doc_id AS document_id, toxic, quality FROM labels)")
def response_changes(spark, d):
    gone, come = workflow.response_changes(F.array("toxic"), F.array("quality"), multiple=False)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return X.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), joined(gone).alias("gone"), joined(come).alias("come"))


@query("parse_answers", "SELECT event_id, 'q1' AS question, event_type AS answer FROM events UNION ALL SELECT event_id, 'q2', NULL FROM events", prelude=False)
def parse_answers(spark, d):
    xml = F.concat(
        F.lit("<QuestionFormAnswers><Answer><QuestionIdentifier>q1</QuestionIdentifier><FreeText>"), "event_type",
        F.lit("</FreeText></Answer>\n<Answer><QuestionIdentifier>q2</QuestionIdentifier><SelectionIdentifier/></Answer></QuestionFormAnswers>"),
    )
    rows = X.table(spark, d, "events").select("event_id", F.explode(workflow.parse_answers(xml)).alias("a"))
    return rows.select("event_id", "a.question", "a.answer")


HALVES = """, u AS (SELECT x::DOUBLE / 20 AS threshold FROM range(20) AS r(x)),
    v AS (SELECT threshold, document_id % 2 AS half, t.label_id = 10 AS t, (CASE WHEN p.label_id = 11 THEN 1 - probability ELSE probability END) >= threshold AS g FROM truth t JOIN prediction p USING (document_id), u),
    b AS (SELECT threshold, half, sum((t AND g)::INT) AS tp, sum((NOT t AND g)::INT) AS fp, sum((t AND NOT g)::INT) AS fn FROM v GROUP BY 1, 2),
    m AS (SELECT threshold, half, round(least(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END), 9) AS s FROM b)
    SELECT threshold FROM m GROUP BY 1 ORDER BY min(s) DESC, threshold LIMIT 1"""


@query("best_cv_threshold", HALVES)
def best_cv_threshold(spark, d):
    """The threshold that does best on the worse of two disjoint sets of documents, one as test, one as fold."""

    def scores(half: int):
        truth = X.truth(spark, d).where(F.col("document_id") % 2 == half)
        out = agreement.threshold_scores(X.prediction(spark, d), truth, 11, 10, THRESHOLDS).withColumn("outcome_column", F.lit("label_id__10"))
        return out.withColumn("precision_recall_min", F.round("precision_recall_min", 9))

    return agreement.best_cv_threshold(scores(0), scores(1))


@query("fold_average", ", s AS (SELECT document_id % 3 AS fold, label_id, avg(probability) AS p FROM prediction GROUP BY 1, 2) SELECT label_id::VARCHAR AS outcome_column, round(avg(p), 6) AS probability FROM s GROUP BY 1")
def fold_average(spark, d):
    scores = X.prediction(spark, d).groupBy((F.col("document_id") % 3).alias("fold"), F.col("label_id").cast("string").alias("outcome_column")).agg(F.avg("probability").alias("probability"))
    return X.rounded(agreement.fold_average(scores))


@query(
    "tfidf_bigrams",
    r""", w AS (SELECT document_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM document), z AS (SELECT document_id, unnest(list_zip(w[:-2], w[2:])) AS p FROM w WHERE len(w) > 1),
    c AS (SELECT document_id, p[1] || ' ' || p[2] AS term, count(*)::DOUBLE AS tf FROM z GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 0.5 * (SELECT count(*) FROM document))
    SELECT document_id, term, round((1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM document)) / (1 + df)) + 1), 6) AS weight FROM c JOIN f USING (term)""",
)
def tfidf_bigrams(spark, d):
    docs = X.document(spark, d).select("document_id", "text")
    return X.rounded(features.tfidf(docs, ngram_range=(2, 2), min_df=3, max_df=0.5, sublinear_tf=True, norm=False))


@query(
    "word_vector_features",
    """, v AS (SELECT i, 'the and of to in a is with for on'.split(' ')[i + 1] AS word, embedding FROM (SELECT vec_id AS i, embedding FROM embeddings WHERE vec_id < 10)),
    t AS (SELECT document_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM document),
    x AS (SELECT document_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM t JOIN v USING (word))
    SELECT document_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS mean, round(max(x), 5) AS max, round(min(x), 5) AS min, round(stddev_samp(x), 5) AS std, round(median(x), 5) AS median FROM x GROUP BY 1, 2""".replace("\\\\", "\\"),
)
def word_vector_features(spark, d):
    names = X.lit_array("the and of to in a is with for on".split(" "))
    vectors = X.table(spark, d, "embeddings").where("vec_id < 10").select(F.element_at(names, F.col("vec_id").cast("int") + 1).alias("word"), "embedding")
    return X.rounded(features.word_vector_features(X.document(spark, d).select("document_id", "text"), vectors), digits=5)


@query("topic_features", ", s AS (SELECT document_id, 1.0 - (document_id % 4) / 4.0 AS v FROM document WHERE document_id % 2 = 0) SELECT document_id, coalesce(v, 0.0) AS topic_even FROM document LEFT JOIN s USING (document_id)")
def topic_features(spark, d):
    doc = X.document(spark, d).select("document_id")
    topic = doc.where("document_id % 2 = 0").select("document_id", F.lit(0).alias("topic"), (F.lit(1.0) - (F.col("document_id") % 4) / 4.0).alias("value"))
    return features.topic_features(doc, topic, {0: "even", 1: ""})


@query("field_lookups", "SELECT d.document_id, try_cast(l.quality AS DOUBLE) AS quality, try_cast(d.document_type AS DOUBLE) AS document_type FROM document d LEFT JOIN labels l ON l.doc_id = d.document_id")
def field_lookups(spark, d):
    doc = X.document(spark, d).select("document_id", "document_type")
    fields = doc.join(X.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), "quality"), "document_id", "left")
    return features.field_lookups(doc, fields, ["quality", "document_type"])


def _through_csv(spark, d):
    """Whole documents written by the CSV sink and read by the source."""
    path = f"{writers.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    writers.write_csv(X.document(spark, d).select("document_id", "language", "text"), path)
    return readers.documents_csv(spark, path, "document_id long, language string, text string")


@query("csv_round_trip", "SELECT document_id, language, left(text, 200) AS text FROM document")
def csv_round_trip(spark, d):
    """Documents through the CSV sink and source; what comes back is shown by its start, and by ``csv_round_trip_whole`` whole."""
    return _through_csv(spark, d).withColumn("text", T.prefix(F.col("text"), 200))


@query("csv_round_trip_whole", "SELECT document_id, language, md5(text) AS digest, length(text) AS n FROM document")
def csv_round_trip_whole(spark, d):
    """Digests and lengths of whole texts that went through the CSV sink and source."""
    return _through_csv(spark, d).select("document_id", "language", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


@query("cached_dataset", "SELECT document_id, label_10, label_11 FROM (SELECT document_id, avg(label_10) AS label_10, avg(label_11) AS label_11 FROM by_coder GROUP BY 1)")
def cached_dataset(spark, d):
    """A dataset that is made once for its parameters and then read."""
    from ..operators import datasets

    root = f"{writers.shared_dir(spark)}/results"
    key = writers.cache_key("document_mean", {"dir": d, "labels": [10, 11], "run": uuid.uuid4().hex})
    make = lambda: datasets.document_aggregate(datasets.document_coder(X.codes(spark, d), (10, 11)), "mean", ["label_10", "label_11"])
    writers.cached(spark, root, key, make)
    return writers.cached(spark, root, key, make, only_existing=True)


@query(
    "topic_anchor_codes",
    r"""SELECT document_id, topic, (regexp_matches(lower(text), p))::INT AS label_id FROM document, (VALUES (0, '(^|[^\p{L}\p{N}\p{M}_])(the|and)($|[^\p{L}\p{N}\p{M}_])'), (1, '(^|[^\p{L}\p{N}\p{M}_])(der|und)($|[^\p{L}\p{N}\p{M}_])')) AS v(topic, p)""",
)
def topic_anchor_codes(spark, d):
    from ..operators import topics

    return topics.anchor_codes(X.document(spark, d), {0: ["the", "and"], 1: ["der", "und"]})


@query("sample_share", f", k AS (SELECT document_id, row_number() OVER (ORDER BY {_draw(8)}, document_id) AS r, count(*) OVER () AS n FROM document WHERE document_id % 3 <> 0) SELECT document_id FROM k WHERE r <= floor(0.05 * (SELECT count(*) FROM document))")
def sample_share(spark, d):
    """A twentieth of the frame at random, of documents that the project's other sample does not have."""
    frame = X.document(spark, d).select("document_id")
    return sampling.draw(frame, 0.05, 8, others=[frame.where("document_id % 3 = 0")])


@query("sample_everything", "SELECT document_id FROM document WHERE document_id % 4 <> 0")
def sample_everything(spark, d):
    frame = X.document(spark, d).select("document_id")
    return sampling.draw(frame, None, 0, "all", others=[frame.where("document_id % 4 = 0")])


@query("ordered_assignments", "SELECT assignment_id, row_number() OVER (ORDER BY coder_id DESC, time_finished DESC NULLS LAST, assignment_id) AS place FROM assignment")
def ordered_assignments(spark, d):
    """Assignments in an order that the caller names, key by key."""
    return workflow.placed(X.assignment(spark, d), ["-coder_id", "-time_finished", "assignment_id"]).select("assignment_id", "place")


@query("questions_with_codes", "SELECT question_id, max((label_id = 11)::INT) = 1 AS has FROM code GROUP BY 1")
def questions_with_codes(spark, d):
    return workflow.any_match(X.codes(spark, d, None), ["question_id"], F.col("label_id") == 11, "has")
