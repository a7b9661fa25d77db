"""The coding data model projected from the tables at hand, and the same as SQL.

Labels become the answers of four coders to two questions, with partial
coverage and some disagreement; events become assignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = (10, 11, 20, 21)
PATTERNS = {"the": "(?i)the", "license": "(?i)licen[sc]e", "digits": "[0-9]{4}"}
LEXICON = {"function": ["the", "and", "of"], "stems": ["th*", "er*"], "mixed": ["in", "an*", "licensed"]}

PRELUDE = """
WITH coder(coder_id, coder_name, coder_is_mturk) AS (
  VALUES (1, 'coder1', false), (2, 'coder2', false), (3, 'turk1', true), (4, 'turk2', true)
), document AS (
  SELECT doc_id AS document_id, text, lang AS language, source AS document_type, DATE '2000-01-01' + CAST(doc_id AS INTEGER) AS date FROM documents
), question_value AS (
  SELECT doc_id AS document_id, 1 AS question_id, 'toxic' AS question_name, toxic AS value FROM labels
  UNION ALL SELECT doc_id, 2, 'quality', quality FROM labels
), coded AS (
  SELECT q.document_id, c.coder_id, c.coder_name, c.coder_is_mturk, q.question_id, q.question_name,
    CASE WHEN (q.document_id * 7919 + c.coder_id * 104729 + q.question_id * 13) % 100 < 10 THEN 1 - q.value ELSE q.value END AS v,
    (q.document_id + c.coder_id) % 23 = 0 AS consensus_ignore, q.document_id % 500 AS hit_id
  FROM question_value q CROSS JOIN coder c WHERE (q.document_id * 31 + c.coder_id * 17) % 7 <> 0
), code AS (
  SELECT *, CASE WHEN question_id = 1 THEN 11 - v ELSE 21 - v END AS label_id, CAST(v AS VARCHAR) AS label_value, 'sample' AS sample_name FROM coded
), toxic AS (SELECT * FROM code WHERE question_id = 1),
by_coder AS (
  SELECT document_id, coder_id, CAST(sum(CASE WHEN label_id = 10 THEN 1 ELSE 0 END) AS DOUBLE) AS label_10,
    CAST(sum(CASE WHEN label_id = 11 THEN 1 ELSE 0 END) AS DOUBLE) AS label_11, min(coder_name) AS coder_name, bool_or(coder_is_mturk) AS coder_is_mturk
  FROM toxic GROUP BY 1, 2
), sample_unit AS (SELECT d.* FROM document d WHERE document_id IN (SELECT doc_id FROM labels)),
flags AS (
  SELECT document_id, language, document_type, regexp_matches(text, '(?i)the') AS search_the,
    regexp_matches(text, '(?i)licen[sc]e') AS search_license, regexp_matches(text, '[0-9]{4}') AS search_digits FROM document
), flagged AS (SELECT *, NOT (search_the OR search_license OR search_digits) AS search_none FROM flags),
assignment AS (
  SELECT event_id AS assignment_id, user_id AS coder_id, event_id % 500 AS hit_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS time_finished, event_type = 'signup' AS uncodeable, value AS reward, ts FROM events
), hit AS (SELECT DISTINCT hit_id, hit_id % 3 = 0 AS turk, 15 AS num_coders FROM assignment),
prediction AS (
  SELECT document_id, CASE WHEN (document_id * 31) % 10 < 3 THEN 10 ELSE 11 END AS label_id, 0.5 + ((document_id * 6151) % 500) / 1000.0 AS probability FROM document
), truth AS (SELECT doc_id AS document_id, 11 - toxic AS label_id FROM labels)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    date = F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int"))
    return d.select(F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("language"), F.col("source").alias("document_type"), date.alias("date"))


def coder(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values (1, 'coder1', false), (2, 'coder2', false), (3, 'turk1', true), (4, 'turk2', true) as v(coder_id, coder_name, coder_is_mturk)")


def label(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values (10, 1, '1'), (11, 1, '0'), (20, 2, '1'), (21, 2, '0') as v(label_id, question_id, label_value)")


def question(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values (1, 'toxic'), (2, 'quality') as v(question_id, question_name)")


def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, coder_id, label_id, hit_id, sample_name, consensus_ignore``: each label row meets the four coders and two questions as literals."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "toxic", "quality")
    rows = rows.withColumn("coder_id", F.explode(F.array(*map(F.lit, range(1, 5)))))
    rows = rows.where((F.col("document_id") * 31 + F.col("coder_id") * 17) % 7 != 0)
    q = F.explode(F.array(F.struct(F.lit(1).alias("q"), F.col("toxic").alias("value")), F.struct(F.lit(2).alias("q"), F.col("quality").alias("value")))).alias("a")
    rows = rows.select("document_id", "coder_id", q)
    flip = (F.col("document_id") * 7919 + F.col("coder_id") * 104729 + F.col("a.q") * 13) % 100 < 10
    v = F.when(flip, 1 - F.col("a.value")).otherwise(F.col("a.value"))
    return rows.select(
        "document_id", "coder_id", F.when(F.col("a.q") == 1, 11 - v).otherwise(21 - v).cast("int").alias("label_id"),
        (F.col("document_id") % 500).alias("hit_id"), F.lit("sample").alias("sample_name"), ((F.col("document_id") + F.col("coder_id")) % 23 == 0).alias("consensus_ignore"),
    )


def codes(spark: SparkSession, sf_dir: str, question_id: int | None = 1) -> DataFrame:
    """Codes with coder, label and question columns; of one question unless it is ``None``."""
    small = label(spark).join(question(spark), "question_id")
    out = code_facts(spark, sf_dir).join(F.broadcast(coder(spark)), "coder_id").join(F.broadcast(small), "label_id")
    return out if question_id is None else out.where(F.col("question_id") == question_id)


def sample_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("assignment_id"), F.col("user_id").alias("coder_id"), (F.col("event_id") % 500).alias("hit_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("time_finished"), (F.col("event_type") == "signup").alias("uncodeable"),
        F.col("value").alias("reward"), "ts",
    )


def hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark, sf_dir).select("hit_id").distinct().select("hit_id", (F.col("hit_id") % 3 == 0).alias("turk"), F.lit(15).alias("num_coders"))


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document(spark, sf_dir)
    probability = F.lit(0.5) + ((F.col("document_id") * 6151) % 500) / F.lit(1000.0)
    return d.select("document_id", F.when((F.col("document_id") * 31) % 10 < 3, 10).otherwise(11).alias("label_id"), probability.alias("probability"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), (11 - F.col("toxic")).cast("int").alias("label_id"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at the precision in which they are compared; all of them unless named."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def lit_array(values) -> Column:
    return F.array(*map(F.lit, values))
