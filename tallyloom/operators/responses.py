"""Answers of coders from posted forms: fields become codes by the kind of question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = "array<struct<label_id:int,value:string>>"


def _labels(labels: Sequence[dict]) -> Column:
    if not labels:
        return F.expr(f"cast(array() as {CODE})")
    return F.array(*(F.struct(F.lit(x["label_id"]).cast("int").alias("label_id"), F.lit(str(x["value"])).alias("value")) for x in labels))


def _chosen(question: dict, said: Column) -> Column:
    """The labels of one posted field."""
    labels, display = question["labels"], question["display"]
    said = F.filter(said, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    if not question.get("multiple"):
        said = F.slice(said, 1, 1)
    listed = F.filter(_labels(labels), lambda x: F.array_contains(said, x["label_id"].cast("string")))
    if display == "number":
        known = _labels(labels)
        first = lambda v: F.element_at(F.concat(F.transform(F.filter(known, lambda k: k["value"] == v), lambda k: k["label_id"]), F.array(F.lit(None).cast("int"))), 1)
        return F.transform(F.array_distinct(said), lambda v: F.struct(first(v).alias("label_id"), v.alias("value"))).cast(CODE)
    if display in ("text", "date"):
        return _labels([x for x in labels if x["value"] == "open_response"])
    if display == "checkbox":
        return F.when(F.size(said) == 0, _labels([x for x in labels if x.get("default")])).otherwise(listed)
    return listed


def responses(form: DataFrame, questions: Sequence[dict]) -> DataFrame:
    """``response_id, question_id, labels, answer, notes, incomplete``: a row for each response and question.

    ``form`` has ``response_id, field, chosen`` (an array of strings, one field
    once in a response); fields are names of questions, the same with
    ``_notes``, ``notes`` and ``uncodeable``; others mean nothing.  Empty
    values do not count; single choices keep the first.  Checkboxes without a
    value take their defaults, numbers the label of that value (without an id
    while there is none yet), texts and dates the label ``open_response``, with
    what was said in ``answer``.  Questions that were not posted take defaults,
    a single choice only if it has just one.  ``incomplete`` marks posted
    questions that need a label and have none.
    """
    sums, out = [], []
    for n, q in enumerate(questions):
        for field, name in ((q["name"], f"said{n}"), (f"{q['name']}_notes", f"notes{n}")):
            sums.append(F.max(F.when(F.col("field") == field, F.col("chosen"))).alias(name))
        said, defaults = F.col(f"said{n}"), [x for x in q["labels"] if x.get("default")]
        unposted = _labels(defaults if q.get("multiple") or len(defaults) == 1 else [])
        labels = F.when(said.isNull(), unposted).otherwise(_chosen(q, said))
        answer = F.get(said, F.lit(0)) if q["display"] in ("text", "date") else F.lit(None).cast("string")
        needed = said.isNotNull() & (F.size(labels) == 0) & F.lit(not q.get("optional"))
        out.append(F.struct(F.lit(q["question_id"]).alias("question_id"), labels.alias("labels"), answer.alias("answer"), F.get(F.col(f"notes{n}"), F.lit(0)).alias("notes"), needed.alias("incomplete")))
    return form.groupBy("response_id").agg(*sums).select("response_id", F.inline(F.array(*out)))


def new_codes(answers: DataFrame) -> DataFrame:
    """``response_id, question_id, label_id, value, answer, notes``: a row for each label of ``responses``."""
    return answers.select("response_id", "question_id", F.explode("labels").alias("l"), "answer", "notes").select("response_id", "question_id", "l.*", "answer", "notes")


def closed(form: DataFrame, answers: DataFrame) -> DataFrame:
    """``response_id, notes, uncodeable, finished``: a response is finished unless a question that needs an answer has none."""
    head = form.groupBy("response_id").agg(
        F.max(F.when(F.col("field") == "notes", F.get("chosen", F.lit(0)))).alias("notes"),
        F.coalesce(F.bool_or((F.col("field") == "uncodeable") & (F.get("chosen", F.lit(0)) == "1")), F.lit(False)).alias("uncodeable"),
    )
    done = answers.groupBy("response_id").agg((~F.bool_or("incomplete")).alias("finished"))
    return head.join(done, "response_id", "left")
