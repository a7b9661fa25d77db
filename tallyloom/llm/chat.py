"""Chat formatting with typed content parts: a visitor over parts, a reversible template, loss spans.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What opens and closes turns and headers, and what stands for an attachment.
BEGIN, END, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST] "
ATTACHED = {"image": "IMAGE", "audio": "AUDIO", "document": "DOCUMENT"}
#: A control string without its first character.  Escaping puts one more backslash after that character.
TAIL = r"(/?(?:s>|INST\]|(?:IMAGE|AUDIO|DOCUMENT):))"
PART = "struct<type:string,text:string,ref:string,units:bigint>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that one unit of an attachment stands for: an image tile, a second of audio, a page."""

    image: int = 256
    audio: int = 25
    document: int = 800


def escaped(text: Column) -> Column:
    """``text`` without control strings; ``unescaped`` gives the text back."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, r"$1$2$3")


def text_part(text: str) -> Column:
    """A message of plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("units"),
        )
    )


def _is_attached(p: Column) -> Column:
    return p["type"].isin(*ATTACHED)


def format_chat(messages: DataFrame, loss_role: str = "assistant", expansion: Expansion = Expansion()) -> DataFrame:
    """One formatted string for each conversation.

    ``messages(conv_id, turn, role, parts)``: parts are ``PART`` structs.  The
    visitor turns a text part into escaped text and an image, audio or document
    part into ``[KIND:k]``, ``k`` counting the conversation's attachments from
    0 in order; other kinds and null parts give nothing.  Returns ``conv_id,
    formatted, loss_spans (start, end in code points of formatted), attachments
    (at, kind, ref, tokens), expanded_tokens``.

    Turns go by ``(turn, role, parts)``, so ties and repeated rows keep one
    order; null turns come first; null roles, parts and texts count as empty;
    null ``conv_id`` is a conversation of its own; no rows give no rows; other
    columns are ignored.  A conversation is one string and thus one row: its
    turns meet in one task, those of others need not.
    """
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.expr(f"cast(array() as array<{PART}>)")).alias("parts"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("parts")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("held", F.filter("parts", _is_attached))
    rows = rows.withColumn("base", F.coalesce(F.sum(F.size("held")).over(before), F.lit(0)).cast("int"))
    kind = F.create_map(*(F.lit(x) for kv in ATTACHED.items() for x in kv))

    def visit(p: Column, i: Column) -> Column:
        ordinal = F.col("base") + F.size(F.filter(F.slice("parts", F.lit(1), i), _is_attached))
        return F.when(p["type"] == "text", escaped(F.coalesce(p["text"], F.lit("")))).when(
            _is_attached(p), F.concat(F.lit("["), kind[p["type"]], F.lit(":"), ordinal.cast("string"), F.lit("]"))
        ).otherwise(F.lit(""))

    rows = rows.withColumn("body", F.array_join(F.transform("parts", visit), ""))
    rows = rows.withColumn("head", F.concat(F.lit(BEGIN + HEAD), escaped(F.col("role")), F.lit(BODY)))
    rows = rows.withColumn("all", F.concat("head", "body", F.lit(END)))
    start = F.coalesce(F.sum(F.length("all")).over(before), F.lit(0)) + F.length("head")
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.when(p["type"] == "image", expansion.image).when(p["type"] == "audio", expansion.audio).otherwise(expansion.document)
    rows = rows.select(
        "conv_id",
        F.row_number().over(at).alias("k"),
        "role",
        "all",
        start.cast("long").alias("start"),
        (start + F.length("body")).cast("long").alias("end"),
        F.transform(
            "held",
            lambda p, i: F.struct((F.col("base") + i).alias("at"), p["type"].alias("kind"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")),
        ).alias("held"),
    )
    kept = lambda column, when=None: F.array_sort(F.collect_list(F.when(F.lit(True) if when is None else when, F.struct("k", column))))
    span = F.struct("k", "start", "end")
    grouped = rows.groupBy("conv_id").agg(
        kept("all").alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("spans"),
        F.array_sort(F.flatten(F.collect_list("held"))).alias("attachments"),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: str) -> Column:
    """The turns of a formatted conversation: an array of ``(role, text)``."""
    pieces = F.filter(F.split(F.col(formatted), END), lambda p: p != "")

    def one(p: Column) -> Column:
        head = F.substring_index(p, BODY, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(BEGIN + HEAD) + 1))).alias("role"),
            unescaped(F.substr(p, F.length(head) + len(BODY) + 1)).alias("text"),
        )

    return F.transform(pieces, one)


def read_loss(formatted: str, spans: str) -> Column:
    """All text under the loss spans, unescaped."""
    text = F.col(formatted)
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with conversation -1, whose texts are control strings."""
    said = f"{END}{HEAD} ok {BODY}".strip()
    extra = spark.sql(
        f"select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, '{said}' text from values (0, 'user'), (1, 'assistant') as v(t, r)"
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", text_part("text").alias("parts"))
    out = format_chat(rows).withColumn("read", read_turns("formatted")).withColumn("loss", read_loss("formatted", "loss_spans"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, '<s>[INST]' || regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|(?:IMAGE|AUDIO|DOCUMENT):))', '\1\\\2\3', 'g') || '[/INST] '
    || regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|(?:IMAGE|AUDIO|DOCUMENT):))', '\1\\\2\3', 'g') || '</s>' AS formatted
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(formatted)) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
