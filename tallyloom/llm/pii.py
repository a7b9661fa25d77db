"""Personal data spans: exact base patterns, and weakly supervised additions.

Everything that touches rows is DataFrame expressions.  Labelers vote on each
candidate; the votes are counted into a table of at most 5 x 3**4 rows, from
which expectation-maximisation estimates each labeler's reliability on the
driver and fits the span classifier, whose weights go back as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, documents

#: Kinds with a base definition, then all kinds: secrets (keys, tokens) are found by the labelers alone.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("pattern", "gazetteer", "context", "shape")

#: The base patterns, in forms that take linear time: what may not be retried is possessive, and a match starts only
#: where the leftmost one can.  Card: the runs that the plain pattern finds, of which those of 14 to 19 digits pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that the base patterns miss: spelled-out or bracketed signs, groups of a number with other separators.
#: Each needs what ordinary prose lacks, and none contains an unbounded repeat that could be entered twice.
EXTRA = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{](?:at|@)[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{](?:dot|\.)[)\]}])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[(\[{](?:\.|dot)[)\]}][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9./_])[0-9]{4}+([./_])[0-9]{4}+\1[0-9]{4}+\1[0-9]{2,7}+(?![0-9./_])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
#: Whether a text can match at all: plain searches before the patterns.
NEEDS = {"email": ("@", r"[(\[{](?i:at|@)[)\]}]"), "ip": (".", r"[0-9][(\[{]"), "card": (None, r"[0-9]{4}[./_][0-9]{4}"), "phone": ("+", r"[0-9)][\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"), "secret": (None, r"[A-Za-z0-9+/_-]{20}")}
#: Endings of mail domains, first digits of card issuers, calling codes: small lists, since they only vote.
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|in|br|ru|ch|at|be|pl|se"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|62"
TOKENS = r"AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[-_]|xox[abpr]-|eyJ"
CODES = r"1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|addr|ping|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|cell|fax|anruf|appel|llam)",
    "secret": r"(?i)(?:token|secret|key|passw|pwd|auth|bearer|credential)",
}
AGAINST = r"(?i)(?:isbn|version|\bv\.?\x20?$|order|invoice|\bno\.?\x20?$|serial|part|doi|date|sha-?[0-9]|md5|commit|digest|checksum|uuid)"
#: Usual written forms, which say nothing of where a candidate comes from.
FORM = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*(?:@|\x20?[(\[{](?:at|@)[)\]}]\x20?)[a-z0-9-]+(?:(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?)[a-z0-9-]+)*(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?)[a-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}[^0-9]{1,5}){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20(.-]*)?(?:\(?[0-9]{2,4}\)?[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}$",
    "secret": r"^(?:[A-Za-z]{2,8}[-_][A-Za-z0-9_-]{16,}|[A-Za-z0-9+/_-]{24,}={0,2})$",
}
SPAN = "struct<kind:string,start:bigint,end:bigint,said:string,before:string>"


def _found(text: str, kind: str, pattern: str, guard: Column) -> Column:
    """Matches of a pattern as ``SPAN`` structs: what stands between matches gives their places."""
    p = pattern.replace("'", "''")
    got = F.expr(
        rf"""aggregate(
          arrays_zip(split({text}, r'{p}', -1), regexp_extract_all({text}, r'{p}', 0)),
          cast(struct(0L, array()) as struct<at:bigint,out:array<{SPAN}>>),
          (acc, x) -> if(x['1'] is null, acc, cast(struct(
            acc.at + length(x['0']) + length(x['1']),
            concat(acc.out, array(named_struct('kind', '{kind}', 'start', acc.at + length(x['0']), 'end', acc.at + length(x['0']) + length(x['1']), 'said', x['1'], 'before', right(x['0'], 24))))
          ) as struct<at:bigint,out:array<{SPAN}>>)),
          acc -> acc.out)"""
    )
    return F.when(guard, got).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _strict(s: Column) -> Column:
    """What the base definition asks of a match, beyond its pattern."""
    d = _digits(s["said"])
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(s["kind"] == "ip", s["said"].rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(s["kind"] == "card", F.length(d).between(14, 19) & luhn(d))
        .when(s["kind"] == "phone", F.length(d).between(10, 15))
        .otherwise(F.lit(True))
    )


def _votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none.  None of them knows which pattern found the candidate."""
    said, kind, d = s["said"], s["kind"], _digits(s["said"])
    sign = lambda c: F.when(c, 1).otherwise(-1)
    by_kind = lambda of: F.coalesce(*(F.when(kind == k, v) for k, v in of.items()))
    form = by_kind({k: sign(said.rlike(p)) for k, p in FORM.items()})
    form = F.when((kind == "secret") & said.rlike("^[0-9a-f]+$"), 0).otherwise(form)  # a key or a plain hash
    listed = by_kind({
        "email": sign(said.rlike(rf"(?i)(?:{DOMAINS})$")),
        "ip": F.when(d.rlike("^(?:0|127|255)"), -1).otherwise(0),
        "card": sign(d.rlike(f"^(?:{ISSUERS})")),
        "phone": F.when(said.startswith("+"), sign(d.rlike(f"^(?:{CODES})"))).otherwise(0),
        "secret": F.when(said.rlike(f"^(?:{TOKENS})"), 1).otherwise(0),
    })
    near = by_kind({k: F.when(s["before"].rlike(FOR[k]), 1).otherwise(0) for k in KINDS})
    near = F.when(s["before"].rlike(AGAINST), -1).otherwise(near)
    parts = F.transform(F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0)), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))
    shape = by_kind({
        "email": sign(said.rlike(r"^[A-Za-z0-9]") & (F.length(said) <= 254)),
        "ip": sign(F.forall(parts, lambda p: p <= 255)),
        "card": sign(luhn(d)),
        "phone": sign(F.length(d).between(10, 15)),
        # Keys have many different signs, in no order: words and numbered names have not; but so have plain hashes.
        "secret": F.when((F.size(F.array_distinct(F.split(said, ""))) >= 10) & (F.length(d) * 8 >= F.length(said)), 0).otherwise(-1),
    })
    return {"pattern": form, "gazetteer": listed, "context": near, "shape": shape}


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: base spans (``base`` true) and further candidates, each with its votes.

    Further candidates are matches of base patterns that the base definition
    rejects, and other written forms; none overlaps a base span.
    """
    text = "__text"
    docs = docs.withColumn(text, F.coalesce("text", F.lit("")))
    base, extra = [], []
    for kind in KINDS:
        needs, hint = NEEDS[kind]
        if kind in BASE:
            first = F.col(text).contains(needs) if needs else F.lit(True)
            base.append(_found(text, kind, BASE[kind], first & F.col(text).rlike(BASE[kind])))
        extra.append(_found(text, kind, EXTRA[kind], F.col(text).rlike(hint)))
    docs = docs.withColumn("__all", F.concat(*base)).withColumn("__base", F.filter("__all", _strict))
    docs = docs.withColumn("__extra", F.concat(F.filter("__all", lambda s: ~_strict(s)), *extra))
    docs = docs.withColumn("__extra", F.filter("__extra", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))

    def voted(is_base: bool):
        def one(s: Column) -> Column:
            return F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("rank"), s["end"], s["kind"], F.lit(is_base).alias("base"), *(v.alias(k) for k, v in _votes(s).items()))

        return one

    every = F.concat(F.transform("__base", voted(True)), F.transform("__extra", voted(False)))
    return docs.withColumn("found", F.array_sort(every)).drop(text, "__all", "__base", "__extra")


def reliabilities(counts: list[tuple], rounds: int = 200) -> tuple[dict, dict]:
    """Dawid-Skene for one kind: ``counts`` are (votes, n) or (votes, n, known), ``known`` of the n being true by
    definition.  Returns P(true) of the others by votes, and P(vote | truth) by labeler.

    Beta priors, which weigh as a share of the candidates, keep labelers better
    than chance, so a labeler that always votes alike stays near its prior.  The
    shape labeler checks what true spans of a kind with a definition always
    have (a check digit, parts in range), so where some are known to be true
    its prior for those outweighs the corpus.
    """
    rows = [(v, n - sum(known), sum(known)) for v, n, *known in counts]
    # A labeler that objects weighs three times at the start: most check something that true spans always have.
    # The plain sum stays in the odds, or a kind on which only one labeler votes both ways would drift to one side.
    start = {v: 1.5 * sum(x if x > 0 else 3 * x for x in v) for v, *_ in rows}
    belief = {v: 1 / (1 + math.exp(-x)) for v, x in start.items()}
    table: dict = {}
    weight = max(1.0, sum(n for _, n, *_ in counts) / 25)
    for _ in range(rounds):
        table = {}
        for k in range(len(LABELERS)):
            for truth in (1, 0):
                seen = {x: weight * (4.0 if (x == 1) == bool(truth) and x else 1.0) for x in (-1, 0, 1)}
                if truth and LABELERS[k] == "shape" and any(known for *_, known in rows):
                    seen[1] += 20 * sum(n + known for _, n, known in rows)
                for v, n, known in rows:
                    seen[v[k]] += n * belief[v] + known if truth else n * (1 - belief[v])
                total = sum(seen.values())
                table[k, truth] = {x: s / total for x, s in seen.items()}
        total = sum(n + known for _, n, known in rows)
        prior = (1 + sum(n * belief[v] + known for v, n, known in rows)) / (2 + total)
        for v, *_ in rows:
            odds = sum(v) + math.log(prior / (1 - prior)) + sum(math.log(table[k, 1][x] / table[k, 0][x]) for k, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return belief, table


def span_classifier(counts: dict[str, list[tuple]], steps: int = 400, rate: float = 0.5) -> dict[str, list[float]]:
    """Logistic weights by kind, [bias, then a for and an against weight for each labeler], on EM's beliefs."""
    out = {}
    for kind in KINDS:
        rows = counts.get(kind, [])
        weights = [0.0] + [1.0, -1.0] * len(LABELERS)
        if rows:
            belief, _ = reliabilities(rows)
            inputs = [([1.0] + [float(x == s) for x in v for s in (1, -1)], belief[v], n - sum(known)) for v, n, *known in rows]
            inputs += [([1.0] + [float(x == s) for x in v for s in (1, -1)], 1.0, sum(known)) for v, _, *known in rows]
            total = sum(math.sqrt(n) for _, _, n in inputs)
            for _ in range(steps):
                slope = [0.0] * len(weights)
                for x, y, n in inputs:
                    p = 1 / (1 + math.exp(-sum(w * a for w, a in zip(weights, x, strict=True))))
                    for i, a in enumerate(x):
                        slope[i] += math.sqrt(n) * (p - y) * a
                weights = [w - rate * (s / total + 1e-3 * w) for w, s in zip(weights, slope, strict=True)]
        out[kind] = weights
    return out


def _score(s: Column, weights: dict[str, list[float]]) -> Column:
    total = F.lit(0.0)
    for kind in KINDS:
        w = weights[kind]
        sum_ = F.lit(w[0])
        for k, name in enumerate(LABELERS):
            sum_ = sum_ + F.when(s[name] == 1, w[1 + 2 * k]).when(s[name] == -1, w[2 + 2 * k]).otherwise(0.0)
        total = F.when(s["kind"] == kind, sum_).otherwise(total)
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: an array of ``(start, rank, end, kind, base, score)``, by start, then kind.

    Base spans always stay; further candidates stay where the span classifier
    gives ``threshold`` or more and no base span overlaps them; of several that
    start together of one kind, all do.  Places are
    code points, ends exclusive.  Null texts count as empty and have no spans;
    repeated rows are rows; an empty table stays empty.  ``docs`` may have any
    columns but ``found`` and ``spans``; all are kept, ``text`` only with ``keep_text``.
    """
    found = candidates(docs)
    stored = Stored(found if keep_text else found.drop("text"), "pii").df
    votes = stored.select(F.explode("found").alias("s")).groupBy("s.kind", *(f"s.{k}" for k in LABELERS)).agg(F.count("*").alias("n"), F.count_if("s.base").alias("known"))
    counts: dict[str, list[tuple]] = {}
    for r in votes.collect():
        counts.setdefault(r["kind"], []).append((tuple(r[k] for k in LABELERS), r["n"], r["known"]))
    weights = span_classifier({k: sorted(v) for k, v in counts.items()})
    scored = F.transform("found", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["base"], _score(s, weights).alias("score")))
    return stored.withColumn("spans", F.filter(scored, lambda s: s["base"] | (s["score"] >= threshold))).drop("found")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the later keeps its rest."""
    return F.expr(
        f"""aggregate({spans}, cast(struct(0L, array()) as struct<at:bigint,out:array<string>>),
          (acc, s) -> if(s.end <= acc.at, acc, cast(struct(s.end, concat(acc.out, array(
             substring({text}, cast(acc.at as int) + 1, cast(greatest(s.start, acc.at) - acc.at as int)), concat('[', upper(s.kind), ']')))) as struct<at:bigint,out:array<string>>)),
          acc -> concat(array_join(acc.out, ''), substring({text}, cast(acc.at as int) + 1)))"""
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["rank"] == k + 1)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]  # noqa: B023
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))
