"""Queries over the coding data: filters, datasets, weights, samples, agreement, workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, datasets, filters, lookups, sampling, weights, workflow
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (X.PRELUDE if prelude else "") + sql
        return f

    return put


# --- flagship --------------------------------------------------------------------------------------------------------


@query(
    "document_dataset",
    """, d AS (SELECT document_id, avg(label_10) AS label_10, avg(label_11) AS label_11 FROM by_coder WHERE NOT coder_is_mturk GROUP BY 1)
    SELECT d.document_id, CASE WHEN label_10 >= 0.4 THEN '10' ELSE '11' END AS label_id, o.date, o.document_type
    FROM d LEFT JOIN document o ON o.document_id = d.document_id""",
)
def document_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expert codes to one label per document: filter, one-hot by coder, mean over coders, threshold, document columns."""
    kept = filters.apply_chain(X.codes(spark, sf_dir), [filters.excluding_crowd])
    by_coder = datasets.document_coder(kept, (10, 11))
    by_document = datasets.document_aggregate(by_coder, "mean", ["label_10", "label_11"])
    labelled = by_document.select("document_id", datasets.discrete_label(["label_10", "label_11"], "11", 0.4).alias("label_id"))
    return datasets.with_documents(labelled, X.document(spark, sf_dir), ("date", "document_type"))


# --- scans and filters -----------------------------------------------------------------------------------------------

RAW = "document_id, coder_id, coder_name, coder_is_mturk, CAST(label_id AS INTEGER) AS label_id, label_value, question_id, question_name, consensus_ignore"
KEYS = "document_id, coder_id, label_id"


@query("raw_codes", f"SELECT {RAW}, length(text) AS text_length, date FROM code JOIN document USING (document_id)")
def raw_codes(spark, d):
    out = datasets.raw_codes(X.code_facts(spark, d), F.broadcast(X.coder(spark)), X.label(spark), X.question(spark), X.document(spark, d))
    return out.select("document_id", "coder_id", "coder_name", "coder_is_mturk", "label_id", "label_value", "question_id", "question_name", "consensus_ignore", F.length("text").cast("long").alias("text_length"), "date")


@query("raw_documents", "SELECT document_id, date, document_type, length(text) AS text_length FROM document WHERE language = 'en' AND text IS NOT NULL")
def raw_documents(spark, d):
    return X.document(spark, d).where("language = 'en' and text is not null").select("document_id", "date", "document_type", F.length("text").cast("long").alias("text_length"))


@query("frame_predicate", "SELECT DISTINCT document_id FROM document WHERE language = 'en' AND regexp_matches(text, '(?i)the') AND NOT regexp_matches(text, '(?i)licen[sc]e')")
def frame_predicate(spark, d):
    out = lookups.frame_predicate(X.document(spark, d), {"language": "en", "text__iregex": "the"}, {"text__iregex": "licen[sc]e"})
    return out.select("document_id").distinct()


@query("lookup_filter_or", "SELECT document_id FROM document WHERE contains(lower(text), 'de') OR contains(lower(document_type), 'de')")
def lookup_filter_or(spark, d):
    return lookups.lookup_filter(X.document(spark, d), ["text__icontains", "document_type__icontains"], "de", operator="or").select("document_id")


@query("lookup_filter_exclude", "SELECT document_id FROM document WHERE NOT regexp_matches(text, '[0-9]{4}')")
def lookup_filter_exclude(spark, d):
    return lookups.lookup_filter(X.document(spark, d), "text__regex", "[0-9]{4}", exclude=True).select("document_id")


@query("filter_by_date", "SELECT document_id, date FROM document WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-03-31'")
def filter_by_date(spark, d):
    return filters.by_date(X.document(spark, d), "2000-02-01", "2000-03-31").select("document_id", "date")


@query("filter_by_document_ids", f"SELECT {KEYS} FROM toxic WHERE document_id IN (SELECT document_id FROM document WHERE language = 'de')")
def filter_by_document_ids(spark, d):
    return filters.by_document_ids(X.codes(spark, d), X.document(spark, d).where("language = 'de'")).select("document_id", "coder_id", "label_id")


@query("filter_by_other_dataset", f"SELECT {KEYS} FROM code WHERE question_id = 2 AND document_id IN (SELECT document_id FROM truth WHERE label_id = 10)")
def filter_by_other_dataset(spark, d):
    return filters.by_other_dataset(X.codes(spark, d, 2), X.truth(spark, d), 10).select("document_id", "coder_id", "label_id")


@query(
    "filter_by_other_prediction",
    f"""SELECT {KEYS} FROM toxic WHERE document_id IN (SELECT document_id FROM prediction
    WHERE (CASE WHEN label_id = 11 THEN 1 - probability ELSE probability END) >= 0.3)""",
)
def filter_by_other_prediction(spark, d):
    decided = agreement.apply_threshold(X.prediction(spark, d), 0.3, 11, 10)
    return filters.by_other_dataset(X.codes(spark, d), decided, 10).select("document_id", "coder_id", "label_id")


def _coder_filter(name: str, where: str, f) -> None:
    query(name, f"SELECT {KEYS} FROM toxic WHERE {where}")(lambda spark, d: f(X.codes(spark, d)).select("document_id", "coder_id", "label_id"))


_coder_filter("exclude_by_coder_names", "coder_name NOT IN ('coder1', 'turk2')", lambda c: filters.excluding_coders(c, ["coder1", "turk2"]))
_coder_filter("filter_by_coder_names", "coder_name IN ('coder1', 'turk2')", lambda c: filters.only_coders(c, ["coder1", "turk2"]))
_coder_filter("exclude_experts", "coder_is_mturk", filters.excluding_experts)
_coder_filter("exclude_mturk", "NOT coder_is_mturk", filters.excluding_crowd)
_coder_filter(
    "min_coder_doc_count", "coder_id IN (SELECT coder_id FROM toxic GROUP BY 1 HAVING count(DISTINCT document_id) > 10)", lambda c: filters.coders_with_documents(c, 10)
)
_coder_filter(
    "require_all_coders",
    "document_id IN (SELECT document_id FROM toxic GROUP BY 1 HAVING count(DISTINCT coder_id) = (SELECT max(n) FROM (SELECT count(DISTINCT coder_id) AS n FROM toxic GROUP BY document_id)))",
    filters.coded_by_all,
)
_coder_filter("require_min_coder_count", "document_id IN (SELECT document_id FROM toxic GROUP BY 1 HAVING count(coder_id) >= 3)", lambda c: filters.coded_at_least(c, 3))
_coder_filter("code_filter", "label_value = '1'", lambda c: c.transform(lambda df: df.where("label_value = '1'")))
_coder_filter("consensus_exclusion", "NOT consensus_ignore", filters.excluding_consensus_ignored)


@query(
    "filter_chain",
    f""", a AS (SELECT * FROM toxic WHERE NOT consensus_ignore AND coder_name <> 'turk2'),
    n AS (SELECT document_id, count(DISTINCT coder_id) AS n FROM a GROUP BY 1)
    SELECT {KEYS} FROM a WHERE document_id IN (SELECT document_id FROM n WHERE n = (SELECT max(n) FROM n)) AND document_id IN (SELECT document_id FROM document WHERE language = 'en')""",
)
def filter_chain(spark, d):
    english = X.document(spark, d).where("language = 'en'")
    out = filters.apply_chain(
        X.codes(spark, d), [filters.excluding_consensus_ignored], [lambda c: filters.excluding_coders(c, ["turk2"]), filters.coded_by_all], [lambda c: filters.by_document_ids(c, english)]
    )
    return out.select("document_id", "coder_id", "label_id")


@query(
    "filter_hits",
    """, f AS (SELECT h.*, coalesce(n, 0) >= num_coders AS finished FROM hit h LEFT JOIN (SELECT hit_id, count(time_finished) AS n FROM assignment GROUP BY 1) USING (hit_id))
    SELECT hit_id, turk, num_coders, finished FROM f WHERE NOT turk AND finished AND hit_id NOT IN (SELECT hit_id FROM assignment WHERE coder_id IN (1, 2))""",
)
def filter_hits(spark, d):
    a = X.assignment(spark, d)
    return filters.hits(workflow.finished(X.hit(spark, d), a), a, experts_only=True, finished_only=True, exclude_coders=[1, 2]).select("hit_id", "turk", "num_coders", "finished")


@query(
    "filter_assignments",
    """SELECT DISTINCT assignment_id, coder_id, hit_id FROM assignment WHERE time_finished IS NOT NULL AND NOT uncodeable AND coder_id <> 3
    AND coder_id IN (SELECT coder_id FROM assignment GROUP BY 1 HAVING count(time_finished) >= 20)""",
)
def filter_assignments(spark, d):
    return filters.assignments(X.assignment(spark, d), completed_only=True, uncodeable=False, exclude_coders=[3], coder_min_hit_count=20).select("assignment_id", "coder_id", "hit_id")


@query("filter_coders", "SELECT coder_id, count(time_finished) AS n_completed FROM assignment GROUP BY 1 HAVING count(time_finished) >= 20")
def filter_coders(spark, d):
    return filters.coders(X.assignment(spark, d), 20)


@query("valid_weights", "SELECT count(DISTINCT probability) > 1 OR max(probability) <> 1.0 AS valid FROM prediction")
def valid_weights(spark, d):
    return filters.valid_weights(X.prediction(spark, d), "probability")


@query("keyword_flags", "SELECT document_id, search_the, search_license, search_digits, search_none FROM flagged")
def keyword_flags(spark, d):
    return sampling.keyword_flags(X.document(spark, d), X.PATTERNS).select("document_id", "search_the", "search_license", "search_digits", "search_none")


@query("mapped_variable", "SELECT document_id, year(date) || '_' || month(date) AS year_month FROM document")
def mapped_variable(spark, d):
    return X.document(spark, d).select("document_id", T.year_month(F.col("date")).alias("year_month"))


# --- datasets --------------------------------------------------------------------------------------------------------


@query("document_coder_label", f"SELECT {KEYS}, label_value FROM toxic")
def document_coder_label(spark, d):
    return X.codes(spark, d).select("document_id", "coder_id", "label_id", "label_value")


@query("index_uniqueness", "SELECT document_id, coder_id, label_id, count(*) AS n FROM code GROUP BY 1, 2, 3 HAVING count(*) > 1")
def index_uniqueness(spark, d):
    return datasets.duplicate_keys(X.codes(spark, d, None), ["document_id", "coder_id", "label_id"])


@query("document_coder", "SELECT * FROM by_coder")
def document_coder(spark, d):
    return datasets.document_coder(X.codes(spark, d), (10, 11))


@query(
    "bitstring_labels",
    """SELECT document_id, coder_id, concat_ws('', max((label_id = 10)::INT), max((label_id = 11)::INT), max((label_id = 20)::INT), max((label_id = 21)::INT)) AS label_id
    FROM code GROUP BY 1, 2""",
)
def bitstring_labels(spark, d):
    return datasets.bit_strings(X.codes(spark, d, None), X.LABELS)


def _document(how: str, sql: str) -> None:
    query(f"document_{how}", f"SELECT document_id, round({sql}(label_10), 6) AS label_10, round({sql}(label_11), 6) AS label_11 FROM by_coder GROUP BY 1")(
        lambda spark, d: X.rounded(datasets.document_aggregate(datasets.document_coder(X.codes(spark, d), (10, 11)), how, ["label_10", "label_11"]))
    )


for _how, _sql in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min")):
    _document(_how, _sql)


def _discrete(name: str, base: str | None, threshold: float | None, case: str) -> None:
    query(
        f"document_discrete_{name}",
        f", m AS (SELECT document_id, avg(label_10) AS a, avg(label_11) AS b FROM by_coder GROUP BY 1) SELECT document_id, {case} AS label_id FROM m",
    )(
        lambda spark, d: datasets.document_aggregate(datasets.document_coder(X.codes(spark, d), (10, 11)), "mean", ["label_10", "label_11"]).select(
            "document_id", datasets.discrete_label(["label_10", "label_11"], base, threshold).alias("label_id")
        )
    )


_discrete("thr_base", "11", 0.4, "CASE WHEN a >= 0.4 THEN '10' ELSE '11' END")
_discrete("thr_nobase", None, 0.6, "CASE WHEN greatest(a, b) >= 0.6 THEN CASE WHEN a >= b THEN '10' ELSE '11' END END")
_discrete("nothr_base", "11", None, "CASE WHEN a > 0 THEN '10' ELSE '11' END")
_discrete("nothr_nobase", None, None, "CASE WHEN greatest(a, b) > 0 THEN CASE WHEN a >= b THEN '10' ELSE '11' END END")
_discrete("thr_zero", "11", 0.0, "CASE WHEN a > 0 THEN '10' ELSE '11' END")


@query(
    "standardize_coders",
    """SELECT document_id, coder_id, round((label_10 - avg(label_10) OVER w) / nullif(stddev_samp(label_10) OVER w, 0), 6) AS label_10,
    round((label_11 - avg(label_11) OVER w) / nullif(stddev_samp(label_11) OVER w, 0), 6) AS label_11 FROM by_coder WINDOW w AS (PARTITION BY coder_id)""",
)
def standardize_coders(spark, d):
    out = datasets.standardize(datasets.document_coder(X.codes(spark, d), (10, 11)), ["label_10", "label_11"])
    return X.rounded(out.select("document_id", "coder_id", "label_10", "label_11"))


@query(
    "mode_by_document",
    """SELECT document_id, label_id FROM (SELECT document_id, label_id, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, label_id) AS r
    FROM toxic GROUP BY 1, 2) WHERE r = 1""",
)
def mode_by_document(spark, d):
    return datasets.mode(X.codes(spark, d), ["document_id"], "label_id")


@query("document_type", "SELECT document_id, CASE WHEN document_id IN (SELECT doc_id FROM labels) THEN 'labels' WHEN document_id IN (SELECT vec_id FROM embeddings) THEN 'embeddings' END AS document_type FROM document")
def document_type(spark, d):
    parents = [("labels", X.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))), ("embeddings", X.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id")))]
    return datasets.document_type(X.document(spark, d).select("document_id"), parents)


# --- weights and samples ---------------------------------------------------------------------------------------------

STRATA = """, f AS (SELECT language, count(*) AS frame_count FROM document GROUP BY 1), s AS (SELECT language, count(*) AS sample_count FROM sample_unit GROUP BY 1),
  st AS (SELECT language, coalesce(frame_count, 0) AS frame_count, coalesce(sample_count, 0) AS sample_count FROM f FULL JOIN s USING (language)),
  sp AS (SELECT *, frame_count / nullif(sum(frame_count) OVER (), 0) AS frame_pct, sample_count / nullif(sum(sample_count) OVER (), 0) AS sample_pct FROM st)"""


@query("frame_sample_strata", STRATA + " SELECT language, frame_count, sample_count, round(frame_pct, 6) AS frame_pct, round(sample_pct, 6) AS sample_pct FROM sp")
def frame_sample_strata(spark, d):
    return X.rounded(weights.strata(X.document(spark, d), X.sample_unit(spark, d), ["language"]))


@query("poststrat_weights", STRATA + " SELECT document_id, round(coalesce(frame_pct / sample_pct, 1), 6) AS weight FROM sample_unit LEFT JOIN sp USING (language)")
def poststrat_weights(spark, d):
    out = weights.poststratification(X.document(spark, d), X.sample_unit(spark, d), ["language"])
    return X.rounded(out.select("document_id", "weight"))


@query(
    "combined_weights",
    """, t AS (SELECT g.*, document_id IN (SELECT doc_id FROM labels) AS s FROM flagged g),
    n AS (SELECT *, count(*) OVER () AS N, sum(s::INT) OVER () AS n1 FROM t),
    w AS (SELECT document_id, s,
      (count(*) OVER k / N) / (sum(s::INT) OVER k / n1) AS keyword_weight, (count(*) OVER l / N) / (sum(s::INT) OVER l / n1) AS strat_weight,
      (count(*) OVER j / N) / (sum(s::INT) OVER j / n1) AS weight FROM n
      WINDOW k AS (PARTITION BY search_the, search_license), l AS (PARTITION BY language), j AS (PARTITION BY search_the, search_license, language))
    SELECT document_id, round(keyword_weight, 6) AS keyword_weight, round(strat_weight, 6) AS strat_weight, CAST(NULL AS DOUBLE) AS additional_weight,
      round(keyword_weight * strat_weight, 6) AS approx_weight, round(weight, 6) AS weight FROM w WHERE s""",
)
def combined_weights(spark, d):
    frame = sampling.keyword_flags(X.document(spark, d), X.PATTERNS).select("document_id", "language", "search_the", "search_license")
    sample = frame.join(X.truth(spark, d).select("document_id"), "document_id", "left_semi")
    out = weights.combined(frame, sample, ["search_the", "search_license"], ["language"], [])
    return X.rounded(out.select("document_id", "keyword_weight", "strat_weight", "additional_weight", "approx_weight", "weight"))


@query("join_weights", STRATA + f", w AS (SELECT document_id, frame_pct / sample_pct AS w FROM sample_unit JOIN sp USING (language)) SELECT {KEYS}, round(coalesce(w, 1), 6) AS sampling_weight FROM toxic LEFT JOIN w USING (document_id)")
def join_weights(spark, d):
    w = weights.poststratification(X.document(spark, d), X.sample_unit(spark, d), ["language"]).select("document_id", F.col("weight").alias("sampling_weight"))
    out = X.codes(spark, d).join(w, "document_id", "left").withColumn("sampling_weight", F.coalesce("sampling_weight", F.lit(1.0)))
    return X.rounded(out.select("document_id", "coder_id", "label_id", "sampling_weight"))


@query("balancing_weights", ", g AS (SELECT document_type, count(*) AS n_g FROM sample_unit GROUP BY 1) SELECT document_id, round((SELECT sum(n_g) FROM g) / ((SELECT count(*) FROM g) * n_g), 6) AS balancing_weight FROM sample_unit JOIN g USING (document_type)")
def balancing_weights(spark, d):
    return X.rounded(weights.balancing(X.sample_unit(spark, d), ["document_type"]).select("document_id", "balancing_weight"))


CLASS = ", c AS (SELECT label_id, count(*) AS w_c FROM truth GROUP BY 1), k AS (SELECT label_id, (SELECT sum(w_c) / count(*) FROM c) / w_c AS factor FROM c)"


@query("class_weights", CLASS + " SELECT document_id, round(factor, 6) AS weight FROM truth JOIN k USING (label_id)")
def class_weights(spark, d):
    return X.rounded(weights.class_balanced(X.truth(spark, d).withColumn("weight", F.lit(1.0)), "label_id", "weight").select("document_id", "weight"))


@query(
    "training_weight",
    STRATA
    + """, g AS (SELECT document_type, count(*) AS n_g FROM sample_unit GROUP BY 1),
    b AS (SELECT document_id, (SELECT sum(n_g) FROM g) / ((SELECT count(*) FROM g) * n_g) * (frame_pct / sample_pct) AS w, label_id
      FROM sample_unit JOIN g USING (document_type) JOIN sp USING (language) JOIN truth USING (document_id))
    SELECT document_id, round(w * (sum(w) OVER () / (SELECT count(DISTINCT label_id) FROM b)) / sum(w) OVER (PARTITION BY label_id), 6) AS weight FROM b""",
)
def training_weight(spark, d):
    s = weights.balancing(weights.poststratification(X.document(spark, d), X.sample_unit(spark, d), ["language"], "sampling_weight"), ["document_type"])
    s = s.join(X.truth(spark, d), "document_id").withColumn("weight", weights.training_weight("sampling_weight", "balancing_weight"))
    return X.rounded(weights.class_balanced(s, "label_id", "weight").select("document_id", "weight"))


@query(
    "weighted_moments",
    """WITH m AS (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS mean, sum(l_quantity) AS w FROM lineitem)
    SELECT round(any_value(mean), 8) AS mean, round(1 / sqrt(any_value(w)), 8) AS error, round(sqrt(sum(l_quantity ** 2 * (l_discount - mean) ** 2)) / any_value(w), 8) AS calculated_error,
    round(sqrt(sum(l_quantity * (l_discount - mean) ** 2) / any_value(w)), 8) AS sdev FROM lineitem, m""",
    prelude=False,
)
def weighted_moments(spark, d):
    return X.rounded(weights.weighted_moments(X.table(spark, d, "lineitem"), "l_discount", "l_quantity"), digits=8)


def _draw(seed: int) -> str:
    return f"md5('{seed}_' || document_id)"


@query("sample_random", f"SELECT document_id FROM document ORDER BY {_draw(42)}, document_id LIMIT 100")
def sample_random(spark, d):
    return sampling.simple(X.document(spark, d).select("document_id"), 100, 42)


QUOTA = """, c AS (SELECT language, count(*) AS available, row_number() OVER (ORDER BY language) AS i FROM document GROUP BY 1),
  q AS (SELECT *, 100.0 * available / sum(available) OVER () AS exact, count(*) OVER () AS h FROM c),
  r AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, language) AS o, 100 - sum(floor(exact)) OVER () AS short FROM q)"""


def _stratified(name: str, strategy: str, quota: str) -> None:
    query(
        name,
        QUOTA + f""", u AS (SELECT language, least({quota}, available) AS quota FROM r),
        k AS (SELECT document_id, language, row_number() OVER (PARTITION BY language ORDER BY {_draw(42)}, document_id) AS n FROM document)
        SELECT document_id, language FROM k JOIN u USING (language) WHERE n <= quota""",
    )(lambda spark, d: sampling.stratified(X.document(spark, d).select("document_id", "language"), ["language"], 100, 42, strategy).select("document_id", "language"))


_stratified("sample_stratified", "stratify", "low + (o <= short)::INT")
_stratified("sample_even", "stratify_even", "floor(100 / h) + (i <= 100 - floor(100 / h) * h)::INT")
_stratified("sample_guaranteed", "stratify_guaranteed", "greatest(1, low + (o <= short)::INT)")


def _part(flag: str, n: int) -> str:
    return f"(SELECT document_id FROM flagged WHERE {flag} ORDER BY {_draw(42)}, document_id LIMIT {n})"


@query(
    "sample_keyword",
    f""", u AS (SELECT DISTINCT document_id FROM ({_part("search_none", 40)} UNION ALL {_part("search_license", 30)} UNION ALL {_part("search_digits", 30)}))
    SELECT document_id FROM document ORDER BY (document_id NOT IN (SELECT document_id FROM u)), {_draw(42)}, document_id LIMIT 100""",
)
def sample_keyword(spark, d):
    flagged = sampling.keyword_flags(X.document(spark, d), X.PATTERNS).drop("text")
    return sampling.keyword_oversample(flagged, {"license": 0.3, "digits": 0.3}, 100, 42)


@query("sample_fill", f", f AS (SELECT document_id FROM sample_unit WHERE document_id % 7 = 0) SELECT document_id FROM document ORDER BY (document_id NOT IN (SELECT document_id FROM f)), {_draw(7)}, document_id LIMIT 150")
def sample_fill(spark, d):
    drawn = X.sample_unit(spark, d).where("document_id % 7 = 0").select("document_id")
    return sampling.fill_up(X.document(spark, d).select("document_id"), drawn, 150, 7)


@query(
    "expand_samples",
    f""", m AS (SELECT language, round_even(count(*) * 0.25, 0) AS more FROM sample_unit GROUP BY 1),
    k AS (SELECT document_id, language, row_number() OVER (PARTITION BY language ORDER BY {_draw(9)}, document_id) AS n FROM document WHERE document_id NOT IN (SELECT document_id FROM sample_unit))
    SELECT document_id FROM sample_unit UNION ALL SELECT document_id FROM k JOIN m USING (language) WHERE n <= more""",
)
def expand_samples(spark, d):
    frame = X.document(spark, d).select("document_id", "language")
    return sampling.expand(frame, X.sample_unit(spark, d).select("document_id"), ["language"], 0.25, 9)


@query("anti_join_unsampled", "SELECT document_id FROM document WHERE document_id NOT IN (SELECT document_id FROM sample_unit)")
def anti_join_unsampled(spark, d):
    return sampling.unsampled(X.document(spark, d).select("document_id"), X.sample_unit(spark, d))


@query("sync_with_frame", "SELECT document_id FROM sample_unit WHERE language = 'en'")
def sync_with_frame(spark, d):
    return sampling.in_frame(X.sample_unit(spark, d).select("document_id"), X.document(spark, d).where("language = 'en'"))


@query("stratified_folds", f"SELECT document_id, label_id, CAST((row_number() OVER (PARTITION BY label_id ORDER BY {_draw(5)}, document_id) - 1) % 5 AS INTEGER) AS fold FROM truth")
def stratified_folds(spark, d):
    return sampling.folds(X.truth(spark, d), "label_id", 5, 5)


@query("train_test_split", f", r AS (SELECT document_id, row_number() OVER (ORDER BY {_draw(5)}, document_id) AS n, count(*) OVER () AS c FROM truth) SELECT document_id, n <= ceil(c * 0.2 - 1e-9) AS is_test FROM r")
def train_test_split(spark, d):
    return sampling.train_test(X.truth(spark, d).select("document_id"), 0.2, 5)


# --- agreement -------------------------------------------------------------------------------------------------------

PAIRS = ", p AS (SELECT a.document_id, a.coder_id AS coder1, b.coder_id AS coder2, a.label_id AS y1, b.label_id AS y2 FROM toxic a JOIN toxic b ON a.document_id = b.document_id AND a.coder_id <> b.coder_id)"
BINARY = """SELECT {keys}, count(*) AS n, sum((t AND g)::DOUBLE) AS tp, sum((NOT t AND g)::DOUBLE) AS fp, sum((t AND NOT g)::DOUBLE) AS fn, sum((NOT t AND NOT g)::DOUBLE) AS tn FROM {source} GROUP BY {keys}"""
METRICS = """round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)) / nullif(1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n), 0), 6) AS cohens_kappa,
  round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS matthews_corrcoef,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS roc_auc,
  round(1 - ((fp + fn) / n) / nullif(1 - ((2 * tp + fp + fn) * (2 * tp + fp + fn - 1) + (2 * tn + fp + fn) * (2 * tn + fp + fn - 1)) / (2.0 * n * (2.0 * n - 1)), 0), 6) AS alpha_unweighted"""
SCORES = ("accuracy", "precision", "recall", "f1", "cohens_kappa", "matthews_corrcoef", "roc_auc", "alpha_unweighted")


@query("coder_pairs", PAIRS + " SELECT document_id, coder1, coder2, y1, y2 FROM p")
def coder_pairs(spark, d):
    return agreement.coder_pairs(X.codes(spark, d)).drop("w")


@query("coder_pairs_unordered", PAIRS + " SELECT document_id, coder1, coder2, y1, y2 FROM p WHERE coder1 < coder2 AND coder1 <= 2 AND coder2 <= 2")
def coder_pairs_unordered(spark, d):
    return agreement.coder_pairs(filters.excluding_crowd(X.codes(spark, d))).drop("w")


@query(
    "irr_pairwise_by_label",
    PAIRS + ", v AS (SELECT coder1, coder2, x AS value, y1 = x AS t, y2 = x AS g FROM p, (VALUES (10), (11)) AS u(x)), b AS (" + BINARY.format(keys="coder1, coder2, value", source="v") + f") SELECT coder1, coder2, n, 'label_id__' || value AS outcome_column, {METRICS} FROM b WHERE n >= 10",
)
def irr_pairwise_by_label(spark, d):
    out = agreement.scores_by_value(X.codes(spark, d), values=[10, 11])
    return X.rounded(out.select("coder1", "coder2", "n", "outcome_column", *SCORES))


@query(
    "irr_pairwise_overall",
    PAIRS + ", v AS (SELECT coder1, coder2, y1 = 10 AS t, y2 = 10 AS g FROM p), b AS (" + BINARY.format(keys="coder1, coder2", source="v") + """),
    m AS (SELECT *, tp + fn AS t1, tn + fp AS t0, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
      CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0 FROM b)
    SELECT coder1, coder2, n, round((tp + tn) / n, 6) AS accuracy, round((t1 * p1 + t0 * p0) / n, 6) AS "precision", round((t1 * r1 + t0 * r0) / n, 6) AS recall,
      round(((tp + tn) / n - (t1 * (tp + fp) + t0 * (tn + fn)) / (n * n)) / nullif(1 - (t1 * (tp + fp) + t0 * (tn + fn)) / (n * n), 0), 6) AS cohens_kappa,
      round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS matthews_corrcoef,
      round(1 - ((fp + fn) / n) / nullif(1 - ((2 * tp + fp + fn) * (2 * tp + fp + fn - 1) + (2 * tn + fp + fn) * (2 * tn + fp + fn - 1)) / (2.0 * n * (2.0 * n - 1)), 0), 6) AS alpha_unweighted
    FROM m WHERE n >= 10""",
)
def irr_pairwise_overall(spark, d):
    out = agreement.scores_overall(X.codes(spark, d))
    return X.rounded(out.select("coder1", "coder2", "n", "accuracy", "precision", "recall", "cohens_kappa", "matthews_corrcoef", "alpha_unweighted"))


@query(
    "irr_two_datasets",
    ", v AS (SELECT 1 AS one, t.label_id = 10 AS t, p.label_id = 10 AS g FROM truth t JOIN prediction p USING (document_id)), b AS (" + BINARY.format(keys="one", source="v") + f") SELECT 'dataset1' AS coder1, 'dataset2' AS coder2, n, {METRICS} FROM b",
)
def irr_two_datasets(spark, d):
    both = agreement.as_coders(X.truth(spark, d), X.prediction(spark, d))
    out = agreement.scores_by_value(both, values=[10], ordered=False)
    return X.rounded(out.select("coder1", "coder2", "n", *SCORES))


@query(
    "irr_overall_alpha_fleiss",
    """, c AS (SELECT document_id, label_id, count(*) AS c FROM toxic GROUP BY 1, 2), m AS (SELECT document_id, sum(c) AS m, sum(c * (c - 1)) AS pairs FROM c GROUP BY 1 HAVING sum(c) > 1),
    k AS (SELECT label_id, sum(c) AS k FROM c WHERE document_id IN (SELECT document_id FROM m) GROUP BY 1),
    t AS (SELECT sum(m)::DOUBLE AS n, sum(pairs / (m - 1)) AS o, avg(pairs / (m * (m - 1))) AS po FROM m), e AS (SELECT sum(k * (k - 1))::DOUBLE AS kk, sum(k * k)::DOUBLE AS k2 FROM k)
    SELECT round(1 - (1 - o / n) / (1 - kk / (n * (n - 1))), 6) AS alpha, round((po - k2 / (n * n)) / (1 - k2 / (n * n)), 6) AS fleiss_kappa FROM t, e""",
)
def irr_overall_alpha_fleiss(spark, d):
    return X.rounded(agreement.overall(X.codes(spark, d)))


def _judged(spark, d) -> DataFrame:
    p = X.prediction(spark, d).withColumnRenamed("label_id", "predicted")
    return X.truth(spark, d).join(p, "document_id")


JUDGED = ", v AS (SELECT t.label_id AS a, p.label_id AS b, p.probability AS w FROM truth t JOIN prediction p USING (document_id)), s AS (SELECT sum(w) AS w, sum(w * (a = 10 AND b = 10)::INT) AS tp, sum(w * (a <> 10 AND b = 10)::INT) AS fp, sum(w * (a = 10 AND b <> 10)::INT) AS fn, sum(w * (a <> 10 AND b <> 10)::INT) AS tn FROM v)"


@query("scorer_cohens_kappa", JUDGED + " SELECT round(((tp + tn) / w - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (w * w)) / (1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (w * w)), 6) AS score FROM s")
def scorer_cohens_kappa(spark, d):
    return X.rounded(agreement.cohens_kappa(_judged(spark, d), "label_id", "predicted", "probability"))


@query("scorer_matthews", JUDGED + " SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS score FROM s")
def scorer_matthews(spark, d):
    return X.rounded(agreement.matthews_corrcoef(_judged(spark, d), "label_id", "predicted", "probability"))


@query("scorer_maxmin", JUDGED + " SELECT round(least(tp / (tp + fp), tp / (tp + fn), tn / (tn + fn), tn / (tn + fp)), 6) AS score FROM s")
def scorer_maxmin(spark, d):
    return X.rounded(agreement.maxmin(_judged(spark, d), "label_id", "predicted", "probability"))


@query("scorer_mean_difference", JUDGED + " SELECT round(least(sum(a * w), sum(b * w)) / greatest(sum(a * w), sum(b * w)), 6) AS score FROM v")
def scorer_mean_difference(spark, d):
    return X.rounded(agreement.mean_difference(_judged(spark, d), "label_id", "predicted", "probability"))


@query("confusion_matrix", JUDGED + " SELECT a AS truth, b AS predicted, count(*) AS n FROM v GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return agreement.confusion_matrix(_judged(spark, d), "label_id", "predicted")


@query(
    "classification_report",
    JUDGED + """, r AS (SELECT 10 AS label, tp, fp, fn, tn FROM s UNION ALL SELECT 11, tn, fn, fp, tp FROM s)
    SELECT label, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp + fn, 6) AS support FROM r""",
)
def classification_report(spark, d):
    return X.rounded(agreement.classification_report(_judged(spark, d), "label_id", "predicted", "probability"))


PLUS = "(CASE WHEN label_id = 11 THEN 1 - probability ELSE probability END)"


@query("apply_threshold", f"SELECT document_id, CASE WHEN {PLUS} >= 0.6 THEN 10 ELSE 11 END AS label_id, round(probability, 6) AS probability FROM prediction")
def apply_threshold(spark, d):
    return X.rounded(agreement.apply_threshold(X.prediction(spark, d), 0.6, 11, 10))


@query(
    "rethreshold",
    """SELECT document_id, CASE WHEN label_id = 11 AND probability <= 1 - 0.7 THEN 10 WHEN label_id = 10 AND probability < 0.7 THEN 11 ELSE label_id END AS label_id,
    round(CASE WHEN (label_id = 11 AND probability <= 1 - 0.7) OR (label_id = 10 AND probability < 0.7) THEN 1 - probability ELSE probability END, 6) AS probability FROM prediction""",
)
def rethreshold(spark, d):
    return X.rounded(agreement.rethreshold(X.prediction(spark, d), 0.7, 11, 10))


SWEEP = f", u AS (SELECT x::DOUBLE / 20 AS threshold FROM range(20) AS r(x)), v AS (SELECT threshold, t.label_id = 10 AS t, (CASE WHEN p.label_id = 11 THEN 1 - probability ELSE probability END) >= threshold AS g FROM truth t JOIN prediction p USING (document_id), u), b AS ({BINARY.format(keys='threshold', source='v')})"
THRESHOLDS = [k / 20 for k in range(20)]


@query("threshold_sweep", SWEEP + f" SELECT threshold, n, {METRICS} FROM b")
def threshold_sweep(spark, d):
    out = agreement.threshold_scores(X.prediction(spark, d), X.truth(spark, d), 11, 10, THRESHOLDS)
    return X.rounded(out.select("threshold", "n", *SCORES))


@query("best_threshold", SWEEP + ", m AS (SELECT threshold, least(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS s FROM b) SELECT round(avg(threshold), 6) AS threshold FROM m WHERE s = (SELECT max(s) FROM m)")
def best_threshold(spark, d):
    return X.rounded(agreement.best_threshold(agreement.threshold_scores(X.prediction(spark, d), X.truth(spark, d), 11, 10, THRESHOLDS)))


@query("incorrect_predictions", "SELECT t.document_id, t.label_id AS truth, p.label_id AS predicted FROM truth t LEFT JOIN prediction p USING (document_id) WHERE t.label_id IS DISTINCT FROM p.label_id")
def incorrect_predictions(spark, d):
    return agreement.incorrect(X.truth(spark, d), X.prediction(spark, d))


# --- workflow --------------------------------------------------------------------------------------------------------


@query(
    "progress_rollup",
    """, c AS (SELECT hit_id, count(time_finished) AS done, sum(uncodeable::INT) AS u FROM assignment GROUP BY 1)
    SELECT count(*) AS total_hits, count(*) FILTER (WHERE done >= num_coders) AS completed_hits, count(*) FILTER (WHERE done < num_coders) AS available_hits,
    count(*) FILTER (WHERE u > 0) AS uncodeable_hits, sum(num_coders)::BIGINT AS total_assignments, sum(done)::BIGINT AS completed_assignments FROM hit JOIN c USING (hit_id)""",
)
def progress_rollup(spark, d):
    return workflow.progress(X.hit(spark, d), X.assignment(spark, d))


@query("coder_progress", "SELECT coder_id, count(time_finished) AS n_completed, count(DISTINCT hit_id) AS n_hits FROM assignment GROUP BY 1")
def coder_progress(spark, d):
    return workflow.coder_progress(X.assignment(spark, d))


@query("classification_counts", "SELECT question_id, label_id, count(*) AS n FROM code GROUP BY 1, 2")
def classification_counts(spark, d):
    return workflow.classification_counts(X.codes(spark, d, None))


@query(
    "disagreements",
    """, e AS (SELECT * FROM code WHERE NOT coder_is_mturk AND NOT consensus_ignore)
    SELECT hit_id, question_id, label_id, min(coder_id) AS first_coder FROM e WHERE (hit_id, question_id) IN (SELECT (hit_id, question_id) FROM e GROUP BY hit_id, question_id HAVING count(DISTINCT label_id) > 1)
    GROUP BY 1, 2, 3""",
)
def disagreements(spark, d):
    return workflow.disagreements(X.codes(spark, d, None))


@query("next_hit", ", n AS (SELECT hit_id, count(time_finished) AS done FROM assignment GROUP BY 1) SELECT hit_id FROM hit JOIN n USING (hit_id) WHERE NOT turk AND done < num_coders AND hit_id NOT IN (SELECT hit_id FROM assignment WHERE coder_id = 5) ORDER BY md5('3_' || hit_id), hit_id LIMIT 1")
def next_hit(spark, d):
    return workflow.next_hit(X.hit(spark, d), X.assignment(spark, d), 5, 3).select("hit_id")


def _pay(spark, d) -> DataFrame:
    a = X.assignment(spark, d)
    return workflow.annual_compensation(a.withColumnsRenamed({"time_finished": "approved_at", "ts": "submitted_at"}), 2024, include_pending=True)


PAY = ", pay AS (SELECT coder_id, sum(reward) AS compensation FROM assignment WHERE year(time_finished) = 2024 OR (time_finished IS NULL AND year(ts) = 2024) GROUP BY 1)"


@query("annual_compensation", PAY + " SELECT coder_id, round(compensation, 4) AS compensation FROM pay")
def annual_compensation(spark, d):
    return X.rounded(_pay(spark, d), digits=4)


@query("over_limit_blocks", PAY + ", b AS (SELECT DISTINCT coder_id FROM assignment WHERE coder_id % 5 = 0), o AS (SELECT coder_id FROM pay WHERE compensation >= 600) SELECT coder_id, 'block' AS change FROM o WHERE coder_id NOT IN (SELECT coder_id FROM b) UNION ALL SELECT coder_id, 'unblock' FROM b WHERE coder_id NOT IN (SELECT coder_id FROM o)")
def over_limit_blocks(spark, d):
    blocked = X.assignment(spark, d).where("coder_id % 5 = 0").select("coder_id").distinct()
    new, old = workflow.block_changes(_pay(spark, d), blocked, 600)
    return new.withColumn("change", F.lit("block")).union(old.withColumn("change", F.lit("unblock")))


@query("blocks_by_reason", "SELECT CASE WHEN coder_id % 2 = 0 THEN 'even' ELSE 'odd' END AS reason, array_to_string(list_sort(list(DISTINCT coder_id)), ',') AS coder_ids FROM assignment GROUP BY 1")
def blocks_by_reason(spark, d):
    blocks = X.assignment(spark, d).select("coder_id", F.when(F.col("coder_id") % 2 == 0, "even").otherwise("odd").alias("reason")).distinct()
    return workflow.blocks_by_reason(blocks).select("reason", F.array_join(F.transform("coder_ids", lambda c: c.cast("string")), ",").alias("coder_ids"))


@query("wide_export", ", n AS (SELECT coder_name, document_id, 'n' || (document_id % 3) AS notes FROM toxic WHERE document_id % 2 = 0) SELECT coder_name, document_id, max(label_value) FILTER (WHERE question_id = 1) AS toxic, max(label_value) FILTER (WHERE question_id = 2) AS quality, any_value(n.notes) AS notes FROM code LEFT JOIN n USING (coder_name, document_id) GROUP BY 1, 2")
def wide_export(spark, d):
    notes = X.codes(spark, d).where("document_id % 2 = 0").select("coder_name", "document_id", F.concat(F.lit("n"), (F.col("document_id") % 3).cast("string")).alias("notes"))
    return workflow.wide_export(X.codes(spark, d, None), ["toxic", "quality"], notes)


@query("preview_top100", "SELECT document_id, round(probability, 6) AS probability FROM prediction WHERE label_id = 10 ORDER BY probability DESC, document_id LIMIT 100")
def preview_top100(spark, d):
    return X.rounded(workflow.preview(X.prediction(spark, d), 10).select("document_id", "probability"))


@query("upsert_predictions", "SELECT document_id, label_id, round(probability, 6) AS probability FROM prediction WHERE document_id NOT IN (SELECT document_id FROM truth) UNION ALL SELECT document_id, label_id, 1.0 FROM truth")
def upsert_predictions(spark, d):
    return X.rounded(workflow.upsert(X.prediction(spark, d), X.truth(spark, d).withColumn("probability", F.lit(1.0)), ["document_id"]))


@query(
    "dependency_chain",
    """WITH RECURSIVE l AS (SELECT 'n' || n_nationkey AS label, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL),
    c AS (SELECT label, parent AS ancestor, 1 AS depth FROM l WHERE parent IS NOT NULL UNION ALL SELECT c.label, l.parent, c.depth + 1 FROM c JOIN l ON l.label = c.ancestor WHERE l.parent IS NOT NULL)
    SELECT label, ancestor, depth FROM c""",
    prelude=False,
)
def dependency_chain(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = X.table(spark, d, "nation").select(key("n", "n_nationkey").alias("label"), key("r", "n_regionkey").alias("parent"))
    region = X.table(spark, d, "region").select(key("r", "r_regionkey").alias("label"), F.lit("root").alias("parent"))
    root = spark.sql("select 'root' label, cast(null as string) parent")
    return workflow.dependency_chain(nation.union(region).union(root))


@query("union_projects", "SELECT c_nationkey AS project FROM customer UNION SELECT s_nationkey FROM supplier", prelude=False)
def union_projects(spark, d):
    return X.table(spark, d, "customer").select(F.col("c_nationkey").alias("project")).union(X.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query(
    "set_ops",
    """SELECT 'except' AS op, c_nationkey AS project FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)
    UNION ALL SELECT 'intersect', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)""",
    prelude=False,
)
def set_ops(spark, d):
    a = X.table(spark, d, "customer").where("c_custkey % 40 = 0").select(F.col("c_nationkey").alias("project"))
    b = X.table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("project"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "project")
    return named("except", a.subtract(b)).union(named("intersect", a.intersect(b)))
