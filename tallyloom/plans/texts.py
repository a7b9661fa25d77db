"""Queries over texts and vectors: cleaning, counts, term weights, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, workflow
from . import fixtures as X
from .coding import query


def _docs(spark, d):
    return X.document(spark, d).select("document_id", "text")


@query(
    "regex_counts",
    """, c AS (SELECT document_id, len(regexp_extract_all(text, '(?i)the')) AS n, len(regexp_extract_all(text, '[0-9]{4}')) AS m FROM document)
    SELECT document_id, n AS the_count, (n > 0)::INT AS the_has_match, n * n AS the_count_sq, round(ln(n + 1), 6) AS the_count_log,
    m AS digits_count, (m > 0)::INT AS digits_has_match, m * m AS digits_count_sq, round(ln(m + 1), 6) AS digits_count_log FROM c""",
)
def regex_counts(spark, d):
    return X.rounded(features.regex_counts(_docs(spark, d), {"the": "(?i)the", "digits": "[0-9]{4}"}))


@query(
    "punctuation_indicators",
    r""", c AS (SELECT document_id, len(regexp_extract_all(text, '\$([0-9]{1,3}(?:(?:,[0-9]{3})+)?(?:\.[0-9]{1,2})?)\s')) AS a, len(regexp_extract_all(text, '\$[0-9]{1,3}(?:,[0-9]{3})+\s')) AS b,
    len(regexp_extract_all(text, '(?i)thousand*|million*|billion*|hundred*')) AS c, len(regexp_extract_all(text, '!')) AS e FROM document)
    SELECT document_id, a AS dollars_count, (a > 0)::INT AS dollars_any, b AS dollars_alt_count, (b > 0)::INT AS dollars_alt_any, c AS amounts_count, (c > 0)::INT AS amounts_any,
    e AS exclamation_count, (e > 0)::INT AS exclamation_any FROM c""",
)
def punctuation_indicators(spark, d):
    return features.punctuation(_docs(spark, d))


# DuckDB has no look-behind: white space is doubled, so that each match can take the one before it.
_PADDED = r"regexp_replace(' ' || text || ' ', '(\s)', '\1\1', 'g')"


@query(
    "ngram_set_counts",
    rf"""SELECT document_id, len(regexp_extract_all({_PADDED}, '(?i)\s(the|and|of)[^a-zA-Z0-9_]')) AS "ngram__function", len(regexp_extract_all({_PADDED}, '(?i)\s(th|er)[a-zA-Z0-9_]')) AS "ngram__stems",
    len(regexp_extract_all({_PADDED}, '(?i)\s(?:an[a-zA-Z0-9_]|(?:in|licensed)[^a-zA-Z0-9_])')) AS "ngram__mixed" FROM document""",
)
def ngram_set_counts(spark, d):
    return features.ngram_sets(_docs(spark, d), X.LEXICON)


@query(
    "ngram_set_words",
    rf"""SELECT document_id, len(regexp_extract_all({_PADDED}, '(?i)\s(the|and|of)[^a-zA-Z0-9_]')) AS "ngram__function", len(regexp_extract_all({_PADDED}, '(?i)\s(the)[^a-zA-Z0-9_]')) AS "ngram__function__the",
    len(regexp_extract_all({_PADDED}, '(?i)\s(and)[^a-zA-Z0-9_]')) AS "ngram__function__and", len(regexp_extract_all({_PADDED}, '(?i)\s(of)[^a-zA-Z0-9_]')) AS "ngram__function__of" FROM document""",
)
def ngram_set_words(spark, d):
    return features.ngram_sets(_docs(spark, d), {"function": X.LEXICON["function"]}, include_words=True)


@query(
    "lexicon_shares",
    rf""", c AS (SELECT document_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, len(regexp_extract_all({_PADDED}, '(?i)\s(the|and|of)[^a-zA-Z0-9_]')) AS c FROM document)
    SELECT document_id, 'function' AS ngram_set, c AS "count", round(coalesce(c / nullif(n, 0), 0), 6) AS "percent" FROM c""",
)
def lexicon_shares(spark, d):
    return X.rounded(features.lexicon_shares(_docs(spark, d), {"function": X.LEXICON["function"]}))


@query(
    "cooccurrence_pairs",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
    i AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p AS (SELECT item_id, w[i] AS a, unnest(w[i + 1:]) AS b FROM i)
    SELECT item_id, a || ' ' || b AS pair, count(*) AS n FROM p GROUP BY 1, 2""",
    prelude=False,
)
def cooccurrence_pairs(spark, d):
    pairs = X.table(spark, d, "benchmark").select("item_id", F.explode(T.cooccurrences(F.col("text"))).alias("pair"))
    return pairs.groupBy("item_id", "pair").agg(F.count("*").alias("n"))


@query(
    "token_bigrams",
    r""", w AS (SELECT document_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM document), t AS (SELECT document_id, len(w) AS n_words, unnest(list_zip(w[:-2], w[2:])) AS p FROM w WHERE len(w) > 1)
    SELECT p[1] || '_' || p[2] AS bigram, count(*) AS n FROM t GROUP BY 1""",
)
def token_bigrams(spark, d):
    words = _docs(spark, d).select(T.words_and_bigrams(F.col("text")).alias("w"), F.size(T.words_of(F.col("text"))).alias("n"))
    bigrams = words.where("n > 1").select(F.explode(F.slice("w", F.col("n") + 1, F.col("n") - 1)).alias("bigram"))
    return bigrams.groupBy("bigram").agg(F.count("*").alias("n"))


@query(
    "clean_text",
    r""", t AS (SELECT document_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '(^|[^\p{L}\p{N}\p{M}_])[\p{L}\p{N}\p{M}_]+[''’][\p{L}\p{N}\p{M}_]+', '\1 ', 'g'), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g'), ' '), lambda w: len(w) >= 3 AND w NOT IN ('the', 'and')) AS w FROM document)
    SELECT document_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM t""",
)
def clean_text(spark, d):
    clean = T.clean_text(F.col("text"), ["articles"], custom_sets={"articles": ["the", "and"]})
    out = _docs(spark, d).select("document_id", clean.alias("text"))
    return out.select("document_id", F.size(T.words_of(F.col("text"))).cast("long").alias("n_words"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "regex_replace",
    r"SELECT document_id, md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(?i)\bthe\b', 'THE', 'g')) AS digest FROM document",
)
def regex_replace(spark, d):
    text = T.replaced(F.col("text"), [("[0-9]+", "#"), (r"(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])", "THE")])
    return _docs(spark, d).select("document_id", F.md5(text.cast("binary")).alias("digest"))


@query(
    "sentence_filter",
    r""", s AS (SELECT document_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '' AND regexp_matches(x, '(?i)the') AND regexp_matches(x, 'and')) AS s FROM document)
    SELECT document_id, len(s) AS n_sentences, md5(array_to_string(s, ' ')) AS digest FROM s""",
)
def sentence_filter(spark, d):
    kept = F.filter(T.sentences(F.col("text")), lambda s: s.rlike("(?i)the") & s.rlike("and"))
    digest = F.md5(T.sentence_filter(F.col("text"), ["(?i)the", "and"]).cast("binary"))
    return _docs(spark, d).select("document_id", F.size(kept).cast("long").alias("n_sentences"), digest.alias("digest"))


@query(
    "strip_html",
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ')) AS digest FROM pages""",
    prelude=False,
)
def strip_html(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("digest"))


@query("text_prefixes", "SELECT document_id, left(text, 50) AS short, left(text, 200) AS long, language || '_' || document_type AS name FROM document")
def text_prefixes(spark, d):
    doc = X.document(spark, d)
    return doc.select("document_id", T.prefix(F.col("text"), 50).alias("short"), T.prefix(F.col("text"), 200).alias("long"), F.concat_ws("_", "language", "document_type").alias("name"))


@query(
    "tfidf_terms",
    r""", t AS (SELECT document_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}')) AS term FROM document), c AS (SELECT document_id, term, count(*)::DOUBLE AS tf FROM t GROUP BY 1, 2),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT document_id, term, tf * (ln((1 + (SELECT count(*) FROM document)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
    SELECT document_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY document_id)), 6) AS weight FROM w""",
)
def tfidf_terms(spark, d):
    return X.rounded(features.tfidf(_docs(spark, d), min_df=5))


@query(
    "vector_stats",
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS mean, round(max(x), 5) AS max, round(min(x), 5) AS min, round(stddev_samp(x), 5) AS std, round(median(x), 5) AS median FROM x GROUP BY 1, 2""",
    prelude=False,
)
def vector_stats(spark, d):
    return X.rounded(features.vector_stats(X.table(spark, d, "embeddings"), "label"), digits=5)


@query("word_category_map", "SELECT * FROM (VALUES ('the', 'function'), ('and', 'function'), ('of', 'function'), ('th*', 'stems'), ('er*', 'stems'), ('in', 'mixed'), ('an*', 'mixed'), ('licensed', 'mixed')) AS v(word, categories)", prelude=False)
def word_category_map(spark, d):
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("category"), X.lit_array(w).alias("words")) for k, w in X.LEXICON.items()))).alias("s"))
    return features.word_categories(rows.select("s.*")).select("word", F.array_join("categories", ",").alias("categories"))


@query(
    "topic_top_ngrams",
    """, c AS (SELECT document_type AS topic, w AS ngram, count(*)::DOUBLE AS n FROM (SELECT document_type, unnest(string_split(lower(text), ' ')) AS w FROM document) WHERE w <> '' GROUP BY 1, 2),
    s AS (SELECT topic, ngram, n / sum(n) OVER (PARTITION BY topic) AS weight FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, ngram) AS r FROM s WHERE weight >= 0.001)
    SELECT topic, string_agg(ngram, ' ' ORDER BY r) AS ngrams FROM r WHERE r <= 20 GROUP BY 1""",
)
def topic_top_ngrams(spark, d):
    words = X.document(spark, d).select(F.col("document_type").alias("topic"), F.explode(F.split(F.lower("text"), " ")).alias("ngram")).where("ngram <> ''")
    counts = words.groupBy("topic", "ngram").agg(F.count("*").cast("double").alias("n"))
    totals = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return workflow.top_ngrams(counts.join(totals, "topic").select("topic", "ngram", (F.col("n") / F.col("total")).alias("weight")))


@query(
    "language_detection",
    r""", w AS (SELECT document_id, regexp_split_to_array(lower(text), '[\s.,;:!?]+') AS w FROM document),
    c AS (SELECT document_id, len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'das', 'den', 'von', 'mit', 'ist', 'nicht', 'ein'))) AS de,
      len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'was', 'for', 'with'))) AS en,
      len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'una', 'por', 'con', 'para', 'del', 'que', 'y'))) AS es,
      len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des', 'et', 'une', 'dans', 'est', 'pour', 'que'))) AS fr FROM w)
    SELECT document_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unk' WHEN fr = greatest(de, en, es, fr) THEN 'fr' WHEN es = greatest(de, en, es, fr) THEN 'es' WHEN en = greatest(de, en, es, fr) THEN 'en' ELSE 'de' END AS language FROM c""",
)
def language_detection(spark, d):
    return _docs(spark, d).select("document_id", T.language(F.col("text")).alias("language"))


@query("content_hash", r"SELECT document_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS digest FROM document")
def content_hash(spark, d):
    return _docs(spark, d).select("document_id", T.content_hash(F.col("text")).alias("digest"))


STOPWORDS = {"html": T.HTML, "months": T.MONTHS, "numbers": T.NUMBERS, "social_media": T.SOCIAL_MEDIA}


@query("stopword_sets", " UNION ALL ".join(f"SELECT '{name}' AS stopword_set, unnest(string_split('{words}', ' ')) AS word" for name, words in STOPWORDS.items()), prelude=False)
def stopword_sets(spark, d):
    """The words of the sets of fixed values, as ``stopwords`` gives them with short words kept."""
    rows = [F.struct(F.lit(name).alias("stopword_set"), F.lit(w).alias("word")) for name in STOPWORDS for w in T.STOPWORD_SETS[name]]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


@query(
    "clean_text_stopwords",
    rf""", s AS (SELECT unnest(string_split('{" ".join(STOPWORDS.values())}', ' ')) AS word), l AS (SELECT list(word) AS words FROM s),
    t AS (SELECT document_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '(^|[^\p{{L}}\p{{N}}\p{{M}}_])[\p{{L}}\p{{N}}\p{{M}}_]+[''’][\p{{L}}\p{{N}}\p{{M}}_]+', '\1 ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'), ' '), lambda w: len(w) >= 3 AND NOT list_contains(words, w)) AS w FROM document, l)
    SELECT document_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM t""",
)
def clean_text_stopwords(spark, d):
    """Texts without the words of all sets of fixed values."""
    out = _docs(spark, d).select("document_id", T.clean_text(F.col("text"), list(STOPWORDS)).alias("text"))
    return out.select("document_id", F.size(T.words_of(F.col("text"))).cast("long").alias("n_words"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "fuzzy_hash",
    r""", w AS (SELECT document_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM document),
    g AS (SELECT document_id, list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM w)
    SELECT document_id, left(list_min(list_transform(g, lambda x: md5('0_' || x))), 8) || ':' || left(list_min(list_transform(g, lambda x: md5('1_' || x))), 8)
      || ':' || left(list_min(list_transform(g, lambda x: md5('2_' || x))), 8) || ':' || left(list_min(list_transform(g, lambda x: md5('3_' || x))), 8) AS digest FROM g""".replace("\\\\", "\\"),
)
def fuzzy_hash(spark, d):
    return _docs(spark, d).select("document_id", T.fuzzy_hash(F.col("text")).alias("digest"))


@query("decoded_text", "SELECT document_id, md5(text) AS digest FROM document")
def decoded_text(spark, d):
    return _docs(spark, d).select("document_id", F.md5(T.decoded(F.encode("text", "UTF-8")).cast("binary")).alias("digest"))
