"""Scalar functions on text, dates and lists, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the stop-word sets name.
ENGLISH = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst an and another any anyhow "
    "anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being below beside "
    "besides between beyond both bottom but by call can cannot could did do does doing done down due during each eight either eleven else elsewhere enough "
    "etc even ever every everyone everything everywhere except few fifteen fifty fill find first five for former formerly forty found four from front full "
    "further get give go had has have having he hence her here hereafter hereby herein hers herself him himself his how however hundred i if in indeed into "
    "is it its itself just last latter least less made many may me meanwhile might mine more moreover most mostly move much must my myself name namely "
    "neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our "
    "ours ourselves out over own part per perhaps please put rather same see seem seemed seeming seems several she should show side since six sixty so some "
    "somehow someone something sometime sometimes somewhere still such take ten than that the their theirs them themselves then thence there thereafter "
    "thereby therefore these they third this those though three through throughout thus to together too top toward towards twelve twenty two under until up "
    "upon us very via was we well were what whatever when whence whenever where whereas whether which while who whoever whole whom whose why will with "
    "within without would yet you your yours yourself yourselves"
)
# The sets that results must equal.
MONTHS = "january jan february feb march mar april apr may june jun july jul august aug september sept sep october oct november nov december dec"
NUMBERS = "first second third fourth fifth sixth seventh eighth ninth tenth"
HTML = "aspx gdata http html bit goo gov www youtu org https pdf php amp rsquo ldquo rdquo"
SOCIAL_MEDIA = "twitter facebook instagram profile page tweet post like share comment retweet fbid photo album event group live video youtube insta tiktok"

STOPWORD_SETS = {"english": ENGLISH.split(), "months": MONTHS.split(), "numbers": NUMBERS.split(), "html": HTML.split(), "social_media": SOCIAL_MEDIA.split()}
#: Sets whose short words stay.
KEEP_SHORT = ("english", "months", "misc_boilerplate")


def stopwords(names: Sequence[str], whitelist: Sequence[str] = (), sets: dict[str, list[str]] | None = None) -> list[str]:
    """The union of named sets without the whitelist, longest first; words of one or two letters only from some sets."""
    known = STOPWORD_SETS | (sets or {})
    words = {w for n in names for w in known[n] if len(w) > 2 or n in KEEP_SHORT}
    return sorted(words - set(whitelist), key=lambda w: (-len(w), w))


def regex_has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def regex_count(text: Column, pattern: str) -> Column:
    """Matches that are not overlapping; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def regex_features(text: Column, pattern: str, prefix: str) -> list[Column]:
    """Count, whether any, squared count, log of count and one."""
    n = regex_count(text, pattern)
    return [n.alias(f"{prefix}_count"), (n > 0).cast("int").alias(f"{prefix}_has_match"), (n * n).alias(f"{prefix}_count_sq"), F.log1p(n.cast("double")).alias(f"{prefix}_count_log")]


def replaced(text: Column, replacers: Sequence[tuple[str, str]]) -> Column:
    for pattern, new in replacers:
        text = F.regexp_replace(text, pattern, new)
    return text


def sentences(text: Column) -> Column:
    """Sentences end at a full stop, question or exclamation mark before white space, and at line breaks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_filter(text: Column, patterns: Sequence[str]) -> Column:
    """The sentences that match every pattern, joined by a space."""
    kept = sentences(text)
    for p in patterns:
        kept = F.filter(kept, lambda s: s.rlike(p))  # noqa: B023
    return F.array_join(kept, " ")


def strip_html(text: Column) -> Column:
    """Text between tags, entities of punctuation resolved, white space squeezed."""
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return squeezed(text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(
    text: Column,
    stopword_sets: Sequence[str] = (),
    whitelist: Sequence[str] = (),
    regex_filters: Sequence[str] = (),
    regex_replacers: Sequence[tuple[str, str]] = (),
    min_length: int = 3,
    html: bool = False,
    custom_sets: dict[str, list[str]] | None = None,
    stem=None,
) -> Column:
    """Lower-cased words without punctuation, contractions, short words and stop words; sentence filters and replacers come first.

    ``stem`` is a Column function on one word; none is applied by default.
    """
    text = F.coalesce(text, F.lit(""))
    if regex_filters:
        text = sentence_filter(text, regex_filters)
    if html:
        text = strip_html(text)
    text = F.lower(replaced(text, regex_replacers))
    text = F.regexp_replace(text, r"(?U)\b\w+['’]\w+\b", " ")
    words = F.filter(F.split(F.regexp_replace(text, r"(?U)[^\w]+", " "), " "), lambda w: F.length(w) >= min_length)
    if stem is not None:
        words = F.transform(words, stem)
    if stopword_sets:
        stops = F.array(*map(F.lit, stopwords(stopword_sets, whitelist, custom_sets)))
        words = F.filter(words, lambda w: ~F.array_contains(stops, w))
    return F.array_join(words, " ")


def suffix_stem(word: Column) -> Column:
    """A small suffix stemmer: plural and verb endings off words that stay longer than three letters."""
    return F.regexp_replace(F.regexp_replace(word, r"(?<=\w{3})(?:ies)$", "y"), r"(?<=\w{4})(?:ing|ed|es|s)$", "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew for each element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cooccurrences(text: Column) -> Column:
    """Every two words of a text in their order, joined by a space: quadratic in the words, so for short texts."""

    def pairs(w: Column) -> Column:
        return F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y: F.concat(x, F.lit(" "), y))))

    return _bound(words_of(text), pairs)


def words_and_bigrams(text: Column) -> Column:
    """Words, and each two neighbours joined by ``_``."""

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat(x, F.lit("_"), y)))

    return _bound(words_of(text), both)


def ngram_pattern(words: Sequence[str]) -> str:
    """One pattern for a category: stems (``stem*``) first, in list order.

    Needs white space before, one more word character after a stem and none
    after a word.  Without words it matches nothing.
    """
    escape = lambda w: re.sub(r"([^\w\s])", r"\\\1", w)
    stems = [rf"(?<=\s){escape(w[:-1])}(?=\w)" for w in words if w.endswith("*")]
    whole = [rf"(?<=\s){escape(w)}(?=\W)" for w in words if not w.endswith("*")]
    return "(?i)" + "|".join(stems + whole) if words else r"(?!)"


def ngram_count(text: Column, words: Sequence[str]) -> Column:
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    return F.regexp_count(padded, F.lit(ngram_pattern(words))).cast("long")


#: Fixed patterns of the punctuation indicators.
PUNCTUATION = (
    ("dollars", r"\$([0-9]{1,3}(?:(?:\,[0-9]{3})+)?(?:\.[0-9]{1,2})?)\s"),
    ("dollars_alt", r"\$[0-9]{1,3}((\,[0-9]{3})+)?\s"),
    ("amounts", r"thousand*|million*|billion*|hundred*"),
    ("exclamation", r"\!"),
)


def punctuation_indicators(text: Column) -> list[Column]:
    out = []
    for name, pattern in PUNCTUATION:
        n = regex_count(text, "(?i)" + pattern)
        if name == "dollars_alt":  # what counts is the group of thousands, so amounts under 1,000 are empty matches
            n = regex_count(text, r"(?i)\$[0-9]{1,3}(?:\,[0-9]{3})+\s")
        out += [n.alias(f"{name}_count"), (n > 0).cast("int").alias(f"{name}_any")]
    return out


def year_month(date: Column) -> Column:
    """``2000_1``; null without a date."""
    return F.when(date.isNotNull(), F.concat_ws("_", F.year(date).cast("string"), F.month(date).cast("string")))


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def split_choices(text: Column) -> Column:
    return F.split(text, r"\|")


def anchors_text(anchors: Column) -> Column:
    return F.array_join(anchors, ", ")


def anchors_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda a: F.trim(a)), lambda a: a != "")


def column_suffix(name: Column) -> Column:
    return F.substring_index(name, "_", -1)


def anchor_pattern(terms: Sequence[str]) -> str:
    """Any of the terms as whole words; letters of all scripts belong to words, whatever the Java version takes for a boundary."""
    return "(?U)" + "|".join(rf"\b{re.escape(t)}\b" for t in terms)


def title(text: Column) -> Column:
    return F.initcap(text)


def content_hash(text: Column) -> Column:
    """A hash by which equal texts are known; near texts are the business of near-duplicate operators."""
    return F.sha2(F.lower(squeezed(F.coalesce(text, F.lit("")))).cast("binary"), 256)


def fuzzy_hash(text: Column, parts: int = 4, width: int = 3) -> Column:
    """A hash that similar texts share in part: for each of ``parts`` seeds the least md5 of the text's runs of ``width``
    lower-case words, eight digits each.  Of two texts with a share J of runs in common each part is equal with
    probability J.  Texts of fewer words are one run; null counts as empty."""

    def parts_of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))
        least = [F.substring(F.array_min(F.transform(runs, lambda r: F.md5(F.concat(F.lit(f"{k}_"), r).cast("binary")))), 1, 8) for k in range(parts)]  # noqa: B023
        return F.concat_ws(":", *least)

    return _bound(words_of(F.lower(text)), parts_of)


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 text; texts are that already.  What is no UTF-8 becomes the replacement sign."""
    return F.decode(raw.cast("binary"), "UTF-8")


#: Function words by which a language is told.
PROFILES = {
    "en": "the of and to in is that was for with",
    "de": "der die und das den von mit ist nicht ein",
    "fr": "le la les des et une dans est pour que",
    "es": "el los las una por con para del que y",
}


def language(text: Column) -> Column:
    """The language whose function words are most frequent; ``unk`` if none occurs; ties go by name."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:!?]+")
    counts = [F.struct(F.size(F.filter(words, lambda w: w.isin(p.split()))).alias("n"), F.lit(k).alias("k")) for k, p in sorted(PROFILES.items(), reverse=True)]  # noqa: B023
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["k"]).otherwise("unk")


def canonical(value) -> str:
    """A parameter value as text that does not depend on the order of keys, sets or equal lists."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))) + "}"
    if isinstance(value, (list, tuple, set, frozenset)):
        return "[" + ",".join(sorted(map(canonical, value))) + "]"
    return repr(value)


def breadcrumb(tree: dict, key: str, path: tuple[str, ...] = ()) -> str | None:
    """Where a key stands in a nested dictionary of labels, as ``A > B``."""
    for name, below in tree.items():
        here = (*path, str(name))
        if str(name) == key or below == key:
            return " > ".join(here)
        if isinstance(below, dict) and (found := breadcrumb(below, key, here)):
            return found
    return None
