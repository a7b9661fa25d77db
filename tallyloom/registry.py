"""Named plug-ins: each registry holds callables or configurations of one kind.

A registry takes the place of a folder of files: ``@register("document_filters")``
puts a function under its name, ``load_folder`` takes all of a package's modules.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections import defaultdict
from collections.abc import Callable

#: The kinds of plug-ins and what a plug-in of each is called with.
KINDS = {
    "dataset_extractors": "(spark, **params) -> DataFrame",
    "dataset_code_filters": "(df, *args) -> DataFrame",
    "dataset_coder_filters": "(df, *args) -> DataFrame",
    "dataset_document_filters": "(df, *args) -> DataFrame",
    "balancing_variables": "(Column) -> Column",
    "feature_extractors": "(df, **params) -> DataFrame",
    "preprocessors": "(Column, **params) -> Column",
    "models": "(**params) -> Estimator",
    "pipelines": "() -> dict",
    "scoring_functions": "(df, truth, predicted, weight) -> DataFrame",
    "sampling_frames": "() -> dict",
    "sampling_methods": "() -> dict",
    "regex_filters": "() -> str",
    "regex_replacers": "() -> list of (pattern, text)",
    "stopword_sets": "() -> list of str",
    "stopword_whitelists": "() -> list of str",
    "topic_models": "() -> dict",
    "projects": "() -> dict",
    "project_hit_types": "() -> dict",
    "project_qualification_tests": "() -> dict",
    "project_qualification_scorers": "(DataFrame of answers) -> DataFrame of coder_id, passed",
    "commands": "(spark, **options)",
}

_known: dict[str, dict[str, Callable]] = defaultdict(dict)


def register(kind: str, name: str | None = None) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(KINDS)}")

    def put(plugin: Callable) -> Callable:
        _known[kind][name or plugin.__name__] = plugin
        return plugin

    return put


def get(kind: str, name: str) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(KINDS)}")
    if name not in _known[kind]:
        raise KeyError(f"no {kind} named {name!r}; there are {sorted(_known[kind])}")
    return _known[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_known[kind])


def load_folder(kind: str, package: str, attribute: str) -> list[str]:
    """Registers ``attribute`` of each module below a package; inner packages become prefixes of the name."""
    root = importlib.import_module(package)
    found = []
    for m in pkgutil.walk_packages(root.__path__, package + "."):
        plugin = getattr(importlib.import_module(m.name), attribute, None)
        if plugin is not None:
            name = m.name.removeprefix(package + ".").replace(".", "_")
            register(kind, name)(plugin)
            found.append(name)
    return sorted(found)


def _builtins() -> None:
    from .functions import text as T
    from .operators import administration, agreement, datasets, features, filters, models
    from .sources import readers

    for f in (filters.excluding_coders, filters.only_coders, filters.excluding_experts, filters.excluding_crowd, filters.coders_with_documents):
        register("dataset_coder_filters")(f)
    for f in (filters.by_date, filters.by_document_ids, filters.by_other_dataset, filters.coded_by_all, filters.coded_at_least):
        register("dataset_document_filters")(f)
    register("dataset_code_filters")(filters.excluding_consensus_ignored)
    for f in (agreement.cohens_kappa, agreement.matthews_corrcoef, agreement.maxmin, agreement.mean_difference):
        register("scoring_functions")(f)
    for f in (features.tfidf, features.regex_counts, features.ngram_sets, features.punctuation, features.vector_stats, features.word_vector_features, features.topic_features, features.field_lookups):
        register("feature_extractors")(f)
    for f in (T.clean_text, T.strip_html, T.replaced, T.sentence_filter, T.cooccurrences):
        register("preprocessors")(f)
    for f in (datasets.document_coder, datasets.document_aggregate, datasets.bit_strings, datasets.raw_codes):
        register("dataset_extractors")(f)
    for name in ("decision_tree", "random_forest", "gradient_boosting", "xgboost", "linear_svc", "svc", "sgd", "multinomial_nb", "logistic_regression"):
        register("models", name)(lambda _name=name, **params: models.classifier(_name, **params))
    for name in T.STOPWORD_SETS:
        register("stopword_sets", name)(lambda _name=name: list(T.STOPWORD_SETS[_name]))
    register("balancing_variables")(T.year_month)
    register("sampling_frames", "all_documents")(dict)
    register("sampling_methods", "all_documents")(lambda: {"sampling_strategy": "all"})
    commands = {
        "coding_create_coder": administration.create_coder, "coding_extract_sampling_frame": administration.extract_frame, "coding_extract_sample": administration.extract_sample,
        "coding_create_sample_hits": administration.create_sample_hits, "models_train_document_classifier": administration.train_classifier,
        "models_apply_document_classifier": administration.apply_classifier, "nlp_reload_liwc": readers.lexicon_dic, "topics_train_model": administration.train_topics,
    }
    for name, command in commands.items():
        register("commands", name)(command)


_builtins()
