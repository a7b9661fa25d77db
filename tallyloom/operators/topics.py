"""Anchored topics by correlation explanation, their n-grams, application and codebooks.

Training (Gallagher et al., 2017) alternates two closed-form steps on a binary
document-word table.  The table is built in Spark from a bounded, documented
sample; the steps run in numpy; applying a model is an Arrow pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .features import tokens
from .sampling import simple


@dataclass
class TopicModel:
    words: list[str]
    alpha: np.ndarray  # topic x word: how much a word counts for a topic
    log_odds: np.ndarray  # topic x word: log P(word | on) - log P(word | off)
    log_odds_absent: np.ndarray
    prior: np.ndarray  # topic: log-odds of on
    information: np.ndarray  # topic x word: mutual information, signed
    anchors: list[list[str]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.prior + x @ (self.alpha * self.log_odds).T + (1 - x) @ (self.alpha * self.log_odds_absent).T
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_words(docs: DataFrame, words: Sequence[str], text: str = "text") -> DataFrame:
    """``document_id, at``: which of ``words`` a document has."""
    place = F.create_map(*(x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))))
    found = F.array_distinct(F.filter(F.transform(tokens(F.col(text)), lambda t: place[t]), lambda i: i.isNotNull()))
    return docs.select("document_id", found.alias("at"))


def vocabulary(docs: DataFrame, size: int, min_df: int = 2, keep: Sequence[str] = (), text: str = "text") -> list[str]:
    """Words of most documents, at most ``size``, and those to keep that occur."""
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= min_df)
    top = [r["w"] for r in df.orderBy(F.desc("n"), "w").limit(size).collect()]
    kept = {r["w"] for r in df.where(F.col("w").isin(list(keep))).select("w").collect()} if keep else set()
    return top + sorted(kept - set(top))


def train(frame: DataFrame, num_topics: int, anchors: Sequence[Sequence[str]] = (), sample_size: int = 2000, words: int = 2000, anchor_strength: float = 4.0, seed: int = 42, rounds: int = 40) -> TopicModel:
    """A topic model of a sample of ``frame``; the first topics take the anchors that the vocabulary has."""
    sample = simple(frame, sample_size, seed)
    names = vocabulary(sample, words, keep=[a for group in anchors for a in group])
    rows = document_words(sample, names).orderBy("document_id").collect()
    x = np.zeros((len(rows), len(names)), dtype=np.float64)
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    place = {w: i for i, w in enumerate(names)}
    held = [[a for a in group if a in place] for group in anchors]
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.3, 0.7, (len(rows), num_topics))
    for k, group in enumerate(held[:num_topics]):
        if group:
            p[:, k] = 0.05 + 0.9 * (x[:, [place[a] for a in group]].max(axis=1))
    alpha = np.ones((num_topics, len(names)))
    pw = (x.mean(axis=0) * len(x) + 0.5) / (len(x) + 1)
    for _ in range(rounds):
        on = p.sum(axis=0) + 1e-9
        w_on = (p.T @ x + 0.5) / (on[:, None] + 1)
        w_off = ((1 - p).T @ x + 0.5) / ((len(x) - on)[:, None] + 1)
        share = on / len(x)
        gain = lambda a, b: a * np.log(a / b)
        info = share[:, None] * (gain(w_on, pw) + gain(1 - w_on, 1 - pw)) + (1 - share)[:, None] * (gain(w_off, pw) + gain(1 - w_off, 1 - pw))
        best = info.max(axis=0, keepdims=True) + 1e-12
        alpha = 0.5 * alpha + 0.5 * np.exp(20 * (info / best - 1))
        for k, group in enumerate(held[:num_topics]):
            for a in group:
                alpha[:, place[a]] = 0
                alpha[k, place[a]] = anchor_strength
        prior = np.log(share + 1e-9) - np.log(1 - share + 1e-9)
        model = TopicModel(names, alpha, np.log(w_on / w_off), np.log((1 - w_on) / (1 - w_off)), prior, info * np.sign(w_on - w_off), held)
        p = model.probabilities(x)
    return model


def topic_ngrams(model: TopicModel, n: int = 20) -> list[tuple[int, str, float]]:
    """(topic, word, information) of the ``n`` most telling words of each topic, of those that speak for it."""
    out = []
    for k, row in enumerate(model.information * (model.alpha > 0.5)):
        order = sorted((i for i in range(len(row)) if row[i] > 0), key=lambda i: (-row[i], model.words[i]))[:n]
        out += [(k, model.words[i], float(row[i])) for i in order]
    return out


def apply(model: TopicModel, docs: DataFrame, probabilities: bool = False) -> DataFrame:
    """``document_id, topic, value`` for each document and topic: a flag, or a probability."""
    rows = document_words(docs, model.words)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                x = np.zeros((len(part), len(model.words)))
                for i, where in enumerate(part["at"]):
                    x[i, where] = 1
                p = model.probabilities(x)
                value = p if probabilities else (p >= 0.5).astype(float)
                k = p.shape[1]
                yield pd.DataFrame({"document_id": np.repeat(part["document_id"].to_numpy(), k), "topic": np.tile(np.arange(k), len(part)), "value": value.ravel()})

    return rows.mapInPandas(run, "document_id long, topic int, value double")


def anchor_codes(docs: DataFrame, anchors: dict[int, Sequence[str]], text: str = "text") -> DataFrame:
    """``document_id, topic, label_id``: whether any anchor of a topic occurs."""
    sets = F.array(*(F.struct(F.lit(k).alias("topic"), F.coalesce(F.lower(F.col(text)).rlike(T.anchor_pattern(a)), F.lit(False)).cast("int").alias("label_id")) for k, a in anchors.items()))
    return docs.select("document_id", F.explode(sets).alias("s")).select("document_id", "s.*")


def codebook(project: str, topics: dict[str, Sequence[str]]) -> dict:
    """A project configuration that asks about each topic."""
    ask = lambda name, anchors: {
        "name": name, "display": "checkbox", "prompt": f"Is this about {name}?", "examples": [{"quote": a} for a in anchors],
        "labels": [{"label": "No", "value": "0", "select_as_default": True}, {"label": "Yes", "value": "1"}],
    }
    return {"name": project, "questions": [ask(n, a) for n, a in topics.items()]}


def validation_method(topics: dict[str, Sequence[str]], share: float = 0.5) -> dict:
    """A sampling method that draws ``share`` of the documents, in equal parts, from those with a topic's anchors."""
    return {"sampling_strategy": "random", "sampling_searches": [{"name": n, "pattern": T.anchor_pattern(a), "proportion": share / len(topics)} for n, a in topics.items()]}
