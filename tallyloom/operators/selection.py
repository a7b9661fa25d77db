"""Choosing models: scorers by name, thresholds over folds and test rows, parameters and names of nested steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from . import agreement

BINARY = ("f1", "precision", "recall")


def _mean(of, weight: str | None):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return F.sum(of * w) / F.sum(w)


def scorer(name: str, positive=None, regression: bool = False, truth: str = "label", predicted: str = "prediction", weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from predictions to one row ``score``, of which more is better: losses come negated.

    Registered scoring functions come first.  Regressions have
    ``mean_squared_error`` and ``r2``; with a positive class there are ``f1``,
    ``precision``, ``recall`` and ``brier_loss`` (of ``probability``, that of
    the predicted class); else the first three are means over all classes.
    """
    if name in registry.names("scoring_functions"):
        return lambda df: registry.get("scoring_functions", name)(df, truth, predicted, weight)
    off = F.col(truth) - F.col(predicted)
    if regression and name == "mean_squared_error":
        return lambda df: df.agg((-_mean(off * off, weight)).alias("score"))
    if regression and name == "r2":
        spread = _mean(F.col(truth) * F.col(truth), weight) - _mean(F.col(truth), weight) ** 2
        return lambda df: df.agg(_mean(off * off, weight).alias("m"), spread.alias("v")).select(F.when(F.col("v") > 0, 1 - F.col("m") / F.col("v")).alias("score"))
    if not regression and positive is not None and name == "brier_loss":
        p = F.when(F.col(predicted) == F.lit(positive), F.col("probability")).otherwise(1 - F.col("probability"))
        miss = p - (F.col(truth) == F.lit(positive)).cast("int")
        return lambda df: df.agg((-_mean(miss * miss, weight)).alias("score"))
    if not regression and name in BINARY:
        report = lambda df: agreement.classification_report(df, truth, predicted, weight)
        if positive is None:
            return lambda df: report(df).where("label is not null").agg(F.avg(name).alias("score"))
        return lambda df: report(df).agg(F.coalesce(F.max(F.when(F.col("label") == F.lit(positive), F.col(name))), F.lit(0.0)).alias("score"))
    raise ValueError(f"no scorer {name!r} here")


def threshold_search(
    test: DataFrame, folds: DataFrame, truth: DataFrame, base, positive, thresholds: Sequence[float] = tuple(k / 100 for k in range(100)),
    metric: str = "precision_recall_min", outcome: str = "label_id", fold: str = "fold",
) -> DataFrame | None:
    """One row: the threshold that is best by the lesser of the test score and the mean over folds; ``None`` unless there are two classes.

    ``test`` and ``folds`` hold predictions with their probability, ``folds``
    also the number of the fold that made each.  Scores that are missing count 0.
    """
    if base is None or positive is None:
        return None
    of = lambda rows, by: agreement.threshold_scores(rows, truth, base, positive, list(thresholds), outcome, by).withColumn("outcome_column", F.lit(f"{outcome}__{positive}"))
    by_fold = of(folds, (fold,)).groupBy("threshold", "outcome_column").agg(F.avg(F.coalesce(metric, F.lit(0.0))).alias(metric))
    return agreement.best_cv_threshold(of(test, ()), by_fold, metric)


def collapsed_params(steps: Sequence[tuple], params: dict[str, dict[str, Sequence]], path: tuple[str, ...] = ()) -> dict[str, Sequence]:
    """The grid of nested steps, keyed ``step__inner__param``.

    A step is ``(name, inner steps)`` or ``(name, anything else)``; ``params``
    has the lists of values by the name of a leaf; empty lists are left out.
    """
    out: dict[str, Sequence] = {}
    for name, inner in steps:
        here = (*path, name)
        if isinstance(inner, (list, tuple)):
            out |= collapsed_params(inner, params, here)
        else:
            out |= {"__".join((*here, k)): v for k, v in params.get(name, {}).items() if len(v)}
    return out


def feature_names(model: Transformer, prefix: str = "") -> list[str]:
    """Names of the places of a model's features, through nested pipelines: terms of vocabularies, then columns put beside them."""
    if isinstance(model, PipelineModel):
        return [n for stage in model.stages for n in feature_names(stage, prefix)]
    if hasattr(model, "vocabulary"):
        return [prefix + w for w in model.vocabulary]
    if model.hasParam("inputCols") and model.hasParam("handleInvalid"):
        return [prefix + c for c in model.getInputCols() if c != "_terms_out"]
    return []


def preprocessed(docs: DataFrame, steps: Sequence[tuple[str, dict]], text: str = "text") -> DataFrame:
    """``docs`` with the registered preprocessors applied to ``text`` one after the other; all other columns stay."""
    for name, params in steps:
        docs = docs.withColumn(text, registry.get("preprocessors", name)(F.col(text), **params))
    return docs
