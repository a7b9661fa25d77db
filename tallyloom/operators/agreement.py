"""Agreement and accuracy scores from confusion sums.

Pairs of coders meet by a join on the document; each pair and outcome becomes
a few sums before any metric is taken, so no data reach Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def as_coders(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two datasets as the codes of coders ``dataset1`` and ``dataset2``; columns that one lacks are null."""
    return first.withColumn("coder_id", F.lit("dataset1")).unionByName(second.withColumn("coder_id", F.lit("dataset2")), allowMissingColumns=True)


def coder_pairs(codes: DataFrame, outcome: str = "label_id", weight: str | None = None, ordered: bool | None = None) -> DataFrame:
    """``document_id, coder1, coder2, y1, y2, w`` for documents that both coded.

    With ``ordered`` both orders are there.  Left open, it is so from three coders on.
    """
    if ordered is None:
        ordered = len(codes.select("coder_id").distinct().limit(3).collect()) > 2
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a = codes.select("document_id", F.col("coder_id").alias("coder1"), F.col(outcome).alias("y1"), w.alias("w"))
    b = codes.select("document_id", F.col("coder_id").alias("coder2"), F.col(outcome).alias("y2"))
    return a.join(b, "document_id").where(F.col("coder1") != F.col("coder2") if ordered else F.col("coder1") < F.col("coder2"))


def binary_sums(pairs: DataFrame, keys: tuple[str, ...] = ("coder1", "coder2"), positive=1) -> DataFrame:
    """tp, fp, fn, tn (weighted), n, and unweighted ones with suffix 0; coder 1 is the truth."""
    y1, y2 = F.col("y1").eqNullSafe(F.lit(positive)), F.col("y2").eqNullSafe(F.lit(positive))
    cells = {"tp": y1 & y2, "fp": ~y1 & y2, "fn": y1 & ~y2, "tn": ~y1 & ~y2}
    sums = [F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(k) for k, c in cells.items()]
    sums += [F.sum(F.when(c, 1.0).otherwise(0.0)).alias(f"{k}0") for k, c in cells.items()]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def binary_metrics(sums: DataFrame) -> DataFrame:
    """The metric row of each line of ``binary_sums``.

    A class that nobody predicts has precision 0; kappa, correlation and alpha
    are null where they are undefined.  A coder's standard error is s / sqrt(n).
    """
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    w = tp + fp + fn + tn
    p, r = F.coalesce(_ratio(tp, tp + fp), F.lit(0.0)), F.coalesce(_ratio(tp, tp + fn), F.lit(0.0))
    m1, m2 = _ratio(tp + fn, w), _ratio(tp + fp, w)
    po, pe = _ratio(tp + tn, w), m1 * m2 + (1 - m1) * (1 - m2)
    u1, u2 = (F.col("tp0") + F.col("fn0")) / n, (F.col("tp0") + F.col("fp0")) / n
    agree0 = (F.col("tp0") + F.col("tn0")) / n
    ones, total = 2 * F.col("tp0") + F.col("fp0") + F.col("fn0"), 2.0 * n
    expected = 1 - (ones * (ones - 1) + (total - ones) * (total - ones - 1)) / (total * (total - 1))
    error = lambda m: F.sqrt(_ratio(m * (1 - m), n - 1))
    return sums.withColumns(
        {
            "coder1_mean": m1, "coder2_mean": m2,
            "coder1_mean_unweighted": u1, "coder2_mean_unweighted": u2,
            "coder1_std": error(m1), "coder2_std": error(m2),
            "coder1_std_unweighted": error(u1), "coder2_std_unweighted": error(u2),
            "pct_agree_unweighted": agree0, "accuracy": po,
            "precision": p, "recall": r, "precision_recall_min": F.least(p, r),
            "f1": F.coalesce(_ratio(2 * p * r, p + r), F.lit(0.0)),
            "cohens_kappa": _ratio(po - pe, 1 - pe),
            "matthews_corrcoef": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
            "roc_auc": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
            "alpha_unweighted": 1 - _ratio(1 - agree0, expected),
        }
    ).drop("tp", "fp", "fn", "tn", "tp0", "fp0", "fn0", "tn0")


def scores_by_value(codes: DataFrame, outcome: str = "label_id", weight: str | None = None, min_overlap: int = 10, ordered: bool | None = None, values=None) -> DataFrame:
    """One-vs-rest metrics of each coder pair and outcome value, pairs with ``min_overlap`` common documents or more."""
    pairs = coder_pairs(codes, outcome, weight, ordered)
    if values is None:
        values = [r[0] for r in codes.select(outcome).where(F.col(outcome).isNotNull()).distinct().orderBy(outcome).collect()]
    spread = pairs.withColumn("value", F.explode(F.array(*map(F.lit, values))))
    spread = spread.withColumns({"y1": F.col("y1").eqNullSafe(F.col("value")).cast("int"), "y2": F.col("y2").eqNullSafe(F.col("value")).cast("int")})
    sums = binary_sums(spread, ("coder1", "coder2", "value"), 1).where(F.col("n") >= min_overlap)
    out = binary_metrics(sums)
    return out.withColumn("outcome_column", F.concat(F.lit(f"{outcome}__"), F.col("value").cast("string"))).withColumn("pos_label", F.lit(1)).drop("value")


def scores_overall(codes: DataFrame, outcome: str = "label_id", weight: str | None = None, min_overlap: int = 10, ordered: bool | None = None) -> DataFrame:
    """One row per coder pair over all classes.

    Precision, recall and f1 are those of the classes weighted by coder 1's
    share; the correlation is the multi-class one; kappa and roc_auc are null
    for more than two classes.
    """
    pairs = coder_pairs(codes, outcome, weight, ordered)
    cells = pairs.groupBy("coder1", "coder2", "y1", "y2").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    by_class = cells.select("coder1", "coder2", F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(1).alias("side")), F.struct(F.col("y2").alias("y"), F.lit(2).alias("side")))).alias("s"), "y1", "y2", "w", "n")
    side = F.col("s.side")
    hit = (F.col("y1") == F.col("y2")) & (side == 1)
    classes = by_class.groupBy("coder1", "coder2", "s.y").agg(
        F.sum(F.when(side == 1, F.col("w")).otherwise(0.0)).alias("t"),
        F.sum(F.when(side == 2, F.col("w")).otherwise(0.0)).alias("p"),
        F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("c"),
        F.sum("n").alias("k"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("c0"),
    )
    prec, rec = F.coalesce(_ratio(F.col("c"), F.col("p")), F.lit(0.0)), F.coalesce(_ratio(F.col("c"), F.col("t")), F.lit(0.0))
    f1 = F.coalesce(_ratio(2 * prec * rec, prec + rec), F.lit(0.0))
    pair = classes.groupBy("coder1", "coder2").agg(
        (F.sum("k") / 2).cast("long").alias("n"), F.count("*").alias("n_classes"), F.sum("t").alias("w"), F.sum("c").alias("agree"), F.sum("c0").alias("agree0"),
        F.sum(F.col("t") * prec).alias("sp"), F.sum(F.col("t") * rec).alias("sr"), F.sum(F.col("t") * f1).alias("sf"),
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("k") * (F.col("k") - 1.0)).alias("kk"),
    ).where(F.col("n") >= min_overlap)
    w, total = F.col("w"), 2.0 * F.col("n")
    po, pe = F.col("agree") / w, F.col("tp") / (w * w)
    two = F.col("n_classes") <= 2
    return pair.select(
        "coder1", "coder2", "n", F.lit(outcome).alias("outcome_column"),
        (F.col("agree0") / F.col("n")).alias("pct_agree_unweighted"), po.alias("accuracy"),
        (F.col("sp") / w).alias("precision"), (F.col("sr") / w).alias("recall"), (F.col("sf") / w).alias("f1"),
        F.least(F.col("sp") / w, F.col("sr") / w).alias("precision_recall_min"),
        F.when(two, _ratio(po - pe, 1 - pe)).alias("cohens_kappa"),
        _ratio(F.col("agree") * w - F.col("tp"), F.sqrt((w * w - F.col("pp")) * (w * w - F.col("tt")))).alias("matthews_corrcoef"),
        (1 - _ratio(1 - F.col("agree0") / F.col("n"), 1 - F.col("kk") / (total * (total - 1)))).alias("alpha_unweighted"),
    )


def overall(codes: DataFrame, outcome: str = "label_id") -> DataFrame:
    """One row: nominal Krippendorff alpha and Fleiss kappa over all coders; documents with one code do not count."""
    cells = codes.where(F.col(outcome).isNotNull()).groupBy("document_id", F.col(outcome).alias("v")).agg(F.count("*").alias("c"))
    docs = cells.groupBy("document_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1.0)).alias("pairs")).where("m > 1")
    doc = docs.agg(
        F.sum("m").alias("N"), F.sum(F.col("pairs") / (F.col("m") - 1)).alias("o"), F.avg(F.col("pairs") / (F.col("m") * (F.col("m") - 1))).alias("po"),
    )
    values = cells.join(docs.select("document_id", "m"), "document_id").groupBy("v").agg(F.sum("c").alias("k"))
    value = values.agg(F.sum(F.col("k") * (F.col("k") - 1.0)).alias("kk"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    both = doc.join(F.broadcast(value))
    n = F.col("N").cast("double")
    pe = F.col("k2") / (n * n)
    return both.select(
        (1 - _ratio(1 - F.col("o") / n, 1 - F.col("kk") / (n * (n - 1)))).alias("alpha"), _ratio(F.col("po") - pe, 1 - pe).alias("fleiss_kappa")
    )


# --- scorers: one row each -------------------------------------------------------------------------------------------


def _cells(df: DataFrame, truth: str, predicted: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.sum(w).alias("w"), F.count("*").alias("n"))


def _per_class(df: DataFrame, truth: str, predicted: str, weight: str | None) -> DataFrame:
    cells = _cells(df, truth, predicted, weight)
    sides = F.explode(F.array(F.struct(F.col("t").alias("y"), F.lit(1).alias("side")), F.struct(F.col("p").alias("y"), F.lit(2).alias("side")))).alias("s")
    spread = cells.select(sides, "t", "p", "w", "n")
    true, guess = F.col("s.side") == 1, F.col("s.side") == 2
    return spread.groupBy("s.y").agg(
        F.sum(F.when(true, F.col("w")).otherwise(0.0)).alias("t"), F.sum(F.when(guess, F.col("w")).otherwise(0.0)).alias("p"),
        F.sum(F.when(true & (F.col("t") == F.col("p")), F.col("w")).otherwise(0.0)).alias("c"), F.sum(F.when(true, F.col("n")).otherwise(0)).alias("n"),
    )


def cohens_kappa(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    s = _per_class(df, truth, predicted, weight).agg(F.sum("t").alias("w"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    po, pe = F.col("c") / F.col("w"), F.col("tp") / F.col("w") ** 2
    return s.select(_ratio(po - pe, 1 - pe).alias("score"))


def matthews_corrcoef(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Of the rarest true label against the rest; ties go to the least."""
    rare = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("y")).agg(F.count("*").alias("n")).orderBy("n", "y").limit(1).select(F.col("y").alias("rare"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = df.join(F.broadcast(rare)).select((F.col(truth) == F.col("rare")).cast("int").alias("y1"), F.col(predicted).eqNullSafe(F.col("rare")).cast("int").alias("y2"), w.alias("w"), F.lit(1).alias("one"))
    return binary_metrics(binary_sums(pairs, ("one",))).select(F.col("matthews_corrcoef").alias("score"))


def maxmin(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """The least precision or recall of any true class; 0 where a class is never predicted."""
    c = _per_class(df, truth, predicted, weight).where("n > 0")
    least = F.least(F.coalesce(_ratio(F.col("c"), F.col("p")), F.lit(0.0)), F.coalesce(_ratio(F.col("c"), F.col("t")), F.lit(0.0)))
    return c.agg(F.min(least).alias("score"))


def mean_difference(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = df.agg(F.sum(F.col(truth) * w).alias("a"), F.sum(F.col(predicted) * w).alias("b"))
    return s.select(_ratio(F.least("a", "b"), F.greatest("a", "b")).alias("score"))


def classification_report(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """precision, recall, f1 and support of each true or predicted class."""
    c = _per_class(df, truth, predicted, weight)
    p, r = F.coalesce(_ratio(F.col("c"), F.col("p")), F.lit(0.0)), F.coalesce(_ratio(F.col("c"), F.col("t")), F.lit(0.0))
    return c.select(F.col("y").alias("label"), p.alias("precision"), r.alias("recall"), F.coalesce(_ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.col("t").alias("support"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


# --- probability thresholds ------------------------------------------------------------------------------------------


def apply_threshold(predicted: DataFrame, threshold, base, positive=None, outcome: str = "label_id") -> DataFrame:
    """Binary predictions at a threshold: positive where its probability reaches it, else base.

    The stored probability is that of the predicted label.  Rows without a
    probability stay as they are; without a positive code all become base.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if positive is None:
        return predicted.withColumn(outcome, F.lit(base))
    p = F.when(F.col(outcome) == F.lit(base), 1 - F.col("probability")).otherwise(F.col("probability"))
    new = F.when(p.isNull(), F.col(outcome)).when(p >= t, F.lit(positive)).otherwise(F.lit(base))
    return predicted.withColumn(outcome, new)


def rethreshold(classified: DataFrame, threshold: float, base, positive, outcome: str = "label_id") -> DataFrame:
    """Stored classifications re-decided at a threshold; where the label changes the probability becomes its complement."""
    p, label = F.col("probability"), F.col(outcome)
    up, down = (label == F.lit(base)) & (p <= 1 - threshold), (label == F.lit(positive)) & (p < threshold)
    return classified.withColumns(
        {outcome: F.when(up, F.lit(positive)).when(down, F.lit(base)).otherwise(label), "probability": F.when(up | down, 1 - p).otherwise(p)}
    )


def threshold_scores(predicted: DataFrame, truth: DataFrame, base, positive, thresholds: list[float], outcome: str = "label_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of the positive class at each threshold, and for each value of ``by``, in one pass: every row meets the literal list of thresholds."""
    both = predicted.join(truth.select("document_id", F.col(outcome).alias("truth")), "document_id")
    spread = both.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    decided = apply_threshold(spread, F.col("threshold"), base, positive, outcome)
    pairs = decided.select("threshold", *by, F.col("truth").alias("y1"), F.col(outcome).alias("y2"), F.lit(1.0).alias("w"))
    return binary_metrics(binary_sums(pairs, ("threshold", *by), positive))


def best_threshold(scores: DataFrame, metric: str = "precision_recall_min") -> DataFrame:
    """One row: the mean of all thresholds whose least score is the highest."""
    least = scores.groupBy("threshold").agg(F.min(metric).alias("s")).where("s is not null")
    top = least.agg(F.max("s").alias("s"))
    return least.join(F.broadcast(top), "s").agg(F.avg("threshold").alias("threshold"))


def best_cv_threshold(test: DataFrame, fold: DataFrame, metric: str = "precision_recall_min") -> DataFrame:
    """One row: the threshold with the best mean, over outcomes, of the lesser of test and fold scores (0 where missing)."""
    a = test.select("threshold", "outcome_column", F.coalesce(metric, F.lit(0.0)).alias("a"))
    b = fold.select("threshold", "outcome_column", F.coalesce(metric, F.lit(0.0)).alias("b"))
    means = a.join(b, ["threshold", "outcome_column"]).groupBy("threshold").agg(F.avg(F.least("a", "b")).alias("s"))
    return means.orderBy(F.desc("s"), "threshold").limit(1).select("threshold")


def fold_average(scores: DataFrame, keys: tuple[str, ...] = ("outcome_column",)) -> DataFrame:
    """Numeric scores averaged over folds."""
    numeric = [c for c, t in scores.dtypes if t in ("double", "float", "int", "bigint") and c not in (*keys, "fold")]
    return scores.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in numeric))


def incorrect(truth: DataFrame, predicted: DataFrame, correct=None, outcome: str = "label_id") -> DataFrame:
    """Documents whose prediction differs from the truth or is missing; of one true label, if given."""
    both = truth.select("document_id", F.col(outcome).alias("truth")).join(predicted.select("document_id", F.col(outcome).alias("predicted")), "document_id", "left")
    out = both.where(~F.col("truth").eqNullSafe(F.col("predicted")))
    return out.where(F.col("truth") == F.lit(correct)) if correct is not None else out
