"""Known results of operators on small inputs."""

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyloom import registry
from tallyloom.functions import text as T
from tallyloom.operators import administration, agreement, datasets, features, filters, lookups, models, sampling, selection, topics, weights, workflow
from tallyloom.sources import readers, writers
from tallyloom.streaming import incremental

# A sentence, its cleaned forms and scores that results must equal.
SAID = "Testing one two three and four but not five. This is an action movie and it's exciting."


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, "testing one two three and four but not five this action movie and exciting"),
        ({"regex_replacers": [("movie", "replacer_worked")]}, "testing one two three and four but not five this action replacer_worked and exciting"),
        ({"stopword_sets": ["english"]}, "testing action movie exciting"),
        ({"stopword_sets": ["english", "test"], "custom_sets": {"test": ["movie"]}}, "testing action exciting"),
        ({"regex_filters": ["action"]}, "this action movie and exciting"),
        ({"stopword_sets": ["english"], "whitelist": ["and"]}, "testing and action movie and exciting"),
    ],
)
def test_clean_text(spark, options, want):
    assert one(spark, T.clean_text(F.lit(SAID), **options)) == want


def test_text_functions(spark):
    assert one(spark, F.array_join(T.cooccurrences(F.lit("one two three")), " ")) == "one two one three two three"
    assert one(spark, T.cooccurrences(F.lit("one"))) == []
    assert one(spark, T.words_and_bigrams(F.lit("a b c"))) == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, T.words_and_bigrams(F.lit(None).cast("string"))) == []
    assert one(spark, features.tokens(F.lit("One two three"), (1, 2))) == ["one", "two", "three", "one two", "two three"]
    assert one(spark, T.ngram_count(F.lit("abandon abandoned Abandoning"), ["abandon*"])) == 2
    assert one(spark, T.ngram_count(F.lit("go, go going"), ["go"])) == 2
    assert one(spark, T.ngram_count(F.lit("anything"), [])) == 0
    assert one(spark, T.year_month(F.lit("2000-01-05").cast("date"))) == "2000_1"
    assert one(spark, T.anchors_list(F.lit("a, b ,"))) == ["a", "b"]
    assert one(spark, T.language(F.lit("der Hund und die Katze"))) == "de"
    assert one(spark, T.language(F.lit("xyz"))) == "unk"
    assert T.canonical({"b": [2, 1], "a": {"y": 1, "x": 2}}) == T.canonical({"a": {"x": 2, "y": 1}, "b": [1, 2]})
    assert T.breadcrumb({"A": {"B": "anger"}}, "anger") == "A > B"


def pairs(spark, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame([(i, c, v) for i, (a, b) in enumerate(rows) for c, v in ((1, a), (2, b))], "document_id int, coder_id int, label_id int")


def test_agreement_goldens(spark):
    codes = pairs(spark, 8, 3, 3, 186)
    row = agreement.scores_by_value(codes, values=[1]).first()
    for name, want in {
        "cohens_kappa": 0.7113997113997114, "matthews_corrcoef": 0.7113997113997114, "roc_auc": 0.8556998556998558,
        "alpha_unweighted": 0.7121212121212122, "pct_agree_unweighted": 0.97, "precision": 8 / 11,
    }.items():
        assert row[name] == pytest.approx(want), name
    assert row["coder1_std_unweighted"] == pytest.approx(math.sqrt(0.055 * 0.945 / 199))
    assert agreement.overall(codes).first()["alpha"] == pytest.approx(0.7121212121212122)
    whole = agreement.scores_overall(codes).first()
    assert whole["cohens_kappa"] == pytest.approx(0.7113997113997114)
    assert agreement.scores_by_value(codes, values=[1], min_overlap=201).count() == 0


def test_overall_row_of_several_classes(spark):
    rows = [("a", "a")] * 5 + [("b", "b")] * 4 + [("c", "b")] * 1 + [("c", "c")] * 2
    codes = spark.createDataFrame([(i, c, v) for i, r in enumerate(rows) for c, v in enumerate(r)], "document_id int, coder_id int, label_id string")
    row = agreement.scores_overall(codes).first()
    assert row["recall"] == pytest.approx(11 / 12)
    assert row["precision"] == pytest.approx((5 * 1 + 4 * 0.8 + 3 * 1) / 12)
    assert row["cohens_kappa"] is None


def test_scorers_with_a_class_nobody_predicts(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "t int, p int")
    assert agreement.maxmin(df, "t", "p").first()["score"] == 0
    assert agreement.matthews_corrcoef(df, "t", "p").first()["score"] is None


def test_threshold_without_probability_leaves_rows(spark):
    df = spark.createDataFrame([(1, 10, None), (2, 11, 0.9), (3, 10, 0.7)], "document_id int, label_id int, probability double")
    assert [r["label_id"] for r in agreement.apply_threshold(df, 0.8, 11, 10).orderBy("document_id").collect()] == [10, 11, 11]
    assert {r["label_id"] for r in agreement.apply_threshold(df, 0.8, 11).collect()} == {11}
    again = {r["document_id"]: (r["label_id"], round(r["probability"], 6)) for r in agreement.rethreshold(df.where("probability is not null"), 0.8, 11, 10).collect()}
    assert again == {2: (11, 0.9), 3: (11, 0.3)}


def test_lookups_keep_nulls_when_excluding(spark):
    df = spark.createDataFrame([(1, "Action"), (2, None), (3, "drama")], "document_id int, text string")
    ids = lambda d: sorted(r["document_id"] for r in d.collect())
    assert ids(lookups.lookup_filter(df, "text__icontains", "action", exclude=True)) == [2, 3]
    assert ids(lookups.lookup_filter(df, "text__isnull", True)) == [2]
    assert ids(lookups.lookup_filter(df, None, "x")) == [1, 2, 3]
    assert ids(lookups.frame_predicate(df, {"document_id__in": [1, 2]}, {"text": "Action"})) == [2]


def test_filters_follow_their_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, None)], "document_id int, coder_id int")
    docs = lambda d: sorted({r["document_id"] for r in d.collect()})
    assert docs(filters.coded_at_least(df, 2)) == [1]
    assert docs(filters.coded_by_all(df)) == [1]
    assert docs(filters.coders_with_documents(df, 1)) == [1, 2]
    assert docs(filters.by_document_ids(df, [2])) == [2]


def test_discrete_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.2, 0.8)], "document_id int, label_1 double, label_2 double")
    pick = lambda **o: [r["x"] for r in df.orderBy("document_id").select(datasets.discrete_label(["label_1", "label_2"], **o).alias("x")).collect()]
    assert pick() == ["1", None, "2"]
    assert pick(base="2") == ["1", "2", "1"]
    assert pick(threshold=0.6) == [None, None, "2"]
    assert pick(threshold=0.0) == pick()


def test_weights(spark):
    months = [("a",)] * 23 + [("b",)] * 18 + [("c",)] * 20 + [("d",)] * 19 + [("e",)] * 20 + [(None,)]
    df = spark.createDataFrame([(i, m) for i, (m,) in enumerate(months)], "document_id int, month string")
    got = {r["month"]: round(r["balancing_weight"], 2) for r in weights.balancing(df, ["month"]).collect()}
    assert (got["a"], got["b"], got[None]) == (0.87, 1.11, 1.0)
    assert {r["weight"] for r in weights.poststratification(df, df, []).collect()} == {1.0}


def test_samples_have_their_size_and_repeat(spark):
    df = spark.range(100).select(F.col("id").alias("document_id"), (F.col("id") % 3).alias("s"))
    a, b = (sorted(r["document_id"] for r in sampling.simple(df, 10, 1).collect()) for _ in range(2))
    assert a == b and len(a) == 10
    assert sampling.simple(df, 1000, 1).count() == 100
    sorted_draw, sampling.SORTED_DRAW = sampling.SORTED_DRAW, 0
    try:
        assert sorted(r["document_id"] for r in sampling.simple(df, 10, 1).collect()) == a
        assert sampling.simple(df, 100, 1).count() == 100
    finally:
        sampling.SORTED_DRAW = sorted_draw
    q = {r["s"]: r["quota"] for r in sampling.quotas(df, ["s"], 10).collect()}
    assert q == {0: 4, 1: 3, 2: 3}
    assert sampling.stratified(df, ["s"], 10, 1).count() == 10
    assert {r["quota"] for r in sampling.quotas(df, ["s"], 1, "stratify_guaranteed").collect()} == {1}
    split = sampling.train_test(df, 0.25, 1)
    assert split.where("is_test").count() == 25
    folds = sampling.folds(df, "s", 5, 1).groupBy("fold").count().collect()
    assert len(folds) == 5 and max(f["count"] for f in folds) <= 21
    assert sampling.expansion_size(100, 150, 10) == 15
    with pytest.raises(ValueError):
        sampling.quotas(df, ["s"], 10, "other").count()


def test_workflow(spark):
    existing = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, workflow.upsert(existing, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    xml = "<QuestionFormAnswers><Answer><QuestionIdentifier>q1</QuestionIdentifier><FreeText>yes</FreeText></Answer><Answer><QuestionIdentifier>q2</QuestionIdentifier><SelectionIdentifier/></Answer></QuestionFormAnswers>"
    assert [tuple(r) for r in one(spark, workflow.parse_answers(F.lit(xml)))] == [("q1", "yes"), ("q2", None)]
    gone, come = workflow.response_changes(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), True)
    assert one(spark, gone) == [1] and one(spark, come) == [3]
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "label string, parent string")
    with pytest.raises(ValueError):
        workflow.dependency_chain(loop, max_depth=6)


def test_lexicons_and_configs(spark, tmp_path):
    (tmp_path / "l.dic").write_text("%\n1\tanger\n2\tjoy\n%\nhate\t1\nlove*\t2\nhappy\t2\t1\n")
    got = {r["category"]: (r["label"], r["words"]) for r in readers.lexicon_dic(spark, str(tmp_path / "l.dic"), {"Affect": {"Negative": "anger"}}).collect()}
    assert got == {"anger": ("Affect > Negative", ["happy", "hate"]), "joy": ("joy", ["happy", "love*"])}
    (tmp_path / "n.tsv").write_text("good\ttrust\t1\nbad\ttrust\t0\n")
    row = readers.lexicon_tsv(spark, str(tmp_path / "n.tsv"), {"trust": ["extra"]}).first()
    assert (row["label"], row["words"]) == ("Trust", ["extra", "good"])
    (tmp_path / "projects" / "sub").mkdir(parents=True)
    (tmp_path / "projects" / "sub" / "p.json").write_text('{"questions": [{"name": "q", "labels": [{"value": 1}, {"value": 0, "select_as_default": true}]}]}')
    config = readers.configurations(spark, str(tmp_path / "projects"))
    assert list(config) == ["sub_p"]
    questions, labels = readers.project_tables(config["sub_p"])
    assert questions == [("q", None, None, 0)] and [x[1] for x in labels] == ["1", "0"]
    frame = spark.range(3).select(F.col("id").alias("document_id"))
    assert writers.write_frame(frame, str(tmp_path / "f")) and not writers.write_frame(frame, str(tmp_path / "f"))
    key = writers.cache_key("x", {"a": [1, 2]})
    assert key == writers.cache_key("x", {"a": [2, 1]})
    assert writers.cached(spark, str(tmp_path), key, lambda: frame, only_existing=True) is None
    assert writers.cached(spark, str(tmp_path), key, lambda: frame).count() == 3


def test_registry():
    @registry.register("scoring_functions", "mine")
    def mine(df, truth, predicted, weight=None):
        return df

    assert registry.get("scoring_functions", "mine") is mine
    with pytest.raises(KeyError):
        registry.get("scoring_functions", "none")
    with pytest.raises(ValueError):
        registry.register("nothing")


def test_models_and_topics(spark):
    rows = [(i, "good great film" if i % 2 else "bad awful film", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "document_id long, text string, label double")
    folds = sampling.folds(df, "label", 2, 1)
    out = models.cross_validated(folds, models.pipeline("multinomial_nb"), 2)
    assert models.binary_report(out).first()["f1"] == 1.0
    best, tried = models.grid_search(folds, lambda smoothing: models.pipeline("multinomial_nb", smoothing=smoothing), {"smoothing": [0.5, 1.0]}, 2, lambda r: agreement.maxmin(r, "label", "prediction"))
    assert len(tried) == 2 and best["smoothing"] in (0.5, 1.0)
    fitted = models.pipeline("logistic_regression").fit(df)
    assert {w for w, _ in models.top_features(fitted, 4)} == {"good", "great", "bad", "awful"}
    again = models.apply_to_frame(fitted, df, df.where("document_id < 30").select("document_id"))
    assert again.count() == 10
    assert models.positive_class(df, 0.0).first()["label"] == 1.0
    model = topics.train(df, 2, [["good"], ["bad"]], words=10, rounds=8)
    value = {(r["document_id"], r["topic"]): r["value"] for r in topics.apply(model, df).collect()}
    assert value[1, 0] == 1 and value[0, 0] == 0 and value[0, 1] == 1
    assert topics.topic_ngrams(model, 1)[0][0] == 0
    method = topics.validation_method({"film": ["film"]})
    assert method["sampling_searches"][0]["proportion"] == 0.5 and topics.codebook("p", {"film": ["film"]})["questions"][0]["name"] == "film"


def test_stream_classifies_each_document_once(spark, tmp_path):
    source, done = str(tmp_path / "in"), str(tmp_path / "done")
    label = lambda df: df.select("document_id", F.lit(1).alias("label_id"))
    for part in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in part], "document_id long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("document_id long").parquet(source)
        incremental.classify_new(stream, label, done)
        spark.catalog.clearCache()
    ids = sorted(r["document_id"] for r in spark.read.parquet(done).collect())
    assert sorted(set(ids)) == [1, 2, 3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "document_id long, coder_id int, label_id int, text string")
    assert datasets.document_coder(empty.withColumns({"coder_name": F.lit("x"), "coder_is_mturk": F.lit(True)}), (1, 2)).count() == 0
    assert agreement.scores_overall(empty).count() == 0
    assert agreement.overall(empty).first()["alpha"] is None
    assert features.tfidf(empty).count() == 0
    assert sampling.simple(empty, 5, 1).count() == 0


def test_placed_and_ranked_over_many_partitions(spark):
    """Places by ranges and ranks by bins equal one sort, nulls in keys and strata included."""
    rows = [(i, None if i % 7 == 0 else (i * 37) % 11, None if i % 5 == 0 else f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "document_id long, k long, s string").repartition(7)
    got = {r["document_id"]: r["place"] for r in workflow.placed(df, ["-k", "document_id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[r[0]] for r in order] == list(range(1, 401))
    key = lambda i: (hashlib.md5(f"3_{i}".encode()).hexdigest(), i)
    ranks = {r["document_id"]: r["rank_"] for r in sampling.ranked(df, ["s"], 3).collect()}
    for s in ("s0", "s1", "s2", None):
        assert [ranks[i] for i in sorted((r[0] for r in rows if r[2] == s), key=key)] == list(range(1, 1 + sum(r[2] == s for r in rows)))


def test_exact_median_of_large_groups(spark):
    r = random.Random(2)
    rows = [(k, [r.choice([r.random(), 0.5]), float(r.randint(0, 3))]) for k in ("a", "b", None) for _ in range(r.choice([1, 2, 501, 640]))]
    got = {(s["g"], s["dim"]): s["median"] for s in features.vector_stats(spark.createDataFrame(rows, "g string, embedding array<double>"), "g").collect()}
    for (g, dim), median in got.items():
        assert median == pytest.approx(statistics.median(v[dim] for k, v in rows if k == g))
    assert len(got) == 2 * len({k for k, _ in rows})


def test_commands_and_guards(spark):
    assert len(registry.names("commands")) == 8
    coders = spark.createDataFrame([], "coder_id int, coder_name string, coder_is_mturk boolean")
    assert [tuple(r) for r in registry.get("commands", "coding_create_coder")(coders, "new").collect()] == [(1, "new", False)]
    known = spark.createDataFrame([("html",), ("months",)], "name string")
    assert administration.guarded("stopword_sets", known, "name").count() == 2
    with pytest.raises(KeyError, match="nothing"):
        administration.guarded("stopword_sets", spark.createDataFrame([("nothing",), (None,)], "name string"), "name")


def test_fuzzy_hashes_share_parts(spark):
    words = [f"w{k}" for k in range(200)]
    near = [*words[:100], "x", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, None), (5, " \n"), (6, "One two"), (7, "one  TWO")]
    got = {r["i"]: r["h"].split(":") for r in spark.createDataFrame(rows, "i int, t string").select("i", T.fuzzy_hash(F.col("t")).alias("h")).collect()}
    assert sum(a == b for a, b in zip(got[1], got[2], strict=True)) >= 2 and not set(got[1]) & set(got[3])
    assert got[4] == got[5] and got[6] == got[7] and all(len(h) == 4 for h in got.values())


def plain_naive_bayes(x, y, z):
    """Multinomial with add-one smoothing."""
    prior = np.log([(y == c).mean() for c in (0, 1)])
    theta = np.log([(x[y == c].sum(axis=0) + 1) / (x[y == c].sum() + x.shape[1]) for c in (0, 1)])
    return (z @ theta.T + prior).argmax(axis=1)


def test_classifiers_equal_plain_fits(spark):
    """Naive Bayes as numpy fits it; the others tell a planted rule that no constant does; weights of rows count like repeats."""
    rng = np.random.default_rng(5)
    x = rng.poisson(2, size=(300, 6)).astype(float)
    y = (x[:, 0] + x[:, 1] > x[:, 2] + x[:, 3]).astype(int)
    frame = lambda x, y, w: spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True)], ["features", "label", "w"])
    ones, w = np.ones(300), rng.integers(1, 4, 300)
    told = lambda model, df: np.array([r["prediction"] for r in model.transform(df).collect()])
    df = frame(x, y, ones)
    assert (told(models.classifier("multinomial_nb").fit(df), df) == plain_naive_bayes(x, y, x)).all()
    for name in ("decision_tree", "random_forest", "gradient_boosting", "linear_svc", "sgd", "logistic_regression"):
        assert (told(models.classifier(name, **({"maxIter": 10} if name in ("linear_svc", "gradient_boosting") else {})).fit(df), df) == y).mean() > 0.85, name
    repeated = np.repeat(np.arange(300), w)
    weighted = models.classifier("multinomial_nb", weight="w").fit(frame(x, y, w))
    theta = np.log([(x[repeated][y[repeated] == c].sum(axis=0) + 1) / (x[repeated][y[repeated] == c].sum() + 6) for c in (0, 1)])
    assert np.allclose(weighted.theta.toArray(), theta)


def test_nested_parameters_names_and_preprocessors(spark):
    steps = [("features", [("tfidf", None), ("counts", None)]), ("model", None)]
    assert selection.collapsed_params(steps, {"tfidf": {"min_df": [1, 5], "none": []}, "model": {"depth": [3]}}) == {"features__tfidf__min_df": [1, 5], "model__depth": [3]}
    rows = [(i, "good day sun" if i % 2 else "bad rain night", float(i), float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "document_id long, text string, n double, label double")
    model = models.pipeline("logistic_regression", numeric=["n"]).fit(df)
    assert sorted(selection.feature_names(model, "x_")) == sorted(["x_n_filled", *(f"x_{w}" for w in ("good", "day", "sun", "bad", "rain", "night"))])
    out = selection.preprocessed(df, [("replaced", {"replacers": [("sun", "moon")]}), ("clean_text", {})])
    assert out.columns == df.columns and out.where("document_id = 1").first()["text"] == "good day moon"


def test_scorers_refuse_unknown_names_and_search_needs_two_classes(spark):
    with pytest.raises(ValueError, match="brier_loss"):
        selection.scorer("brier_loss")
    df = spark.createDataFrame([(1, 1), (0, 1)], "label int, prediction int")
    assert selection.scorer("precision", 1)(df).first()["score"] == 0.5 and selection.scorer("f1", 7)(df).first()["score"] == 0.0
    assert selection.threshold_search(df, df, df, None, 1) is None


def test_paths_keep_rows_that_lead_nowhere(spark):
    rows, far = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "i int, k int"), spark.createDataFrame([(5, "a")], "k int, name string")
    got = lookups.follow(rows, ["far__name", "i"], {"far": (far, "k")})
    assert sorted((r["i"], r["far__name"]) for r in got.collect()) == [(1, "a"), (2, None), (3, None)]
    with pytest.raises(KeyError, match="nowhere"):
        lookups.follow(rows, ["nowhere__name"], {})
