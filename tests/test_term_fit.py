"""The regression over terms in blocks: the rows' products, the minimum, and the model that stays in tables."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparkmail.operators import ml as ML
from sparkmail.operators.regression import fit_logistic
from sparkmail.operators.term_fit import Rows, Terms, fit_rows, number_rows, term_blocks
from sparkmail.operators.term_model import TermClassifier, count_feedback, fit_term_model

TEXTS = ["the cat sat the mat", "the dog", None, "", "a b", "cat dog dog bird", "the the the", "Bird CAT naïve", "the cat sat the mat"]


def dense(texts):
    """Terms, and the TF-IDF rows of M9."""
    counts = [Counter(w for w in (t or "").lower().split() if len(w) > 1) for t in texts]
    terms = sorted(set().union(*counts))
    idf = [math.log((1 + len(texts)) / (1 + sum(t in c for c in counts))) + 1 for t in terms]
    x = np.array([[c[t] * i for t, i in zip(terms, idf)] for c in counts])
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, idf, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def feedback(spark, classes, n=90):
    words = {"spam": "winner prize claim money", "ham": "meeting agenda notes paper", "news": "today press report"}
    rows = [(i, None if i % 17 == 0 else f"the {words[c]} common {words[c].split()[i % 3]} no{i} {words[classes[i % 7 % len(classes)]]}", c)
            for i, c in enumerate([*classes] * (n // len(classes)))]
    return spark.createDataFrame([*rows, (rows[0][0], "prize", None)], "message_id long, text string, feedback string").repartition(5)


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(1000).repartition(7).where("id % 3 > 0")
    got = number_rows(df)
    assert sorted(r.row for r in got.collect()) == list(range(666)) and got.columns == ["id", "row"]
    assert number_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1, 3, 1 << 21])
def test_blocks_hold_whole_terms_and_give_the_products(spark, pairs):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row int, text string")
    blocks = term_blocks(df, pairs=pairs)
    terms, idf, x = dense(TEXTS)
    found = sorted(t for r in blocks.collect() for t in r.terms)
    assert found == terms
    assert all(len(Terms.read(r).rows) <= pairs or len(r.terms) == 1 for r in blocks.collect())
    space = Rows(blocks, len(TEXTS))
    v = np.random.default_rng(3).standard_normal((len(TEXTS), 2))
    assert space.times(v) == pytest.approx(x @ x.T @ v)
    w = {r.term: r for r in space.weights(v).collect()}
    space.close()
    assert [w[t].idf for t in terms] == pytest.approx(idf)
    assert np.array([w[t].coefs for t in terms]) == pytest.approx(x.T @ v)


@pytest.mark.parametrize("classes", [2, 3])
def test_minimum_is_that_of_the_fit_by_features(spark, classes):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(8)
    x = rng.random((80, 30)) * (rng.random((80, 30)) < 0.2)
    y = rng.integers(0, classes, 80)
    a, b, z = fit_rows(lambda v: x @ (x.T @ v), y, classes, 1 / 80, tolerance=1e-10)
    df = spark.createDataFrame([(float(c), Vectors.dense(r)) for c, r in zip(y, x)], ["y", "x"]).coalesce(2)
    weights, intercepts, _ = fit_logistic(df, "x", "y", 30, classes, 1 / 80, tolerance=1e-12)
    assert (x.T @ a).T == pytest.approx(weights, abs=1e-3) and b == pytest.approx(intercepts, abs=1e-3)
    assert z == pytest.approx(x @ (x.T @ a))


@pytest.mark.parametrize("classes", [["spam", "ham"], ["spam", "ham", "news"]])
def test_many_terms_stay_in_tables(spark, tmp, classes):
    """More terms than are gathered: the same model, but no stage that holds them; served as it is saved."""
    fb = feedback(spark, classes)
    small, want = ML.retrain(fb)
    large, got = ML.retrain(fb, most_terms=20)
    assert len(small.stages[1].vocabulary) > 20 and [type(s) for s in large.stages] == [TermClassifier]
    ML.save_model(large, tmp, "1")
    back = PipelineModel.load(f"{tmp}/models/v1")
    assert back.stages[0].uid == large.stages[0].uid
    given = fb.where("feedback is not null")
    served = back.transform(given.withColumn("text", F.upper("text")))
    by_id = lambda df: {r.message_id: r for r in df.collect()}
    want = by_id(small.transform(given.withColumn("text", F.coalesce("text", F.lit("")))))
    got, served = by_id(got), by_id(served)
    assert got.keys() == served.keys() == want.keys()
    for k, r in want.items():
        assert list(got[k].probability) == pytest.approx(list(r.probability), abs=2e-3)
        assert list(served[k].probability) == pytest.approx(list(got[k].probability), abs=1e-9)
        assert got[k].predicted_label == served[k].predicted_label == sorted(classes)[int(got[k].prediction)]


def test_tables_are_registered_and_label_through_the_champion(spark, tmp, monkeypatch):
    from sparkmail.plans.flows import retrain_and_register
    from sparkmail.streaming.stream import model_labeler

    fb = feedback(spark, ["spam", "ham"]).withColumn("_row", F.lit("own"))
    reg = retrain_and_register(spark, fb, tmp, "1", "2026-01-15", dt.datetime(2026, 1, 15), most_terms=0)
    assert [r.is_champion for r in reg.collect()] == [True]
    out = model_labeler(tmp)(fb.select("message_id", "text", "_row"))
    assert out.columns == ["message_id", "text", "_row", "predicted_label", "confidence"]
    assert {r.predicted_label for r in out.collect()} == {"spam", "ham"}


def test_counted_once_for_two_models(spark):
    fb = feedback(spark, ["spam", "ham"])
    counted = count_feedback(fb)
    assert counted.rows.where("feedback is null").isEmpty()
    a = {r.term: r.coefs[0] for r in fit_term_model(fb, counted=counted).terms.collect()}
    b = {r.term: r.coefs[0] for r in fit_term_model(fb).terms.collect()}
    assert a.keys() == b.keys() and [a[t] for t in a] == pytest.approx([b[t] for t in a], abs=1e-6)
    model, pred = ML.retrain(fb, most_terms=0, counted=counted)
    assert {r.term: r.coefs[0] for r in model.stages[0].model.terms.collect()} == pytest.approx(a, abs=1e-6)
    assert pred.columns == ["message_id", "text", "feedback", "probability", "predicted_label", "prediction"]


def test_one_class_and_texts_without_terms(spark):
    one = spark.createDataFrame([("a b", "spam"), (None, "spam"), ("", "spam"), ("x", "spam"), ("y", "spam")], "text string, feedback string")
    assert {tuple(r.probability) for r in fit_term_model(one).predict(one).collect()} == {(1.0,)}
    two = one.union(one.withColumn("feedback", F.lit("ham")).limit(2))
    model, pred = ML.retrain(two, most_terms=-1)
    assert {round(r.probability[1], 3) for r in pred.collect()} == {round(5 / 7, 3)}
    assert model.transform(two).count() == 7
