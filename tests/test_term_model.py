"""The feedback model in tables gives the labels of the one that holds its vocabulary."""

import math

import pytest
from pyspark.sql import functions as F

from sparkmail.operators import ml as ML
from sparkmail.operators.term_model import TermModel, fit_term_model, join_terms, term_dictionary
from sparkmail.session import stage_table


def feedback(spark, classes):
    words = {"spam": "winner prize claim money", "ham": "meeting agenda notes paper", "news": "today press report"}
    rows = [(i, f"the {w} common {w.split()[i % 3]} no{i}" if i % 9 else None if i % 2 else "", c)
            for i, (c, w) in enumerate([(c, words[c]) for c in classes] * 12)]
    return spark.createDataFrame([*rows, (900, "prize", None)], "message_id long, text string, feedback string")


@pytest.mark.parametrize("classes", [["spam", "ham"], ["spam", "ham", "news"]])
def test_labels_and_probabilities_of_the_present_model(spark, tmp, classes):
    fb = feedback(spark, classes)
    model, _ = ML.retrain(fb)
    fit_term_model(fb).save(f"{tmp}/m")
    mine = TermModel.load(spark, f"{tmp}/m")
    new = spark.createDataFrame([(1, "Prize money"), (2, "the agenda"), (3, "unheard words"), (4, None), (4, None), (5, "press today")], "k long, text string")
    theirs = fb.unionByName(new.select(F.col("k").alias("message_id"), F.col("text"), F.lit(None).cast("string").alias("feedback"))) \
        .withColumn("text", F.coalesce("text", F.lit("")))
    want = sorted((r.message_id, r.text, r.predicted_label, [round(float(v), 3) for v in r.probability]) for r in model.transform(theirs).collect())
    got = sorted((r.message_id, r.text, r.predicted_label, [round(v, 3) for v in r.probability]) for r in mine.predict(theirs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], abs=0.005)
        assert g[2] == w[2] or sorted(w[3])[-1] - sorted(w[3])[-2] < 0.01
    assert mine.predict(new.withColumn("_row", F.lit("x"))).columns == ["k", "text", "_row", "probability", "predicted_label"]
    assert mine.predict(new.limit(0)).count() == 0


def test_too_few_samples_and_one_class(spark):
    few = spark.createDataFrame([("a b", "spam")] * 4, "text string, feedback string")
    assert fit_term_model(few) is None
    one = fit_term_model(few.union(few))
    assert {r.predicted_label for r in one.predict(few).collect()} == {"spam"}


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "b aa aa cc"), (2, "cc Aa"), (3, None)], "id long, text string")
    d = term_dictionary(ML.tfidf(docs, "id", "text"), 3)
    assert [(r.idx, r.term, r.df, round(r.idf, 9)) for r in d.orderBy("idx").collect()] == \
        [(0, "aa", 2, round(math.log(4 / 3) + 1, 9)), (1, "cc", 2, round(math.log(4 / 3) + 1, 9))]


def test_hot_terms_are_joined_once(spark):
    pairs = stage_table(spark.range(300).select("id", F.when(F.col("id") < 200, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("term")), "pairs")
    terms = pairs.select("term").distinct().where("term <> 't7'").withColumn("idx", F.length("term"))
    for most in (1, 2, 10, 1000):
        got = join_terms(pairs, terms, most)
        assert got.count() == 298 and got.select("id").distinct().count() == 298
