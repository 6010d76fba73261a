"""The one-pass grid search against separate fits by Spark, and its cases."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from sparkmail.operators import ml as ML
from sparkmail.operators.grid import Descent, fold_of, grid_search
from sparkmail.operators.ranks import auc_by, rank_statistics

SIZE, FOLDS, GRID = 64, 3, (0.01, 0.1, 1.0)


def messages(spark, n=400):
    rng = random.Random(3)
    spam, ham, both = "prize winner claim offer".split(), "agenda notes budget review".split(), "the a hello please team and".split()
    rows = []
    for i in range(n):
        label = float(rng.random() < 0.4)
        own = (spam if label else ham) if rng.random() < 0.8 else (ham if label else spam)
        rows.append((i, " ".join(["all", *rng.choices(both, k=6), *rng.choices(own, k=2)]), label))
    df = spark.createDataFrame(rows, "message_id long, text string, label double")
    return HashingTF(inputCol="t", outputCol="x", numFeatures=SIZE).transform(Tokenizer(inputCol="text", outputCol="t").transform(df))


@pytest.fixture(scope="module")
def counted(spark):
    return messages(spark).persist()


@pytest.fixture(scope="module")
def found(counted):
    return grid_search(counted, "x", SIZE, GRID, FOLDS, seed=5, tolerance=1e-9)


def test_same_weights_as_separate_fits(counted, found):
    """Every model, also with a term in all rows: what Spark's pipeline fits on the fold's training rows."""
    for fold, penalty in [(0, 0.01), (1, 0.1), (2, 1.0)]:
        train = counted.where(fold_of("message_id", FOLDS, 5) != fold)
        fit = Pipeline(stages=[IDF(inputCol="x", outputCol="f"), LogisticRegression(
            featuresCol="f", regParam=penalty, maxIter=200, tol=1e-10)]).fit(train)
        want = np.append(fit.stages[1].coefficients.toArray() * fit.stages[0].idf.toArray(), fit.stages[1].intercept)
        assert found.weights[fold, penalty] == pytest.approx(want, abs=2e-3)


def test_same_choice_and_areas_as_the_separate_search(counted, found):
    idf, lr = IDF(inputCol="x", outputCol="f"), LogisticRegression(featuresCol="f", maxIter=200, tol=1e-10)
    cv = CrossValidator(estimator=Pipeline(stages=[idf, lr]), estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(GRID)).build(),
                        evaluator=BinaryClassificationEvaluator(numBins=0), numFolds=FOLDS, foldCol="fold")
    separate = cv.fit(counted.withColumn("fold", fold_of("message_id", FOLDS, 5)))
    means = {r.penalty: r.auc for r in found.results.groupBy("penalty").agg(F.avg("auc").alias("auc")).collect()}
    assert [means[p] for p in GRID] == pytest.approx(separate.avgMetrics, abs=2e-3)
    assert found.best == GRID[int(np.argmax(separate.avgMetrics))]
    rows = found.results.collect()
    assert len(rows) == FOLDS * len(GRID) and all(r.trained + r.held == 400 for r in rows)
    for r in rows:
        share = counted.where(fold_of("message_id", FOLDS, 5) != r.fold).agg(F.avg("label")).first()[0]
        assert r.mean_score == pytest.approx(share, abs=1e-3)


def test_jobs_do_not_grow_with_models(spark, counted):
    """A pass is one job for all models, however many they are."""
    sc = spark.sparkContext

    def jobs(grid, folds):
        name = f"grid-{len(grid)}-{folds}"
        sc.setJobGroup(name, name)
        s = grid_search(counted, "x", SIZE, grid, folds, steps=6, tolerance=0.0)
        n = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n - s.passes, s.passes

    few, many = jobs((0.1,), 2), jobs((0.01, 0.03, 0.1, 0.3), 5)
    assert abs(many[0] - few[0]) <= 4  # jobs beside the passes; adaptive plans vary
    assert many[1] <= 4 * few[1]  # twenty models against two: line searches may differ, models do not add up


def test_nulls_repeats_one_class_and_empty(spark, counted):
    odd = counted.limit(30).unionByName(counted.limit(30)).withColumn("message_id", F.when(F.col("message_id") < 3, None).otherwise(F.col("message_id")))
    odd = odd.withColumn("label", F.when(F.col("message_id") == 5, None).otherwise(F.col("label"))).withColumn("fold", F.lit("x")).withColumn("a.b", F.lit(1))
    got = grid_search(odd, "x", SIZE, (0.1,), 2)
    assert sum(r.held for r in got.results.collect()) == odd.where("label is not null").count()
    one = grid_search(counted.limit(20).withColumn("label", F.lit(1.0)), "x", SIZE, (0.1, 0.2), 2)
    assert one.best == 0.1 and all(r.auc is None for r in one.results.collect())
    none = grid_search(counted.limit(0), "x", SIZE, (0.1, 0.2), 2)
    assert none.best == 0.1 and none.passes <= 3 and all(r.auc is None and r.held == 0 for r in none.results.collect())


def test_dense_vectors_are_the_same(spark, counted, found):
    dense = counted.withColumn("x", array_to_vector(vector_to_array("x")))
    again = grid_search(dense, "x", SIZE, (0.1,), FOLDS, seed=5, tolerance=1e-9)
    assert all(again.weights[f, 0.1] == pytest.approx(found.weights[f, 0.1], abs=1e-4) for f in range(FOLDS))


def test_descent_on_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    d = Descent(np.array([3.0, -2.0, 1.0]), 200, 1e-14)
    while d.trial is not None:
        d.tell(float(d.trial @ a @ d.trial) / 2, a @ d.trial)
    assert np.abs(d.point).max() < 1e-4


@pytest.mark.parametrize("part_rows", [3, 1 << 17])
def test_grouped_areas(spark, part_rows):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(8) / 4, rng.choice([0.0, 1.0, None])) for _ in range(300)] + [("d", 1.0, 1.0), ("e", None, 0.0)]
    df = spark.createDataFrame(rows, "g string, score double, label double")
    got = {r.g: r.auc for r in auc_by(df, ["g"], part_rows=part_rows).collect()}
    assert set(got) == {None, "a", "b", "c", "d"} and got["d"] is None
    for g in (None, "a", "b", "c"):
        assert got[g] == pytest.approx(rank_statistics(df.where(F.col("g").eqNullSafe(g))).first().auc)


def test_training_by_either_search(spark):
    rows = [(i, ("winner prize " if i % 2 else "agenda notes ") + str(i % 7), float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "message_id long, text string, label double")
    for search in ("together", "separate"):
        model, metrics = ML.train(df, seed=1, folds=2, grid=(0.01, 0.1), search=search)
        assert model.stages[-1].getLabels() == ["ham", "spam"]
        assert {r.split: r.accuracy for r in metrics.collect()} == {"train": 1.0, "holdout": 1.0}
