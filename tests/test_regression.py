"""Logistic regression in the features as they are: the minimum, and in few passes."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import Vectors

from sparkmail.operators.regression import fit_logistic, logistic_model


def rows(classes, n=600, size=400):
    """Sparse unit vectors: a few frequent features, many that one or two rows have."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        y = int(rng.integers(classes))
        at = sorted({int(v) for v in rng.integers(0, 8, 3)} | {8 + int(v) for v in rng.integers(0, size - 8, 4)} | {y if rng.random() < 0.6 else 7})
        x = rng.random(len(at)) + 0.1
        out.append((float(y), Vectors.sparse(size, at, x / np.linalg.norm(x))))
    return out


def gradient(data, weights, intercepts, penalty):
    """By dense arrays, features by classes."""
    x, y = np.array([v.toArray() for _, v in data]), np.array([int(c) for c, _ in data])
    z = x @ weights.T + intercepts
    if len(weights) == 1:
        rest = 1 / (1 + np.exp(-z)) - y[:, None]
    else:
        rest = np.exp(z - z.max(1, keepdims=True))
        rest = rest / rest.sum(1, keepdims=True) - np.eye(len(weights))[y]
    return np.vstack([x.T @ rest / len(y) + penalty * weights.T, rest.mean(0)])


@pytest.mark.parametrize("classes", [2, 3])
def test_at_the_minimum_and_as_spark(spark, classes):
    data = rows(classes)
    df = spark.createDataFrame(data, ["y", "x"]).coalesce(2)
    weights, intercepts, passes = fit_logistic(df, "x", "y", 400, classes, 1 / 600, tolerance=1e-10)
    assert np.abs(gradient(data, weights, intercepts, 1 / 600)).max() < 1e-5
    theirs = LogisticRegression(featuresCol="x", labelCol="y", maxIter=1000, tol=1e-9, regParam=1 / 600, standardization=False).fit(df)
    assert weights == pytest.approx(theirs.coefficientMatrix.toArray(), abs=0.02)
    assert intercepts == pytest.approx(theirs.interceptVector.toArray(), abs=0.02)
    # Spark's search, in features divided by their deviation, takes more steps on the same rows.
    assert passes < len(theirs.summary.objectiveHistory)


@pytest.mark.parametrize("classes", [2, 3])
def test_model_is_saved_and_served(spark, tmp, classes):
    df = spark.createDataFrame(rows(classes, 60), ["y", "x"])
    weights, intercepts, _ = fit_logistic(df, "x", "y", 400, classes, 1 / 60)
    logistic_model(weights, intercepts, "x", "y").write().save(f"{tmp}/m")
    back = LogisticRegressionModel.load(f"{tmp}/m")
    assert back.numClasses == classes and back.getFeaturesCol() == "x"
    z = np.array([v.toArray() for _, v in rows(classes, 60)]) @ weights.T + intercepts
    p = np.hstack([1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))]) if classes == 2 else np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got = np.array([r.probability.toArray() for r in back.transform(df).select("probability").collect()])
    assert np.sort(got, 0) == pytest.approx(np.sort(p, 0), abs=1e-9)


def test_empty_vectors_and_partitions(spark):
    df = spark.createDataFrame([(0.0, Vectors.sparse(3, [], [])), (1.0, Vectors.sparse(3, [2], [1.0])), (1.0, Vectors.dense([0.0, 1.0, 0.0]))], ["y", "x"])
    data = [(r.y, r.x) for r in df.collect()]
    weights, intercepts, _ = fit_logistic(df.repartition(9), "x", "y", 3, 2, 0.5, tolerance=1e-12)
    assert np.abs(gradient(data, weights, intercepts, 0.5)).max() < 1e-5
