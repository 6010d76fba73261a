"""Logistic regression over as many features as there are terms (M8).

The objective is that of Spark's logistic regression without standardisation: mean log-loss plus half the penalty times the
squared weights; one weight a feature for two classes, one a feature and class for more, intercepts without penalty. Spark
minimises it in features divided by their deviation, where the penalty of a rare term is thousands of times that of a frequent
one and the search takes hundreds of steps. Here it is minimised in the features as they are. Every step is a pass over all
rows, kept as sparse blocks; the gradient is added up by slices of features in tasks, and the driver gets one number a
feature and class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, SparseVector, Vectors
from pyspark.sql import DataFrame

from sparkmail.operators.grid import BLOCK_ENTRIES, Block, Descent
from sparkmail.operators.ranks import col
from sparkmail.session import ensure_shipped

#: Features of a slice of the gradient, and partitions that a pass runs in at most: each holds a gradient.
SLICE, MOST_PARTS = 1 << 16, 64


def _blocks(rows: Iterator) -> Iterator[Block]:
    """(class, vector) rows as blocks of at least ``BLOCK_ENTRIES`` entries, but for the last."""
    labels, vectors, entries = [], [], 0

    def block():
        lengths = [len(v[0]) for v in vectors]
        return Block(np.zeros(len(labels), np.int32), np.array(labels, np.float64), np.repeat(np.arange(len(labels)), lengths),
                     np.concatenate([v[0] for v in vectors]).astype(np.int32), np.concatenate([v[1] for v in vectors]).astype(np.float64))

    for r in rows:
        labels.append(r.label)
        at = r.x.indices if isinstance(r.x, SparseVector) else np.arange(len(r.x))
        vectors.append((at, r.x.values))
        entries += len(at) + 1
        if entries >= BLOCK_ENTRIES:
            yield block()
            labels, vectors, entries = [], [], 0
    if labels:
        yield block()


def _sums(weights: np.ndarray, blocks) -> np.ndarray:
    """Loss and gradient summed over the rows of ``blocks``; features + 2 rows (intercept and loss last), classes columns."""
    size, classes = weights.shape[0] - 1, weights.shape[1]
    out = np.zeros((size + 2, classes))
    for b in blocks:
        z, own = b.margins(weights), b.labels.astype(np.int64)
        if classes == 1:
            out[size + 1, 0] += np.sum(np.logaddexp(0.0, z[:, 0]) - b.labels * z[:, 0])
            e = np.exp(-np.abs(z))
            rest = np.where(z >= 0, 1.0, e) / (1.0 + e) - b.labels[:, None]
        else:
            z = z - z.max(1, keepdims=True)
            e = np.exp(z)
            all_ = e.sum(1, keepdims=True)
            at = np.arange(len(own))
            out[size + 1, 0] += np.sum(np.log(all_[:, 0]) - z[at, own])
            rest = e / all_
            rest[at, own] -= 1.0
        for m in range(classes):
            np.add.at(out[:, m], b.indices, b.counts * rest[b.rows, m])
        out[size] += rest.sum(0)
    return out


def fit_logistic(rows: DataFrame, features: str, label: str, size: int, classes: int, penalty: float, steps: int = 1000,
                 tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, intercepts, passes) at the minimum over ``rows`` (vector of ``size``, class number below ``classes``, two or more).

    ``weights`` has a row for two classes (of the second) and one a class for more, where intercepts add up to 0. It ends when
    a step improves the objective by less than ``tolerance`` of it, or after ``steps``."""
    spark = rows.sparkSession
    ensure_shipped(spark)
    given = rows.select(col(label).cast("int").alias("label"), col(features).alias("x")).rdd
    blocks = given.coalesce(min(MOST_PARTS, max(1, given.getNumPartitions()))).mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    counts = blocks.map(lambda b: np.bincount(b.labels.astype(np.int64), minlength=classes)).fold(np.zeros(classes, np.int64), np.add)
    n = int(counts.sum())
    columns = 1 if classes == 2 else classes
    start = np.zeros((size + 1, columns))
    shares = np.log(np.maximum(counts, 0.5) / n)
    start[-1] = shares[1] - shares[0] if classes == 2 else shares - shares.mean()

    def passed(point: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(point.reshape(size + 1, columns))

        def parts(own):
            total = _sums(sent.value, own)
            return [(at, total[at:at + SLICE]) for at in range(0, size + 2, SLICE)]

        slices = blocks.mapPartitions(parts).reduceByKey(np.add, min(MOST_PARTS, blocks.getNumPartitions())).collect()
        sent.destroy()
        total = np.concatenate([x for _, x in sorted(slices, key=lambda s: s[0])]) / n
        w = point.reshape(size + 1, columns)[:-1]
        grad = total[:-1].copy()
        grad[:-1] += penalty * w
        return float(total[-1, 0] + penalty / 2 * np.sum(w * w)), grad.ravel()

    search, passes = Descent(start.ravel(), steps, tolerance), 0
    try:
        while search.trial is not None:
            search.tell(*passed(search.trial))
            passes += 1
    finally:
        blocks.unpersist()
    found = search.point.reshape(size + 1, columns)
    intercepts = found[-1] if classes == 2 else found[-1] - found[-1].mean()
    return np.ascontiguousarray(found[:-1].T), intercepts, passes


def logistic_model(weights: np.ndarray, intercepts: np.ndarray, features: str, label: str) -> LogisticRegressionModel:
    """The weights of ``fit_logistic`` as Spark's model, which transforms, is saved and is loaded like one that Spark has fitted."""
    k = len(weights)
    uid = LogisticRegression().uid
    made = LogisticRegressionModel._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", uid,
        DenseMatrix(k, weights.shape[1], weights.ravel(), True), Vectors.dense(intercepts), max(2, k), k > 1)
    return LogisticRegressionModel(made)._set(featuresCol=features, labelCol=label)
