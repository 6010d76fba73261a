"""Cross-validation over a grid of penalties with all models fitted together (M3).

A cross-validator fits one model per fold and penalty, each by its own passes over the data. Here the rows are stored once as
sparse blocks that carry each row's fold, and every pass over them gives loss and gradient of all models at once: a
model's rows are those of the other folds. The driver keeps a few vectors a model (a number per feature each), and moves each
model by its own limited-memory quasi-Newton step. Held-out scores of all models come from one more pass, their exact AUCs
from one range sort.

The objective is that of Spark's logistic regression with standardised features: mean log-loss plus half the penalty times the
squared weights of x / std(x). An IDF weight cancels in x / std(x), so that counts need no IDF per fold; terms that all
training rows have get none there (their IDF is 0), and none here.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmail.operators.ranks import auc_by, col
from sparkmail.session import ensure_shipped, stage_table

#: Non-zero entries of a block, about; a row with more is a block of its own.
BLOCK_ENTRIES = 1 << 16
#: Partial sums that come to the driver from a pass at most; more are added up in tasks first.
MOST_PARTS = 64
BLOCK = "folds binary, labels binary, starts binary, indices binary, counts binary"
MEMORY, SUFFICIENT, SHORTEST = 10, 1e-4, 1e-10


def fold_of(id_col: str, folds: int, seed: int) -> Column:
    """The fold, 0 to ``folds`` - 1, of a row by a digest of its id: the same whatever the partitioning."""
    text = F.concat_ws(":", F.lit("fold"), F.lit(seed), col(id_col).cast("string"))
    return (F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long") % folds).cast("int")


def sparse_blocks(rows: DataFrame, features: str) -> DataFrame:
    """(fold, label, sparse vector) rows as blocks of arrays: fold and label by row, and the vectors one after another."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, entries = [], 0
        for batch in batches:
            for fold, label, x in zip(batch["fold"], batch["label"], batch[features]):
                # A vector comes as its fields; a dense one has no indices.
                values = np.asarray(x["values"], np.float64)
                at = np.flatnonzero(values)
                kept.append((fold, label, at if x["indices"] is None else np.asarray(x["indices"])[at], values[at]))
                entries += len(at) + 1
                if entries >= BLOCK_ENTRIES:
                    yield _block(kept)
                    kept, entries = [], 0
        if kept:
            yield _block(kept)

    return rows.select("fold", "label", col(features).alias(features)).mapInPandas(packed, BLOCK)


def _block(kept) -> pd.DataFrame:
    starts = np.concatenate([[0], np.cumsum([len(k[2]) for k in kept])])
    arrays = (np.array([k[0] for k in kept], np.int32), np.array([k[1] for k in kept], np.float64), starts.astype(np.int64),
              np.concatenate([k[2] for k in kept]).astype(np.int32), np.concatenate([k[3] for k in kept]).astype(np.float64))
    return pd.DataFrame({name.split()[0]: [a.tobytes()] for name, a in zip(BLOCK.split(", "), arrays)})


@dataclass
class Block:
    folds: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    indices: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, r) -> Block:
        starts = np.frombuffer(r.starts, np.int64)
        return cls(np.frombuffer(r.folds, np.int32), np.frombuffer(r.labels, np.float64), np.repeat(np.arange(len(starts) - 1), np.diff(starts)),
                   np.frombuffer(r.indices, np.int32), np.frombuffer(r.counts, np.float64))

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """Rows by models; ``weights`` is features by models, intercepts last."""
        out = np.empty((len(self.folds), weights.shape[1]))
        for m in range(weights.shape[1]):
            out[:, m] = np.bincount(self.rows, self.counts * weights[self.indices, m], len(self.folds)) + weights[-1, m]
        return out


def summed(blocks: DataFrame, of_block: Callable[[Block], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of_block`` over all blocks, in one job; None without blocks."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for r in batch.itertuples():
                x = of_block(Block.read(r))
                total = x if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "shape": [list(total.shape)], "total": [total.tobytes()]})

    def added(batch: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in batch["total"])
        return batch.head(1).assign(total=[total.tobytes()])

    schema = "part int, shape array<int>, total binary"
    parts = blocks.mapInPandas(partial, schema)
    if blocks.rdd.getNumPartitions() > MOST_PARTS:
        parts = parts.groupBy((F.col("part") % MOST_PARTS).alias("group")).applyInPandas(added, schema)
    total = None
    for r in parts.collect():
        x = np.frombuffer(r.total).reshape(r.shape)
        total = x if total is None else total + x
    return total


class Descent:
    """Minimises one function whose values are told from outside: ``trial`` is the next point to evaluate, None at the end."""

    def __init__(self, start: np.ndarray, steps: int, tolerance: float):
        self.point = self.trial = start
        self.value, self.grad, self.left, self.tolerance = None, None, steps, tolerance
        self.pairs: deque = deque(maxlen=MEMORY)

    def tell(self, value: float, grad: np.ndarray) -> None:
        if self.value is not None:
            if value > self.value + SUFFICIENT * self.step * self.slope:
                self.step /= 2
                self.trial = self.point + self.step * self.direction if self.step > SHORTEST else None
                return
            moved, change = self.trial - self.point, grad - self.grad
            if moved @ change > 0:
                self.pairs.append((moved, change))
            self.left -= 1
            small = self.value - value <= self.tolerance * max(abs(value), 1e-12)
            self.point, self.value, self.grad = self.trial, value, grad
            if small or self.left <= 0:
                self.trial = None
                return
        self.value, self.grad = value, grad
        self.direction = self._direction()
        self.slope = float(grad @ self.direction)
        if self.slope >= 0:  # no way down: at the minimum
            self.trial = None
            return
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / float(np.linalg.norm(grad)))
        self.trial = self.point + self.step * self.direction

    def _direction(self) -> np.ndarray:
        q, used = self.grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        return -q


@dataclass
class Search:
    """``results``: (fold, penalty, trained, held, auc, mean_score) by model, ``mean_score`` the mean chance it gives its training
    rows, which at the minimum is their share of ones; ``best``: the penalty with the greatest mean AUC (ties: the
    first given; the first without any AUC); ``passes``: jobs over the blocks; ``weights``: (fold, penalty) -> weights of the
    counts, intercept last."""

    results: DataFrame
    best: float
    passes: int
    weights: dict[tuple[int, float], np.ndarray]


def _moments(folds: int, size: int):
    """By fold: rows and, by feature, sum, sum of squares and rows that have it."""
    def of_block(b: Block) -> np.ndarray:
        out = np.zeros((folds, 4, size))
        for f in range(folds):
            own = b.folds[b.rows] == f
            at, x = b.indices[own], b.counts[own]
            out[f, 0, 0] = np.sum(b.folds == f)
            out[f, 1], out[f, 2], out[f, 3] = (np.bincount(at, w, size) for w in (x, x * x, np.ones(len(x))))
        return out
    return of_block


def _losses(weights: np.ndarray, fold_of_model: np.ndarray):
    """Loss, and gradient by feature, of each model over the rows outside its fold: features + 2 rows, models columns."""
    def of_block(b: Block) -> np.ndarray:
        size, models = weights.shape[0] - 1, weights.shape[1]
        z = b.margins(weights)
        inside = b.folds[:, None] != fold_of_model[None, :]
        loss = np.where(inside, np.logaddexp(0.0, z) - b.labels[:, None] * z, 0.0)
        # As exp of minus the absolute value, which cannot overflow.
        e = np.exp(-np.abs(z))
        rest = np.where(inside, np.where(z >= 0, 1.0, e) / (1.0 + e) - b.labels[:, None], 0.0)
        out = np.empty((size + 2, models))
        for m in range(models):
            out[:size, m] = np.bincount(b.indices, b.counts * rest[b.rows, m], size)
        out[size], out[size + 1] = rest.sum(0), loss.sum(0)
        return out
    return of_block


def _chances(weights: np.ndarray, fold_of_model: np.ndarray):
    """Sum over each model's training rows of the chance that it gives them."""
    def of_block(b: Block) -> np.ndarray:
        p = 0.5 * (1.0 + np.tanh(b.margins(weights) / 2))
        return np.where(b.folds[:, None] != fold_of_model[None, :], p, 0.0).sum(0)
    return of_block


def grid_search(rows: DataFrame, features: str, size: int, grid=(0.01, 0.1), folds: int = 5, seed: int = 42,
                id_col: str = "message_id", label_col: str = "label", steps: int = 50, tolerance: float = 1e-6) -> Search:
    """The penalties of ``grid`` compared by ``folds``-fold cross-validation on ``rows`` (id, 0/1 label, vector of ``size`` counts).

    Rows with a null label or vector are left out; repeated rows count each, in the fold of their id (null ids: one fold). A model
    without training rows, or with those of one class, ends at its intercept; an AUC without both classes is null and does not
    enter the mean. An empty table gives no AUC and the first penalty. Other columns are not read. Jobs run when called."""
    spark = rows.sparkSession
    ensure_shipped(spark)
    given = rows.select(fold_of(id_col, folds, seed).alias("fold"), col(label_col).cast("double").alias("label"), col(features).alias("x"))
    given = given.withColumn("fold", F.coalesce("fold", F.lit(0))).where("label is not null and x is not null")
    blocks = stage_table(sparse_blocks(given, "x"), "sparse-blocks").persist(StorageLevel.MEMORY_AND_DISK)
    models = [(f, float(p)) for f in range(folds) for p in grid]
    fold_of_model = np.array([f for f, _ in models])
    try:
        moments = summed(blocks, _moments(folds, size))
        passes = 1
        own = np.zeros((folds, 4, size)) if moments is None else moments
        held = own[:, 0, 0]
        rest = own.sum(0)[None] - own
        n = rest[:, 0, 0]
        many = np.maximum(n, 2.0)[:, None]
        spread = np.sqrt(np.maximum((rest[:, 2] - rest[:, 1] ** 2 / np.maximum(many, 1)) / (many - 1), 0.0))
        usable = (spread > 0) & (rest[:, 3] < n[:, None])
        scale = np.where(usable, 1.0 / np.where(usable, spread, 1.0), 0.0)[fold_of_model]
        trained = np.maximum(n, 1.0)[fold_of_model]
        runs = [Descent(np.zeros(size + 1), steps, tolerance) for _ in models]
        if moments is None:
            runs = []

        def of_counts(points):
            return np.stack([np.append(p[:-1] * s, p[-1]) for p, s in zip(points, scale)], 1)

        while True:
            open_ = [m for m, run in enumerate(runs) if run.trial is not None]
            if not open_:
                break
            weights = of_counts([runs[m].trial if runs[m].trial is not None else runs[m].point for m in range(len(models))])
            total = summed(blocks, _losses(weights[:, open_], fold_of_model[open_]))
            passes += 1
            for column, m in enumerate(open_):
                w, penalty = runs[m].trial, models[m][1]
                value = total[size + 1, column] / trained[m] + penalty / 2 * float(w[:-1] @ w[:-1])
                grad = np.append(total[:size, column] * scale[m] / trained[m] + penalty * w[:-1], total[size, column] / trained[m])
                runs[m].tell(value, grad)
        fitted = of_counts([r.point for r in runs] or [np.zeros(size + 1)] * len(models))
        scores = stage_table(held_out_scores(blocks, fitted, fold_of_model), "held-out-scores")
        chances = summed(blocks, _chances(fitted, fold_of_model))
        passes += 2
    finally:
        blocks.unpersist()
    about = spark.createDataFrame([(m, f, p, int(n[f]), int(held[f]), float(chances[m] / n[f]) if n[f] else None) for m, (f, p) in enumerate(models)],
                                  "model int, fold int, penalty double, trained long, held long, mean_score double")
    # One row per model.
    results = about.join(F.broadcast(auc_by(scores, ["model"])), "model", "left").select("fold", "penalty", "trained", "held", "auc", "mean_score")
    means = {r.penalty: r.auc for r in results.groupBy("penalty").agg(F.avg("auc").alias("auc")).collect() if r.auc is not None}
    best = max(grid, key=lambda p: means.get(float(p), -math.inf))
    return Search(results, float(best), passes, {m: fitted[:, i] for i, m in enumerate(models)})


def held_out_scores(blocks: DataFrame, weights: np.ndarray, fold_of_model: np.ndarray) -> DataFrame:
    """(model, label, score) of each row by the models that have not seen it."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                b = Block.read(r)
                z = b.margins(weights)
                row, model = np.nonzero(b.folds[:, None] == fold_of_model[None, :])
                yield pd.DataFrame({"model": model.astype(np.int32), "label": b.labels[row], "score": z[row, model]})
    return blocks.mapInPandas(scored, "model int, label double, score double")
