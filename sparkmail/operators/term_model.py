"""The feedback model with its terms in tables (M8).

``ml.retrain`` gathers a small vocabulary in the driver and keeps it in the model. Here each term's idf and weights are a row of
a table, made by ``term_fit``, and labels are given by a join with the weights and a sum per document. What the driver holds
is what the regression needs, a few numbers per labelled row and class; no term passes through it, nor a number a term. Tokens, idf,
norm and penalty are those of ``ml.retrain``, which gives this model, as a ``TermClassifier``, for more terms than it gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.operators.ranks import col, unused, with_position
from sparkmail.operators.term_fit import Rows, fit_rows, number_rows, tasks_for, term_blocks, term_counts
from sparkmail.session import stage_table

#: A term with more than one in so many of all (document, term) pairs is hot: fewer terms than this can be.
MOST_HOT = 100_000


def join_terms(pairs: DataFrame, terms: DataFrame, most_hot: int = MOST_HOT) -> DataFrame:
    """``pairs`` with the columns of their ``term`` in ``terms`` (one row a term); pairs of other terms are left out.

    Rows of hot terms, fewer than ``most_hot`` by construction, are broadcast, so that a term which all documents have is not
    gathered in a task; all others are joined by shuffle. ``pairs`` should be a table: it is read several times."""
    n = unused(pairs.columns, "_n")[0]
    total = pairs.agg(F.count(F.lit(1))).scalar()
    hot = stage_table(pairs.groupBy("term").agg(F.count(F.lit(1)).alias(n)).where(F.col(n) * most_hot > total).select("term"), "hot-terms")
    cold = pairs.join(F.broadcast(hot), "term", "left_anti").join(terms, "term")
    return pairs.join(F.broadcast(hot.join(terms, "term")), "term").unionByName(cold)


def term_dictionary(weights: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf, idx) of the terms of ``weights`` (term, df, ..), numbered from 0 in their order."""
    terms = stage_table(weights.groupBy("term").agg(F.min("df").alias("df")), "terms")
    return with_position(terms.withColumn("idf", F.log(F.lit(1.0 + documents) / (F.col("df") + 1)) + 1), [F.col("term").asc()], position="idx")


class TermModel:
    """Weights by term: ``terms`` (term, idf, coefs), a weight per class, or one weight for two classes (of the second)."""

    def __init__(self, terms: DataFrame, labels: list[str], intercepts: list[float]):
        self.terms, self.labels, self.intercepts = terms, labels, intercepts

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.terms.sparkSession.createDataFrame([(self.labels, self.intercepts)], "labels array<string>, intercepts array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermModel:
        r = spark.read.parquet(f"{path}/classes").first()
        return cls(spark.read.parquet(f"{path}/terms"), list(r.labels), list(r.intercepts))

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with ``probability`` (by label, in the order of ``labels``) and ``predicted_label`` (ties: the first). Unknown terms
        count for nothing; a text without known ones, or null, is judged by the intercepts. Repeated rows are rows of their own."""
        row, norm = unused(df.columns, "_row", "_norm")
        k = len(self.intercepts)
        sums = unused([*df.columns, row, norm], *[f"_sum{c}" for c in range(k)])
        rows = stage_table(df.drop("probability", "predicted_label").withColumn(row, F.monotonically_increasing_id()), "to-label")
        pairs = stage_table(term_counts(rows, row, text_col, tasks_for(rows, text_col)).withColumnsRenamed({"row": row, "n": "tf"}), "term-counts")
        x = F.col("tf") * F.col("idf")
        scores = join_terms(pairs, self.terms).groupBy(row).agg(
            F.sqrt(F.sum(x * x)).alias(norm), *[F.sum(x * F.col("coefs")[c]).alias(sums[c]) for c in range(k)])
        out = self.judged(rows.join(scores, row, "left"), [F.coalesce(F.col(sums[c]) / F.col(norm), F.lit(0.0)) for c in range(k)])
        return out.drop(row, norm, *sums)

    def judged(self, rows: DataFrame, sums: list[Column]) -> DataFrame:
        """``rows`` with ``probability`` and ``predicted_label`` from the weights' ``sums`` over their terms."""
        k = len(self.intercepts)
        margins = [s + F.lit(float(b)) for s, b in zip(sums, self.intercepts)]
        if k == 1 and len(self.labels) > 1:
            second = 1 / (1 + F.exp(-margins[0]))
            chances = [1 - second, second]
        elif k == 1:
            chances = [F.lit(1.0)]
        else:
            powers = [F.exp(m - F.greatest(*margins)) for m in margins]
            chances = [p / sum(powers[1:], powers[0]) for p in powers]
        out = rows.withColumn("probability", F.array(*chances))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("predicted_label", F.element_at(F.array(*[F.lit(v) for v in self.labels]), best))


@dataclass
class Counted:
    """Feedback rows, written once and numbered by ``row``, and their terms in blocks."""

    rows: DataFrame
    blocks: DataFrame
    row: str


def count_feedback(feedback: DataFrame) -> Counted:
    """The rows of (text, feedback, ..) that have feedback, counted once for all models of them. Fewer than 2**31."""
    row = unused(feedback.columns, "_row")[0]
    rows = number_rows(feedback.where(F.col("feedback").isNotNull()), row)
    return Counted(rows, term_blocks(rows, row), row)


def fit_term_model(feedback: DataFrame, min_samples: int = R.MIN_FEEDBACK_SAMPLES, counted: Counted | None = None) -> TermModel | None:
    """M8 on rows (text, feedback): None with fewer than ``min_samples`` rows that have feedback. A null text has no terms.
    ``counted`` is ``count_feedback`` of the same rows, for who has it."""
    given = feedback.where(F.col("feedback").isNotNull())
    if len(given.select("feedback").limit(min_samples).collect()) < min_samples:
        return None
    return fit_counted(counted or count_feedback(given.select("text", "feedback")))[0]


def fit_counted(counted: Counted) -> tuple[TermModel, np.ndarray]:
    """The model, and the weights' sums over the terms of each of its rows: what it gives them but for the intercepts."""
    index = StringIndexer(inputCol="feedback", outputCol="_label", stringOrderType="alphabetAsc").fit(counted.rows)
    # A number a row: its class.
    given = index.transform(counted.rows.select(col(counted.row).cast("int").alias("row"), "feedback"))
    given = given.select("row", F.col("_label").cast("int").alias("label")).toPandas()
    labels = np.empty(len(given), np.int64)
    labels[given["row"]] = given["label"]
    space = Rows(counted.blocks, len(labels))
    try:
        if len(index.labels) > 1:
            found, intercepts, sums = fit_rows(space.times, labels, len(index.labels), 1.0 / len(labels))
        else:
            found, intercepts, sums = np.zeros((len(labels), 1)), np.zeros(1), np.zeros((len(labels), 1))
        terms = stage_table(space.weights(found).select("term", "idf", "coefs"), "term-model")
    finally:
        space.close()
    return TermModel(terms, list(index.labels), [float(v) for v in intercepts]), sums


def label_counted(counted: Counted, model: TermModel, sums: np.ndarray) -> DataFrame:
    """The model's labels of the rows that it was fitted on, as ``TermModel.predict`` gives them, from the ``sums`` of the fit."""
    sent = counted.rows.sparkSession.sparkContext.broadcast(sums)

    @F.pandas_udf("array<double>")
    def own(row: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value[row.to_numpy()]))

    at = unused(counted.rows.columns, "_sums")[0]
    rows = counted.rows.drop("probability", "predicted_label").withColumn(at, own(col(counted.row)))
    return model.judged(rows, [F.col(at)[c] for c in range(sums.shape[1])]).drop(at, counted.row)


def as_vectors(judged: DataFrame) -> DataFrame:
    """``judged`` with what a fitted classifier of Spark gives: ``prediction``, the label's number, and a vector as ``probability``."""
    number = F.array_position("probability", F.array_max("probability")) - 1
    return judged.withColumn("prediction", number.cast("double")).withColumn("probability", array_to_vector("probability"))


class TermClassifier(Model, MLWritable, MLReadable):
    """A ``TermModel`` as a stage of a pipeline, which is saved, loaded and served like any other: it reads ``text`` and adds
    ``probability``, ``prediction`` and ``predicted_label``. The terms stay in a table, in memory and in the saved model."""

    def __init__(self, model: TermModel | None = None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return as_vectors(self.model.predict(dataset))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: TermClassifier):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.model.save(path)


class _Reader(MLReader):
    def load(self, path: str) -> TermClassifier:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = TermClassifier(TermModel.load(self.sparkSession, path))
        stage._resetUid(found["uid"])
        return stage
