"""Labelling operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions.classify import classify_keyword as _kw, classify_rules as _rules, urgency

#: Rows of an Arrow batch that the user's hook is given at most.
HOOK_ROWS = 128


def flatten_prediction(df: DataFrame, pred: Column, date: str | None = None) -> DataFrame:
    """Add the struct's fields as columns, copy ``label``, stamp the date."""
    out = df.withColumn("_pred", pred).select("*", "_pred.*").drop("_pred")
    out = out.withColumn("label", F.col("spam_label"))
    if date is not None:
        out = out.withColumn("classification_date", F.lit(date))
    return out


def classify_keyword(df: DataFrame, rules: R.KeywordRules = R.JOB_RULES, date: str | None = None) -> DataFrame:
    """The batch job: F1 on (subject, body or preview), flattened."""
    body = F.coalesce(F.col("body"), F.col("body_preview")) if "body_preview" in df.columns else F.col("body")
    return flatten_prediction(df, _kw(F.col("subject"), body, F.col("sender"), rules), date)


def classify_mailbox(df: DataFrame, rules: R.MailboxRules = R.MAILBOX_RULES) -> DataFrame:
    """The mailbox path: F2 + F3 labels and the F4 urgency score."""
    p = _rules(F.col("subject"), F.col("body"), F.col("sender"), rules)
    return (df.withColumn("_p", p).select("*", "_p.*").drop("_p")
            .withColumn("urgency_score", urgency(F.col("subject"), F.col("body"), rules)))


def register_classifier(spark, fn: Callable, name: str = "classify_message"):
    """User hook. ``fn(subject: pd.Series, body: pd.Series, sender: pd.Series)
    -> pd.DataFrame`` with the ``schemas.PREDICTION`` columns, wrapped as an
    Arrow-batched pandas UDF and registered for SQL. Prefer the native rules
    above; this exists for models that are only available in Python.
    Arrow batches are kept to ``HOOK_ROWS`` rows: a worker holds the texts of a
    batch several times over, and a text may be long."""
    from sparkmail.schemas import PREDICTION
    from sparkmail.session import ensure_shipped

    ensure_shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HOOK_ROWS))

    @F.pandas_udf(PREDICTION)
    def _udf(subject, body, sender):
        return fn(subject.fillna(""), body.fillna(""), sender.fillna(""))

    spark.udf.register(name, _udf)
    return _udf
