"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.session import ensure_shipped

#: Rows of two or three numbers that are broadcast at most (some 25 MB as a hash table); a larger table is joined by shuffle.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else unchanged.
    ``df`` should be a staged table: it is read for the count and again for the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def python_ready(spark: SparkSession, batch_rows: int = 128) -> None:
    """Before an operator runs Python on the executors: ship the package, and keep
    Arrow batches to few rows, as a text may be long."""
    ensure_shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are. ``lower`` is the same,
    and faster, unless the text has upper-case letters outside ASCII."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)) \
        .otherwise(F.lower(text))
