"""Row checks and job checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, required=(), nonblank=(), checks: dict[str, Column] | None = None):
    """V1: split rows into ``(good, bad)``; bad rows get the first failing
    ``reason`` (missing field, blank field, then named checks in order).
    Extra columns pass through untouched."""
    reason = None

    def add(cond, text):
        nonlocal reason
        reason = F.when(cond, F.lit(text)) if reason is None else reason.when(cond, F.lit(text))

    for c in required:
        add(F.col(c).isNull(), f"missing {c}")
    for c in nonblank:
        add(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"blank {c}")
    for name, ok in (checks or {}).items():
        add(~F.coalesce(ok, F.lit(False)), name)
    if reason is None:
        return df, df.limit(0).withColumn("reason", F.lit(None).cast("string"))
    x = df.withColumn("reason", reason)
    return x.where(F.col("reason").isNull()).drop("reason"), x.where(F.col("reason").isNotNull())


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """V1 defaults: fill missing columns and nulls with the given values."""
    x = df
    for c, v in defaults.items():
        x = x.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in x.columns else x.withColumn(c, F.lit(v))
    return x


def assert_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    """V2 pre/post check: fail fast on an empty frame (reads one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def written_count(spark, path: str, where: Column | None = None) -> int:
    """A18/V2 post-check: rows in a written Parquet table (optionally one
    partition). Parquet answers a count from file footers, so this reads no
    column data and does not re-run the job that wrote the table.

    (``DataFrame.observe`` with an ``Observation`` would avoid even that, but
    in Spark 4.1 a session that has used it fails to serialize later ML
    closures, so the library does not use it.)"""
    df = spark.read.parquet(path)
    return (df.where(where) if where is not None else df).count()
