"""Key-based merges: dedup, insert-if-absent, feedback and reclassification
(J2-J5, P12, S19, V1 label check).

Dedup keeps one row per key with ``min``/``max`` over a struct whose first
fields are the ordering columns. Both are mergeable aggregates, so Spark
combines rows map-side before the shuffle: a key holding a third of the
batch costs one row per task in the exchange, not a third of the data in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.functions import rules as R


def _pick(df: DataFrame, keys, order, newest: bool) -> DataFrame:
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    agg = (F.max if newest else F.min)(packed).alias("_row")
    out = df.groupBy(*keys).agg(agg)
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the smallest by ``order`` (ties: the other columns)."""
    return _pick(df, keys, order, newest=False)


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the largest by ``order`` (ties: the other columns)."""
    return _pick(df, keys, order, newest=True)


def insert_unseen(target: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``; duplicates
    inside ``new`` keep the first by ``order`` (arrival order).

    Only the key columns of ``target`` are read. The anti join is a
    sort-merge join on the keys; AQE turns it into a broadcast join only if
    the measured key side is small.
    """
    keys = list(keys)
    batch = first_per_key(new, keys, order) if order else new.dropDuplicates(keys)
    return batch.join(target.select(*keys), keys, "left_anti")


def merge_unseen(target: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """Target after the insert of J2 (union by name, new columns allowed)."""
    return target.unionByName(insert_unseen(target, new, keys, order), allowMissingColumns=True)


def apply_feedback(target: DataFrame, feedback: DataFrame, key: str = "email_id",
                   label_col: str = "corrected_label", at_col: str = "feedback_at"):
    """Set ``feedback`` and ``feedback_at`` from the newest correction per
    key. Returns ``(updated target, unmatched feedback)``."""
    fb = latest_per_key(feedback.select(key, at_col, label_col), [key], [at_col])
    fb = fb.select(F.col(key), F.col(label_col).alias("_fb"), F.col(at_col).alias("_fb_at"))
    t = target
    if "feedback" not in t.columns:
        t = t.withColumn("feedback", F.lit(None).cast("string"))
    if "feedback_at" not in t.columns:
        t = t.withColumn("feedback_at", F.lit(None).cast("timestamp"))
    j = t.join(fb, key, "left")
    hit = F.col("_fb_at").isNotNull() | F.col("_fb").isNotNull()
    updated = j.withColumn("feedback", F.when(hit, F.col("_fb")).otherwise(F.col("feedback"))) \
        .withColumn("feedback_at", F.when(hit, F.col("_fb_at")).otherwise(F.col("feedback_at"))) \
        .drop("_fb", "_fb_at")
    unmatched = feedback.join(target.select(key), key, "left_anti")
    return updated, unmatched


def feedback_rows(df: DataFrame) -> DataFrame:
    """Rows carrying human feedback (the retraining input)."""
    return df.where(F.col("feedback").isNotNull())


def valid_label(c) -> Column:
    """Label check of the reclassify request: ``^(spam|ham)$``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(R.VALID_LABEL_PATTERN), F.lit(False))


def reclassify(target: DataFrame, changes: DataFrame, key: str = "message_id",
               label_col: str = "spam_label", ts_col: str = "feedback_timestamp"):
    """Apply label changes. Returns ``(new target, feedback log rows,
    rejected changes)``.

    ``changes`` has (key, corrected_label, user_email, reason, ts). Invalid
    labels are rejected; the log gets one row per valid change that matched
    a target row, carrying the label it replaced: the stored one for a key's
    first change, that of the change before for later ones (by time, then label).
    """
    ok = changes.where(valid_label("corrected_label"))
    rejected = changes.where(~valid_label("corrected_label"))
    before = F.lag("corrected_label").over(Window.partitionBy(key).orderBy(ts_col, "corrected_label", "user_email", "reason"))
    log = ok.withColumn("_before", before) \
        .join(target.select(F.col(key), F.col(label_col).alias("_stored")), key, "inner") \
        .withColumn("original_label", F.coalesce("_before", "_stored")).select(
        F.col(key).alias("message_id"), "user_email", "original_label", "corrected_label", "reason",
        F.col(ts_col).alias("feedback_timestamp"))
    last = latest_per_key(ok.select(key, ts_col, "corrected_label"), [key], [ts_col]) \
        .select(key, F.col("corrected_label").alias("_new"))
    new = target.join(last, key, "left") \
        .withColumn(label_col, F.coalesce(F.col("_new"), F.col(label_col))).drop("_new")
    return new, log, rejected
