"""Raw message cleaning (P1-P3, F15, S12 id mapping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.functions.text import parse_iso_ts

_TEXT_DEFAULTS = ("subject", "sender", "body_preview", "body", "raw_headers")
_INT_DEFAULTS = ("attachment_count", "cc_count")


def clean_raw(df: DataFrame, date: str | None = None, mailbox_type: str | None = None) -> DataFrame:
    """P1-P3 on raw messages.

    * text columns null -> '', counts null -> 0 (P1);
    * ``received_at`` text -> timestamp; unparsable text -> null instead of
      failing the job under ANSI mode (P2, F15);
    * ``ingestion_date`` / ``mailbox_type`` from the folder when the reader
      found them, else the given literals (P3; default mailbox 'faculty');
    * Kafka-shaped rows carry ``id`` rather than ``message_id``.
    """
    x = df
    if "id" in x.columns:
        mid = F.coalesce(F.col("message_id"), F.col("id")) if "message_id" in x.columns else F.col("id")
        x = x.withColumn("message_id", mid).drop("id")
    for c in _TEXT_DEFAULTS:
        x = x.withColumn(c, F.coalesce(F.col(c), F.lit(""))) if c in x.columns else x.withColumn(c, F.lit(""))
    for c in _INT_DEFAULTS:
        x = x.withColumn(c, F.coalesce(F.col(c), F.lit(0))) if c in x.columns else x.withColumn(c, F.lit(0))
    x = x.withColumn("received_at", parse_iso_ts(F.col("received_at")) if "received_at" in x.columns
                     else F.lit(None).cast("timestamp"))
    path_date = F.col("ingestion_date") if "ingestion_date" in x.columns else F.lit(None).cast("string")
    path_box = F.col("mailbox_type") if "mailbox_type" in x.columns else F.lit(None).cast("string")
    x = x.withColumn("ingestion_date", F.coalesce(path_date, F.lit(date)).cast("string"))
    x = x.withColumn("mailbox_type", F.coalesce(path_box, F.lit(mailbox_type or "faculty")))
    return x
