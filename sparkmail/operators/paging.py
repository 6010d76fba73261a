"""Filters, lookups, latest-n, paging and top-m per user.

Every ordering ends with the id column, so pages and top lists are
deterministic. A global ``orderBy().limit(n)`` plans as
TakeOrderedAndProject (each task keeps n rows); a per-group
``row_number() <= m`` gets a partial WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions.text import between_days
from sparkmail.operators.ranks import PART_ROWS, with_position
from sparkmail.session import stage_table


def search(df: DataFrame, user_id=None, spam_label: str | None = None, mailbox_type: str | None = None,
           sender: str | None = None, text: str | None = None, start: str | None = None,
           end: str | None = None, topic: str | None = None, ts_col: str = "received_at",
           escape: bool = False) -> DataFrame:
    """Conjunctive optional filters of the list endpoint.

    ``sender``: case-insensitive substring; ``text``: in the subject, or in a
    non-null preview; ``start``/``end``: inclusive dates; ``topic``: equal.
    As in the reference, the text is placed between ``%`` as given, so ``%``
    and ``_`` typed by the user act as LIKE wildcards (``escape=True`` makes
    them literal); a backslash is always literal.
    """
    x = df
    if user_id is not None:
        x = x.where(F.col("user_id") == F.lit(user_id))
    if spam_label:
        x = x.where(F.col("spam_label") == F.lit(spam_label))
    if mailbox_type:
        x = x.where(F.col("mailbox_type") == F.lit(mailbox_type))
    esc = _esc if escape else (lambda v: v.replace("\\", "\\\\"))
    if sender:
        x = x.where(F.col("sender").ilike(f"%{esc(sender)}%"))
    if text:
        pat = f"%{esc(text)}%"
        x = x.where(F.col("subject").ilike(pat) | (F.col("body_preview").isNotNull() & F.col("body_preview").ilike(pat)))
    x = between_days(x, ts_col, start, end)
    if topic:
        x = x.where(F.col("topic") == F.lit(topic))
    return x


def _esc(s: str) -> str:
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def by_id(df: DataFrame, user_id, message_id, id_col: str = "message_id") -> DataFrame:
    """Point lookup by (user, id); at most one row."""
    return df.where((F.col("user_id") == F.lit(user_id)) & (F.col(id_col) == F.lit(message_id))).limit(1)


def latest(df: DataFrame, limit: int = 20, source: str | None = None, ts_col: str = "timestamp",
           id_col: str = "email_id") -> DataFrame:
    """W4 + P13: newest rows, ``limit`` clamped to 1..500, optional source."""
    n = max(1, min(int(limit), R.RECENT_LIMIT_MAX))
    x = df if not source else df.where(F.col("pipeline_source") == F.lit(source))
    return x.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)


def page(df: DataFrame, page_no: int = 1, size: int = 50, ts_col: str = "received_at",
         id_col: str = "message_id") -> DataFrame:
    """Page ``page_no`` (1-based) of ``size`` rows, newest first."""
    page_no = max(1, int(page_no))
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).offset((page_no - 1) * size).limit(size)


def write_page_index(df: DataFrame, root: str, ts_col: str = "received_at", id_col: str = "message_id", part_rows: int = PART_ROWS) -> None:
    """W5 for deep pages: ``df`` newest first, in range partitions that are folders of the table ``root``/rows, and
    ``root``/parts with the rows before each. One sort of the table, then any page opens one or two partitions.

    Null times come last, as in ``page``. ``df`` must not have columns ``part`` and ``position``."""
    order = [F.col(ts_col).desc_nulls_last(), F.col(id_col).desc_nulls_last()]
    placed = with_position(stage_table(df, "page-rows"), order, position="position", part="part", part_rows=part_rows)
    # A partition is a folder with one file of sorted rows: they come sorted from one task each.
    placed.repartition("part").sortWithinPartitions("part", "position").write.mode("overwrite").partitionBy("part").parquet(f"{root}/rows")
    rows = df.sparkSession.read.parquet(f"{root}/rows")
    rows.groupBy(F.col("part").cast("int").alias("part")).agg(F.min("position").alias("first"), F.max("position").alias("last")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{root}/parts")


def indexed_page(spark, root: str, page_no: int = 1, size: int = 50) -> DataFrame:
    """The rows of ``page`` from an index, in order. Only the partitions that hold the page are read."""
    first = (max(1, int(page_no)) - 1) * size
    parts = spark.read.parquet(f"{root}/parts").where((F.col("last") >= first) & (F.col("first") < first + size))
    # As many as a page spans: two, unless pages are larger than partitions.
    wanted = [str(r.part) for r in parts.select("part").collect()]
    return spark.read.parquet(f"{root}/rows").where(F.col("part").cast("string").isin(wanted)) \
        .where(F.col("position").between(first, first + size - 1)).orderBy("position").drop("part", "position")


def page_after(df: DataFrame, last_ts, last_id, size: int = 50, ts_col: str = "received_at",
               id_col: str = "message_id") -> DataFrame:
    """Keyset paging for deep pages: rows strictly after (last_ts, last_id)
    in (ts desc, id desc) order. Each task keeps ``size`` rows, whatever the
    depth, where offset paging keeps offset + size."""
    ts, i = F.col(ts_col), F.col(id_col)
    after = (ts < F.lit(last_ts)) | ((ts == F.lit(last_ts)) & (i < F.lit(last_id)))
    return df.where(after).orderBy(ts.desc(), i.desc()).limit(size)


def page_info(df: DataFrame, size: int = 50) -> DataFrame:
    """W5 + A18: one row (total, pages = ceil(total / size))."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("long").alias("pages"))


def top_per_user(df: DataFrame, m: int, user_col: str = "user_id", ts_col: str = "received_at",
                 id_col: str = "message_id") -> DataFrame:
    """Newest ``m`` rows per user (partial WindowGroupLimit pre-shuffle)."""
    w = Window.partitionBy(user_col).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= m)


def pages_for(total: int, size: int) -> int:
    return math.ceil(total / size) if size else 0


def serving_record(df: DataFrame) -> DataFrame:
    """The list endpoint's record. ``timestamp`` is ISO-8601 text with microseconds only if
    there are any, '' for a null time; a field that ``df`` lacks is null."""
    ts = F.col("received_at")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                   F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(""))
    made = {"timestamp": F.coalesce(iso, F.lit("")), "message_id": F.col("message_id").cast("string")}
    return df.select(*[(made[c] if c in made else F.col(c) if c in df.columns else F.lit(None).cast(kind)).alias(c)
                       for c, kind in SERVING_FIELDS])


# The fields of a served message, in order.
SERVING_FIELDS = (
    ("message_id", "string"), ("sender", "string"), ("sender_name", "string"), ("subject", "string"), ("body", "string"),
    ("body_preview", "string"), ("timestamp", "string"), ("spam_label", "string"), ("spam_score", "double"),
    ("topic", "string"), ("topic_confidence", "double"), ("urgency_score", "double"), ("sentiment_score", "double"),
    ("attachment_count", "int"), ("cc_count", "int"), ("mailbox_type", "string"),
)
