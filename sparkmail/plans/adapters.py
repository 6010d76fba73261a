"""Fixed mappings from the driver's tables onto the message data model.

The test data holds no e-mail tables, so each adapter derives message
columns from a generic table with plain expressions. Every adapter has a
twin SQL text (``*_SQL``) with the same expressions, used by the DuckDB
oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.session import apply_conf

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- events -> classified messages -----------------------------------------

def messages_from_events(ev: DataFrame) -> DataFrame:
    """events -> classified message rows (D3/D11 shape)."""
    uid = F.col("user_id")
    domain = F.when(uid % 5 == 0, F.lit("gmail.com")) \
        .otherwise(F.concat(F.lit("d"), (uid % 13).cast("string"), F.lit(".example.org")))
    return ev.select(
        F.col("event_id").alias("message_id"),
        uid.alias("user_id"),
        F.col("ts").alias("received_at"),
        F.concat(F.lit("user"), uid.cast("string"), F.lit("@"), domain).alias("sender"),
        F.concat(F.lit("Event "), F.col("event_type")).alias("subject"),
        F.col("props").alias("body"),
        F.col("props").alias("body_preview"),
        F.col("event_type").alias("topic"),
        F.when(F.col("event_type") == "error", F.lit("spam")).otherwise(F.lit("ham")).alias("spam_label"),
        F.when(F.col("event_type") == "error", F.lit(0.9)).otherwise(F.lit(0.1)).alias("spam_score"),
        F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("urgency_score"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("sentiment_score"),
        F.when(uid % 5 == 0, F.lit("personal")).otherwise(F.lit("faculty")).alias("mailbox_type"),
        F.element_at(F.array(F.lit("mailbox"), F.lit("synthetic"), F.lit("demo")),
                     (uid % 3 + 1).cast("int")).alias("pipeline_source"),
        F.date_format("ts", "yyyy-MM-dd").alias("classification_date"),
    )


MESSAGES_FROM_EVENTS_SQL = """
SELECT event_id AS message_id, user_id, ts AS received_at,
       'user' || CAST(user_id AS VARCHAR) || '@' ||
         CASE WHEN user_id % 5 = 0 THEN 'gmail.com' ELSE 'd' || CAST(user_id % 13 AS VARCHAR) || '.example.org' END AS sender,
       'Event ' || event_type AS subject, props AS body, props AS body_preview,
       event_type AS topic,
       CASE WHEN event_type = 'error' THEN 'spam' ELSE 'ham' END AS spam_label,
       CASE WHEN event_type = 'error' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS spam_score,
       least(1.0, value / 100.0) AS urgency_score,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS sentiment_score,
       CASE WHEN user_id % 5 = 0 THEN 'personal' ELSE 'faculty' END AS mailbox_type,
       CASE user_id % 3 WHEN 0 THEN 'mailbox' WHEN 1 THEN 'synthetic' ELSE 'demo' END AS pipeline_source,
       strftime(ts, '%Y-%m-%d') AS classification_date
FROM events
"""


# --- documents -> raw message text -----------------------------------------

def messages_from_documents(docs: DataFrame) -> DataFrame:
    """documents -> message rows with subject, body and sender."""
    return docs.select(
        F.col("doc_id").alias("message_id"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.col("text").alias("body"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@"), F.col("source"),
                 F.lit(".example.org")).alias("sender"),
        F.col("lang"),
        F.col("source"),
    )


MESSAGES_FROM_DOCUMENTS_SQL = """
SELECT doc_id AS message_id, split_part(text, chr(10), 1) AS subject, text AS body,
       'u' || CAST(doc_id AS VARCHAR) || '@' || source || '.example.org' AS sender,
       lang, source
FROM documents
"""


# --- labels -> human corrections -------------------------------------------

def feedback_from_labels(labels: DataFrame) -> DataFrame:
    """labels -> (message_id, corrected_label): toxic means spam."""
    return labels.select(
        F.col("doc_id").alias("message_id"),
        F.when(F.col("toxic") == 1, F.lit("spam")).otherwise(F.lit("ham")).alias("corrected_label"),
        F.col("quality"),
    )


FEEDBACK_FROM_LABELS_SQL = """
SELECT doc_id AS message_id, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS corrected_label, quality
FROM labels
"""
