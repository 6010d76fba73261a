"""Declared schemas of the data model."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
    MapType, StringType, StructField, StructType, TimestampType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


# Raw JSON message as delivered.
RAW_MESSAGE = _s(
    ("message_id", StringType()), ("subject", StringType()), ("sender", StringType()),
    ("body_preview", StringType()), ("body", StringType()), ("received_at", StringType()),
    ("raw_headers", StringType()), ("attachment_count", IntegerType()), ("cc_count", IntegerType()),
)

# Raw Kafka message (``id`` instead of ``message_id``; extra fields allowed).
KAFKA_RAW = _s(
    ("id", StringType()), ("subject", StringType()), ("sender", StringType()),
    ("body_preview", StringType()), ("received_at", StringType()),
    ("mailbox_type", StringType()), ("raw_headers", StringType()),
)

# Output of the classifiers (P4 flattens it).
PREDICTION = _s(
    ("spam_label", StringType()), ("spam_score", DoubleType()), ("topic", StringType()),
    ("topic_confidence", DoubleType()), ("urgency_score", DoubleType()),
    ("sentiment_score", DoubleType()),
)

# Daily analytics row.
DAILY = StructType([
    StructField("metric_date", StringType()),
    StructField("daily_volume", LongType()),
    StructField("spam_count", LongType()),
    StructField("spam_rate", DoubleType()),
    StructField("ham_count", LongType()),
    StructField("topic_distribution", MapType(StringType(), LongType())),
    StructField("avg_urgency_score", DoubleType()),
    StructField("top_senders_by_domain", ArrayType(_s(("domain", StringType()), ("count", LongType())))),
    StructField("updated_at", TimestampType()),
])

# Model registry.
REGISTRY = _s(
    ("version", StringType()), ("training_date", StringType()), ("accuracy", DoubleType()),
    ("f1", DoubleType()), ("model_path", StringType()), ("is_champion", BooleanType()),
    ("created_at", TimestampType()),
)

# Stream event.
STREAM_EVENT = _s(
    ("email_id", StringType()), ("text", StringType()), ("timestamp", StringType()),
    ("pipeline_source", StringType()),
)

# Stored result of the stream.
STREAM_RESULT = _s(
    ("email_id", StringType()), ("text", StringType()), ("predicted_label", StringType()),
    ("confidence", FloatType()), ("timestamp", TimestampType()), ("feedback", StringType()),
    ("feedback_at", TimestampType()), ("pipeline_source", StringType()),
)

# Feedback log.
FEEDBACK_LOG = _s(
    ("message_id", StringType()), ("user_email", StringType()), ("original_label", StringType()),
    ("corrected_label", StringType()), ("reason", StringType()), ("feedback_timestamp", TimestampType()),
)

# Nested mail JSON (url-safe base64 bodies).
_BODY = _s(("data", StringType()))
NESTED_MESSAGE = _s(
    ("id", StringType()),
    ("payload", _s(
        ("headers", ArrayType(_s(("name", StringType()), ("value", StringType())))),
        ("body", _BODY),
        ("parts", ArrayType(_s(("mimeType", StringType()), ("filename", StringType()), ("body", _BODY)))),
    )),
)

# Dead-letter record.
DEAD_LETTER = _s(("record", StringType()), ("reason", StringType()), ("dlq_date", StringType()))
