"""Registered queries: sources and sinks, round-tripped through the shared
checkpoint folder (S1-S14, S21, P1-P3, A18).

Each query writes the whole derived table to a fresh folder under
``spark.checkpoint.dir`` (never a machine-local path on a cluster), reads it
back through the operator under test and returns the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmail import schemas as S
from sparkmail.operators import analytics as A
from sparkmail.operators.ingest import clean_raw
from sparkmail.plans.adapters import MESSAGES_FROM_EVENTS_SQL as EV
from sparkmail.plans.q_analytics import FIRST, LAST, _events, all_days
from sparkmail.plans.registry import query
from sparkmail.session import scratch_path
from sparkmail.sources import lake as L


def _raw_records(spark, sf):
    """events -> raw JSON message records with nulls and mixed timestamp text."""
    m = _events(spark, sf)
    eid = F.col("message_id")
    ts_text = (F.when(eid % 97 == 0, F.lit("not a date"))
               .when(eid % 2 == 0, F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .otherwise(F.date_format("received_at", "yyyy-MM-dd HH:mm:ss")))
    return m.select(
        eid.cast("string").alias("message_id"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("subject")).alias("subject"),
        "sender",
        F.col("body_preview"),
        F.when(eid % 10 == 0, F.lit(None)).otherwise(F.col("body")).alias("body"),
        ts_text.alias("received_at"),
        F.lit(None).cast("string").alias("raw_headers"),
        F.when(eid % 5 == 0, F.lit(None)).otherwise((eid % 3).cast("int")).alias("attachment_count"),
        (F.col("user_id") % 4).cast("int").alias("cc_count"),
        F.col("classification_date").alias("ingestion_date"),
        "mailbox_type",
    )


_RAW_SQL = f"""
r AS (SELECT CAST(message_id AS VARCHAR) AS message_id,
             coalesce(CASE WHEN message_id % 11 = 0 THEN NULL ELSE subject END, '') AS subject,
             coalesce(CASE WHEN message_id % 10 = 0 THEN NULL ELSE body END, '') AS body,
             CASE WHEN message_id % 97 = 0 THEN NULL ELSE strftime(received_at, '%Y-%m-%d %H:%M:%S') END AS received_at,
             coalesce(CASE WHEN message_id % 5 = 0 THEN NULL ELSE CAST(message_id % 3 AS INTEGER) END, 0)
               AS attachment_count,
             CAST(user_id % 4 AS INTEGER) AS cc_count, '' AS raw_headers,
             classification_date AS ingestion_date, mailbox_type
      FROM ({EV}))"""


@query("roundtrip_json", sql=f"""
WITH {_RAW_SQL}
SELECT message_id, subject, body, received_at, attachment_count, cc_count, raw_headers, ingestion_date, mailbox_type
FROM r
""")
def q_roundtrip_json(spark, sf):
    root = scratch_path(spark, "raw")
    L.write_raw_table(_raw_records(spark, sf), root)
    c = clean_raw(L.read_raw(spark, root))
    return c.select("message_id", "subject", "body",
                    F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"),
                    "attachment_count", "cc_count", "raw_headers", "ingestion_date", "mailbox_type")


@query("ingest_one_date", sql=f"""
WITH {_RAW_SQL}
SELECT ingestion_date, mailbox_type, count(*) AS n, count(received_at) AS n_ts FROM r
WHERE ingestion_date = '2024-01-15' GROUP BY 1, 2
""")
def q_ingest_one_date(spark, sf):
    root = scratch_path(spark, "raw")
    L.write_raw_table(_raw_records(spark, sf), root)
    c = clean_raw(L.read_raw(spark, root, date="2024-01-15"))        # partition pruning on the folder
    return c.groupBy("ingestion_date", "mailbox_type").agg(F.count(F.lit(1)).alias("n"),
                                                         F.count("received_at").alias("n_ts"))


def _classified_written(spark, sf):
    m = _events(spark, sf).withColumn("label", F.col("spam_label"))
    path = scratch_path(spark, "classified")
    L.write_partitions(m, path, ["classification_date", "label"])
    return m, path


@query("roundtrip_partition_overwrite", sql=f"""
SELECT message_id, classification_date, spam_label AS label,
       CASE WHEN classification_date = '2024-01-15' THEN CAST(1.0 AS DOUBLE) ELSE urgency_score END AS urgency_score
FROM ({EV})
""")
def q_roundtrip_overwrite(spark, sf):
    m, path = _classified_written(spark, sf)
    again = m.where(F.col("classification_date") == "2024-01-15").withColumn("urgency_score", F.lit(1.0))
    L.write_partitions(again, path, ["classification_date", "label"])     # replaces that date only
    back = spark.read.parquet(path)
    return back.select("message_id", "classification_date", "label", "urgency_score")


@query("partition_list", sql=f"""
SELECT DISTINCT classification_date, spam_label AS label FROM ({EV})
""")
def q_partition_list(spark, sf):
    _, path = _classified_written(spark, sf)
    return L.list_partitions(spark.read.parquet(path), ["classification_date", "label"])


@query("roundtrip_orc", sql=f"""
SELECT CAST(message_id AS VARCHAR) AS message_id, spam_label AS label, topic,
       CASE WHEN strpos(sender, '@') > 0 THEN lower(reverse(split_part(reverse(sender), '@', 1))) ELSE '' END
         AS sender_domain, received_at, '2024-01-30' AS training_date
FROM ({EV})
""")
def q_roundtrip_orc(spark, sf):
    from sparkmail.functions.text import sender_domain
    m = _events(spark, sf)
    feats = m.select(F.col("message_id").cast("string").alias("message_id"), F.col("spam_label").alias("label"),
                     "topic", sender_domain("sender").alias("sender_domain"), "received_at",
                     F.lit("2024-01-30").alias("training_date"))
    path = scratch_path(spark, "features")
    L.write_table(feats, path, fmt="orc")
    return L.read_features(spark, path, path + "-missing")


@query("roundtrip_daily_json", sql=f"""
WITH m AS ({EV})
SELECT classification_date AS metric_date, count(*) AS daily_volume,
       count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
       count(*) FILTER (WHERE spam_label = 'ham') AS ham_count,
       string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics
FROM m WHERE classification_date BETWEEN {FIRST} AND {LAST} GROUP BY 1
""")
def q_roundtrip_daily_json(spark, sf):
    root = scratch_path(spark, "daily-json")
    m = _events(spark, sf)
    end, days = all_days(m)
    L.write_daily_json(A.daily_metrics(m, end, days=days), root)
    back = spark.read.schema(S.DAILY).json(root)
    return back.select("metric_date", "daily_volume", "spam_count", "ham_count",
                       F.array_join(F.array_sort(F.map_keys("topic_distribution")), ",").alias("topics"))


# --- S2, S3, S13, U2: parts of stored tables, and what is missing ---

def _stored_messages(spark, sf):
    """The messages as a table by date and mailbox; (root, messages)."""
    root = scratch_path(spark, "messages")
    m = _events(spark, sf).select("message_id", "user_id", "topic", "spam_label", "mailbox_type", "classification_date")
    L.write_partitions(m, root, ["classification_date", "mailbox_type"])
    return root, m


@query("partition_scan", sql=f"""
SELECT message_id, user_id, topic, spam_label, mailbox_type, classification_date FROM ({EV})
WHERE classification_date = {LAST} AND mailbox_type = 'faculty'
""")
def q_partition_scan(spark, sf):
    """S3: one mailbox of the last date; the other folders are not read."""
    root, m = _stored_messages(spark, sf)
    found = L.read_partition(spark, root, all_days(_events(spark, sf))[0], "faculty", date_col="classification_date")
    return found.select(*m.columns[:4], "mailbox_type", F.col("classification_date").cast("string").alias("classification_date"))


@query("missing_input", sql=f"SELECT message_id, topic, spam_label FROM ({EV})")
def q_missing_input(spark, sf):
    """A table that is there and one that is not, which has no rows but the columns."""
    root, m = _stored_messages(spark, sf)
    there = L.read_or_empty(spark, root, m.schema)
    return there.unionByName(L.read_or_empty(spark, f"{root}-of-nobody", m.schema)).select("message_id", "topic", "spam_label")


@query("day_document", sql=f"""
SELECT {LAST} AS metric_date, count(*) AS daily_volume, count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
       count(*) FILTER (WHERE spam_label = 'ham') AS ham_count
FROM ({EV}) WHERE classification_date = {LAST} HAVING count(*) > 0
""")
def q_day_document(spark, sf):
    """The last day's metrics as a JSON document and back; the day after has none."""
    m = _events(spark, sf)
    last = all_days(m)[0]
    root = scratch_path(spark, "days")
    L.write_summary_json(A.daily_metrics(m, last, days=0).drop("updated_at"), f"{root}/{last}.json")
    found = L.read_day_document(spark, root, last).unionByName(L.read_day_document(spark, root, A._shift(last, 1)))
    return found.select("metric_date", "daily_volume", "spam_count", "ham_count")


@query("partition_union", sql=f"""
SELECT DISTINCT classification_date, mailbox_type FROM ({EV}) WHERE topic = 'error' OR topic = 'signup'
""")
def q_partition_union(spark, sf):
    """The partitions of two tables, each once."""
    names = []
    for topic in ("error", "signup"):
        root = scratch_path(spark, "named")
        L.write_partitions(_events(spark, sf).where(F.col("topic") == topic).select("message_id", "classification_date", "mailbox_type"),
                           root, ["classification_date", "mailbox_type"])
        names.append(L.list_partitions(spark.read.parquet(root).withColumn("classification_date", F.col("classification_date").cast("string")),
                                       ["classification_date", "mailbox_type"]))
    return L.union_partitions(*names)
