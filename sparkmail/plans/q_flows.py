"""Registered queries: flows, checks, star schema, daily-table reads and
small scalar functions (V1-V6, S9, S10, S13, S16, S21, S22, J8, W7, A18,
F15-F18, P5-P7, P17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions import text as T
from sparkmail.operators import analytics as A
from sparkmail.operators.ingest import clean_raw
from sparkmail.operators.ml import training_frame
from sparkmail.operators.quality import validate
from sparkmail.operators.star import build_star, star_join
from sparkmail.plans import flows as FL
from sparkmail.plans.adapters import MESSAGES_FROM_EVENTS_SQL as EV
from sparkmail.plans.q_analytics import DOM, FIRST, LAST, _TOPIC_CAT_SQL, _events, all_days
from sparkmail.plans.q_io import _RAW_SQL, _raw_records
from sparkmail.plans.q_stream import EVENT_RULES
from sparkmail.plans.q_text import _UUID_SQL
from sparkmail.plans.registry import query
from sparkmail.session import scratch_path
from sparkmail.sources import lake as L

_WS = T.WS_CLASS


# --- V3/V4: the daily chain over the whole range -------------------------------

_CHAIN_SQL = f"""
r AS (SELECT classification_date AS d,
             coalesce(CASE WHEN message_id % 11 = 0 THEN NULL ELSE subject END, '') AS subj,
             coalesce(CASE WHEN message_id % 10 = 0 THEN NULL ELSE body END, '') AS b FROM ({EV})),
c AS (SELECT d, CASE WHEN contains(lower(subj || ' ' || b), 'error') THEN 'spam' ELSE 'ham' END AS spam_label,
             CASE WHEN contains(lower(subj || ' ' || b), 'purchase') THEN 'promotions' ELSE 'general' END AS topic
      FROM r)"""


@query("backfill_range", sql=f"""
WITH {_CHAIN_SQL},
t AS (SELECT d, string_agg(topic || '=' || CAST(n AS VARCHAR), ',' ORDER BY topic) AS topics
      FROM (SELECT d, topic, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT c.d AS metric_date, count(*) AS daily_volume, count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
       count(*) FILTER (WHERE spam_label = 'ham') AS ham_count, CAST(0.5 AS DOUBLE) AS avg_urgency_score,
       any_value(topics) AS topic_distribution
FROM c JOIN t ON c.d = t.d GROUP BY c.d
""")
def q_backfill(spark, sf):
    base = scratch_path(spark, "chain")
    L.write_raw_table(_raw_records(spark, sf), f"{base}/raw")
    out = FL.backfill(spark, f"{base}/raw", f"{base}/lake", *FL.raw_range(spark, f"{base}/raw"), rules=EVENT_RULES)
    return _daily_text(spark.read.parquet(out["daily"]))


def _daily_text(d):
    return d.select("metric_date", "daily_volume", "spam_count", "ham_count",
                    F.round("avg_urgency_score", 9).alias("avg_urgency_score"),
                    A.topic_map_text("topic_distribution").alias("topic_distribution"))


@query("ingest_count", sql=f"SELECT count(*) AS ingested, count(*) AS classified FROM ({EV})")
def q_ingest_count(spark, sf):
    base = scratch_path(spark, "chain")
    L.write_raw_table(_raw_records(spark, sf), f"{base}/raw")
    out = FL.backfill(spark, f"{base}/raw", f"{base}/lake", *FL.raw_range(spark, f"{base}/raw"), rules=EVENT_RULES)
    return spark.createDataFrame([(int(out["ingested"]), int(out["classified"]))],
                                 "ingested bigint, classified bigint")


# --- V3/V4: what is run again replaces itself and nothing else ---------------------

def _chained(spark, sf, rules=EVENT_RULES):
    """The whole range ingested and classified; (base folder, first and last date)."""
    base = scratch_path(spark, "chain")
    L.write_raw_table(_raw_records(spark, sf), f"{base}/raw")
    days = FL.raw_range(spark, f"{base}/raw")
    FL.backfill(spark, f"{base}/raw", f"{base}/lake", *days, rules=rules)
    return base, days


@query("rerun_other_rules", sql=f"""
SELECT classification_date, count(*) AS n, count(DISTINCT message_id) AS ids,
       count(*) FILTER (WHERE spam_label = 'spam') AS spam_count
FROM (SELECT classification_date, message_id,
             CASE WHEN contains(lower(coalesce(CASE WHEN message_id % 11 = 0 THEN NULL ELSE subject END, '') || ' ' ||
                                      coalesce(CASE WHEN message_id % 10 = 0 THEN NULL ELSE body END, '')), 'purchase')
                  THEN 'spam' ELSE 'ham' END AS spam_label FROM ({EV}))
GROUP BY 1
""")
def q_rerun_other_rules(spark, sf):
    """Classified twice with different rules: only the second labels are left, once per message."""
    base, days = _chained(spark, sf)
    other = R.KeywordRules(spam_terms=("purchase",), promo_terms=("error",))
    FL.backfill(spark, f"{base}/raw", f"{base}/lake", *days, rules=other)
    return spark.read.parquet(f"{base}/lake/emails_classified").groupBy("classification_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("ids"),
        F.count_if(F.col("spam_label") == "spam").alias("spam_count"))


@query("run_two_mailboxes", sql=f"""
SELECT classification_date, mailbox_type, count(*) AS n, count(DISTINCT message_id) AS ids FROM ({EV}) GROUP BY 1, 2
""")
def q_run_two_mailboxes(spark, sf):
    """The last day run again for one mailbox: the other mailbox and the other days stay."""
    base, days = _chained(spark, sf)
    FL.run_day(spark, f"{base}/raw", f"{base}/lake", days[1], rules=EVENT_RULES, mailbox_type="faculty")
    return spark.read.parquet(f"{base}/lake/emails_classified").groupBy("classification_date", "mailbox_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("ids"))


@query("backfill_keeps_other_days", sql=f"""
SELECT classification_date AS metric_date, count(*) AS daily_volume FROM ({EV}) GROUP BY 1
""")
def q_backfill_keeps(spark, sf):
    """The first day backfilled again: the daily table keeps all days."""
    base, days = _chained(spark, sf)
    out = FL.backfill(spark, f"{base}/raw", f"{base}/lake", days[0], days[0], rules=EVENT_RULES)
    return spark.read.parquet(out["daily"]).select("metric_date", "daily_volume")


def _plain_date_folders(spark, root):
    """Renames ingestion_date=D to D, the other layout of the raw folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(hadoop(root)):
        name = s.getPath().getName()
        if name.startswith("ingestion_date="):
            fs.rename(s.getPath(), hadoop(f"{root}/{name.partition('=')[2]}"))


@query("ingest_reference_layout", sql=f"""
SELECT classification_date AS ingestion_date, mailbox_type, count(*) AS n,
       count(*) FILTER (WHERE message_id % 97 = 0) AS bad_time
FROM ({EV}) GROUP BY 1, 2
""")
def q_ingest_reference_layout(spark, sf):
    """Raw files under D/mailbox_type=M; date and mailbox come from the path."""
    root = scratch_path(spark, "raw")
    L.write_raw_table(_raw_records(spark, sf), root)
    _plain_date_folders(spark, root)
    return clean_raw(L.read_raw(spark, root)).groupBy("ingestion_date", "mailbox_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("received_at").isNull()).alias("bad_time"))


@query("raw_dead_letters", sql=f"""
SELECT classification_date AS dlq_date, 'malformed json' AS reason, count(*) AS n FROM ({EV})
WHERE message_id % 50 = 7 GROUP BY 1, 2
UNION ALL
SELECT classification_date, 'good', count(*) FROM ({EV}) WHERE message_id % 50 <> 7 GROUP BY 1
""")
def q_raw_dead_letters(spark, sf):
    """Every fiftieth line is cut off; such lines become dead letters, the others messages."""
    root = scratch_path(spark, "raw")
    m = _raw_records(spark, sf)
    line = F.to_json(F.struct(*[F.col(c) for c in m.columns if c not in ("ingestion_date", "mailbox_type")]))
    cut = F.when(F.col("message_id").cast("long") % 50 == 7, F.substring(line, 1, 40)).otherwise(line)
    m.select(cut.alias("value"), "ingestion_date", "mailbox_type").write.partitionBy("ingestion_date", "mailbox_type").text(root)
    good, bad = L.split_corrupt(L.read_raw(spark, root, corrupt=True))
    return bad.groupBy("dlq_date", "reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.groupBy(F.col("ingestion_date").alias("dlq_date")).agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("good")))


# --- V1: validation split --------------------------------------------------------

@query("validate_split", sql=f"""
WITH m AS ({EV}),
x AS (SELECT CASE WHEN message_id % 11 = 0 THEN 'missing subject'
                  WHEN message_id % 13 = 0 THEN 'blank body'
                  WHEN urgency_score > 0.95 THEN 'urgency in range' END AS reason
      FROM m)
SELECT reason, count(*) AS n FROM x GROUP BY 1
""")
def q_validate(spark, sf):
    m = _events(spark, sf)
    eid = F.col("message_id")
    dirty = m.withColumn("subject", F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("subject"))) \
        .withColumn("body", F.when(eid % 13 == 0, F.lit("  ")).otherwise(F.col("body")))
    good, bad = validate(dirty, required=["subject"], nonblank=["body"],
                         checks={"urgency in range": F.col("urgency_score") <= 0.95})
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- V6, S16, F14, F18: republish as events ------------------------------------------

_EVENTS_SQL = f"""
WITH m AS ({EV}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at DESC, message_id DESC) AS rn FROM m),
e AS (SELECT user_id, message_id, subject, sender, body, body_preview, received_at,
             sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('mailbox:' || CAST(message_id AS VARCHAR))) AS h
      FROM r WHERE rn <= 5),
v AS (SELECT user_id, {_UUID_SQL} AS email_id,
             ('Subject: ' || coalesce(subject, '') || chr(10) || 'From: ' || coalesce(sender, '') || chr(10)
                       || chr(10) || regexp_replace(coalesce(nullif(body, ''), nullif(body_preview, ''), ''),
                                                    '^{_WS}+|{_WS}+$', '', 'g')) AS text,
             strftime(received_at, '%Y-%m-%dT%H:%M:%S') ||
               CASE WHEN strftime(received_at, '%f') <> '000000' THEN '.' || strftime(received_at, '%f') ELSE '' END
               || '+00:00' AS timestamp,
             'mailbox' AS pipeline_source
      FROM e)"""


@query("republish", sql=_EVENTS_SQL + """
SELECT email_id AS key,
       CAST(json_object('email_id', email_id, 'text', text, 'timestamp', timestamp,
                        'pipeline_source', pipeline_source) AS VARCHAR) AS value
FROM v
""")
def q_republish(spark, sf):
    return FL.to_kafka_rows(FL.to_events(_events(spark, sf), per_user=5))


@query("event_fields", sql=_EVENTS_SQL + "SELECT * FROM v")
def q_event_fields(spark, sf):
    return FL.to_events(_events(spark, sf), per_user=5)


@query("source_tag", sql=f"""
SELECT pipeline_source, count(*) AS n FROM (
  SELECT substring(coalesce(nullif(CASE WHEN message_id % 4 = 0 THEN '' WHEN message_id % 4 = 1 THEN NULL
                                        WHEN message_id % 4 = 2 THEN repeat(pipeline_source, 8)
                                        ELSE pipeline_source END, ''), 'unknown'), 1, 32) AS pipeline_source
  FROM ({EV})) GROUP BY 1
""")
def q_source_tag(spark, sf):
    m = _events(spark, sf)
    k = F.col("message_id") % 4
    raw = (F.when(k == 0, F.lit("")).when(k == 1, F.lit(None).cast("string"))
           .when(k == 2, F.repeat(F.col("pipeline_source"), 8)).otherwise(F.col("pipeline_source")))
    return m.select(T.source_tag(raw).alias("pipeline_source")).groupBy("pipeline_source") \
        .agg(F.count(F.lit(1)).alias("n"))


# --- F15, F16: timestamps from text ---------------------------------------------------

@query("parse_dates", sql=f"""
SELECT message_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS iso_z,
       strftime(received_at - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS iso_offset,
       strftime(received_at, '%Y-%m-%d %H:%M:%S') AS rfc2822,
       CASE WHEN message_id % 9 = 0 THEN NULL ELSE strftime(received_at, '%Y-%m-%d %H:%M:%S') END AS dirty
FROM ({EV})
""")
def q_parse_dates(spark, sf):
    m = _events(spark, sf)
    ts = F.col("received_at")
    z = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    off = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    rfc = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    dirty = F.when(F.col("message_id") % 9 == 0, F.lit("15/01/2024")).otherwise(z)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return m.select("message_id", fmt(T.parse_iso_ts(z)).alias("iso_z"), fmt(T.parse_iso_ts(off)).alias("iso_offset"),
                    fmt(T.parse_rfc2822(rfc)).alias("rfc2822"), fmt(T.parse_iso_ts(dirty)).alias("dirty"))


@query("parse_dates_forms", sql=f"""
SELECT message_id, CASE WHEN message_id % 8 IN (2, 4, 5) THEN NULL
                        WHEN message_id % 8 = 6 THEN strftime(received_at, '%Y-%m-%d 00:00:00')
                        WHEN message_id % 8 = 7 THEN strftime(received_at, '%Y-%m-%d %H:%M:00')
                        ELSE strftime(received_at, '%Y-%m-%d %H:%M:%S') END AS iso,
       CASE WHEN message_id % 4 = 3 THEN '2000-01-01 00:00:00' ELSE strftime(received_at, '%Y-%m-%d %H:%M:%S') END AS mail
FROM ({EV})
""")
def q_parse_dates_forms(spark, sf):
    """Compact forms and dates without zone are read, a bare time or year is not."""
    m = _events(spark, sf)
    ts, k = F.col("received_at"), F.col("message_id") % 8
    form = lambda f: F.date_format(ts, f)
    iso = (F.when(k == 0, form("yyyyMMdd'T'HHmmss'Z'")).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss'+0000'"))
           .when(k == 2, form("HH:mm:ss")).when(k == 3, form("yyyy-MM-dd HH:mm:ss.SSS")).when(k == 4, form("yyyy"))
           .when(k == 5, form("yyyy-MM")).when(k == 6, form("yyyy-MM-dd")).otherwise(form("yyyy-MM-dd'T'HH:mm")))
    q = F.col("message_id") % 4
    mail = (F.when(q == 0, form("EEE, d MMM yyyy HH:mm:ss")).when(q == 1, form("d MMM yy HH:mm:ss"))
            .when(q == 2, F.concat(form("d MMM yy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit("soon")))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return m.select("message_id", fmt(T.parse_iso_ts(iso)).alias("iso"),
                    fmt(T.parse_rfc2822(mail, F.lit("2000-01-01 00:00:00").cast("timestamp"))).alias("mail"))


# --- P5, P6, P17: training text ----------------------------------------------------------

@query("text_prep", sql=f"""
SELECT message_id, coalesce(subject, '') || ' ' || coalesce(body_preview, '') AS text,
       CAST(CASE WHEN spam_label = 'spam' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS label
FROM ({EV})
""")
def q_text_prep(spark, sf):
    return training_frame(_events(spark, sf)).select("message_id", "text", "label")


# --- S22, J8: star schema ----------------------------------------------------------------------

@query("star_join", sql=f"""
SELECT message_id, CAST(strftime(received_at, '%Y-%m-%d') AS DATE) AS date, sender, {DOM} AS domain, topic,
       {_TOPIC_CAT_SQL.replace('(t)', '(topic)')} AS category, spam_label
FROM ({EV})
""")
def q_star_join(spark, sf):
    fact, dd, ds, dt = build_star(_events(spark, sf))
    return star_join(fact, dd, ds, dt).select("message_id", "date", "sender", "domain", "topic", "category",
                                              "spam_label")


@query("star_null_time", sql=f"""
SELECT message_id, CASE WHEN message_id % 4 <> 0 THEN CAST(strftime(received_at, '%Y-%m-%d') AS DATE) END AS date, sender
FROM ({EV})
""")
def q_star_null_time(spark, sf):
    """Fact rows without a time stay, with a null date."""
    m = _events(spark, sf)
    m = m.withColumn("received_at", F.when(F.col("message_id") % 4 != 0, F.col("received_at")))
    return star_join(*build_star(m)).select("message_id", "date", "sender")


@query("star_dims", sql=f"""
SELECT (SELECT count(DISTINCT strftime(received_at, '%Y%m%d')) FROM ({EV})) AS dates,
       (SELECT count(DISTINCT sender) FROM ({EV})) AS senders, (SELECT count(DISTINCT sender) FROM ({EV})) AS last_sender_key,
       (SELECT count(DISTINCT topic) FROM ({EV})) AS topics, (SELECT count(DISTINCT topic) FROM ({EV})) AS last_topic_key
""")
def q_star_dims(spark, sf):
    """Dimensions without gaps in their keys."""
    _, dd, ds, dt = build_star(_events(spark, sf))

    def one(d, c):
        return d.agg(c).scalar()  # scalar subqueries, no join
    n = F.count(F.lit(1))
    return dd.agg(n.alias("dates")).select("dates", one(ds, n).alias("senders"), one(ds, F.max("sender_key")).alias("last_sender_key"),
                                           one(dt, n).alias("topics"), one(dt, F.max("topic_key")).alias("last_topic_key"))


@query("star_reload", sql=f"""
WITH m AS (SELECT sender, max(CAST(user_id % 2 = 0 AS INTEGER)) AS old FROM ({EV}) GROUP BY 1)
SELECT sender, row_number() OVER (ORDER BY old DESC, sender) AS sender_key FROM m
""")
def q_star_reload(spark, sf):
    """A second load keeps the keys of the first and numbers new members behind them."""
    m = _events(spark, sf)
    _, _, senders, topics = build_star(m.where("user_id % 2 = 0"))
    _, _, again, _ = build_star(m, existing={"sender": senders, "topic": topics})
    return again.select("sender", "sender_key")


# --- W7, S8, S13: reads of the stored daily table ---------------------------------------------------

def _daily(spark, sf):
    """The daily table over all days."""
    m = _events(spark, sf)
    end, days = all_days(m)
    return A.daily_metrics(m, end, days=days)


def _daily_stored(spark, sf):
    path = scratch_path(spark, "analytics_daily")
    L.write_table(_daily(spark, sf), path)
    return spark.read.parquet(path)


_DAILY_SQL = f"""
d AS (SELECT classification_date AS metric_date, count(*) AS daily_volume,
             count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
             count(*) FILTER (WHERE spam_label = 'spam') / count(*) AS spam_rate
      FROM ({EV}) GROUP BY 1)"""


@query("daily_range", sql=f"WITH {_DAILY_SQL} SELECT * FROM d WHERE metric_date BETWEEN '2024-01-10' AND '2024-01-20'")
def q_daily_range(spark, sf):
    path = scratch_path(spark, "analytics_daily")
    L.write_table(_daily(spark, sf), path)
    d = L.read_daily(spark, path, "2024-01-10", "2024-01-20")
    return A.daily_range(d, "2024-01-10", "2024-01-20").select("metric_date", "daily_volume", "spam_count",
                                                               "spam_rate")


@query("spam_trend", sql=f"WITH {_DAILY_SQL} SELECT * FROM d")
def q_spam_trend(spark, sf):
    return A.spam_trend(_daily_stored(spark, sf), *all_days(_events(spark, sf)))


@query("topics_of", sql=f"""
SELECT classification_date AS metric_date, topic, count(*) AS count FROM ({EV}) GROUP BY 1, 2
""")
def q_topics_of(spark, sf):
    return A.topics_of(_daily_stored(spark, sf))


@query("topics_of_date", sql=f"""
SELECT classification_date AS metric_date, topic, count(*) AS count FROM ({EV})
WHERE classification_date = '2024-01-15' GROUP BY 1, 2
""")
def q_topics_of_date(spark, sf):
    return A.topics_of(_daily_stored(spark, sf), "2024-01-15")


# --- S10: run summary JSON ----------------------------------------------------------------------------

@query("summary_json", sql=f"""
SELECT classification_date AS date, count(*) AS total, count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
       count(*) FILTER (WHERE spam_label = 'ham') AS ham_count
FROM ({EV}) GROUP BY 1
""")
def q_summary_json(spark, sf):
    path = scratch_path(spark, "summaries")
    L.write_summary_json(A.run_summary(_events(spark, sf)), path)
    return spark.read.schema("date string, total bigint, spam_count bigint, ham_count bigint").json(path)


# --- S9, S21: catalog tables and partitions -------------------------------------------------------------

@query("catalog_partitions", sql=f"""
SELECT DISTINCT t || 'classification_date=' || classification_date AS partition
FROM ({EV}), (VALUES ('emails_classified/')) v(t)
UNION ALL SELECT DISTINCT 'emails_raw/ingestion_date=' || classification_date || '/mailbox_type=' || mailbox_type FROM ({EV})
UNION ALL SELECT DISTINCT 'analytics_daily/metric_date=' || classification_date FROM ({EV})
UNION ALL SELECT * FROM (VALUES ('email_features/'), ('model_registry/'))
""")
def q_catalog_partitions(spark, sf):
    """The daily chain registers its tables; all five tables of the model with their partitions."""
    base = scratch_path(spark, "chain")
    root = f"{base}/lake"
    db = "sm_" + uuid.uuid4().hex[:10]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}'")
    L.write_raw_table(_raw_records(spark, sf), f"{base}/raw")
    days = FL.raw_range(spark, f"{base}/raw")
    FL.backfill(spark, f"{base}/raw", root, *days, rules=EVENT_RULES, database=db)
    L.create_tables(spark, root, database=db)
    L.register_partition(spark, f"{db}.emails_classified", {"classification_date": days[1]})
    rows = None
    for name in L.DDL:
        parts = spark.sql(f"SHOW PARTITIONS {db}.{name}") if L.DDL[name][2] else \
            spark.sql(f"SHOW TABLES IN {db}").where(F.col("tableName") == name).select(F.lit("").alias("partition"))
        parts = parts.select(F.concat(F.lit(f"{name}/"), "partition").alias("partition"))
        rows = parts if rows is None else rows.unionByName(parts)
    # The names are few (dates and mailboxes): kept, so that the database can go again.
    rows = spark.createDataFrame(rows.collect(), "partition string")
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return rows



@query("ingest_defaults", sql=f"""
WITH {_RAW_SQL}
SELECT ingestion_date, count(*) FILTER (WHERE subject = '') AS blank_subject,
       count(*) FILTER (WHERE body = '') AS blank_body,
       count(*) FILTER (WHERE attachment_count = 0) AS zero_attachments,
       count(*) FILTER (WHERE received_at IS NULL) AS bad_time
FROM r GROUP BY 1
""")
def q_ingest_defaults(spark, sf):
    """How many fields each date got defaulted (over the whole table)."""
    root = scratch_path(spark, "raw")
    L.write_raw_table(_raw_records(spark, sf), root)
    c = clean_raw(L.read_raw(spark, root))
    return c.groupBy("ingestion_date").agg(
        F.count_if(F.col("subject") == "").alias("blank_subject"),
        F.count_if(F.col("body") == "").alias("blank_body"),
        F.count_if(F.col("attachment_count") == 0).alias("zero_attachments"),
        F.count_if(F.col("received_at").isNull()).alias("bad_time"))


@query("sender_domain", sql=f"""
SELECT {DOM} AS domain, count(*) AS n FROM ({EV}) GROUP BY 1
""")
def q_sender_domain(spark, sf):
    """F10 alone: messages per sender domain."""
    return _events(spark, sf).groupBy(T.sender_domain("sender").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_topic_map", sql=f"""
SELECT metric_date, string_agg(topic || '=' || CAST(n AS VARCHAR), ',' ORDER BY topic) AS topic_distribution
FROM (SELECT classification_date AS metric_date, topic, count(*) AS n FROM ({EV})
      WHERE classification_date BETWEEN {FIRST} AND {LAST} AND topic IS NOT NULL GROUP BY 1, 2)
GROUP BY 1
""")
def q_daily_topic_map(spark, sf):
    """A3 alone: the per-day topic -> count map (shown as sorted text)."""
    d = _daily(spark, sf)
    return d.select("metric_date", A.topic_map_text("topic_distribution").alias("topic_distribution"))


@query("topic_vs_max", sql=f"""
WITH c AS (SELECT topic AS name, count(*) AS count FROM ({EV}) WHERE topic IS NOT NULL GROUP BY 1
           ORDER BY count DESC, name LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY count DESC, name) AS INTEGER) AS rank, name, count,
       round(count / sum(count) OVER () * 100, 1) AS share_pct,
       CAST(round(count / max(count) OVER () * 100, 0) AS INTEGER) AS of_max_pct
FROM c
""")
def q_topic_vs_max(spark, sf):
    """W1 + W2 over the global top topics."""
    return A.with_shares(A.top_topics(_events(spark, sf), k=10), shown=10)


@query("star_fact", sql=f"""
SELECT message_id, CAST(strftime(received_at, '%Y%m%d') AS INTEGER) AS date_key,
       CAST(year(received_at) AS INTEGER) AS year, CAST(month(received_at) AS INTEGER) AS month,
       spam_label, urgency_score
FROM ({EV})
""")
def q_star_fact(spark, sf):
    """The fact rows (hash surrogate keys left out of the comparison)."""
    fact, _, _, _ = build_star(_events(spark, sf))
    return fact.select("message_id", "date_key", "year", "month", "spam_label", "urgency_score")


@query("event_json", sql=f"""
SELECT CAST(message_id AS VARCHAR) AS key,
       CAST(json_object('email_id', CAST(message_id AS VARCHAR), 'predicted_label', spam_label,
                        'pipeline_source', substring(coalesce(nullif(CASE WHEN message_id % 7 = 0 THEN ''
                                                                   ELSE pipeline_source END, ''), 'unknown'), 1, 32))
            AS VARCHAR) AS value
FROM ({EV})
""")
def q_event_json(spark, sf):
    """F18 + S16: stored rows as Kafka (key, JSON value), source tag defaulted."""
    m = _events(spark, sf)
    rows = m.select(F.col("message_id").cast("string").alias("email_id"), F.col("spam_label").alias("predicted_label"),
                    F.when(F.col("message_id") % 7 == 0, F.lit("")).otherwise(F.col("pipeline_source"))
                    .alias("pipeline_source"))
    return FL.to_kafka_rows(rows)
