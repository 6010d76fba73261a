"""Registered queries: merges (J2-J5, P12) and paging/filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmail.operators import merge as M
from sparkmail.operators import paging as P
from sparkmail.operators.classify import classify_mailbox
from sparkmail.plans.adapters import MESSAGES_FROM_EVENTS_SQL as EV, feedback_from_labels, table
from sparkmail.plans.q_analytics import _events
from sparkmail.plans.q_text import OBSERVED_MAILBOX, _docs, sql_mailbox
from sparkmail.plans.registry import query
from sparkmail.session import scratch_path

FB_AT = "2024-02-01 00:00:00"


# --- J2: insert unseen keys ---------------------------------------------------

@query("insert_unseen", sql="""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS rn FROM conversations),
d AS (SELECT conv_id, turn, role, text FROM b WHERE rn = 1)
SELECT * FROM d
WHERE NOT EXISTS (SELECT 1 FROM conversations t WHERE t.turn < 2 AND t.conv_id = d.conv_id AND t.role = d.role)
""")
def q_insert_unseen(spark, sf):
    conv = table(spark, sf, "conversations")
    stored = conv.where(F.col("turn") < 2)          # rows written by an earlier sync
    return M.insert_unseen(stored, conv, ["conv_id", "role"], order=["turn"]).select("conv_id", "turn", "role", "text")


@query("latest_per_conversation", sql="""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations)
WHERE rn = 1
""")
def q_latest_per_conv(spark, sf):
    return M.latest_per_key(table(spark, sf, "conversations"), ["conv_id"], ["turn"])


# --- J4, P12: feedback ---------------------------------------------------------

def _stored_docs(spark, sf):
    """All classified documents (the merge target)."""
    return classify_mailbox(_docs(spark, sf), OBSERVED_MAILBOX) \
        .select(F.col("message_id").alias("email_id"), F.col("spam_label").alias("predicted_label"))


def _feedback(spark, sf):
    fb = feedback_from_labels(table(spark, sf, "labels"))
    # every tenth correction is for a message that is not stored
    eid = F.when(F.col("message_id") % 10 == 3, -F.col("message_id")).otherwise(F.col("message_id"))
    return fb.select(eid.alias("email_id"), "corrected_label",
                     F.to_timestamp_ntz(F.lit(FB_AT)).alias("feedback_at"))


_STORED_SQL = f"""
st AS (SELECT message_id AS email_id, spam_label AS predicted_label
       FROM ({sql_mailbox(OBSERVED_MAILBOX)})),
fb AS (SELECT CASE WHEN doc_id % 10 = 3 THEN -doc_id ELSE doc_id END AS email_id, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS corrected_label FROM labels)"""


@query("apply_feedback", sql=f"""
WITH {_STORED_SQL}
SELECT st.email_id, predicted_label, fb.corrected_label AS feedback,
       CASE WHEN fb.email_id IS NOT NULL THEN '{FB_AT}' END AS feedback_at
FROM st LEFT JOIN fb ON st.email_id = fb.email_id
""")
def q_apply_feedback(spark, sf):
    upd, _ = M.apply_feedback(_stored_docs(spark, sf), _feedback(spark, sf))
    return upd.select("email_id", "predicted_label", "feedback",
                      F.date_format("feedback_at", "yyyy-MM-dd HH:mm:ss").alias("feedback_at"))


@query("feedback_unmatched", sql=f"""
WITH {_STORED_SQL}
SELECT email_id, corrected_label FROM fb WHERE email_id NOT IN (SELECT email_id FROM st)
""")
def q_feedback_unmatched(spark, sf):
    _, unmatched = M.apply_feedback(_stored_docs(spark, sf), _feedback(spark, sf))
    return unmatched.select("email_id", "corrected_label")


@query("feedback_rows", sql=f"""
WITH {_STORED_SQL}
SELECT predicted_label, fb.corrected_label AS feedback, count(*) AS n
FROM st JOIN fb ON st.email_id = fb.email_id GROUP BY 1, 2
""")
def q_feedback_rows(spark, sf):
    upd, _ = M.apply_feedback(_stored_docs(spark, sf), _feedback(spark, sf))
    return M.feedback_rows(upd).groupBy("predicted_label", "feedback").agg(F.count(F.lit(1)).alias("n"))


# --- J5: reclassify --------------------------------------------------------------

def _changes(spark, sf):
    """One change per labelled document, and a second one, back, an hour later for every third."""
    lb = table(spark, sf, "labels")
    first = _first_changes(lb)
    again = first.where(F.col("message_id") % 3 == 0).select(
        "message_id", F.when(F.col("corrected_label") == "spam", F.lit("ham")).otherwise(F.lit("spam")).alias("corrected_label"),
        "user_email", F.lit("again").alias("reason"), (F.col("feedback_timestamp") + F.expr("INTERVAL 1 HOUR")).alias("feedback_timestamp"))
    return first.unionByName(again)


def _first_changes(lb):
    label = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("Spam!")) \
        .when(F.col("toxic") == 1, F.lit("spam")).otherwise(F.lit("ham"))
    return lb.select(
        F.col("doc_id").alias("message_id"), label.alias("corrected_label"),
        F.concat(F.lit("reviewer"), (F.col("doc_id") % 7).cast("string"), F.lit("@uni.example.edu")).alias("user_email"),
        F.when(F.col("quality") == 1, F.lit("checked")).alias("reason"),
        F.to_timestamp_ntz(F.lit(FB_AT)).alias("feedback_timestamp"))


_CHANGES_SQL = f"""
ch1 AS (SELECT doc_id AS message_id,
              CASE WHEN toxic = 1 AND quality = 0 THEN 'Spam!' WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS corrected_label,
              'reviewer' || CAST(doc_id % 7 AS VARCHAR) || '@uni.example.edu' AS user_email,
              CASE WHEN quality = 1 THEN 'checked' END AS reason, '{FB_AT}' AS made_at
       FROM labels),
ch AS (SELECT * FROM ch1 UNION ALL
       SELECT message_id, CASE WHEN corrected_label = 'spam' THEN 'ham' ELSE 'spam' END, user_email, 'again',
              replace('{FB_AT}', ' 00:', ' 01:') FROM ch1 WHERE message_id % 3 = 0),
tg AS (SELECT message_id, spam_label FROM ({sql_mailbox(OBSERVED_MAILBOX)}))"""


def _reclassify(spark, sf):
    target = classify_mailbox(_docs(spark, sf), OBSERVED_MAILBOX).select("message_id", "spam_label")
    return M.reclassify(target, _changes(spark, sf))


@query("reclassify_log", sql=f"""
WITH {_CHANGES_SQL}
SELECT ch.message_id, user_email,
       coalesce((SELECT max(b.corrected_label) FROM ch b WHERE b.message_id = ch.message_id AND b.made_at < ch.made_at
                  AND regexp_matches(b.corrected_label, '^(spam|ham)$')), tg.spam_label) AS original_label,
       corrected_label, reason, made_at AS feedback_timestamp
FROM ch JOIN tg ON ch.message_id = tg.message_id WHERE regexp_matches(corrected_label, '^(spam|ham)$')
""")
def q_reclassify_log(spark, sf):
    _, log, _ = _reclassify(spark, sf)
    return log.withColumn("feedback_timestamp", F.date_format("feedback_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("reclassify_state", sql=f"""
WITH {_CHANGES_SQL}
SELECT tg.message_id, coalesce(ok.corrected_label, tg.spam_label) AS spam_label
FROM tg LEFT JOIN (SELECT message_id, arg_max(corrected_label, made_at) AS corrected_label FROM ch
                   WHERE regexp_matches(corrected_label, '^(spam|ham)$') GROUP BY 1) ok
  ON tg.message_id = ok.message_id
""")
def q_reclassify_state(spark, sf):
    new, _, _ = _reclassify(spark, sf)
    return new


@query("reclassify_rejected", sql=f"""
WITH {_CHANGES_SQL}
SELECT message_id, corrected_label FROM ch WHERE NOT regexp_matches(corrected_label, '^(spam|ham)$')
""")
def q_reclassify_rejected(spark, sf):
    _, _, rej = _reclassify(spark, sf)
    return rej.select("message_id", "corrected_label")


# --- W4-W6, P8-P15: lists and pages -------------------------------------------

def _stream_rows(spark, sf):
    """events -> stored stream results (D13 shape)."""
    m = _events(spark, sf)
    return m.select(F.col("message_id").cast("string").alias("email_id"), F.col("subject").alias("text"),
                    F.col("spam_label").alias("predicted_label"), F.col("spam_score").alias("confidence"),
                    F.col("received_at").alias("timestamp"), "pipeline_source")


_STREAM_SQL = f"""
sr AS (SELECT CAST(message_id AS VARCHAR) AS email_id, subject AS text, spam_label AS predicted_label,
              spam_score AS confidence, received_at AS timestamp, pipeline_source FROM ({EV}))"""


@query("latest_n", sql=f"""
WITH {_STREAM_SQL}
SELECT * FROM sr WHERE pipeline_source = 'mailbox' ORDER BY timestamp DESC, email_id DESC LIMIT 20
""")
def q_latest_n(spark, sf):
    return P.latest(_stream_rows(spark, sf), limit=20, source="mailbox")


@query("latest_n_clamped", sql=f"""
WITH {_STREAM_SQL}
SELECT * FROM sr ORDER BY timestamp DESC, email_id DESC LIMIT 500
""")
def q_latest_clamped(spark, sf):
    return P.latest(_stream_rows(spark, sf), limit=5000)


_MSG_COLS = "message_id, user_id, received_at, sender, subject, spam_label, topic, mailbox_type"


@query("page_k", sql=f"""
SELECT {_MSG_COLS} FROM ({EV}) ORDER BY received_at DESC, message_id DESC LIMIT 50 OFFSET 100
""")
def q_page_k(spark, sf):
    return P.page(_events(spark, sf), page_no=3, size=50).select(*_MSG_COLS.split(", "))


@query("page_from_index", sql=f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY received_at DESC, message_id DESC) AS pos, count(*) OVER () AS n FROM ({EV}))
SELECT {_MSG_COLS} FROM p WHERE pos > (n // 100) * 50 AND pos <= (n // 100) * 50 + 50
""")
def q_page_from_index(spark, sf):
    """The page in the middle of the list, from the index."""
    m = _events(spark, sf).select(*_MSG_COLS.split(", "))
    root = scratch_path(spark, "pages")
    P.write_page_index(m, root, part_rows=4096)
    return P.indexed_page(spark, root, page_no=m.count() // 100 + 1, size=50)


@query("page_after", sql=f"""
SELECT {_MSG_COLS} FROM ({EV})
WHERE received_at < TIMESTAMP '2024-01-15 12:00:00'
ORDER BY received_at DESC, message_id DESC LIMIT 50
""")
def q_page_after(spark, sf):
    import datetime as dt
    return P.page_after(_events(spark, sf), dt.datetime(2024, 1, 15, 12), 0, size=50) \
        .select(*_MSG_COLS.split(", "))


@query("page_info", sql=f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM ({EV}) WHERE spam_label = 'spam'
""")
def q_page_info(spark, sf):
    return P.page_info(P.search(_events(spark, sf), spam_label="spam"), size=50)


@query("latest_per_user", sql=f"""
SELECT {_MSG_COLS}, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at DESC, message_id DESC) AS rn FROM ({EV}))
WHERE rn <= 5
""")
def q_latest_per_user(spark, sf):
    return P.top_per_user(_events(spark, sf), 5).select(*_MSG_COLS.split(", "), "rn")


@query("search", sql=f"""
SELECT {_MSG_COLS} FROM ({EV})
WHERE spam_label = 'spam' AND sender ILIKE '%D1%'
  AND (subject ILIKE '%ERROR%' OR (body_preview IS NOT NULL AND body_preview ILIKE '%ERROR%'))
""")
def q_search(spark, sf):
    return P.search(_events(spark, sf), spam_label="spam", sender="D1", text="ERROR").select(*_MSG_COLS.split(", "))


@query("date_topic_filter", sql=f"""
SELECT {_MSG_COLS} FROM ({EV})
WHERE mailbox_type = 'faculty' AND topic = 'click'
  AND strftime(received_at, '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-20'
""")
def q_date_topic(spark, sf):
    return P.search(_events(spark, sf), mailbox_type="faculty", topic="click", start="2024-01-10",
                    end="2024-01-20").select(*_MSG_COLS.split(", "))


@query("search_backslash", sql="""
SELECT doc_id AS message_id FROM documents WHERE contains(text, chr(92)) OR doc_id % 5 = 0
""")
def q_search_backslash(spark, sf):
    """A backslash in the term is literal; % and _ are wildcards as typed."""
    d = _docs(spark, sf).withColumn("user_id", F.lit(1)).withColumn(
        "subject", F.when(F.col("message_id") % 5 == 0, F.lit(r"C:\mail\in")).otherwise(F.lit("other"))) \
        .withColumn("body_preview", F.col("body"))
    return P.search(d, text="\\").select("message_id")


@query("serving_record", sql=f"""
SELECT CAST(message_id AS VARCHAR) AS message_id, sender, CAST(NULL AS VARCHAR) AS sender_name, subject, body, body_preview,
       strftime(received_at, '%Y-%m-%dT%H:%M:%S') ||
         CASE WHEN strftime(received_at, '%f') <> '000000' THEN '.' || strftime(received_at, '%f') ELSE '' END AS timestamp,
       spam_label, spam_score, topic, CAST(NULL AS DOUBLE) AS topic_confidence, urgency_score, sentiment_score,
       CAST(NULL AS INTEGER) AS attachment_count, CAST(NULL AS INTEGER) AS cc_count, mailbox_type
FROM ({EV})
""")
def q_serving_record(spark, sf):
    """The sixteen served fields."""
    return P.serving_record(_events(spark, sf))


@query("by_id", sql=f"""
SELECT {_MSG_COLS} FROM ({EV}) WHERE user_id = 8 AND message_id = 0 LIMIT 1
""")
def q_by_id(spark, sf):
    return P.by_id(_events(spark, sf), 8, 0).select(*_MSG_COLS.split(", "))


@query("page_orders", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 100
""")
def q_page_orders(spark, sf):
    o = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").ilike("%urgent%"))
    return P.page(o, page_no=2, size=100, ts_col="o_orderdate", id_col="o_orderkey")


@query("apply_feedback_bucketed", sql=f"""
WITH {_STORED_SQL}
SELECT st.email_id, predicted_label, fb.corrected_label AS feedback,
       CASE WHEN fb.email_id IS NOT NULL THEN '{FB_AT}' END AS feedback_at
FROM st LEFT JOIN fb ON st.email_id = fb.email_id
""")
def q_apply_feedback_bucketed(spark, sf):
    """J4 against a target stored bucketed by id: the join reads it in place."""
    import uuid

    from sparkmail.session import scratch_path
    from sparkmail.sources.lake import write_bucketed

    name = "stored_mail_" + uuid.uuid4().hex[:10]
    write_bucketed(_stored_docs(spark, sf), name, ["email_id"], 8, path=scratch_path(spark, name))
    upd, _ = M.apply_feedback(spark.table(name), _feedback(spark, sf))
    return upd.select("email_id", "predicted_label", "feedback",
                      F.date_format("feedback_at", "yyyy-MM-dd HH:mm:ss").alias("feedback_at"))
