"""Registered queries: nested mail JSON (F7-F13, F16) and RFC 822 bytes.

Inputs are packed from the driver's tables inside Spark: each conversation
becomes one nested message (turn 0 = top-level body when it is a system
turn, later turns = parts), and each document becomes one RFC 822 message.
The oracle derives the expected fields straight from the flat tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmail.functions import text as T
from sparkmail.operators.parse import parse_eml, parse_nested
from sparkmail.plans.adapters import table
from sparkmail.plans.q_text import OBSERVED_MAILBOX, sql_mailbox, strip_sql
from sparkmail.plans.registry import query


def _b64url(c):
    return F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_")


def _html(c):
    return F.concat(F.lit("<div><script>track()</script><p>"), F.coalesce(c, F.lit("")), F.lit("</p></div>"))


def pack_conversations(conv):
    """conversations -> nested messages (``schemas.NESTED_MESSAGE``)."""
    part = F.struct(
        F.col("turn"),
        F.when(F.col("role") == "user", F.lit("text/plain")).otherwise(F.lit("text/html")).alias("mimeType"),
        F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1),
               F.concat(F.lit("note"), F.col("turn").cast("string"), F.lit(".txt"))).otherwise(F.lit(""))
         .alias("filename"),
        F.struct(F.when(F.col("role") == "user", _b64url(F.col("text"))).otherwise(_b64url(_html(F.col("text"))))
                 .alias("data")).alias("body"))
    g = conv.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.struct("role", "text"))).alias("t0"),
        F.array_sort(F.collect_list(F.when(F.col("turn") >= 1, part))).alias("parts"))
    cid = F.col("conv_id")
    ts = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=cid.cast("int"))
    hdr = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.filter(F.array(
        hdr("Subject", F.substring_index(F.col("t0.text"), "\n", 1)),
        hdr("From", F.concat(F.lit("Agent "), cid.cast("string"), F.lit(" <agent"), cid.cast("string"),
                             F.lit("@example.org>"))),
        hdr("Cc", F.when(cid % 3 == 0, F.lit("a@x.org, b@y.org"))),
        hdr("Date", F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))),
        F.when(cid % 5 == 0, hdr("SUBJECT", F.lit("override"))),
    ), lambda h: h.isNotNull())
    body = F.struct(F.when(F.col("t0.role") == "system", _b64url(F.col("t0.text"))).alias("data"))
    parts = F.transform("parts", lambda p: F.struct(p["mimeType"], p["filename"], p["body"]))
    return g.select(cid.cast("string").alias("id"),
                    F.struct(headers.alias("headers"), body.alias("body"), parts.alias("parts")).alias("payload"))


_NESTED_SRC = f"""
WITH t0 AS (SELECT conv_id, role AS r0, text AS x0 FROM conversations WHERE turn = 0),
ids AS (SELECT DISTINCT conv_id FROM conversations),
pl AS (SELECT conv_id, arg_min(text, turn) AS plain FROM conversations
       WHERE turn >= 1 AND role = 'user' AND coalesce(text, '') <> '' GROUP BY 1),
ht AS (SELECT conv_id, turn,
              {strip_sql("'<div><script>track()</script><p>' || coalesce(text, '') || '</p></div>'")} AS s
       FROM conversations WHERE turn >= 1 AND role <> 'user'),
h1 AS (SELECT conv_id, arg_min(s, turn) AS html FROM ht WHERE s <> '' GROUP BY 1),
att AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn >= 1 AND role = 'assistant' AND turn % 2 = 1
        GROUP BY 1),
m AS (SELECT 'gmail-' || CAST(ids.conv_id AS VARCHAR) AS message_id,
             CASE WHEN ids.conv_id % 5 = 0 THEN 'override' ELSE coalesce(split_part(x0, chr(10), 1), '') END AS subject,
             'agent' || CAST(ids.conv_id AS VARCHAR) || '@example.org' AS sender,
             'Agent ' || CAST(ids.conv_id AS VARCHAR) AS sender_name,
             (CASE WHEN pl.plain IS NOT NULL THEN pl.plain
                            WHEN r0 = 'system' AND coalesce(x0, '') <> '' THEN x0
                            WHEN h1.html IS NOT NULL THEN h1.html ELSE '' END) AS body,
             strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(ids.conv_id AS INTEGER)), '%Y-%m-%d %H:%M:%S')
               AS received_at,
             CAST(coalesce(att.n, 0) AS INTEGER) AS attachment_count,
             CASE WHEN ids.conv_id % 3 = 0 THEN 2 ELSE 0 END AS cc_count
      FROM ids LEFT JOIN t0 USING (conv_id) LEFT JOIN pl USING (conv_id) LEFT JOIN h1 USING (conv_id)
      LEFT JOIN att USING (conv_id))
SELECT * FROM m"""


@query("nested_payload", sql=f"""
SELECT message_id, sender, sender_name, subject, nullif(body, '') AS body,
       nullif(replace(substring(body, 1, 300), chr(10), ' '), '') AS body_preview, received_at,
       attachment_count, cc_count, spam_label, topic, mailbox_type, urgency_score
FROM ({sql_mailbox(OBSERVED_MAILBOX, _NESTED_SRC,
                   "message_id, sender, sender_name, subject, body, received_at, attachment_count, cc_count")})
""")
def q_nested_payload(spark, sf):
    msgs = pack_conversations(table(spark, sf, "conversations"))
    p = parse_nested(msgs, OBSERVED_MAILBOX)
    return p.select("message_id", "sender", "sender_name", "subject", "body", "body_preview",
                    F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"),
                    "attachment_count", "cc_count", "spam_label", "topic", "mailbox_type", "urgency_score")


# --- F19 ------------------------------------------------------------------------------

_B = "=_sparkmail_b_="


def eml_bytes(docs):
    """documents -> (path, content) RFC 822 messages in four shapes:
    html-before-plain alternative, html only, plain + attachment, plain only."""
    i = F.col("doc_id")
    sid = i.cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    html = F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>"))
    ts = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(mins=i.cast("int"))
    head = F.concat(
        F.lit("Message-ID: <doc"), sid, F.lit("@example.org>\n"),
        F.lit("Subject: Doc "), sid, F.lit("\n"),
        F.lit("From: \"Src "), F.col("source"), F.lit("\" <u"), sid, F.lit("@"), F.col("source"),
        F.lit(".example.org>\n"),
        F.lit("Date: "), F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000\n"),
        F.when(i % 3 == 0, F.lit("Cc: a@x.org, b@y.org, c@z.org\n")).otherwise(F.lit("")),
        F.lit("MIME-Version: 1.0\n"))
    ctype = lambda t: F.lit(f"Content-Type: {t}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")
    alt = F.concat(F.lit(f"Content-Type: multipart/alternative; boundary=\"{_B}\"\n\n--{_B}\n"), ctype("text/html"),
                   html, F.lit(f"\n--{_B}\n"), ctype("text/plain"), text, F.lit(f"\n--{_B}--\n"))
    mixed = F.concat(F.lit(f"Content-Type: multipart/mixed; boundary=\"{_B}\"\n\n--{_B}\n"), ctype("text/plain"),
                     text, F.lit(f"\n--{_B}\nContent-Type: application/octet-stream\n"
                                 f"Content-Disposition: attachment; filename=\"data.bin\"\n\nAAAA\n--{_B}--\n"))
    body = (F.when(i % 4 == 0, alt).when(i % 4 == 1, F.concat(ctype("text/html"), html))
            .when(i % 4 == 2, mixed).otherwise(F.concat(ctype("text/plain"), text)))
    return docs.select(F.concat(F.lit("doc"), sid, F.lit(".eml")).alias("path"),
                       F.encode(F.concat(head, body), "UTF-8").alias("content"))


_EML_SRC = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source,
             CASE WHEN doc_id % 4 IN (0, 1) THEN {strip_sql("'<html><body><p>' || text || '</p></body></html>'")}
                  WHEN doc_id % 4 = 3 AND contains(text, '<') AND contains(text, '>') THEN {strip_sql('text')}
                  ELSE text END AS body0
      FROM d)
SELECT '<doc' || CAST(doc_id AS VARCHAR) || '@example.org>' AS message_id,
       'u' || CAST(doc_id AS VARCHAR) || '@' || source || '.example.org' AS sender,
       'Src ' || source AS sender_name, 'Doc ' || CAST(doc_id AS VARCHAR) AS subject,
       body0 AS body,
       CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS attachment_count,
       CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS cc_count,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S')
         AS received_at
FROM b"""


@query("eml_parse", sql=f"""
SELECT message_id, sender, sender_name, subject, body, replace(substring(body, 1, 300), chr(10), ' ') AS body_preview,
       received_at, CAST(attachment_count AS INTEGER) AS attachment_count, CAST(cc_count AS INTEGER) AS cc_count,
       spam_label, topic, mailbox_type, urgency_score
FROM ({sql_mailbox(OBSERVED_MAILBOX, _EML_SRC,
                   "message_id, sender, sender_name, subject, body, attachment_count, cc_count, received_at")})
""")
def q_eml_parse(spark, sf):
    p = parse_eml(eml_bytes(table(spark, sf, "documents")), OBSERVED_MAILBOX)
    return p.select("message_id", "sender", "sender_name", "subject", "body", "body_preview",
                    F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"),
                    "attachment_count", "cc_count", "spam_label", "topic", "mailbox_type", "urgency_score")
