"""Parsing (F12, F13, F19), star schema (S22, J8), checks (V1, V2) and flows (V3-V6)."""

import base64
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkmail import schemas as S
from sparkmail.operators.parse import parse_eml, parse_nested
from sparkmail.operators.quality import assert_nonempty, validate, with_defaults, written_count
from sparkmail.operators.star import build_star, star_join
from sparkmail.plans import flows as FL


def b64(s):
    return base64.urlsafe_b64encode(s.encode()).decode()


def _nested(spark, rows):
    return spark.createDataFrame(rows, S.NESTED_MESSAGE)


def test_nested_plain_part_wins(spark):
    hdr = [("Subject", "Hello"), ("From", "Jane <jane@gmail.com>"), ("Date", "Tue, 13 Jan 2026 10:00:00 +0000"),
           ("cc", "a@x, b@y"), ("SUBJECT", "Winner inside")]
    payload = (hdr, (b64("top body"),), [("text/html", "", (b64("<p>html</p>"),)),
                                          ("text/plain", "a.txt", (b64("plain body"),))])
    r = parse_nested(_nested(spark, [("m1", payload)])).first()
    assert r["message_id"] == "gmail-m1" and r["subject"] == "Winner inside"
    assert r["body"] == "plain body" and r["sender"] == "jane@gmail.com" and r["sender_name"] == "Jane"
    assert r["received_at"] == dt.datetime(2026, 1, 13, 10, 0)
    assert (r["cc_count"], r["attachment_count"]) == (2, 1)
    assert (r["spam_label"], r["mailbox_type"]) == ("spam", "personal")


def test_nested_html_only_and_top_level(spark):
    html_only = ([("From", "x@uni.edu")], None, [("text/html", None, (b64("<style>a{}</style><b>Hi</b> there"),))])
    top = ([("From", "x@uni.edu")], (b64("top"),), [("text/html", None, (b64("<b>ignored</b>"),))])
    bad = ([("From", "x@uni.edu")], ("%%%",), [])
    rows = parse_nested(_nested(spark, [("a", html_only), ("b", top), ("c", bad), ("", top)])).orderBy("message_id")
    got = [(r["message_id"], r["body"]) for r in rows.collect()]
    assert got == [("gmail-a", "Hi there"), ("gmail-b", "top"), ("gmail-c", None)]


def _eml(text):
    return text.replace("\n", "\r\n").encode()


def test_parse_eml_shapes(spark):
    msgs = [
        ("plain.eml", _eml("Message-ID: <1@x>\nSubject: =?utf-8?q?Caf=C3=A9?=\nFrom: Bob <bob@outlook.com>\n"
                           "Date: Mon, 12 Jan 2026 08:00:00 +0000\nCc: a@x, b@y\n\nHello plain")),
        ("html.eml", _eml("Subject: H\nFrom: a@uni.edu\nContent-Type: text/html\n\n<p>Hi <b>there</b></p>")),
        ("multi.eml", _eml("Subject: M\nFrom: a@uni.edu\nContent-Type: multipart/mixed; boundary=XX\n\n"
                           "--XX\nContent-Type: text/plain\n\nbody text\n--XX\nContent-Type: application/pdf\n"
                           "Content-Disposition: attachment; filename=a.pdf\n\nAAAA\n--XX--\n")),
    ]
    df = spark.createDataFrame(msgs, "path string, content binary")
    got = {r["path"]: r for r in parse_eml(df).collect()}
    p = got["plain.eml"]
    assert (p["subject"], p["sender"], p["sender_name"], p["body"], p["cc_count"]) == (
        "Café", "bob@outlook.com", "Bob", "Hello plain", 2)
    assert p["mailbox_type"] == "personal" and p["received_at"] == dt.datetime(2026, 1, 12, 8, 0)
    assert got["html.eml"]["body"] == "Hi there"
    assert got["multi.eml"]["body"].strip() == "body text" and got["multi.eml"]["attachment_count"] == 1


def test_parse_eml_binary_file_source(spark, tmp):
    with open(os.path.join(tmp, "a.eml"), "wb") as f:
        f.write(_eml("Subject: S\nFrom: a@b.org\n\nbody"))
    df = spark.read.format("binaryFile").load(tmp)
    assert parse_eml(df).first()["body"] == "body"


def test_star_schema(spark):
    rows = [(1, dt.datetime(2026, 1, 15, 9), "a@x.org", "Research - Grant", "ham", 0.3),
            (2, dt.datetime(2026, 1, 16, 9), "b@y.org", "Shopping", "spam", 0.9),
            (3, dt.datetime(2026, 1, 16, 10), "a@x.org", None, "ham", 0.1)]
    df = spark.createDataFrame(rows, "message_id long, received_at timestamp_ntz, sender string, topic string, "
                                     "spam_label string, urgency_score double")
    fact, dd, ds, dtp = build_star(df)
    assert (dd.count(), ds.count(), dtp.count()) == (2, 2, 3)
    j = {r["message_id"]: r for r in star_join(fact, dd, ds, dtp).collect()}
    assert j[1]["category"] == "Research" and j[2]["domain"] == "y.org" and j[3]["topic"] == ""
    assert fact.where("year = 2026 AND month = 1").count() == 3


def test_validate_and_defaults(spark):
    df = spark.createDataFrame([("a", "x", 0.5), (None, "x", 0.5), ("b", " ", 0.5), ("c", "x", 2.0)],
                               "email_id string, text string, confidence double")
    good, bad = validate(df, required=["email_id"], nonblank=["text"], checks={"confidence range": F.col("confidence") <= 1})
    assert [r["email_id"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == ["blank text", "confidence range", "missing email_id"]
    d = with_defaults(spark.createDataFrame([(None,)], "mailbox_type string"), {"mailbox_type": "faculty", "x": ""})
    assert tuple(d.first()) == ("faculty", "")
    with pytest.raises(ValueError):
        assert_nonempty(df.limit(0))


def test_written_count(spark, tmp):
    spark.range(7).withColumn("d", F.col("id") % 2).write.partitionBy("d").parquet(os.path.join(tmp, "o"))
    assert written_count(spark, os.path.join(tmp, "o")) == 7
    assert written_count(spark, os.path.join(tmp, "o"), F.col("d") == 1) == 3


def _raw_dir(spark, tmp):
    recs = [{"message_id": f"m{i}", "subject": "WINNER" if i == 1 else "Hi", "sender": "a@x.org", "body": "b",
             "received_at": f"2026-01-{14 + i % 3}T10:00:00Z"} for i in range(6)]
    root = os.path.join(tmp, "raw")
    for day in ("2026-01-14", "2026-01-15", "2026-01-16"):
        d = os.path.join(root, f"ingestion_date={day}", "mailbox_type=faculty")
        os.makedirs(d)
        with open(os.path.join(d, "batch.json"), "w") as f:
            f.write(json.dumps([r for r in recs if r["received_at"].startswith(day)]) + "\n")
    return root


def test_run_day_then_backfill(spark, tmp):
    root = _raw_dir(spark, tmp)
    lake = os.path.join(tmp, "lake")
    out = FL.run_day(spark, root, lake, "2026-01-15")
    assert out["ingested"] == 2 and out["classified"] == 2
    daily = spark.read.parquet(out["daily"]).collect()
    assert [(r["metric_date"], r["daily_volume"], r["spam_count"]) for r in daily] == [("2026-01-15", 2, 1)]
    out = FL.backfill(spark, root, lake, "2026-01-14", "2026-01-16")
    got = sorted((r["metric_date"], r["daily_volume"]) for r in spark.read.parquet(out["daily"]).collect())
    assert got == [("2026-01-14", 2), ("2026-01-15", 2), ("2026-01-16", 2)]
    jd = spark.read.json(os.path.join(lake, "analytics", "daily"))
    assert jd.count() == 3


def test_to_events_and_kafka_rows(spark):
    import uuid

    rows = [(1, 7, dt.datetime(2026, 1, 15, 10, 0), "S", "a@b", "  body ", None),
            (1, 8, dt.datetime(2026, 1, 15, 11, 0, 0, 5), "T", "a@b", "", "prev")]
    df = spark.createDataFrame(rows, "user_id long, message_id long, received_at timestamp_ntz, subject string, "
                                     "sender string, body string, body_preview string")
    ev = {r["email_id"]: r for r in FL.to_events(df, per_user=5).collect()}
    e7 = ev[str(uuid.uuid5(uuid.NAMESPACE_URL, "mailbox:7"))]
    assert e7["text"] == "Subject: S\nFrom: a@b\n\nbody" and e7["timestamp"] == "2026-01-15T10:00:00+00:00"
    e8 = ev[str(uuid.uuid5(uuid.NAMESPACE_URL, "mailbox:8"))]
    assert e8["timestamp"] == "2026-01-15T11:00:00.000005+00:00" and e8["text"].endswith("prev")
    kv = FL.to_kafka_rows(FL.to_events(df, per_user=1)).collect()
    assert len(kv) == 1 and json.loads(kv[0]["value"])["email_id"] == kv[0]["key"]
