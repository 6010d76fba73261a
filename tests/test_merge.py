"""Merges and lists."""

import datetime as dt

from pyspark.sql import functions as F

from sparkmail.operators import merge as M
from sparkmail.operators import paging as P


def test_insert_unseen_batch_and_stored_duplicates(spark):
    stored = spark.createDataFrame([(1, "m1", "old")], "user_id long, message_id string, body string")
    new = spark.createDataFrame([(1, "m1", "dup of stored", 1), (1, "m2", "first", 2), (1, "m2", "second", 3),
                                 (2, "m1", "other user", 4)],
                                "user_id long, message_id string, body string, arrival long")
    out = M.insert_unseen(stored, new, ["user_id", "message_id"], order=["arrival"]).orderBy("user_id", "message_id")
    assert [(r["user_id"], r["message_id"], r["body"]) for r in out.collect()] == [(1, "m2", "first"),
                                                                                   (2, "m1", "other user")]
    merged = M.merge_unseen(stored, new.drop("arrival"), ["user_id", "message_id"])
    assert merged.count() == 3


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k long, t long, v string")
    got = sorted((r["k"], r["v"]) for r in M.latest_per_key(df, ["k"], ["t"]).collect())
    assert got == [(1, "c"), (2, "x")]


def test_first_per_key_plan_is_partial_aggregate(spark):
    df = spark.createDataFrame([(1, 1, "a")], "k long, t long, v string")
    plan = M.first_per_key(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_apply_feedback(spark):
    at = dt.datetime(2026, 1, 15, 10)
    emails = spark.createDataFrame([("e1", "spam"), ("e2", "ham")], "email_id string, predicted_label string")
    fb = spark.createDataFrame([("e1", "ham", at), ("e1", "spam", at + dt.timedelta(hours=1)), ("zz", "ham", at)],
                               "email_id string, corrected_label string, feedback_at timestamp")
    upd, unmatched = M.apply_feedback(emails, fb)
    got = {r["email_id"]: (r["feedback"], r["feedback_at"]) for r in upd.collect()}
    assert got["e1"] == ("spam", at + dt.timedelta(hours=1)) and got["e2"] == (None, None)
    assert [r["email_id"] for r in unmatched.collect()] == ["zz"]
    assert [r["email_id"] for r in M.feedback_rows(upd).collect()] == ["e1"]


def test_reclassify(spark):
    at = dt.datetime(2026, 1, 15)
    target = spark.createDataFrame([("m1", "ham"), ("m2", "spam")], "message_id string, spam_label string")
    ch = spark.createDataFrame([("m1", "spam", "u@x", "oops", at), ("m2", "SPAM", "u@x", None, at),
                                ("m3", "ham", "u@x", None, at)],
                               "message_id string, corrected_label string, user_email string, reason string, "
                               "feedback_timestamp timestamp")
    new, log, rejected = M.reclassify(target, ch)
    assert {r["message_id"]: r["spam_label"] for r in new.collect()} == {"m1": "spam", "m2": "spam"}
    assert [(r["message_id"], r["original_label"], r["corrected_label"]) for r in log.collect()] == [("m1", "ham", "spam")]
    assert [r["message_id"] for r in rejected.collect()] == ["m2"]


def _mail(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [(i % 3, i, base + dt.timedelta(hours=i // 2), "spam" if i % 4 == 0 else "ham",
             ["mailbox", "synthetic", ""][i % 3], f"User{i}@Dept{i % 2}.edu", f"Subject {i}",
             None if i % 5 == 0 else f"preview {i}", "faculty" if i % 2 else "personal", f"t{i % 3}")
            for i in range(40)]
    return spark.createDataFrame(rows, "user_id long, message_id long, received_at timestamp_ntz, spam_label string, "
                                       "pipeline_source string, sender string, subject string, body_preview string, "
                                       "mailbox_type string, topic string")


def test_latest_clamps_and_filters(spark):
    m = _mail(spark).withColumnRenamed("received_at", "timestamp").withColumnRenamed("message_id", "email_id")
    assert P.latest(m, limit=0).count() == 1
    assert P.latest(m, limit=10_000).count() == 40
    top = P.latest(m, limit=3, source="mailbox").collect()
    assert [r["email_id"] for r in top] == [39, 36, 33]


def test_page_and_keyset_agree(spark):
    m = _mail(spark)
    p2 = [r["message_id"] for r in P.page(m, 2, 7).collect()]
    p1 = P.page(m, 1, 7).collect()
    last = p1[-1]
    after = [r["message_id"] for r in P.page_after(m, last["received_at"], last["message_id"], 7).collect()]
    assert p2 == after
    info = P.page_info(m, 7).first()
    assert (info["total"], info["pages"]) == (40, 6)


def test_top_per_user(spark):
    out = P.top_per_user(_mail(spark), 2)
    got = sorted((r["user_id"], r["message_id"]) for r in out.collect())
    assert got == [(0, 36), (0, 39), (1, 34), (1, 37), (2, 35), (2, 38)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_search_filters(spark):
    m = _mail(spark)
    assert P.search(m, sender="dept1").count() == 20                       # case-insensitive
    assert P.search(m, text="preview 1").count() == P.search(m, text="PREVIEW 1").count()
    assert P.search(m, text="Subject 5").count() == 1                       # subject hit, preview null
    s = P.search(m, spam_label="spam", mailbox_type="personal", user_id=0, topic="t0",
                 start="2026-01-01", end="2026-01-05")
    assert all(r["spam_label"] == "spam" and r["user_id"] == 0 for r in s.collect())
    assert P.search(m, sender="dept_.edu").count() == 40                   # '_' is a LIKE wildcard, as in the reference
    assert P.search(m, sender="dept_.edu", escape=True).count() == 0
    assert P.by_id(m, 1, 1).count() == 1 and P.by_id(m, 1, 2).count() == 0


def test_search_pushes_filters_to_parquet(spark, tmp):
    _mail(spark).write.parquet(tmp + "/m")
    plan = P.search(spark.read.parquet(tmp + "/m"), spam_label="spam")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(spam_label), EqualTo(spam_label,spam)]" in plan


def test_serving_record(spark):
    r = P.serving_record(_mail(spark).withColumn("urgency_score", F.lit(0.5))).orderBy("message_id").first()
    assert r["message_id"] == "0" and r["timestamp"] == "2026-01-01T00:00:00" and r["sender_name"] is None
    assert len(r) == 16


def test_reclassify_logs_each_replaced_label(spark):
    target = spark.createDataFrame([(1, "ham")], "message_id long, spam_label string")
    changes = spark.createDataFrame([(1, "spam", "u", None, "2026-01-01"), (1, "ham", "u", None, "2026-01-02")],
                                    "message_id long, corrected_label string, user_email string, reason string, feedback_timestamp string")
    new, log, _ = M.reclassify(target, changes)
    assert sorted((r.original_label, r.corrected_label) for r in log.collect()) == [("ham", "spam"), ("spam", "ham")]
    assert new.first().spam_label == "ham"


def test_search_takes_a_backslash_literally(spark):
    d = spark.createDataFrame([(1, "a\\b", None), (2, "ab", None)], "message_id long, subject string, body_preview string")
    assert [r.message_id for r in P.search(d, text="\\").collect()] == [1]


def test_bucketed_target_is_not_shuffled(spark, tmp):
    from sparkmail.sources.lake import write_bucketed

    target = spark.range(1000).select(F.col("id").cast("string").alias("email_id"),
                                      F.lit("ham").alias("predicted_label"))
    write_bucketed(target, "emails_bucketed_t", ["email_id"], 8, path=tmp + "/t")
    fb = spark.range(0, 2000, 7).select(F.col("id").cast("string").alias("email_id"),
                                        F.lit("spam").alias("corrected_label"),
                                        F.current_timestamp().alias("feedback_at"))
    upd, _ = M.apply_feedback(spark.table("emails_bucketed_t"), fb)
    plain, _ = M.apply_feedback(target, fb)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # force the shuffled join
    try:
        shuffles = [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
                    for p in (upd, plain)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles[0] < shuffles[1]                                   # the bucketed side is read in place
    assert upd.where(F.col("feedback") == "spam").count() == len(range(0, 1000, 7))
