"""Structured Streaming operators with a file stand-in for Kafka."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.streaming import stream as ST

NOW = {"availableNow": True}


def _write_lines(d, name, lines):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _ev(i, text="hello", ts="2026-01-15T10:00:00Z", src="mailbox"):
    return json.dumps({"email_id": f"e{i}", "text": text, "timestamp": ts, "pipeline_source": src})


def _run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_classify_dedup_and_dlq_across_batches(spark, tmp):
    src, sink, dlq, ck = (os.path.join(tmp, x) for x in ("in", "sink", "dlq", "ck"))
    _write_lines(src, "a.json", [_ev(1, "you are a winner"), _ev(2), _ev(2, "dup in batch"), "{broken",
                                 json.dumps({"email_id": "e3"}), _ev(4, "  "), _ev(5, ts="yesterday")])
    rules = R.JOB_RULES
    _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, dlq, ck, ST.rule_labeler(rules), NOW))
    _write_lines(src, "b.json", [_ev(1, "again"), _ev(6, ts="2026-01-15T11:00:00+01:00")])
    _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, dlq, ck, ST.rule_labeler(rules), NOW))
    out = {r["email_id"]: r for r in spark.read.parquet(sink).collect()}
    assert sorted(out) == ["e1", "e2", "e6"]
    assert out["e1"]["predicted_label"] == "spam" and out["e1"]["text"] == "you are a winner"
    assert out["e2"]["predicted_label"] == "ham" and abs(out["e2"]["confidence"] - 0.9) < 1e-6
    assert out["e6"]["timestamp"] == dt.datetime(2026, 1, 15, 10, 0)
    reasons = sorted(r["reason"] for r in spark.read.json(dlq).collect())
    assert reasons == ["bad timestamp", "blank text", "malformed json", "missing text"]


def test_retried_batch_is_idempotent(spark, tmp):
    sink, dlq = os.path.join(tmp, "sink"), os.path.join(tmp, "dlq")
    batch = spark.createDataFrame([(_ev(1),), (_ev(2),)], "value string")
    ST.classify_batch(batch, 0, sink, dlq, ST.rule_labeler())
    ST.classify_batch(batch, 0, sink, dlq, ST.rule_labeler())       # the same batch again after a failure
    assert spark.read.parquet(sink).count() == 2


def test_live_daily_with_watermark(spark, tmp):
    d = os.path.join(tmp, "msgs")
    rows = [(dt.datetime(2026, 1, 15, h), "spam" if h % 2 else "ham", 0.5) for h in range(6)]
    rows += [(dt.datetime(2026, 1, 17, 1), "ham", 0.1)]
    spark.createDataFrame(rows, "received_at timestamp, spam_label string, urgency_score double").write.parquet(d)
    sdf = spark.readStream.schema("received_at timestamp, spam_label string, urgency_score double").parquet(d)
    q = (ST.live_daily(sdf).writeStream.outputMode("complete").format("memory").queryName("live_t")
         .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start())
    _run(q)
    got = {r["metric_date"]: (r["daily_volume"], r["spam_count"], r["ham_count"]) for r in spark.table("live_t").collect()}
    assert got == {"2026-01-15": (6, 3, 3), "2026-01-17": (1, 0, 1)}


def test_dedup_within_watermark(spark, tmp):
    src = os.path.join(tmp, "in")
    _write_lines(src, "a.json", [_ev(1), _ev(1), _ev(2)])
    good, _ = ST.split_bad(ST.decode(ST.file_source(spark, src)))
    rows = ST.dedup_stream(good.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    q = (rows.writeStream.format("memory").queryName("dedup_t").option("checkpointLocation", os.path.join(tmp, "ck"))
         .trigger(availableNow=True).start())
    _run(q)
    assert sorted(r["email_id"] for r in spark.table("dedup_t").collect()) == ["e1", "e2"]


def test_emit_only_on_change(spark, tmp):
    src, sink, dlq, out, state, ck = (os.path.join(tmp, x) for x in ("in", "sink", "dlq", "out", "state", "ck"))
    _write_lines(src, "a.json", [_ev(1), _ev(2)])
    _write_lines(src, "b.json", [_ev(1)])                            # a duplicate: nothing changes
    _run(ST.emit_on_change(ST.file_source(spark, src, max_files=1), sink, dlq, out, state, ck, limit=5, trigger=NOW))
    emitted = spark.read.parquet(out)
    assert sorted({r["batch_id"] for r in emitted.collect()}) == ["0"]
    assert emitted.count() == 2


def test_stream_to_lake_partitions(spark, tmp):
    src = os.path.join(tmp, "in")
    _write_lines(src, "a.json", [_ev(1, src="mailbox"), _ev(2, src="demo")])
    good, _ = ST.split_bad(ST.decode(ST.file_source(spark, src)))
    rows = good.select("email_id", F.date_format("timestamp", "yyyy-MM-dd").alias("ingestion_date"),
                       F.col("pipeline_source").alias("mailbox_type"))
    _run(ST.stream_to_lake(rows, os.path.join(tmp, "lake"), os.path.join(tmp, "ck"), trigger=NOW))
    back = spark.read.parquet(os.path.join(tmp, "lake"))
    assert sorted((r["ingestion_date"], r["mailbox_type"]) for r in back.collect()) == [
        ("2026-01-15", "demo"), ("2026-01-15", "mailbox")]


def test_running_totals(spark, tmp):
    d = os.path.join(tmp, "m")
    spark.createDataFrame([("spam",), ("ham",), ("spam",)], "spam_label string").write.parquet(d)
    sdf = spark.readStream.schema("spam_label string").parquet(d)
    q = (ST.running_totals(sdf).writeStream.outputMode("complete").format("memory").queryName("tot_t")
         .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start())
    _run(q)
    r = spark.table("tot_t").first()
    assert (r["total_emails"], r["spam_count"]) == (3, 2)


def test_sink_probe_mode(spark, tmp):
    src, sink, dlq, ck = (os.path.join(tmp, x) for x in ("in", "sink", "dlq", "ck"))
    _write_lines(src, "a.json", [_ev(1), _ev(1), "{bad"])
    _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, dlq, ck, trigger=NOW, dedup="sink"))
    _write_lines(src, "b.json", [_ev(1), _ev(2)])
    _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, dlq, ck, trigger=NOW, dedup="sink"))
    assert sorted(r["email_id"] for r in spark.read.parquet(sink).collect()) == ["e1", "e2"]
    assert [r["reason"] for r in spark.read.json(dlq).collect()] == ["malformed json"]


def test_complete_to_table(spark, tmp):
    d = os.path.join(tmp, "m")
    spark.createDataFrame([("spam",), ("ham",)], "spam_label string").write.parquet(d)
    spark.createDataFrame([("spam",)], "spam_label string").write.mode("append").parquet(d)
    sdf = spark.readStream.schema("spam_label string").option("maxFilesPerTrigger", "1").parquet(d)
    _run(ST.complete_to_table(ST.running_totals(sdf), os.path.join(tmp, "out"), os.path.join(tmp, "ck"), NOW))
    r = ST.read_latest(spark, os.path.join(tmp, "out")).first()
    assert (r["total_emails"], r["spam_count"]) == (3, 2)


def test_three_class_champion_is_served_by_its_labels(spark, tmp):
    from sparkmail.plans.flows import retrain_and_register

    rows = [(f"{w} {i}", c) for c, w in (("ham", "agenda meeting notes"), ("phish", "password account verify"), ("spam", "winner prize claim"))
            for i in range(4)]
    fb = spark.createDataFrame(rows, "text string, feedback string")
    reg = retrain_and_register(spark, fb, tmp, "1", "2026-01-15", dt.datetime(2026, 1, 15))
    assert [r.is_champion for r in reg.collect()] == [True]
    src, sink, dlq, ck = (os.path.join(tmp, x) for x in ("in", "sink", "dlq", "ck"))
    _write_lines(src, "a.json", [_ev(1, "winner prize claim"), _ev(2, "verify password account"), _ev(3, "meeting agenda notes")])
    _run(ST.stream_classify(ST.file_source(spark, src), sink, dlq, ck, ST.model_labeler(tmp), NOW))
    assert {r.email_id: r.predicted_label for r in spark.read.parquet(sink).collect()} == {"e1": "spam", "e2": "phish", "e3": "ham"}


def test_correction_emits_a_new_snapshot(spark, tmp):
    out, state = os.path.join(tmp, "out"), os.path.join(tmp, "state")
    rows = ST.to_results(spark.createDataFrame([("e1", "t", "ham", 0.9, dt.datetime(2026, 1, 15), "m")],
                                               "email_id string, text string, predicted_label string, confidence double, timestamp timestamp, pipeline_source string"))
    none = rows.limit(0)
    fix = spark.createDataFrame([("e1", "spam", dt.datetime(2026, 1, 16))], "email_id string, corrected_label string, feedback_at timestamp")
    assert ST.emit_if_changed(spark, rows, out, state, 0, corrections=fix.limit(0))
    assert not ST.emit_if_changed(spark, none, out, state, 1, corrections=fix.limit(0))
    assert ST.emit_if_changed(spark, none, out, state, 2, corrections=fix)
    assert not ST.emit_if_changed(spark, none, out, state, 3, corrections=fix)
    assert [r.feedback for r in spark.read.parquet(out + "/batch_id=2").collect()] == ["spam"]


def test_stored_ids_in_buckets_give_the_same_results_as_state(spark, tmp):
    src, ck = os.path.join(tmp, "in"), os.path.join(tmp, "ck")

    def put(ids, n):
        rows = [(json.dumps({"email_id": i, "text": f"t {n}", "timestamp": f"2024-01-0{n}T00:00:00Z"}),) for i in ids]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(src)

    put(["a", "b", "a", "c"], 1)
    put(["b", "d"], 2)
    sinks = [os.path.join(tmp, f"sink{i}") for i in range(2)]
    for sink, dedup in zip(sinks, ("state", "store")):
        _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, f"{sink}-dlq", f"{ck}-{dedup}", trigger=NOW, dedup=dedup))
    put(["a", "e"], 3)
    for sink, dedup in zip(sinks, ("state", "store")):  # after a restart
        _run(ST.stream_classify(ST.file_source(spark, src, max_files=1), sink, f"{sink}-dlq", f"{ck}-{dedup}", trigger=NOW, dedup=dedup))
    got = [sorted(r.email_id for r in spark.read.parquet(s).collect()) for s in sinks]
    assert got == [["a", "b", "c", "d", "e"]] * 2


def test_stream_input_has_no_more_files_than_its_lines_need(spark, tmp):
    """The micro-batches of a stream that takes two files at a time must not grow with the tasks of the scan."""
    from sparkmail.plans import q_stream as Q

    ev = spark.range(400).select(
        F.col("id").alias("event_id"), (F.lit(dt.datetime(2026, 1, 5)) + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    ev.repartition(8).write.parquet(f"{tmp}/events.parquet")
    Q._write_stream_input(spark, tmp, f"{tmp}/in")
    lines = spark.read.text(f"{tmp}/in")
    assert len(lines.inputFiles()) == 5
    assert lines.count() == 400 + 10 + 134 and lines.distinct().count() == 400


def test_large_appends_have_several_files(spark, tmp, monkeypatch):
    from sparkmail.plans import q_stream as Q

    monkeypatch.setattr(Q, "LINES_A_FILE", 10)
    Q._append_lines(spark.range(0, 35, 1, 8).select(F.col("id").cast("string").alias("value")), f"{tmp}/in")
    lines = spark.read.text(f"{tmp}/in")
    assert len(lines.inputFiles()) == 4 and sorted(int(r.value) for r in lines.collect()) == list(range(35))
