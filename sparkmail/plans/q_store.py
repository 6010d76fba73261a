"""Registered queries: the segmented log, batches by size or age, and bucketed tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from sparkmail.operators.merge import apply_feedback, first_per_key, reclassify
from sparkmail.plans.adapters import MESSAGES_FROM_EVENTS_SQL as EV
from sparkmail.plans.q_analytics import _events
from sparkmail.plans.registry import query
from sparkmail.session import scratch_path
from sparkmail.sources.buckets import BucketTable
from sparkmail.streaming.buffer import batch_sizes, flush_batches
from sparkmail.streaming.log import append_segment, log_end, log_source


def _drained(source, checkpoint: str, sink: str) -> list[int]:
    """Runs a stream into ``sink`` until its source has nothing more; records of each batch."""
    q = source.writeStream.option("checkpointLocation", f"{checkpoint}/query").format("parquet").option("path", sink) \
        .trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        return [p.numInputRows for p in q.recentProgress if p.numInputRows]
    finally:
        q.stop()


def log_runs(spark, events, root: str):
    """Two segments streamed in bounded batches, a restart with the third, and a replay from behind the first.
    Returns the two sinks and the batch sizes of the three runs."""
    rows = events.select(F.col("message_id"), F.col("user_id").cast("string").alias("key"), F.col("received_at").alias("timestamp"),
                         F.to_json(F.struct("message_id", "user_id", "topic")).alias("value"))
    # A third of the messages a batch, whatever their number.
    most = -(-rows.count() // 3)
    log, sink, again = f"{root}/log", f"{root}/sink", f"{root}/again"
    append_segment(rows.where("message_id % 3 = 0"), log)
    first = log_end(log)
    append_segment(rows.where("message_id % 3 = 1"), log)
    sizes = [_drained(log_source(spark, log, f"{root}/ck", max_lag=most), f"{root}/ck", sink)]
    append_segment(rows.where("message_id % 3 = 2"), log)
    sizes.append(_drained(log_source(spark, log, f"{root}/ck", max_lag=most), f"{root}/ck", sink))
    sizes.append(_drained(log_source(spark, log, f"{root}/ck2", starting=first, max_lag=most), f"{root}/ck2", again))
    return sink, again, sizes


@query("log_stream", sql=f"""
SELECT message_id, user_id, topic, 1 AS streamed, CASE WHEN message_id % 3 = 0 THEN 0 ELSE 1 END AS replayed FROM ({EV})
""")
def q_log_stream(spark, sf):
    sink, again, _ = log_runs(spark, _events(spark, sf), scratch_path(spark, "log"))
    schema = "message_id long, user_id long, topic string"

    def records(path, name):
        r = spark.read.parquet(path).select(F.from_json("value", schema).alias("r")).select("r.*")
        return r.select("*", F.lit(name).alias("run"))

    both = records(sink, "streamed").unionByName(records(again, "replayed"))
    return both.groupBy("message_id", "user_id", "topic").agg(
        F.count_if(F.col("run") == "streamed").cast("int").alias("streamed"),
        F.count_if(F.col("run") == "replayed").cast("int").alias("replayed"))


SHARDS = 4


@query("flush_by_size_or_age", sql=f"""
WITH n AS (SELECT mailbox_type, CAST(user_id % {SHARDS} AS INTEGER) AS shard, count(*) AS n, CAST(sum(message_id) AS BIGINT) AS key_ids
           FROM ({EV}) GROUP BY 1, 2),
b AS (SELECT *, unnest(range(0, (n + 499) // 500)) AS batch_no FROM n)
SELECT mailbox_type, shard, batch_no, CASE WHEN n - 500 * batch_no >= 500 THEN 'size' ELSE 'age' END AS flush_cause,
       least(500, n - 500 * batch_no) AS batch_rows, key_ids
FROM b
""")
def q_flush(spark, sf):
    """Everything arrives at once: whole batches go out by size, what is left of each buffer by age."""
    base = scratch_path(spark, "flush")
    m = _events(spark, sf).select("message_id", "mailbox_type", (F.col("user_id") % SHARDS).cast("int").alias("shard"), "body")
    m.write.parquet(f"{base}/in")
    rows = m.count()
    source = spark.readStream.schema(m.schema).parquet(f"{base}/in")
    out = flush_batches(source, ["mailbox_type", "shard"], seconds=2)
    q = out.writeStream.option("checkpointLocation", f"{base}/ck").format("parquet").option("path", f"{base}/out") \
        .trigger(processingTime="1 second").start()
    try:
        # Timers fire in the micro-batches that follow; the query ends when all records are out.
        while rows and (not q.recentProgress or spark.read.schema(out.schema).parquet(f"{base}/out").count() < rows):
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
            time.sleep(1)
    finally:
        q.stop()
    found = spark.read.schema(out.schema).parquet(f"{base}/out")
    keys = ["mailbox_type", "shard"]
    return batch_sizes(found, keys).join(found.groupBy(*keys).agg(F.sum("message_id").alias("key_ids")), keys) \
        .select(*keys, "batch_no", "flush_cause", F.col("counted").alias("batch_rows"), "key_ids")


# --- a bucketed message table: corrections, reclassification and inserts touch few buckets ---

BUCKETS = 16


def message_store(spark, sf, root: str) -> BucketTable:
    m = _events(spark, sf).select("message_id", "user_id", "topic", "spam_label")
    table = BucketTable(spark, root, ["message_id"], BUCKETS)
    table.create(m.withColumn("feedback", F.lit(None).cast("string")).withColumn("feedback_at", F.lit(None).cast("timestamp")))
    return table


@query("store_feedback", sql=f"""
WITH c AS (SELECT message_id, max(received_at) AS feedback_at FROM ({EV}) WHERE topic = 'error' AND user_id = (SELECT min(user_id) FROM events) GROUP BY 1)
SELECT m.message_id, m.user_id, m.topic, m.spam_label, CASE WHEN c.message_id IS NOT NULL THEN 'ham' END AS feedback,
       strftime(c.feedback_at, '%Y-%m-%d %H:%M:%S.%f') AS feedback_at
FROM ({EV}) m LEFT JOIN c ON c.message_id = m.message_id
""")
def q_store_feedback(spark, sf):
    """J4 in place: the corrections of one user's errors rewrite the buckets of these messages."""
    table = message_store(spark, sf, scratch_path(spark, "store"))
    m = _events(spark, sf)
    least = m.agg(F.min("user_id").alias("u"))
    changes = m.where("topic = 'error'").join(F.broadcast(least), F.col("user_id") == F.col("u")).select(
        "message_id", F.lit("ham").alias("corrected_label"), F.col("received_at").alias("feedback_at"))
    table.merge(changes, lambda rows, c: apply_feedback(rows, c, key="message_id")[0])
    return table.read().withColumn("feedback_at", F.date_format("feedback_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("store_reclassify", sql=f"""
SELECT message_id, user_id, topic, CASE WHEN message_id % 500 = 0 THEN 'spam' ELSE spam_label END AS spam_label FROM ({EV})
""")
def q_store_reclassify(spark, sf):
    """J5 in place: new labels of a few messages; an invalid one changes nothing."""
    table = message_store(spark, sf, scratch_path(spark, "store"))
    changes = _events(spark, sf).where("message_id % 500 = 0 or message_id % 700 = 1").select(
        "message_id", F.when(F.col("message_id") % 500 == 0, F.lit("spam")).otherwise(F.lit("junk")).alias("corrected_label"),
        F.lit("a@example.org").alias("user_email"), F.lit(None).cast("string").alias("reason"), F.col("received_at").alias("feedback_timestamp"))
    table.merge(changes, lambda rows, c: reclassify(rows, c)[0])
    return table.read().select("message_id", "user_id", "topic", "spam_label")


@query("store_dedup", sql=f"""
WITH b AS (SELECT message_id, received_at, topic, message_id % 4 AS batch FROM ({EV}) UNION ALL
           SELECT message_id, received_at, topic, 4 FROM ({EV}) WHERE message_id % 3 = 0)
SELECT message_id, topic, CAST(min(batch) AS INTEGER) AS batch FROM b GROUP BY 1, 2
""")
def q_store_dedup(spark, sf):
    """T5/J3 across all time: each batch opens the buckets of its own ids; a batch run twice adds nothing."""
    m = _events(spark, sf).select("message_id", "topic", "received_at")
    store = BucketTable(spark, f"{scratch_path(spark, 'ids')}", ["message_id"], BUCKETS)
    store.create(m.select("message_id", "topic", F.lit(0).alias("batch")).limit(0))
    batches = [m.where(F.col("message_id") % 4 == k) for k in range(4)] + [m.where("message_id % 3 = 0")]
    for k, batch in enumerate(batches):
        rows = first_per_key(batch.unionByName(batch.where("message_id % 40 = 0")), ["message_id"], ["received_at"])
        for _ in range(2 if k == 2 else 1):
            store.append_unseen(rows.select("message_id", "topic", F.lit(k).alias("batch")), tag=str(k), most_folders=3)
    return store.read()
