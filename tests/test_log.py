"""The segmented log: offsets, bounded batches, restart and replay."""

import json

import pytest
from pyspark.sql import functions as F

from sparkmail.plans.q_store import log_runs
from sparkmail.streaming.log import MAX_LAG, SegmentReader, Segments, advance, append_segment, between, lag, log_end, log_source


def rows(spark, a, b):
    return spark.range(a, b).select((F.col("id") % 7).alias("key"), F.concat(F.lit("v"), "id").alias("value"),
                                    F.timestamp_seconds("id").alias("timestamp"))


def read_all(segments, slices):
    reader = SegmentReader({"path": segments.root})
    from sparkmail.streaming.log import LogSlice

    return [v for s in slices for b in reader.read(LogSlice(*s)) for v in b.column("value").to_pylist()]


def test_offsets_advance_by_bounded_steps_and_cover_everything_once(spark, tmp):
    assert log_end(tmp) == {} and Segments(f"{tmp}/none").ahead({}) == {}
    append_segment(rows(spark, 0, 300), tmp, rows_per_file=20)
    append_segment(rows(spark, 300, 500), tmp, partitions=2)
    segments = Segments(tmp)
    offset, seen, steps = {}, [], []
    while lag(segments.ahead(offset)):
        new = advance(offset, segments.ahead(offset), 90)
        slices = between(segments, offset, new)
        steps.append(sum(b - a for _, _, a, b in slices))
        seen += read_all(segments, slices)
        offset = new
    assert steps == [90] * 5 + [50]
    assert sorted(seen) == sorted(f"v{i}" for i in range(500)) and offset == segments.end()


def test_small_lag_is_taken_whole():
    ahead = {0: [("a", 0, 5)], 1: [("b", 2, 4)]}
    assert advance({}, ahead, MAX_LAG) == {"0": {"file": "a", "row": 5}, "1": {"file": "b", "row": 4}}
    assert advance({"0": {"file": "a", "row": 0}}, {}, 3) == {"0": {"file": "a", "row": 0}}


def test_hot_partition_does_not_starve_the_others():
    ahead = {0: [("a", 0, 900)], 1: [("b", 0, 90)], 2: [("c", 0, 10)]}
    moved = advance({}, ahead, 100)
    assert {p: x["row"] for p, x in moved.items()} == {"0": 90, "1": 9, "2": 1}


def test_order_within_a_partition_and_null_keys(spark, tmp):
    df = rows(spark, 0, 50).unionByName(spark.createDataFrame([(None, None, None)], "key long, value string, timestamp timestamp"))
    append_segment(df, tmp, partitions=3)
    segments = Segments(tmp)
    for p, slices in segments.ahead({}).items():
        own = [v for v in read_all(segments, [(p, *s) for s in slices]) if v]
        assert own == sorted(own, key=lambda v: int(v[1:]))
    assert lag(segments.ahead({})) == 51


def test_a_reader_goes_on_where_its_last_planned_batch_ended(spark, tmp):
    append_segment(rows(spark, 0, 100), f"{tmp}/log")
    options = {"path": f"{tmp}/log", "maxlag": "40", "position": f"{tmp}/ck/position.json"}
    one = SegmentReader(options)
    start = one.initialOffset()
    end = one.latestOffset()
    assert one.latestOffset() == end  # asking moves nothing
    one.partitions(start, end)
    two = SegmentReader(options)  # after a restart
    assert two.now == end and sum(b - a for _, _, a, b in between(two.segments, end, two.latestOffset())) == 40
    # A batch that was planned but not committed is planned again by Spark, with the same ends.
    assert [(s.name, s.first, s.end) for s in two.partitions(start, end)] == [(s.name, s.first, s.end) for s in one.partitions(start, end)]


@pytest.mark.parametrize("starting, want", [("earliest", 30), ("latest", 0)])
def test_where_a_new_reader_starts(spark, tmp, starting, want):
    append_segment(rows(spark, 0, 30), tmp)
    reader = SegmentReader({"path": tmp, "startingoffsets": starting})
    assert lag(reader.segments.ahead(reader.initialOffset())) == want
    given = json.dumps(log_end(tmp))
    assert SegmentReader({"path": tmp, "startingoffsets": given}).initialOffset() == log_end(tmp)


def test_streams_in_bounded_batches_restarts_and_replays(spark, tmp):
    events = spark.range(900).select(F.col("id").alias("message_id"), (F.col("id") % 9).alias("user_id"),
                                     F.timestamp_seconds("id").alias("received_at"), F.lit("t").alias("topic"))
    sink, again, sizes = log_runs(spark, events, tmp)
    assert sizes == [[300, 300], [300], [300, 300]]
    got = spark.read.parquet(sink)
    assert got.count() == 900 and got.select("value").distinct().count() == 900
    assert spark.read.parquet(again).count() == 600


def test_an_empty_log_is_a_stream_without_rows(spark, tmp):
    q = log_source(spark, f"{tmp}/none", f"{tmp}/ck").writeStream.option("checkpointLocation", f"{tmp}/ck/q").format("parquet") \
        .option("path", f"{tmp}/out").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    assert q.exception() is None and not any(p.numInputRows for p in q.recentProgress)
    q.stop()
