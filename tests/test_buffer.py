"""Batches by size or age: the processor on a fake state, step by step, and a stream with both causes."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkmail.streaming.buffer import DUE, FULL, Flush, batch_sizes, flush_batches


class Rows:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def appendList(self, more):  # noqa: N802
        self.rows += more

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers, self.rows, self.value = set(), Rows(), Value()

    def getListState(self, *_):  # noqa: N802
        return self.rows

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


@pytest.fixture()
def flush():
    p = Flush(StructType([StructField("v", LongType())]), ["k", "batch_no", "flush_cause", "batch_rows", "v"], size=3, seconds=10)
    p.init(Handle())
    return p


def put(p, at, *values):
    return [(r.batch_no, r.flush_cause, r.batch_rows, r.v) for r in p.handleInputRows(("a",), iter([(v,) for v in values]), Clock(at))]


def fire(p, at):
    p.handle.timers.discard(at)
    return [(r.batch_no, r.flush_cause, r.v) for r in p.handleExpiredTimer(("a",), None, Clock(at))]


def test_the_timer_belongs_to_the_oldest_record_held(flush):
    assert put(flush, 1000, 1) == [] and flush.handle.timers == {11000}
    assert put(flush, 5000, 2) == [] and flush.handle.timers == {11000}
    assert put(flush, 6000, 3, 4) == [(0, FULL, 3, 1), (0, FULL, 3, 2), (0, FULL, 3, 3)]
    assert flush.handle.timers == {16000} and flush.handle.rows.rows == [(4,)]
    assert fire(flush, 16000) == [(1, DUE, 4)] and flush.handle.rows.rows == []
    assert put(flush, 20000, 5) == [] and flush.handle.timers == {30000}


def test_several_batches_at_once_and_exact_fit(flush):
    assert [x[0] for x in put(flush, 0, *range(6))] == [0, 0, 0, 1, 1, 1]
    assert flush.handle.timers == set() and flush.handle.rows.rows == []
    assert [x[0] for x in put(flush, 0, *range(7))] == [2] * 3 + [3] * 3 and flush.handle.timers == {10000}


def test_a_late_timer_of_a_batch_that_is_out_does_nothing(flush):
    put(flush, 0, 1)
    put(flush, 5000, 2, 3, 4)
    assert fire(flush, 10000) == [] and flush.handle.rows.rows == [(4,)]


def test_stream_with_both_causes(spark, tmp):
    df = spark.range(230).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("box"))
    df.write.parquet(f"{tmp}/in")
    out = flush_batches(spark.readStream.schema(df.schema).parquet(f"{tmp}/in"), ["box"], size=50, seconds=2)
    q = out.writeStream.option("checkpointLocation", f"{tmp}/ck").format("parquet").option("path", f"{tmp}/out").trigger(processingTime="1 second").start()
    until = time.time() + 90
    while time.time() < until and q.exception() is None:
        if q.recentProgress and spark.read.schema(out.schema).parquet(f"{tmp}/out").count() >= 230:
            break
        time.sleep(1)
    q.stop()
    found = spark.read.schema(out.schema).parquet(f"{tmp}/out")
    assert sorted(r.id for r in found.collect()) == list(range(230))
    got = {(r.box, r.batch_no, r.flush_cause, r.declared, r.counted) for r in batch_sizes(found, ["box"]).collect()}
    assert got == {(b, *x) for b in (None, "a") for x in ((0, FULL, 50, 50), (1, FULL, 50, 50), (2, DUE, 15, 15))}


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "a int, batch_no int")
    with pytest.raises(ValueError):
        flush_batches(df, ["a"])
    with pytest.raises(ValueError):
        flush_batches(df.drop("batch_no"), [])
