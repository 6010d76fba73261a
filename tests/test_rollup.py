"""The stored roll-up: deltas, late rows, corrections and repeats give what one pass over all messages gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkmail.operators import analytics as A
from sparkmail.operators.rollup import RollUp
from sparkmail.plans.q_analytics import _events, all_days
from tests.conftest import SF

SCHEMA = "message_id long, user_id long, received_at timestamp, spam_label string, urgency_score double, sentiment_score double, body string"


def messages(spark, n=300):
    """Users 1 (two thirds of the rows), 2, 3 and null; null times, labels, scores and bodies."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, (1, 1, 1, 1, 2, 3, None)[i % 7], None if i % 31 == 0 else start + dt.timedelta(minutes=97 * (i * 37 % n), microseconds=i),
             (None, "spam", "ham", "other")[i % 4], None if i % 5 == 0 else i % 11 / 10.0, None if i % 6 == 0 else i % 13 / 12.0 - 0.5,
             None if i % 17 == 0 else "é" * (i % 23)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture()
def made(spark, tmp):
    m = messages(spark)
    r = RollUp(spark, f"{tmp}/r", buckets=8, shards=3)
    for k in range(3):
        r.add(m.where(F.col("message_id") % 3 == k), str(k))
    return m, r


def test_three_deltas_equal_one_pass(made):
    m, r = made
    assert rows(r.dashboard("2024-01-05")) == rows(A.dashboard(m, "2024-01-05"))
    assert rows(r.trends("2024-01-10", 8)) == rows(A.trends(m, "2024-01-10", 8))
    assert rows(r.heatmap()) == rows(A.heatmap(m))


def test_one_user_and_a_range(made):
    m, r = made
    for user in (1, 3, 99):
        assert rows(r.dashboard("2024-01-05", user, "2024-01-02", "2024-01-06")) == \
            rows(A.dashboard(m, "2024-01-05", user, "2024-01-02", "2024-01-06"))
        assert rows(r.trends("2024-01-06", 3, user)) == rows(A.trends(m, "2024-01-06", 3, user))
        assert rows(r.heatmap(user)) == rows(A.heatmap(m, user))
    with pytest.raises(ValueError):
        r.cells(start="2024-01-02")


def test_a_repeated_delta_and_an_empty_one_add_nothing(made):
    m, r = made
    number = r.table.manifest()["number"]
    assert r.add(m.where("message_id % 3 = 1"), "1") == [] and r.add(m.limit(0), "none") == []
    assert r.table.manifest()["number"] == number
    assert rows(r.heatmap()) == rows(A.heatmap(m))


def test_a_correction_replaces_what_was_added(made):
    m, r = made
    after = m.withColumn("spam_label", F.when(F.col("message_id") % 4 == 1, F.lit("ham")).otherwise(F.col("spam_label"))) \
        .withColumn("urgency_score", F.when(F.col("message_id") % 9 == 0, F.lit(0.95)).otherwise(F.col("urgency_score")))
    changed = F.expr("message_id % 4 = 1 or message_id % 9 = 0")
    r.correct(m.where(changed), after.where(changed), "c")
    assert rows(r.dashboard("2024-01-05")) == rows(A.dashboard(after, "2024-01-05"))
    assert rows(r.trends("2024-01-10", 12)) == rows(A.trends(after, "2024-01-10", 12))


def test_late_rows_rewrite_the_buckets_of_their_day_only(spark, made):
    m, r = made
    old = r.table.manifest()["buckets"]
    late = spark.createDataFrame([(1000, 2, dt.datetime(2024, 1, 3, 23, 59), "spam", 0.5, 0.5, "x")], SCHEMA)
    assert len(r.add(late, "late")) == 1
    new = r.table.manifest()["buckets"]
    assert sum(old[b] != new[b] for b in old) == 1 and len(old) > 4
    assert rows(r.dashboard("2024-01-03")) == rows(A.dashboard(m.unionByName(late), "2024-01-03"))


def test_a_question_about_one_day_opens_its_buckets_only(made):
    m, r = made
    opened = {f.split("_bucket=")[1].split("/")[0] for f in r.cells("2024-01-04", "2024-01-04", 1).inputFiles()}
    assert len(opened) == 1
    assert len({f.split("_bucket=")[1].split("/")[0] for f in r.cells("2024-01-04", "2024-01-04").inputFiles()}) <= 3


def test_an_empty_table_and_stored_events(spark, tmp):
    r = RollUp(spark, f"{tmp}/e", buckets=4, shards=2)
    r.add(messages(spark).limit(0), "0")
    assert r.dashboard("2024-01-05").count() == 0 and r.heatmap().count() == 0 and r.trends("2024-01-05", 3).count() == 0
    m = _events(spark, SF)
    r = RollUp(spark, f"{tmp}/f", buckets=4, shards=2)
    r.add(m, "0")
    assert rows(r.dashboard(all_days(m)[0])) == rows(A.dashboard(m, all_days(m)[0]))
