"""Bucketed tables: only touched buckets are rewritten or opened, changes appear whole, retries add nothing."""

import glob

import pytest
from pyspark.sql import functions as F

from sparkmail.operators.merge import apply_feedback
from sparkmail.sources.buckets import BucketTable


def files(root):
    return set(glob.glob(f"{root}/**/*.parquet", recursive=True))


def listed(table):
    return {f"{table.root}/{f}" for folders in table.manifest()["buckets"].values() for f in folders}


@pytest.fixture()
def table(spark, tmp):
    t = BucketTable(spark, f"{tmp}/t", ["email_id"], buckets=8)
    t.create(spark.range(200).select(F.col("id").cast("string").alias("email_id"), F.lit("x").alias("text"),
                                     F.lit(None).cast("string").alias("feedback"), F.lit(None).cast("timestamp").alias("feedback_at")))
    return t


def corrections(spark, ids):
    return spark.createDataFrame([(str(i), "ham") for i in ids], "email_id string, corrected_label string") \
        .withColumn("feedback_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_merge_rewrites_touched_buckets_only(spark, table):
    before, old = listed(table), files(table.root)
    touched = table.merge(corrections(spark, [3, 999]), lambda rows, c: apply_feedback(rows, c)[0])
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if int(f.rsplit("=", 1)[1]) not in touched}
    assert kept == before & listed(table) and len(kept) == 8 - len(touched)
    assert old <= files(table.root)  # the files keep their names and stay until they are vacuumed
    got = {r.email_id: r.feedback for r in table.read().collect()}
    assert len(got) == 200 and {k for k, v in got.items() if v} == {"3"}
    # The state before can still be read.
    assert table.read(number=1).where("feedback is not null").count() == 0
    assert table.vacuum(keep=1) == len(touched) and table.read().count() == 200


def test_reading_some_buckets_opens_their_files_only(spark, table):
    some = table.touched(corrections(spark, [3, 4]))
    opened = {f.rsplit("/", 1)[0].split("=")[-1] for f in table.read(some).inputFiles()}
    assert opened == {str(b) for b in some} and len(opened) < table.buckets
    assert {r.email_id for r in table.read(some).collect()} >= {"3", "4"}


def test_a_failing_merge_leaves_the_table(spark, table):
    with pytest.raises(ValueError):  # rows of other buckets
        table.merge(corrections(spark, [3]), lambda rows, c: table.read())
    with pytest.raises(Exception):
        table.merge(corrections(spark, [3]), lambda rows, c: rows.select(F.raise_error(F.lit("no")).alias("email_id"), "text", "feedback", "feedback_at"))
    assert table.manifest()["number"] == 1 and table.read().count() == 200
    assert table.merge(corrections(spark, []), lambda rows, c: rows) == []


def test_two_writers_do_not_overwrite_each_other(spark, table):
    def slow(rows, changes):
        table.merge(corrections(spark, [5]), lambda r, c: apply_feedback(r, c)[0])  # another writer is faster
        return apply_feedback(rows, changes)[0]
    with pytest.raises(RuntimeError):
        table.merge(corrections(spark, [3]), slow)
    assert {r.email_id for r in table.read().where("feedback is not null").collect()} == {"5"}


def test_appends_once_per_tag_and_compacts(spark, tmp):
    store = BucketTable(spark, f"{tmp}/ids", ["id"], buckets=4)
    store.create(spark.createDataFrame([], "id long, batch int"))
    assert store.read().count() == 0
    seen = set()
    for k in range(7):
        ids = set(range(k * 20, k * 20 + 50))
        rows = spark.createDataFrame([(i, k) for i in ids], "id long, batch int")
        for _ in range(2):  # a micro-batch that is run again gives the same rows and adds none
            fresh = {r.id for r in store.append_unseen(rows, str(k), most_folders=3).collect()}
            assert fresh == ids - seen
        seen |= ids
        assert {r.id for r in store.read().collect()} == seen and store.read().count() == len(seen)
    assert max(len(f) for f in store.manifest()["buckets"].values()) <= 3


def test_an_append_opens_fewer_files_than_there_are(spark, tmp):
    store = BucketTable(spark, f"{tmp}/ids", ["id"], buckets=16)
    store.create(spark.range(1000).select("id"))
    few = spark.range(998, 1001).select("id")
    touched = store.touched(few)
    assert len(store.read(touched).inputFiles()) <= 3 < len(store.read().inputFiles())
    assert [r.id for r in store.append_unseen(few, "a").collect()] == [1000]


def test_null_keys_other_names_and_missing_tables(spark, tmp):
    t = BucketTable(spark, f"{tmp}/t", ["a.b"], buckets=3)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(spark.createDataFrame([(None, 1), ("x", 2)], "`a.b` string, _bucket int"))
    assert {tuple(r) for r in t.read().collect()} == {(None, 1), ("x", 2)}
    with pytest.raises(FileExistsError):
        t.create(t.read())
