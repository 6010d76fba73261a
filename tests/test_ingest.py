"""Ingest path: raw JSON -> cleaned, partitioned rows."""

import json
import os

from pyspark.sql import functions as F

from sparkmail import schemas as S
from sparkmail.operators.ingest import clean_raw
from sparkmail.sources import lake as L


def test_raw_schema_has_nine_fields():
    assert [f.name for f in S.RAW_MESSAGE.fields] == [
        "message_id", "subject", "sender", "body_preview", "body", "received_at", "raw_headers",
        "attachment_count", "cc_count"]


def test_one_raw_row(spark):
    row = ("id1", "Subj", "a@b.com", "p", "b", "2026-01-15 10:00:00", "", 0, 0)
    df = spark.createDataFrame([row], S.RAW_MESSAGE)
    assert df.count() == 1 and len(df.columns) == 9


def test_partition_literals_and_defaults(spark):
    df = spark.createDataFrame([("id2", "Subj")], "message_id string, subject string")
    out = clean_raw(df, date="2026-01-16", mailbox_type="faculty").first()
    assert out["ingestion_date"] == "2026-01-16" and out["mailbox_type"] == "faculty"
    assert out["body"] == "" and out["sender"] == "" and out["cc_count"] == 0 and out["attachment_count"] == 0


def test_default_mailbox_is_faculty(spark):
    df = spark.createDataFrame([("id3",)], "message_id string")
    assert clean_raw(df, date="2026-01-16").first()["mailbox_type"] == "faculty"


def test_empty_raw(spark):
    df = spark.createDataFrame([], "message_id string")
    assert clean_raw(df, "2026-01-16").count() == 0


def test_null_defaults(spark):
    df = spark.createDataFrame([(None,) * 9], S.RAW_MESSAGE)
    r = clean_raw(df, "2026-01-16").first()
    assert (r["subject"], r["sender"], r["body_preview"], r["body"], r["raw_headers"]) == ("",) * 5
    assert (r["attachment_count"], r["cc_count"]) == (0, 0)


def test_timestamps_z_and_unparsable(spark):
    df = spark.createDataFrame([("a", "2026-01-15T10:00:00Z"), ("b", "not a date"), ("c", "2026-01-15 10:00:00")],
                               "message_id string, received_at string")
    got = {r["message_id"]: r["t"] for r in clean_raw(df, "2026-01-15")
           .select("message_id", F.date_format("received_at", "HH:mm").alias("t")).collect()}
    assert got == {"a": "10:00", "b": None, "c": "10:00"}


def test_kafka_id_maps_to_message_id(spark):
    df = spark.createDataFrame([("k1", "s")], "id string, subject string")
    assert clean_raw(df, "2026-01-15").first()["message_id"] == "k1"


def test_read_raw_array_and_object_files(spark, tmp):
    d = os.path.join(tmp, "raw", "ingestion_date=2026-01-15", "mailbox_type=faculty")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps([{"message_id": "1", "subject": "x"}, {"message_id": "2", "subject": "y"}]) + "\n")
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write(json.dumps({"message_id": "3", "subject": "z"}) + "\n")
    df = L.read_raw(spark, os.path.join(tmp, "raw"), "2026-01-15")
    assert sorted(r["message_id"] for r in df.collect()) == ["1", "2", "3"]
    assert {r["mailbox_type"] for r in df.collect()} == {"faculty"}


def test_missing_path_is_typed_empty(spark, tmp):
    df = L.read_raw(spark, os.path.join(tmp, "nothing-here"), "2026-01-15")
    assert df.count() == 0 and "message_id" in df.columns


def test_read_or_empty_reraises_other_errors(spark, tmp):
    p = os.path.join(tmp, "bad.parquet")
    with open(p, "w") as f:
        f.write("not parquet")
    import pytest
    with pytest.raises(Exception):
        L.read_or_empty(spark, p, S.DAILY).collect()


def test_write_raw_batch_rejects_empty(spark, tmp):
    import pytest
    with pytest.raises(ValueError):
        L.write_raw_batch(spark.createDataFrame([], S.RAW_MESSAGE), tmp, "2026-01-15", "faculty")


def test_second_date_keeps_first_partition(spark, tmp):
    path = os.path.join(tmp, "classified")
    a = spark.createDataFrame([("m1", "2026-01-15", "ham")], "message_id string, classification_date string, label string")
    b = spark.createDataFrame([("m2", "2026-01-16", "spam")], "message_id string, classification_date string, label string")
    L.write_partitions(a, path, ["classification_date", "label"])
    L.write_partitions(b, path, ["classification_date", "label"])
    got = sorted((r["message_id"], r["classification_date"]) for r in spark.read.parquet(path).collect())
    assert got == [("m1", "2026-01-15"), ("m2", "2026-01-16")]
    # rewriting one date replaces only that date
    a2 = spark.createDataFrame([("m9", "2026-01-15", "ham")], "message_id string, classification_date string, label string")
    L.write_partitions(a2, path, ["classification_date", "label"])
    got = sorted(r["message_id"] for r in spark.read.parquet(path).collect())
    assert got == ["m2", "m9"]


def test_list_partitions_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "d string")
    assert [r["d"] for r in L.list_partitions(df, ["d"]).collect()] == ["a", "b"]
    u = L.union_partitions(df, spark.createDataFrame([("c",), ("a",)], "d string"))
    assert [r["d"] for r in u.collect()] == ["a", "b", "c"]


def test_partition_pruning_in_plan(spark, tmp):
    df = spark.createDataFrame([("1", "2026-01-15", "faculty"), ("2", "2026-01-16", "faculty")],
                               "message_id string, ingestion_date string, mailbox_type string")
    L.write_raw_table(df, os.path.join(tmp, "raw"))
    files = L.read_raw(spark, os.path.join(tmp, "raw"), "2026-01-15").inputFiles()
    assert files and all("ingestion_date=2026-01-15" in f for f in files)


def test_raw_layouts_and_malformed_lines(spark, tmp):
    """Plain date folders, one folder of a date, pretty documents, arrays and cut lines."""
    root = os.path.join(tmp, "raw")
    for folder, name, text in (("2026-01-15/mailbox_type=personal", "a.json", '[{"message_id": "1"}, {"message_id": "2"}]'),
                               ("2026-01-15/mailbox_type=faculty", "b.json", '{"message_id": "3"}\n{"message_id": "4", "su'),
                               ("ingestion_date=2026-01-16/mailbox_type=faculty", "c.json", '{"message_id": "5"}')):
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        with open(os.path.join(root, folder, name), "w") as f:
            f.write(text)
    def rows(df):
        return sorted((r.message_id, r.ingestion_date, r.mailbox_type) for r in df.collect())
    first = [("1", "2026-01-15", "personal"), ("2", "2026-01-15", "personal"), ("3", "2026-01-15", "faculty")]
    assert rows(L.read_raw(spark, root)) == [*first, ("5", "2026-01-16", "faculty")]
    assert rows(L.read_raw(spark, root, "2026-01-15")) == first
    assert rows(L.read_raw(spark, f"{root}/2026-01-15", "2026-01-15")) == first
    assert L.read_raw(spark, root, "2026-01-17").count() == 0 and L.read_raw(spark, root + "/none").count() == 0
    good, bad = L.split_corrupt(L.read_raw(spark, root, corrupt=True))
    assert good.count() == 4
    assert [tuple(r) for r in bad.collect()] == [('{"message_id": "4", "su', "malformed json", "2026-01-15")]


def test_day_document(spark, tmp):
    for name, text in (("2026-01-15", '{"metric_date": "2026-01-15",\n "daily_volume": 3}'), ("2026-01-16", '[{"metric_date": "2026-01-16"}]')):
        with open(os.path.join(tmp, name + ".json"), "w") as f:
            f.write(text)
    assert [r.daily_volume for r in L.read_day_document(spark, tmp, "2026-01-15").collect()] == [3]
    assert [r.metric_date for r in L.read_day_document(spark, tmp, "2026-01-16").collect()] == ["2026-01-16"]
    assert L.read_day_document(spark, tmp, "2026-01-17").count() == 0


def test_read_features_falls_back(spark, tmp):
    spark.range(3).write.parquet(tmp + "/classified")
    assert L.read_features(spark, tmp + "/features", tmp + "/classified").count() == 3
    spark.range(2).write.orc(tmp + "/features")
    assert L.read_features(spark, tmp + "/features", tmp + "/classified").count() == 2


def test_read_partition(spark, tmp):
    df = spark.createDataFrame([("1", "2026-01-15", "faculty"), ("2", "2026-01-15", "personal"),
                                ("3", "2026-01-16", "faculty")],
                               "message_id string, ingestion_date string, mailbox_type string")
    L.write_partitions(df, tmp + "/emails_raw", ["ingestion_date", "mailbox_type"])
    assert L.read_partition(spark, tmp + "/emails_raw", "2026-01-15").count() == 2
    assert L.read_partition(spark, tmp + "/emails_raw", "2026-01-15", "faculty").count() == 1
    assert L.read_partition(spark, tmp + "/missing", "2026-01-15").count() == 0


def test_write_partitions_sorted_within_files(spark, tmp):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(2000).select((F.col("id") * 7919 % 1000).alias("user_id"),
                                  F.lit("2026-01-15").alias("ingestion_date"), F.lit("faculty").alias("mailbox_type"))
    L.write_partitions(df.repartition(4), tmp + "/s", ["ingestion_date", "mailbox_type"], sort_by="user_id")
    for f in glob.glob(tmp + "/s/*/*/*.parquet"):
        ids = pq.read_table(f).column("user_id").to_pylist()
        assert ids == sorted(ids)


def test_read_raw_pretty_printed_array(spark, tmp):
    d = os.path.join(tmp, "raw", "ingestion_date=2026-01-15", "mailbox_type=personal")
    os.makedirs(d)
    with open(os.path.join(d, "batch.json"), "w") as f:
        json.dump([{"message_id": "1", "subject": "x", "cc_count": 2}, {"message_id": "2"}], f, indent=2)
    df = clean_raw(L.read_raw(spark, os.path.join(tmp, "raw"), "2026-01-15", multi_line=True))
    got = sorted((r["message_id"], r["cc_count"], r["mailbox_type"]) for r in df.collect())
    assert got == [("1", 2, "personal"), ("2", 0, "personal")]
