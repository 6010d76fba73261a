"""Positions in an order by range partitions and offsets."""

import random

from pyspark.sql import functions as F

from sparkmail.operators.paging import indexed_page, page, write_page_index
from sparkmail.operators.ranks import rank_statistics, unused, with_position
from sparkmail.operators.star import build_star, dense_keys, star_join


def test_positions_in_groups_equal_row_number(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "a", "a", "a", "b", "é"]), i) for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.v): r.position for r in with_position(df, [F.desc("v")], ["g"], part_rows=40).collect()}
    for g in (None, "a", "b", "é"):
        own = sorted((v for k, v in rows if k == g), reverse=True)
        assert [got[g, v] for v in own] == list(range(len(own)))


def test_positions_of_a_whole_table(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)  # three keys, each too large for a partition
    rows = with_position(df, [F.col("k"), F.col("id")], position="p", part="part", part_rows=50).orderBy("p").collect()
    assert [r.p for r in rows] == list(range(1000)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)
    assert len({r.part for r in rows}) > 10 and [r.part for r in rows] == sorted(r.part for r in rows)


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, "x", 7)], "_mid long, position long, `a.b` string, _row long")
    row = with_position(df, [F.col("_mid")]).first()
    assert (row["_mid"], row["position"], row["a.b"], row["_row"]) == (1, 0, "x", 7)
    assert with_position(df.limit(0), [F.col("_mid")], ["a.b"]).count() == 0
    assert unused(["A", "_a"], "a", "b") == ["__a", "b"]


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_exact_auc_with_ties_over_many_partitions(spark):
    rnd = random.Random(8)
    rows = [(float(rnd.randrange(60)), int(rnd.random() < 0.3)) for _ in range(900)]
    df = spark.createDataFrame(rows, "score double, label int")
    for part_rows in (7, 1000):
        r = rank_statistics(df, part_rows=part_rows).first()
        assert abs(r.auc - brute_auc(rows)) < 1e-12 and r.positives + r.negatives == 900
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    ks = max(abs(sum(s <= t for s in pos) / len(pos) - sum(s <= t for s in neg) / len(neg)) for t in range(60))
    assert abs(r.ks - ks) < 1e-12


def test_auc_of_one_class_nulls_and_empty(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 0), (0.7, None)], "score double, label int")
    assert tuple(rank_statistics(df).first()) == (1, 0, None, None)
    assert tuple(rank_statistics(df.limit(0)).first()) == (0, 0, None, None)


def test_dense_keys_stay_on_reload(spark):
    def load(names, existing=None):
        df = spark.createDataFrame([(n,) for n in names], "sender string").distinct()
        return dense_keys(df, "sender", "k", existing)
    one = load(["c", "a", "b"])
    two = load(["c", "aa", "z", "a"], one)
    assert {r.sender: r.k for r in one.collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.sender: r.k for r in two.collect()} == {"a": 1, "b": 2, "c": 3, "aa": 4, "z": 5}
    assert {r.sender: r.k for r in load([], two).collect()} == {r.sender: r.k for r in two.collect()}


def test_star_with_a_hot_sender_and_nulls(spark):
    df = spark.range(3000).select(
        F.col("id").alias("message_id"), F.timestamp_seconds(F.col("id") * 3600).alias("received_at"),
        F.when(F.col("id") % 3 == 0, F.lit("hot@x")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), "id", F.lit("@y"))).alias("sender"),
        F.lit("t").alias("topic"), F.lit("ham").alias("spam_label"), F.lit(0.1).alias("urgency_score"))
    fact, dd, ds, dt = build_star(df)
    got = {r.message_id: r for r in star_join(fact, dd, ds, dt).collect()}
    want = {r.message_id: r.sender or "" for r in df.collect()}
    assert len(got) == 3000 and all(got[i].sender == s and got[i].topic == "t" for i, s in want.items())
    assert [r.sender_key for r in ds.orderBy("sender").collect()] == list(range(1, ds.count() + 1))


def wanted_parts(spark, root, k, size):
    parts = spark.read.parquet(f"{root}/parts")
    assert parts.count() >= 8
    return parts.where((F.col("last") >= (k - 1) * size) & (F.col("first") < k * size)).collect() or [None]


def test_page_from_index_equals_sorting_and_opens_few_files(spark, tmp):
    df = spark.range(1000).select(F.col("id").alias("message_id"), F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.col("id") % 97)).alias("received_at"))
    write_page_index(df, tmp, part_rows=100)
    for k, size in ((1, 50), (7, 33), (20, 50), (21, 50), (2, 400)):
        got = indexed_page(spark, tmp, k, size)
        assert [r.message_id for r in got.collect()] == [r.message_id for r in page(df, k, size).collect()]
        if size <= 50 and k <= 20:  # there is such a page
            plan = indexed_page(spark, tmp, k, size)._jdf.queryExecution().executedPlan().toString()
            assert "part#" in plan[plan.index("PartitionFilters:"):].split("]")[0]
            assert 1 <= len(wanted_parts(spark, tmp, k, size)) <= 2


def test_positions_hold_when_spark_makes_more_partitions_than_asked(spark, monkeypatch):
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c, f=kind.repartitionByRange: f(self, max(n, 7), *c))
    rows = with_position(spark.range(40).withColumnRenamed("id", "v"), [F.desc("v")], position="p").collect()
    assert sorted((r.p, r.v) for r in rows) == [(i, 39 - i) for i in range(40)]
