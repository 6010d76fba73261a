"""Search by the trigram index: the rows of the plain search, from few blocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkmail.operators import text_index as T
from sparkmail.operators.paging import search

SCHEMA = "message_id long, user_id long, received_at timestamp, subject string, body_preview string, sender string, spam_label string, mailbox_type string, topic string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    words = ["alpha", "Beta", "gamma_ray", "50%", "Größe", "ΟΔΟΣ", "😀😀x", "c:\\dir", "", "ab", "İzmir"]
    rows = [(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) if i % 50 else None, None if i % 13 == 0 else f"{words[i % 11]} no{i:04d}",
             None if i % 7 == 0 else f"text {i * i} {words[i * 5 % 11]}\nend", f"User{i % 97}@Example.org", "spam" if i % 2 else "ham", "faculty", "t")
            for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    root = str(tmp_path_factory.mktemp("index"))
    T.write_text_index(df, root, block_rows=10, part_rows=300)
    return df, root


def ids(df):
    return sorted(r.message_id for r in df.select("message_id").collect())


@pytest.mark.parametrize("wanted", [
    dict(text="no0421"), dict(text="NO04"), dict(text="größe NO"), dict(text="ΟΔΟΣ"), dict(text="οδοσ"), dict(text="😀😀x"), dict(text="😀x"),
    dict(text="gamma_ray"), dict(text="gamma_ray", escape=True), dict(text="a%ray", escape=True), dict(text="alp%04_1"), dict(text="50%", escape=True),
    dict(text="c:\\dir"), dict(text="İzm"), dict(text="izm"), dict(text="b"), dict(text="_"), dict(text="%"), dict(text="text 1764 "), dict(text="nowhere"),
    dict(sender="user42@"), dict(sender="USER42@", text="end"), dict(sender="@example", text="no0042", spam_label="ham"),
    dict(text="beta", user_id=1, start="2024-01-03", end="2024-01-09"), dict(text="x\nend"), dict(text="%end"), dict(text=""), dict(),
])
def test_rows_of_the_plain_search(spark, made, wanted):
    df, root = made
    assert ids(T.indexed_search(spark, root, **wanted)) == ids(search(df, **wanted))


def test_few_rows_are_read(spark, made):
    df, root = made
    for wanted in (dict(text="no0421"), dict(sender="user42@"), dict(sender="user42@", text="no0042")):
        assert 0 < T.candidate_rows(spark, root, **wanted).count() < 0.2 * df.count()
    assert T.candidate_rows(spark, root, text="no").count() == 1000  # too short for the index
    # The folders are chosen before files are read, the blocks by the statistics in the files.
    plan = T.candidate_rows(spark, root, text="no0421")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "block" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_many_blocks_are_joined(spark, made, monkeypatch):
    df, root = made
    monkeypatch.setattr(T, "LISTED_BLOCKS", 3)
    assert ids(T.indexed_search(spark, root, text="alpha")) == ids(search(df, text="alpha"))


def test_empty_table(spark, made, tmp):
    T.write_text_index(made[0].limit(0), tmp)
    assert T.indexed_search(spark, tmp, text="alpha").count() == 0 and T.indexed_search(spark, tmp, text="a").count() == 0


def test_every_piece_is_listed(spark):
    got = spark.createDataFrame([("AbcD",), ("ab",), ("",), (None,), ("aaaa",)], "t string").select(T.pieces(F.col("t"))).collect()
    assert [r[0] for r in got] == [["abc", "bcd"], [], [], None, ["aaa"]]
