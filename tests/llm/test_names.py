"""Operators that return the columns of their input keep them, whatever their names."""

from sparkmail.llm.decontaminate import drop_contaminated
from sparkmail.llm.near_dup import drop_near_duplicates
from sparkmail.llm.secret_scan import redact
from sparkmail.llm.url_filter import judge_urls

NAMES = "`_id` long, `_th` long, `_spans` string, `_merged` string, `a.b` int, won int, page int, host_key int"


def docs(spark, texts):
    rows = [(i, t, 10 + i, 20 + i, "s", "m", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {NAMES}")


def test_urls(spark):
    df = docs(spark, ["http://a.org/x", None])
    rules = spark.createDataFrame([("block", "org", "/x")], "verdict string, host string, path string")
    got = judge_urls(df, rules, url_col="text").orderBy("doc_id").collect()
    assert [(r["verdict"], r["won"], r["a.b"], r["page"], r["host_key"]) for r in got] == [("block", 2, 1, 3, 4), ("allow", 2, 1, 3, 4)]


def test_stages(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, [words, words, 'password = "hunter2hunter2"', None])
    items = spark.createDataFrame([("x", words)], "item_id string, text string")
    for kept, want in ((drop_near_duplicates(df), [0, 2, 3]), (drop_contaminated(df, items), [2, 3]), (redact(df), [0, 1, 2, 3])):
        rows = kept.orderBy("doc_id").collect()
        assert kept.columns == df.columns and [r.doc_id for r in rows] == want
        assert all((r["_id"], r["_th"], r["_spans"], r["_merged"], r["a.b"]) == (10 + r.doc_id, 20 + r.doc_id, "s", "m", 1) for r in rows)
    assert "hunter2" not in redact(df).where("doc_id = 2").first().text
