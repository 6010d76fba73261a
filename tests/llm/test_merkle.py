"""Merkle manifest: proofs and roots against a plain tree, at several sizes of partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkmail.llm import merkle
from sparkmail.llm.merkle import build_manifest, merkle_manifest, prove
from tests_support import documents

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, at, digest):
    siblings = []
    for level in levels[:-1]:
        run, k = level[at // 3 * 3:at // 3 * 3 + 3], at % 3
        siblings += run[:k] + run[k + 1:]
        digest = sha(*run[:k], digest, *run[k + 1:])
        at //= 3
    return siblings, digest


def tampered(doc_id, text):
    return text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


def brute(rows):
    groups = {}
    for d, s, lang, n, t in rows:
        groups.setdefault(s, []).append((d, sha(*map(field, (d, s, lang, n, t))), sha(*map(field, (d, s, lang, n, tampered(d, t))))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order]) if order else None
    out = []
    for g, s in enumerate(order):
        for i, (d, leaf, claim) in enumerate(groups[s]):
            lower, digest = walk(trees[s], i, claim)
            upper, root = walk(top, g, digest)
            out.append((d, leaf, trees[s][-1][0], top[-1][0], sha(*lower, *upper), root, root == top[-1][0]))
    return sorted(out, key=str)


def claim():
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    return {"text": F.when(odd | F.col("doc_id").isNull(), F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("")))}


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("proof").collect()), key=str)


def sample(n, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice([None, i, i, i, 7]), rnd.choice([None, "a", "a", "é", "src" + str(i % 50)]), rnd.choice([None, "en"]), i,
             rnd.choice([None, "", "a\nb", "xyz\n\n", "q"])) for i in range(n)]


@pytest.mark.parametrize("n, part_leaves", [(1, 5), (40, 3), (600, 17), (600, 5000)])
def test_equals_a_plain_tree(spark, n, part_leaves):
    rows = sample(n)
    assert rows_of(merkle_manifest(spark.createDataFrame(rows, SCHEMA), claim=claim(), part_leaves=part_leaves)) == brute(rows)


def test_deep_trees_are_built_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, "hot" if i % 5 else f"s{i}", None, i, "t\n") for i in range(300)]
    assert rows_of(merkle_manifest(spark.createDataFrame(rows, SCHEMA), claim=claim(), part_leaves=40)) == brute(rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in documents(spark).select(*COLUMNS).collect()]
    assert rows_of(merkle_manifest(documents(spark), claim=claim())) == brute(rows)


def test_partitions_fetch_only_the_rim_of_what_they_derive(spark):
    df = spark.createDataFrame([(i, "one", None, i, "t") for i in range(2000)], SCHEMA)
    m = build_manifest(df, part_leaves=100)
    spans = m.leaves.groupBy("part", "tree").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).withColumn("n", F.lit(2000))
    parts = spans.count()
    assert parts > 5
    asked = merkle.missing(spans).groupBy("part", "level").count().agg(F.max("count")).first()[0]
    assert asked <= 4  # two on each side of a level


def test_proofs_fold_by_hand_and_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(i, None, None, None, "x", "c") for i in range(5)], SCHEMA + ", leaf string")
    for r in prove(build_manifest(df, part_leaves=2), proofs=True).collect():
        assert r.verified and sha(r.proof) == r.proof_sha256 and len(r.proof) % 64 == 0


def test_empty_table(spark):
    assert rows_of(merkle_manifest(spark.createDataFrame([], SCHEMA))) == []


def test_a_changed_value_of_any_column_is_noticed(spark):
    df = spark.createDataFrame([(i, "a", "en", i, "x") for i in range(6)], SCHEMA)
    for c, other in (("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1), ("text", F.lit(""))):
        found = merkle_manifest(df, claim={c: F.when(F.col("doc_id") == 3, other).otherwise(F.col(c))}).collect()
        assert {r.id for r in found if not r.verified} == {3}


def test_groups_are_placed_whatever_number_of_partitions_spark_makes(spark, monkeypatch):
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c, f=kind.repartitionByRange: f(self, max(n, 7), *c))
    rows = [(i, f"s{i % 5}", "en", i, "x\ny") for i in range(40)]
    assert rows_of(merkle_manifest(spark.createDataFrame(rows, SCHEMA), claim=claim())) == brute(rows)
