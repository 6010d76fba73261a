"""Top-k search against all products."""

import random

import numpy as np
import pandas as pd
import pytest

from sparkmail.llm.topk import scaled, search_block, top_k


def brute(queries, corpus, k):
    out = []
    for q, x in queries.items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in corpus.items() if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, queries, corpus, **options):
    def table(rows):
        return spark.createDataFrame(list(rows.items()), "id long, weights array<long>")
    return sorted(tuple(r) for r in top_k(table(queries), table(corpus), **options).collect())


def test_blocks_ties_and_sparse_rows(spark):
    rng = random.Random(2)
    corpus = {i: [rng.choice([0, 0, 1, -2, 3]) for _ in range(rng.randrange(0, 9))] for i in range(300)}
    queries = {i: corpus[i] for i in range(0, 300, 7)} | {1000: [1, 1], 1001: []}
    want = brute(queries, corpus, 5)
    assert run(spark, queries, corpus, k=5) == want
    assert run(spark, queries, corpus, k=5, block=40, query_block=10) == want
    assert run(spark, queries, {0: [1]}, k=5) == brute(queries, {0: [1]}, 5)
    assert run(spark, {}, corpus) == run(spark, queries, {}) == []


@pytest.mark.parametrize("size", [1, 5000, 2**28])
def test_exact_for_large_weights(size):
    rng = np.random.default_rng(0)
    rows = {i: [int(v) for v in rng.integers(-size, size + 1, 16)] for i in range(100)}
    block = pd.DataFrame({"id": list(rows), "weights": list(rows.values()), "row": list(rows)})
    got = search_block(block, block, 3)
    want = {(q, i, s) for q, _, i, s in brute(rows, rows, 3)}
    assert set(got[["query_id", "vec_id", "score"]].itertuples(index=False, name=None)) == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, None), (2, [1.0, None]), (3, [nan]), (4, [inf, 0.0]), (5, [-inf]), (None, [1.0]), (6, []), (7, [0.25, 1.0]), (7, [0.25, 1.0])]
    vectors = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 64)
    assert {(r.id, tuple(r.weights)) for r in vectors.collect()} == {(0, (32, -1)), (None, (64,)), (6, ()), (7, (16, 64))}
    got = [tuple(r) for r in top_k(vectors.where("id % 20 = 0"), vectors).collect()]
    assert sorted(got) == [(0, 1, 7, 448), (0, 2, 7, 448), (0, 3, 6, 0)]


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    rows = [(1, [5]), (1, [9]), (2, [1]), (20, [2]), (20, [3])]
    df = spark.createDataFrame(rows, "id long, weights array<long>")
    got = sorted(tuple(r) for r in top_k(df.where("id = 20"), df, k=3).collect())
    assert got == [(20, 1, 1, 27), (20, 2, 1, 18), (20, 3, 1, 15)]
    got = sorted(tuple(r) for r in top_k(df.where("id = 2"), df, k=9).collect())
    assert got == [(2, 1, 1, 9), (2, 2, 1, 5), (2, 3, 20, 3), (2, 4, 20, 2)]


@pytest.mark.parametrize("share", [0.02, 0.5, 0.9, 1.0])
def test_scattered_and_whole_terms_score_alike(share):
    rng = np.random.default_rng(1)
    rows = {i: [int(v) if rng.random() < share else 0 for v in rng.integers(-9, 10, 24)] for i in range(200)}
    block = pd.DataFrame({"id": list(rows), "weights": list(rows.values()), "row": list(rows)})
    got = search_block(block, block, 7)
    assert set(got[["query_id", "vec_id", "score"]].itertuples(index=False, name=None)) == {(q, i, s) for q, _, i, s in brute(rows, rows, 7)}
