"""Exact top-k search by inner product, term at a time.

Vectors are sparse rows of (term, weight). The corpus is dealt into blocks
by a hash of the id, the queries too; every pair of a query block and a
corpus block is one task. There the corpus block becomes postings (per term
the rows and weights), each query term scatters its weighted postings into
the dense score array of its query, and the block's k best are selected by
partitioning. A window per query merges the blocks' bests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.session import ensure_shipped, stage_table

#: Queries whose score arrays are held at once.
TILE = 64
#: A term's products are added place by place if fewer than one in DENSE of a tile's scores have any.
DENSE = 8


def postings(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (row numbers, weights) of the non-zero components."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    if not sizes.sum():
        return {}
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows])
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(flat)
    some = some[np.argsort(term[some], kind="stable")]
    terms, first = np.unique(term[some], return_index=True)
    return {int(t): (row[at], flat[at]) for t, at in zip(terms, np.split(some, first[1:]))}


def score_type(q: dict, c: dict) -> type:
    """The smallest type in which every score is exact (whole numbers)."""
    def peak(p):
        return {t: float(np.abs(w).max()) for t, (_, w) in p.items()}
    pq, pc = peak(q), peak(c)
    bound = sum(v * pc.get(t, 0.0) for t, v in pq.items())
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores (ids ascend, so earlier wins a tie), rows with the id ``own`` left out."""
    at, end = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if end > at:
        scores = np.delete(scores, slice(at, end))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)[:k - len(sure)]
        found = np.concatenate([sure, ties])
    else:
        found = np.arange(len(scores))
    return found + (found >= at) * (end - at)


def search_block(queries: pd.DataFrame, corpus: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, query, vec_id, score): each query row's k best of one corpus block; ``query`` tells apart rows that repeat an id."""
    names = ("query_id", "query", "vec_id", "score")
    if queries.empty or corpus.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    corpus = corpus.sort_values("id")
    ids, lists = corpus["id"].to_numpy(), postings(corpus["weights"].tolist())
    out: list[list[np.ndarray]] = [[] for _ in names]
    for at in range(0, len(queries), TILE):
        tile = queries.iloc[at:at + TILE]
        asked = postings(tile["weights"].tolist())
        kind = score_type(asked, lists)
        scores = np.zeros((len(tile), len(ids)), dtype=kind)
        part = np.empty_like(scores)
        for term, (row, weight) in asked.items():
            if term not in lists:
                continue
            doc, value = lists[term]
            weight, value = weight.astype(kind), value.astype(kind)
            if DENSE * len(row) * len(doc) < len(tile) * len(ids):
                scores[np.ix_(row, doc)] += np.multiply.outer(weight, value)
                continue
            # A term that most rows have: its postings as arrays over all rows, zero where it is missing.
            one, all_ = np.zeros(len(tile), dtype=kind), np.zeros(len(ids), dtype=kind)
            one[row], all_[doc] = weight, value
            np.multiply.outer(one, all_, out=part)
            scores += part
        for own, number, line in zip(tile["id"].tolist(), tile["row"].tolist(), scores):
            found = best_of(line, ids, own, k)
            for column, values in zip(out, (np.full(len(found), own), np.full(len(found), number), ids[found], line[found].astype(np.int64))):
                column.append(values)
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, out)})


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products with the corpus.

    Both inputs have ``id`` (long) and ``weights`` (array of long, term = place
    in the array; arrays may differ in length, a missing term counts 0). Corpus
    rows with the query's own id are left out; ties go to the smaller id.
    Rows with a null id or null weights take no part. Corpus rows that repeat an
    id are candidates each; a query id that is repeated gets the k best of all
    its rows together. Queries with no candidate have no row; other columns
    are not read. ``block`` and ``query_block`` bound a task's memory, not the
    search: every query meets every block.
    """
    spark = corpus.sparkSession
    ensure_shipped(spark)

    def rows(df, name):
        return stage_table(df.where("id is not null and weights is not null").select("id", "weights")
                           .withColumn("row", F.monotonically_increasing_id()), name)

    corpus, queries = rows(corpus, "topk-corpus"), rows(queries, "topk-queries")
    blocks = max(1, math.ceil(corpus.count() / block))
    query_blocks = max(1, math.ceil(queries.count() / query_block))

    def dealt(df, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64("row", F.lit(own)), F.lit(n_own)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    q = dealt(queries, "qb", query_blocks, "cb", blocks).groupBy("qb", "cb")
    c = dealt(corpus, "cb", blocks, "qb", query_blocks).groupBy("qb", "cb")
    parts = q.cogroup(c).applyInPandas(lambda a, b: search_block(a, b, k), "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, weights): floor(scale * x) of each component; vectors that are null or
    hold a null, NaN or infinite component are left out."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("weights"))
