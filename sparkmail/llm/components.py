"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import BROADCAST_ROWS
from sparkmail.session import stage_table


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over ``links`` (a, b), for each id with a link.

    Each round hangs every vertex's larger neighbours, then its smaller ones,
    on the smallest vertex around (large star, small star) until nothing
    changes: O(log n) rounds of two aggregations and joins, with map-side
    minima, so a vertex with very many links needs no task of its own. Each
    round is written to the shared folder, which cuts the lineage. The minima
    are broadcast while they are counted to be few.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stage_table(edges, "components")
    before, now = None, _signature(edges)
    few = now[0] <= BROADCAST_ROWS // 2  # there are at most twice as many minima
    hint = F.broadcast if few else (lambda df: df)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(least), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stage_table(small, "components")
        before, now = now, _signature(edges)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label")) \
        .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
