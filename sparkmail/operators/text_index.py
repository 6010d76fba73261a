"""Substring search by an index of trigrams.

The messages are put into an order (newest first) and cut into blocks of consecutive rows. For each searched field the index
lists, per piece of three lower-cased characters, the blocks in which it occurs. A search intersects the lists of the
pieces that the wanted text must hold, reads the blocks that are left and applies ``paging.search`` to their rows. So the
result is that of ``search`` on the whole table; only the rows read are fewer. A text without three known characters in a row
restricts nothing, and all blocks are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.operators.paging import search
from sparkmail.operators.ranks import PART_ROWS, unused, with_position
from sparkmail.session import stage_table

#: Fields of ``search``: sender is looked for in one, text in either of the others.
FIELDS = ("subject", "body_preview", "sender")
BLOCK_ROWS = 1024
#: Blocks that a search names in its filter at most (two numbers each); of more blocks the list is joined.
LISTED_BLOCKS = 10_000


def pieces(text: Column) -> Column:
    """The different three-character pieces of the lower-cased text; linear in its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def write_text_index(df: DataFrame, root: str, ts_col: str = "received_at", id_col: str = "message_id",
                     block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> None:
    """Writes the table ``root``/rows in blocks and the lists ``root``/postings (field, piece, part, block).

    One sort of the rows, one of the lists. A piece that most blocks hold has many list rows; these are sorted by all
    columns, so they lie in several range partitions. Null fields have no pieces. ``df`` must not have columns ``part`` and ``block``."""
    spark = df.sparkSession
    order = [F.col(ts_col).desc_nulls_last(), F.col(id_col).desc_nulls_last()]
    position = unused([*df.columns, "part", "block"], "_position")[0]
    placed = with_position(stage_table(df, "index-rows"), order, position=position, part="part", part_rows=part_rows) \
        .withColumn("block", F.floor(F.col(position) / block_rows).cast("long"))
    # A partition is a folder with sorted rows: the blocks of a folder show in the statistics of its row groups and pages.
    dealt = placed.repartition("part").sortWithinPartitions("part", position).drop(position).write.mode("overwrite")
    # Without rows there would be no folder to tell the columns.
    (dealt if placed.isEmpty() else dealt.partitionBy("part")).parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")

    def named(field: str) -> Column:
        own = F.coalesce(pieces(F.col(field)), F.array().cast("array<string>"))
        return F.transform(own, lambda p: F.struct(F.lit(field).alias("field"), p.alias("piece")))

    found = F.flatten(F.array(*[named(f) for f in FIELDS]))
    postings = rows.select(F.col("part").cast("int").alias("part"), "block", F.explode(found).alias("p")) \
        .select("p.field", "p.piece", "part", "block").distinct()
    keys = ["field", "piece", "block", "part"]
    postings.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{root}/postings")


def wanted_pieces(spark: SparkSession, text: str, escape: bool = False) -> list[str]:
    """The pieces that any text matched by ``%text%`` holds; ``%`` and ``_`` are wildcards unless ``escape``."""
    # Lower-cased by the function that the comparison uses.
    pattern = spark.range(1).select(F.lower(F.lit(f"%{text}%"))).first()[0]
    runs = [pattern[1:-1]] if escape else re.split("[%_]", pattern)
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


def candidate_blocks(spark: SparkSession, root: str, sender: str | None = None, text: str | None = None, escape: bool = False) -> DataFrame | None:
    """(part, block) of the blocks that may hold a match; None if the texts restrict nothing."""
    postings = spark.read.parquet(f"{root}/postings")

    def holding(field: str, wanted: list[str]) -> DataFrame:
        own = postings.where((F.col("field") == field) & F.col("piece").isin(wanted))
        return own.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("part", "block")

    out = None
    if text and (wanted := wanted_pieces(spark, text, escape)):
        out = holding("subject", wanted).unionByName(holding("body_preview", wanted)).distinct()
    if sender and (wanted := wanted_pieces(spark, sender, escape)):
        own = holding("sender", wanted)
        out = own if out is None else out.join(own, ["part", "block"])
    return out


def candidate_rows(spark: SparkSession, root: str, sender: str | None = None, text: str | None = None, escape: bool = False) -> DataFrame:
    """The rows of the candidate blocks, all columns."""
    rows = spark.read.parquet(f"{root}/rows")
    rows = rows.withColumn("part", F.col("part").cast("int"))
    blocks = candidate_blocks(spark, root, sender, text, escape)
    if blocks is None:
        return rows.drop("part", "block")
    blocks = stage_table(blocks, "index-blocks")
    listed = blocks.limit(LISTED_BLOCKS + 1).collect()
    if len(listed) > LISTED_BLOCKS:
        return rows.join(blocks, ["part", "block"], "left_semi").drop("part", "block")
    parts, numbers = sorted({r.part for r in listed}), sorted({r.block for r in listed})
    # A block that lies in two partitions is read in both: the rows are checked anyway.
    return rows.where(F.col("part").isin(parts) & F.col("block").isin(numbers)).drop("part", "block")


def indexed_search(spark: SparkSession, root: str, sender: str | None = None, text: str | None = None, escape: bool = False, **filters) -> DataFrame:
    """The rows of ``search(df, sender=, text=, escape=, **filters)`` from the index of ``df``."""
    return search(candidate_rows(spark, root, sender, text, escape), sender=sender, text=text, escape=escape, **filters)
