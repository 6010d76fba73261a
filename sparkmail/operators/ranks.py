"""Positions in an order, for tables of any size.

``row_number()`` over a whole table, or over a group with a third of the rows, sorts
that group in one task. Here the rows are range-partitioned and sorted once, each
task numbers its own rows, and the numbers of rows in the partitions before (one row
per partition and group) are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.session import stage_table

#: Rows of a range partition, on average.
PART_ROWS = 1 << 17
#: Rows of (partition, group, offset) that are broadcast at most: three numbers and a group key each.
BROADCAST_OFFSETS = 100_000


def unused(columns: list[str], *stems: str) -> list[str]:
    """A column name for each stem that no column has, letter case aside."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def range_sorted(df: DataFrame, order: list[Column], parts: int, part_col: str, row_col: str, name: str = "ranges") -> DataFrame:
    """``df`` as a written table in range partitions by ``order``: ``part_col`` is the partition's number, in
    order, and ``row_col`` the row's place in it, from 0. Rows that are equal in ``order`` share a partition."""
    mid = unused(df.columns, "_mid")[0]
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    # The number of a row is (partition << 33) + place; written, so that both stay as they are.
    return stage_table(rows.withColumn(part_col, F.shiftright(mid, 33).cast("int"))
                       .withColumn(row_col, F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).drop(mid), name)


def with_position(df: DataFrame, order: list[Column], by: list[str] = [], position: str = "position", part: str | None = None,
                  rows: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` plus ``position``: the row's place, from 0, among the rows with the same ``by`` columns (all rows
    without) in ``order``. ``part`` names a further column with the number of the row's range partition,
    which holds consecutive rows of consecutive groups. Reads ``df`` for a count (unless ``rows`` says it)
    and for the sort, so it should be a table; jobs run when called.

    Ties in ``order`` get different places in an arbitrary order; give a last column that settles them.
    Null groups are one group; a column called like a new one is replaced; an empty table stays empty.
    """
    keep_part = part is not None
    part = part or unused(df.columns, "_part")[0]
    df = df.drop(position, part)
    row, key, least, offset, n = unused([*df.columns, position, part], "_row", "_key", "_least", "_offset", "_n")
    total = df.count() if rows is None else rows
    parts = max(1, math.ceil(total / part_rows))
    # Null-safe keys of the groups, for the join below.
    keyed = df.withColumn(key, F.struct(*[col(c) for c in by]) if by else F.lit(0))
    # There may be other than ``parts`` partitions: the offsets are those of the partitions that were written.
    ranged = range_sorted(keyed, [*[col(c) for c in by], *order], parts, part, row)
    counts = ranged.groupBy(part, key).agg(F.min(row).alias(least), F.count("*").alias(n))
    counts = stage_table(counts, "ranges-counts")
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, key, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(least)).alias(offset))
    if counts.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    offsets = offsets.withColumnRenamed(part, f"{part}_o").withColumnRenamed(key, f"{key}_o")
    placed = ranged.join(offsets, (F.col(part) == F.col(f"{part}_o")) & F.col(key).eqNullSafe(F.col(f"{key}_o"))) \
        .withColumn(position, (F.col(row) + F.col(offset)).cast("long"))
    return placed.select(*[col(c) for c in df.columns], position, *([part] if keep_part else []))


def rank_statistics(df: DataFrame, score: str = "score", label: str = "label", part_rows: int = PART_ROWS) -> DataFrame:
    """M4: (positives, negatives, auc, ks) of scores against 0/1 labels, exactly, ties counted half.

    ``auc`` is the Mann-Whitney statistic over all pairs of a positive and a negative, ``ks`` the greatest distance of their
    distributions. Rows are counted by score first; the distinct scores are range-partitioned and the counts below
    each are summed within partitions, plus those of the partitions before. Rows with a null score or label are left out;
    without a positive or a negative both are null. Jobs run when called.
    """
    rows = df.select(col(score).cast("double").alias("score"), (col(label) > 0).alias("positive")).where("score is not null and positive is not null")
    counts = stage_table(rows.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")), "scores")
    parts = max(1, math.ceil(counts.count() / part_rows))
    ranged = range_sorted(counts, [F.col("score")], parts, "part", "row", "scores-sorted")
    totals = ranged.groupBy("part").agg(F.sum("p").alias("part_p"), F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_p").over(before), F.lit(0)).alias("p_before"),
                            F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n_before"))
    # One row per partition: as many as there are, which ``part_rows`` bounds.
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("p_seen", F.sum("p").over(own)).withColumn("n_seen", F.sum("n").over(own)).join(offsets, "part") \
        .withColumn("p_seen", F.col("p_seen") + F.col("p_before")).withColumn("n_seen", F.col("n_seen") + F.col("n_before"))
    wide = "decimal(38,0)"
    all_p, all_n = (counts.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for c in ("p", "n"))
    pairs = (F.col("p").cast("decimal(18,0)") * (2 * F.col("n_seen") - F.col("n")).cast("decimal(19,0)")).cast(wide)
    ks = F.abs(F.col("p_seen") / F.lit(max(all_p, 1)) - F.col("n_seen") / F.lit(max(all_n, 1)))
    found = placed.agg(F.sum(pairs).alias("twice"), F.max(ks).alias("ks"))
    both = F.lit(bool(all_p and all_n))
    return found.select(
        F.lit(all_p).cast("long").alias("positives"), F.lit(all_n).cast("long").alias("negatives"),
        F.when(both, F.col("twice").cast("double") / (2.0 * max(all_p, 1) * max(all_n, 1))).alias("auc"), F.when(both, F.col("ks")).alias("ks"))


def auc_by(df: DataFrame, by: list[str], score: str = "score", label: str = "label", part_rows: int = PART_ROWS) -> DataFrame:
    """``by`` and ``auc``: the exact AUC of ``rank_statistics`` in each group, by one range sort of all groups' distinct scores.

    A group may span many range partitions. Rows with a null score or label are left out; null groups are one group; a group
    without a positive or a negative has a null ``auc``, a group without rows is not there. Jobs run when called."""
    key, s, p, n = "_key", "_score", "_p", "_n"
    rows = df.select(F.struct(*[col(c) for c in by]).alias(key), col(score).cast("double").alias(s), (col(label) > 0).alias("_positive")) \
        .where(f"{s} is not null and _positive is not null")
    counts = stage_table(rows.groupBy(key, s).agg(F.count_if("_positive").alias(p), F.count_if(~F.col("_positive")).alias(n)), "scores")
    parts = max(1, math.ceil(counts.count() / part_rows))
    ranged = range_sorted(counts, [F.col(key), F.col(s)], parts, "_part", "_row", "scores-sorted")
    # One row per partition and group.
    totals = ranged.groupBy(key, "_part").agg(F.sum(n).alias("_part_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("_okey"), F.col("_part").alias("_opart"), F.coalesce(F.sum("_part_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_seen", F.sum(n).over(own)).join(offsets, (F.col("_part") == F.col("_opart")) & F.col(key).eqNullSafe(F.col("_okey")))
    pairs = (F.col(p).cast("decimal(18,0)") * (2 * (F.col("_seen") + F.col("_before")) - F.col(n)).cast("decimal(19,0)")).cast("decimal(38,0)")
    found = placed.groupBy(key).agg(F.sum(pairs).alias("_twice"), F.sum(p).alias("_ps"), F.sum(n).alias("_ns"))
    both = (F.col("_ps") > 0) & (F.col("_ns") > 0)
    auc = F.when(both, F.col("_twice").cast("double") / (2.0 * F.col("_ps") * F.col("_ns")))
    return found.select(*[F.col(key).getField(c).alias(c) for c in by], auc.alias("auc"))
