"""Star schema load and fact-to-dimension joins.

Surrogate keys are dense numbers from 1 on. They are given in the order of the natural
keys by range partitions and offsets (``with_position``), not by a global window, and are kept: a later load
numbers only new members, behind the highest key there is. The date key is the natural ``yyyyMMdd`` integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.functions.classify import topic_category
from sparkmail.functions.text import sender_domain
from sparkmail.operators.ranks import with_position
from sparkmail.session import stage_table

#: A member is hot if it has more than one in HOT of the fact's rows; so fewer than HOT members can be hot.
HOT = 1000
#: Values that stand for a hot member in the join it does not take part in.
SALTS = 1024


def _date_key(ts):
    return F.date_format(ts, "yyyyMMdd").cast("int")


def dense_keys(members: DataFrame, natural: str, key: str, existing: DataFrame | None = None) -> DataFrame:
    """(key, natural): the ``existing`` dimension and its new ``members`` (distinct, not null), numbered from its highest key
    on in their order. ``members`` should be a table; jobs run when called, and the numbers are written."""
    new = members.select(natural)
    start = 0
    if existing is not None:
        new = new.join(existing.select(natural), natural, "left_anti")
        start = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = with_position(new, [F.col(natural)], position=key).select((F.col(key) + F.lit(start + 1)).alias(key), natural)
    return numbered if existing is None else existing.select(key, natural).unionByName(numbered)


def with_key(rows: DataFrame, dim: DataFrame, counts: DataFrame, natural: str, key: str, total: int) -> DataFrame:
    """``rows`` plus the ``key`` of their ``natural`` member, whatever share of the rows one member has.

    Hot members (fewer than HOT, by ``counts``) come by broadcast. The others come by a join on the natural key, in which
    the rows of hot members take part under SALTS values that no member has, so that they are spread."""
    hot = counts.where(F.col("n") * HOT > total).join(dim, natural).select(natural, F.col(key).alias("_hot"))
    cold = F.when(F.col("_hot").isNull(), F.col(natural)) \
        .otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("message_id"), F.lit(SALTS)).cast("string")))
    other = dim.select(F.col(natural).alias("_cold"), F.col(key).alias("_key"))
    return rows.join(F.broadcast(hot), natural, "left").withColumn("_cold", cold).join(other, "_cold", "left") \
        .withColumn(key, F.coalesce("_hot", "_key")).drop("_hot", "_cold", "_key")


def build_star(df: DataFrame, ts_col: str = "received_at", existing: dict[str, DataFrame] | None = None):
    """``(fact_emails, dim_date, dim_sender, dim_topic)`` from classified messages.

    ``existing`` has the dimensions of an earlier load (``sender``, ``topic``): their keys stay and new members follow.
    A null sender or topic is the member ''. The fact is partitionable by (year, month). Jobs run when called: rows and keys
    are written once to the shared folder."""
    existing = existing or {}
    ts = F.col(ts_col)
    rows = df.select("message_id", _date_key(ts).alias("date_key"), F.coalesce(F.col("sender"), F.lit("")).alias("sender"),
                     F.coalesce(F.col("topic"), F.lit("")).alias("topic"), "spam_label", "urgency_score",
                     F.year(ts).alias("year"), F.month(ts).alias("month"))
    rows = stage_table(rows, "star-rows")
    total = rows.count()
    fact, dims = rows, {}
    for natural in ("sender", "topic"):
        key = f"{natural}_key"
        counts = stage_table(rows.groupBy(natural).agg(F.count("*").alias("n")), "member-counts")
        dims[natural] = dense_keys(counts, natural, key, existing.get(natural))
        fact = with_key(fact, dims[natural], counts, natural, key, total)
    dim_date = rows.select("date_key").where("date_key is not null").distinct().select(
        "date_key", F.to_date(F.col("date_key").cast("string"), "yyyyMMdd").alias("date"),
        (F.col("date_key") / 10000).cast("int").alias("year"))
    dim_sender = dims["sender"].select("sender_key", "sender", sender_domain("sender").alias("domain"))
    dim_topic = dims["topic"].select("topic_key", "topic", topic_category("topic").alias("category"))
    fact = stage_table(fact.select("message_id", "date_key", "sender_key", "topic_key", "spam_label", "urgency_score", "year", "month"), "star-fact")
    return fact, dim_date, dim_sender, dim_topic


def star_join(fact: DataFrame, dim_date: DataFrame, dim_sender: DataFrame, dim_topic: DataFrame) -> DataFrame:
    """Fact rows with their dimension attributes.

    Left joins: a fact row without a date (P2 makes such rows) keeps null date attributes. The dimensions are joined
    as in ``with_key``: the attributes of hot members come by broadcast, all others by a join in which the rows of hot members
    are spread."""
    total = fact.count()
    out = fact.join(dim_date.select("date_key", "date"), "date_key", "left")
    for key, dim in (("topic_key", dim_topic), ("sender_key", dim_sender)):
        hot = fact.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select(key).join(dim, key)
        packed = [c for c in dim.columns if c != key]
        hot = hot.select(key, F.struct(*packed).alias("_hot"))
        cold = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(-1 - F.pmod(F.xxhash64("message_id"), F.lit(SALTS)))
        other = dim.select(F.col(key).alias("_cold"), F.struct(*packed).alias("_other"))
        out = out.join(F.broadcast(hot), key, "left").withColumn("_cold", cold).join(other, "_cold", "left") \
            .withColumn("_dim", F.coalesce("_hot", "_other")).drop("_hot", "_other", "_cold").select("*", "_dim.*").drop("_dim")
    return out


def write_star(fact: DataFrame, dims: dict, root: str) -> None:
    """Write the fact partitioned by (year, month) and the dimensions."""
    fact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("year", "month").parquet(f"{root}/fact_emails")
    for name, d in dims.items():
        d.write.mode("overwrite").parquet(f"{root}/{name}")
