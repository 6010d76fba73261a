"""URL allow/block rules as a sort-merge range join.

A host's labels are written backwards (``a.example.org`` -> ``org.example.a.``),
so that "this host and its subdomains" is one key prefix, i.e. one interval
of the sorted key space, and so is "paths that start with ...". Intervals of
prefixes nest or are disjoint. The sweep sorts interval starts, interval
ends and the keys to judge together; after each boundary the innermost open
rule (the top of the stack of nested rules) is known, and a key takes the
top that the last boundary before it left. Range partitions are swept side
by side; a partition starts with the top its predecessors leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.operators.ranks import col
from sparkmail.session import stage_table

#: Sorts after every character a key can go on with.
AFTER = "\U0010FFFF"
#: Between host and path of a composite key.
SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """Text after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """``a.example.org`` -> ``org.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def prefix_pairs(keys: DataFrame) -> DataFrame:
    """(key, outer, n): each key with every key of the table that it starts with, itself included."""
    heads = keys.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")) \
        .withColumn("outer", F.substring("key", F.lit(1), F.col("n")))
    return heads.join(keys.select(F.col("key").alias("outer")), "outer")


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, top): for each distinct key of ``points`` the longest key of ``prefixes`` it starts with.

    Keys without one are left out. Both inputs have a non-null string column
    ``key``; repeated keys count once. Two shuffles of the distinct keys, none
    of whole rows; no partition depends on how many keys share a prefix.
    """
    prefixes = prefixes.select("key").distinct()
    outer = prefix_pairs(prefixes).where(F.col("n") < F.length("key")) \
        .groupBy("key").agg(F.max_by("outer", "n").alias("parent"))
    starts = prefixes.select("key", F.lit(0).alias("kind"), F.col("key").alias("top"))
    ends = prefixes.join(outer, "key", "left").select(
        F.concat("key", F.lit(AFTER)).alias("key"), F.lit(0).alias("kind"), F.coalesce("parent", F.lit("")).alias("top"))
    asked = points.select("key").distinct().select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("top"))
    events = starts.unionByName(ends).unionByName(asked).repartitionByRange("key", "kind") \
        .withColumn("part", F.spark_partition_id())
    # Written, so that the partition numbers read below are those of one range partitioning.
    events = stage_table(events, "url-sweep")
    left_open = events.where("kind = 0").groupBy("part").agg(F.max_by("top", "key").alias("left"))
    carried = events.select("part").distinct().join(left_open, "part", "left").select(
        "part", F.last("left", ignorenulls=True).over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    seen = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range partition: bounded by the number of shuffle partitions.
    swept = events.withColumn("seen", F.last("top", ignorenulls=True).over(seen)).where("kind = 1") \
        .join(F.broadcast(carried), "part", "left")
    return swept.select("key", F.coalesce("seen", "carry", F.lit("")).alias("top")).where("top <> ''")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path`` (starting
    with ``/``). A rule fits its host and all subdomains where the path starts
    with the rule's; the longest rule (host and path together) wins, the
    longer host on a tie, block before allow if one host and path has both.
    No rule: ``rule`` is null and ``verdict`` is ``default``.

    A null url or one without ``://`` has empty host and path and no rule.
    Each row is judged, repeated rows too; columns of ``pages`` named like the
    four new ones are replaced. Empty ``pages`` or ``rules`` are fine. Rules
    with a null host, path or verdict are ignored.
    """
    rules = rules.where("host <> '' and path is not null and verdict is not null") \
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict") \
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict")) \
        .withColumn("rule_host_key", host_key(F.col("rule_host"))) \
        .withColumn("rule_key", F.concat("rule_host_key", F.lit(SEP), "rule_path"))
    urls = pages.select(host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path")) \
        .distinct().withColumn("host_key", host_key(F.col("host")))
    hosts = rules.select(F.col("rule_host_key").alias("key")).distinct()
    inner = sweep(urls.select(F.col("host_key").alias("key")), hosts) \
        .withColumnRenamed("key", "host_key")
    # All rule hosts open at a host: the innermost and those around it (one per label at most).
    around = prefix_pairs(hosts).select(F.col("key").alias("top"), F.col("outer").alias("open_host"))
    asked = urls.join(inner, "host_key").join(around, "top") \
        .select("host", "path", F.concat("open_host", F.lit(SEP), "path").alias("key"))
    best = sweep(asked, rules.select(F.col("rule_key").alias("key")))
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    judged = asked.join(best, "key").join(rules.withColumnRenamed("rule_key", "top"), "top") \
        .groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), size).alias("won"))
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c.lower() not in new]
    # The columns of pages travel as one, so that none can clash.
    rows = pages.select(F.struct(*[col(c) for c in keep]).alias("page") if keep else F.lit(None).alias("page"),
                        host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    return rows.join(judged, ["host", "path"], "left").select(
        *[F.col("page").getField(c).alias(c) for c in keep], "host", "path", F.concat("won.rule_host", "won.rule_path").alias("rule"),
        F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"))
