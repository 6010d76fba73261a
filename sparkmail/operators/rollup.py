"""A stored roll-up of messages, from which dashboard, trends and heat map are answered.

One cell per (user, day, hour) holds sums, counts, and the least and greatest time, all of which can be merged. A delta
of messages is aggregated to cells and added to the stored ones; rows that come late only touch the cells of their own
day. Cells lie in buckets by (day, shard of the user): a delta rewrites the buckets of its days, and a question about
some days or one user opens the buckets of these. A user or a day with a third of the messages is combined inside each
task before the shuffle and has 24 cells a user and day at most, over all shards of the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions.text import day
from sparkmail.operators import analytics as A
from sparkmail.session import stage_table
from sparkmail.sources.buckets import BucketTable

KEYS = ["user_id", "day", "hour"]
SUMS = ["n", "spam", "ham", "urgent", "urgency_sum", "urgency_n", "sentiment_sum", "sentiment_n", "length_sum", "length_n", "time_n"]


def cells(messages: DataFrame) -> DataFrame:
    """The cells of some messages. ``spam`` counts the label spam and ``ham`` all other labels but null; ``day`` and
    ``hour`` are null for a null time; null scores and bodies are left out of their sums and counts."""
    u, s, length = F.col("urgency_score"), F.col("sentiment_score"), F.length("body")
    return messages.groupBy("user_id", day("received_at").alias("day"), F.hour("received_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("spam_label") == "spam").alias("spam"),
        F.count_if(F.col("spam_label") != "spam").alias("ham"),
        F.count_if(u > R.URGENT_THRESHOLD).alias("urgent"),
        # Exact decimals: sums do not depend on how the rows came in deltas.
        F.coalesce(F.sum(u.cast(A.URGENCY_SUM)), F.lit(0)).cast(A.URGENCY_SUM).alias("urgency_sum"), F.count(u).alias("urgency_n"),
        F.coalesce(F.sum(s.cast(A.URGENCY_SUM)), F.lit(0)).cast(A.URGENCY_SUM).alias("sentiment_sum"), F.count(s).alias("sentiment_n"),
        F.coalesce(F.sum(length.cast("long")), F.lit(0)).cast("long").alias("length_sum"), F.count(length).alias("length_n"),
        F.count("received_at").alias("time_n"),
        F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
    )


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the same keys made one."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS],
                                   F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def correction(before: DataFrame, after: DataFrame) -> DataFrame:
    """The cells to add when messages ``before`` become ``after``: labels, scores or bodies may differ, while user and
    time must stay (a least or greatest time cannot be taken back)."""
    # Adding and taking away the same times leaves them as they are.
    less = cells(before).select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS], "first_at", "last_at")
    return _added(cells(after).unionByName(less), KEYS)


class RollUp:
    """The roll-up stored under ``root``. ``buckets`` and ``shards`` are fixed when it is made; ``shards`` times the days
    kept should be well above ``buckets``. Writing runs jobs; reading is lazy but for the numbers of the buckets.

    An empty delta changes nothing. Repeated messages count each time: drop them before. A null user is a user."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, shards: int = 8):
        self.spark, self.shards = spark, shards
        self.table = BucketTable(spark, root, ["day", "shard"], buckets)

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(self.shards)).cast("int"))

    def add_cells(self, delta: DataFrame, tag: str | None = None) -> list[int]:
        """Adds cells and returns the buckets rewritten. A delta repeated with its ``tag`` is not added again."""
        # Written once: the merge reads the delta for its buckets and for its rows.
        delta = stage_table(self._sharded(delta), "roll-up-delta")
        if not self.table.manifest()["number"]:
            self.table.create(delta.limit(0))
        return self.table.merge(delta, lambda stored, new: _added(stored.unionByName(new), [*KEYS, "shard"]), tag=tag)

    def add(self, messages: DataFrame, tag: str | None = None) -> list[int]:
        """Adds the messages of a delta."""
        return self.add_cells(cells(messages), tag)

    def correct(self, before: DataFrame, after: DataFrame, tag: str | None = None) -> list[int]:
        """Replaces messages that were added (``before``) by ``after``; see ``correction``."""
        return self.add_cells(correction(before, after), tag)

    def cells(self, start: str | None = None, end: str | None = None, user_id=None) -> DataFrame:
        """The stored cells, of the days ``start..end`` (both or none) and of one user if given. Opens their buckets only."""
        rows = self.table.read()
        if bool(start) != bool(end):
            raise ValueError("both or none of start and end")
        if start:
            days = self.spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")) \
                .select(F.date_format("d", "yyyy-MM-dd").alias("day"))
            if user_id is not None:
                keys = self._sharded(days.withColumn("user_id", F.lit(user_id).cast(rows.schema["user_id"].dataType)))
            else:
                keys = days.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
            rows = self.table.read(self.table.touched(keys)).where(F.col("day").between(start, end))
        return rows if user_id is None else rows.where(F.col("user_id") == F.lit(user_id))

    def users(self) -> DataFrame:
        return self.table.read().select("user_id").distinct()

    def dashboard(self, today: str, user_id=None, start: str | None = None, end: str | None = None) -> DataFrame:
        """A6-A10, A13 as ``analytics.dashboard`` gives them per user."""
        x, yesterday = self.cells(start, end, user_id), A._shift(today, -1)
        mean = lambda c: F.sum(f"{c}_sum").cast("double") / F.sum(f"{c}_n")
        a = x.groupBy("user_id").agg(
            F.sum("n").alias("total_emails"), F.sum("spam").alias("spam_count"),
            F.when(F.sum("urgency_n") > 0, mean("urgency")).alias("_u"),
            F.when(F.sum("sentiment_n") > 0, mean("sentiment")).alias("_s"),
            F.when(F.sum("length_n") > 0, mean("length")).alias("_len"),
            F.sum(F.when(F.col("day") == today, F.col("n")).otherwise(0)).alias("_today"),
            F.sum(F.when(F.col("day") == yesterday, F.col("n")).otherwise(0)).alias("_yday"),
            F.min("first_at").alias("_min"), F.max("last_at").alias("_max"), F.sum("time_n").alias("_n_ts"))
        return A.dashboard_values(A._with_given_user(a, user_id, ("user_id",)))

    def trends(self, end_date: str, days: int = 30, user_id=None, users: DataFrame | None = None) -> DataFrame:
        """A11, J6 as ``analytics.trends`` gives them: opens the buckets of the range, and the users' if none are given."""
        start = A._shift(end_date, -(days - 1))
        x = self.cells(start, end_date, user_id)
        counts = x.groupBy("user_id", F.col("day").alias("date")).agg(
            F.sum("n").alias("total"), *[F.sum(c).alias(c) for c in ("spam", "ham", "urgent")])
        if user_id is not None:
            groups = A._given_user(x, user_id)
        else:
            groups = (users if users is not None else self.users()).select("user_id").distinct()
        return A.fill_days(counts, groups, start, end_date)

    def heatmap(self, user_id=None, start: str | None = None, end: str | None = None) -> DataFrame:
        """A12, J7 as ``analytics.heatmap`` gives them; the days can be bounded."""
        x = self.cells(start, end, user_id)
        counts = x.groupBy("user_id", F.dayofweek(F.to_date("day")).alias("day"), "hour").agg(F.sum("n").alias("volume"))
        groups = A._given_user(x, user_id) if user_id is not None else \
            counts.groupBy("user_id").agg(F.sum("volume").alias("_n")).where(F.col("_n") > 0)
        return A.fill_week(counts, groups)
