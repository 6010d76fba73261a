"""End-to-end flows (V3-V6, S16, F18): the daily chain, a backfill over a
date range, and republishing stored mail as stream events.

The reference ran these as an Airflow DAG of three spark-submit jobs with a
count() before each write. Here each stage is one Spark plan with one
action (its write); row counts are read from the written files' footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions import text as T
from sparkmail.operators import analytics as A
from sparkmail.operators.classify import classify_keyword
from sparkmail.operators.ingest import clean_raw
from sparkmail.operators.paging import top_per_user
from sparkmail.session import stage_table
from sparkmail.sources import lake as L


def _between(col: str, start: str, end: str):
    return F.col(col).between(F.lit(start), F.lit(end))


def _chain(spark: SparkSession, raw_root: str, lake_root: str, start: str, end: str, days: int,
           rules: R.KeywordRules, mailbox_type: str | None, database: str | None) -> dict:
    """Ingest, classify and aggregate the dates ``start..end``.

    What is written is whole: the raw table by (date, mailbox), so ingesting one
    mailbox leaves the other; the classified table by date, always from all
    stored mailboxes of that date, so neither a mailbox nor an old label is left
    behind; the daily table by date, so other days stay.
    """
    raw = L.read_raw(spark, raw_root, date=start if start == end else None, corrupt=True).where(_between("ingestion_date", start, end))
    # The raw JSON is parsed once; both halves are written from the staged rows.
    good, bad = L.split_corrupt(stage_table(raw, "raw"))
    good = clean_raw(good)
    if mailbox_type is not None:
        good = good.where(F.col("mailbox_type") == F.lit(mailbox_type))
    L.write_partitions(good, f"{lake_root}/emails_raw", ["ingestion_date", "mailbox_type"])
    L.write_partitions(bad, f"{lake_root}/dead_letters", ["dlq_date"], fmt="json")
    # A date without dead letters now may have had some before.
    L.keep_partitions(spark, f"{lake_root}/dead_letters", "dlq_date", [r[0] for r in bad.select("dlq_date").distinct().collect()], start, end)

    def stored(name, date_col):
        path = f"{lake_root}/{name}"
        return spark.read.parquet(path).where(_between(date_col, start, end))

    messages = stored("emails_raw", "ingestion_date")
    classified = classify_keyword(messages, rules).withColumn("classification_date", F.col("ingestion_date"))
    L.write_partitions(classified, f"{lake_root}/emails_classified", ["classification_date"])
    L.write_summary_json(A.run_summary(stored("emails_classified", "classification_date")), f"{lake_root}/summaries/{start}_{end}")

    daily = A.daily_metrics(spark.read.parquet(f"{lake_root}/emails_classified"), end, days=days)
    L.write_partitions(daily, f"{lake_root}/analytics_daily", ["metric_date"])
    L.write_daily_json(spark.read.parquet(f"{lake_root}/analytics_daily").where(F.col("metric_date").between(A._shift(end, -days), end)),
                       f"{lake_root}/analytics/daily")
    if database:
        L.create_tables(spark, lake_root, ["emails_raw", "emails_classified", "analytics_daily"], database=database)
        for name in ("emails_raw", "emails_classified", "analytics_daily"):
            L.repair_partitions(spark, f"{database}.{name}")
    return {"ingested": messages.count(), "classified": stored("emails_classified", "classification_date").count(),
            "daily": f"{lake_root}/analytics_daily", "summary": f"{lake_root}/summaries/{start}_{end}"}


def run_day(spark: SparkSession, raw_root: str, lake_root: str, date: str, days: int = 30,
            rules: R.KeywordRules = R.JOB_RULES, mailbox_type: str | None = None, database: str | None = None) -> dict:
    """V3: ingest -> classify -> run summary -> analytics for one date. With
    ``mailbox_type`` only that mailbox is ingested anew. With ``database`` the
    three tables and their partitions are registered there (S9). The analytics
    window ends at ``date``."""
    return _chain(spark, raw_root, lake_root, date, date, days, rules, mailbox_type, database)


def backfill(spark: SparkSession, raw_root: str, lake_root: str, start: str, end: str,
             rules: R.KeywordRules = R.JOB_RULES, database: str | None = None) -> dict:
    """V4: the same chain over ``start..end`` as one job per stage (not a
    loop of daily jobs); every date in the range is rewritten, others kept."""
    import datetime as dt

    days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days
    return _chain(spark, raw_root, lake_root, start, end, days, rules, None, database)


def raw_range(spark: SparkSession, raw_root: str) -> tuple[str, str]:
    """First and last date of the raw folders."""
    r = L.read_raw(spark, raw_root, corrupt=True).agg(F.min("ingestion_date"), F.max("ingestion_date")).first()
    return r[0], r[1]


def iso_utc(c):
    """Python ``datetime.isoformat()`` of a UTC instant: microseconds only when
    non-zero, then ``+00:00``."""
    ts = F.col(c) if isinstance(c, str) else c
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))) \
        .otherwise(F.lit(""))
    return F.concat(base, frac, F.lit("+00:00"))


def to_events(df: DataFrame, per_user: int, source: str = "mailbox") -> DataFrame:
    """V6: newest ``per_user`` stored messages of every user as stream events
    (W6 + F14 + P16): stable UUIDv5 id, composed text, ISO time, source."""
    top = top_per_user(df, per_user)
    return top.select(
        F.col("user_id"),
        T.uuid5(F.col("message_id").cast("string")).alias("email_id"),
        T.compose_text("subject", "sender", "body", "body_preview").alias("text"),
        iso_utc("received_at").alias("timestamp"),
        F.lit(source).alias("pipeline_source"))


def to_kafka_rows(df: DataFrame, key: str = "email_id") -> DataFrame:
    """(key, value) rows for a Kafka sink; value = JSON of the row, source tag
    defaulted to 'unknown' and cut to 32 characters. ``user_id``, which tells the
    newest messages of each user apart, is not part of an event."""
    x = df.drop("user_id")
    if "pipeline_source" in x.columns:
        x = x.withColumn("pipeline_source", T.source_tag(F.col("pipeline_source")))
    return x.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(c) for c in x.columns]))
                    .alias("value"))


def publish(df: DataFrame, servers: str, topic: str) -> None:
    """Write (key, value) rows to Kafka (needs the Kafka connector)."""
    (to_kafka_rows(df).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def retrain_and_register(spark: SparkSession, feedback: DataFrame, root: str, version: str, training_date: str, created_at,
                         **options):
    """M8 to M7: retrain on feedback, save the model (it gives labels, not class numbers) and
    register it as champion. None if there is too little feedback, else the new registry."""
    from sparkmail.operators import ml as ML
    from sparkmail.operators import registry as G

    model, pred = ML.retrain(feedback, **options)
    if model is None:
        return None
    path = ML.save_model(model, root, version)
    report = ML.class_report(pred.select(F.col("feedback").alias("label"), F.col("predicted_label").alias("predicted")))
    scores = report.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
                        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    row = scores.select(F.lit(version).alias("version"), F.lit(training_date).alias("training_date"), "accuracy", "f1",
                        F.lit(path).alias("model_path"), F.lit(created_at).cast("timestamp").alias("created_at"))
    current = G.read_registry(spark, root)
    has_rows = not current.isEmpty()
    gen = spark.read.parquet(f"{root}/model_registry").agg(F.max(F.col("generation").cast("long"))).first()[0] if has_rows else 0
    G.write_registry(G.register(current if has_rows else None, row), root, int(gen or 0) + 1)
    return G.read_registry(spark, root)


def train_and_register(spark: SparkSession, df: DataFrame, root: str, version: str, training_date: str,
                       created_at, promote: str = "always", metric: str = "f1", seed: int = 42, **train_args):
    """The training job end to end (M2-M5, S20, U1, V5): cross-validated fit,
    model saved under ``root/models/v<version>``, one registry row from the
    training-split metrics, and a new registry generation written.

    ``promote="always"`` makes the new version champion (the reference's
    behaviour); ``"if_better"`` only when its ``metric`` beats the current
    champion's. Returns the new registry."""
    from sparkmail.operators import ml as ML
    from sparkmail.operators import registry as G

    model, metrics = ML.train(df, seed=seed, **train_args)
    path = ML.save_model(model, root, version)
    row = metrics.where(F.col("split") == "train").select(
        F.lit(version).alias("version"), F.lit(training_date).alias("training_date"), "accuracy", "f1",
        F.lit(path).alias("model_path"), F.lit(created_at).cast("timestamp").alias("created_at"))
    current = G.read_registry(spark, root)
    has_rows = not current.isEmpty()
    if promote == "if_better" and has_rows:
        new = G.promote_if_better(current, row, metric)
    else:
        new = G.register(current if has_rows else None, row)
    gen = spark.read.parquet(f"{root}/model_registry").agg(F.max(F.col("generation").cast("long"))).first()[0] \
        if has_rows else 0
    G.write_registry(new, root, int(gen or 0) + 1)
    return G.read_registry(spark, root)
