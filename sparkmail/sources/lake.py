"""Files in, files out.

Layouts are Hive-style (``col=value`` folders), so partition discovery puts
the folder values into columns and a filter on them prunes whole folders.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkmail import schemas as S


def _missing(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    code = cond() if cond else None
    return code == "PATH_NOT_FOUND" or "Path does not exist" in str(e)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the Hadoop file system that serves it
    (local, HDFS or an object store); glob characters are expanded."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if any(ch in path for ch in "*?[{"):
        found = fs.globStatus(p)
        return found is not None and len(found) > 0
    return fs.exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  **options) -> DataFrame:
    """Read ``path``; a missing path gives a typed empty frame.

    Only a missing path is absorbed; any other error is raised.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        r = spark.read.format(fmt).options(**options)
        if fmt != "parquet" and fmt != "orc":
            r = r.schema(schema)
        return r.load(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, root: str, date: str | None = None, schema: StructType = S.RAW_MESSAGE,
             multi_line: bool = False, corrupt: bool = False) -> DataFrame:
    """Raw JSON messages under ``root/[ingestion_date=]D/mailbox_type=M``.

    Both layouts may lie side by side; ``root`` may also be one date's folder.
    The date and the mailbox are read from the file's path, so files of a plain
    date folder (not ``name=value``) have them too. With ``date`` only that
    date's folders are read.

    A file may hold one object per line or a JSON array per line (Spark
    explodes a top-level array into rows); ``multi_line`` reads files that
    hold one pretty-printed document. Malformed lines do not fail the job:
    they are left out, or with ``corrupt`` kept as rows of nulls with their
    text in ``_corrupt_record`` (see ``split_corrupt``).
    """
    base = root.rstrip("/")
    typed = StructType([*[f for f in schema.fields if f.name not in ("ingestion_date", "mailbox_type")],
                        StructField(CORRUPT, StringType())])
    paths = [base]
    if date is not None and not re.search(rf"(?:^|[/=]){re.escape(date)}$", base):
        paths = [p for p in (f"{base}/ingestion_date={date}", f"{base}/{date}") if path_exists(spark, p)]
    paths = [p for p in paths if path_exists(spark, p)]
    if paths:
        r = spark.read.schema(typed).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true")
        df = r.json(paths)
        # The path as a column, not partition discovery: a plain date folder holds no name=value.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        # Spark refuses a query that needs the corrupt record alone; this one needs a second column, too.
        first = F.substring(F.coalesce(F.col(typed.fields[0].name).cast("string"), F.lit("")), 1, 0)
        df = df.withColumn(CORRUPT, F.concat(F.col(CORRUPT), first))
        df = df.select("*", F.nullif(F.regexp_extract(path, DATE_FOLDER, 1), F.lit("")).alias("ingestion_date"),
                       F.nullif(F.regexp_extract(path, r"/mailbox_type=([^/]*)/", 1), F.lit("")).alias("mailbox_type"))
    else:
        df = spark.createDataFrame([], typed).withColumn("ingestion_date", F.lit(None).cast("string")) \
            .withColumn("mailbox_type", F.lit(None).cast("string"))
    if date is not None:
        df = df.where(F.col("ingestion_date") == F.lit(date))
    return df if corrupt else df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


#: The last folder of a path that is a date, alone or as ingestion_date=.
DATE_FOLDER = r"/(?:ingestion_date=)?(\d{4}-\d{2}-\d{2})/"


def keep_partitions(spark: SparkSession, root: str, name: str, values: list[str], start: str, end: str) -> list[str]:
    """Deletes the folders ``name=value`` under ``root`` for values in ``start..end`` but those in ``values``; returns their values."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(path) if fs.exists(path) else []:
        folder = s.getPath().getName()
        value = folder[len(name) + 1:]
        if folder.startswith(f"{name}=") and start <= value <= end and value not in values:
            fs.delete(s.getPath(), True)
            gone.append(value)
    return sorted(gone)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S18 for raw files: ``(good, bad)`` of ``read_raw(..., corrupt=True)``; bad rows are dead letters
    (record, reason, dlq_date), dated by their folder."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), F.lit("malformed json").alias("reason"), F.col("ingestion_date").alias("dlq_date"))
    return good, bad


def read_day_document(spark: SparkSession, root: str, date: str, schema: StructType = S.DAILY) -> DataFrame:
    """The JSON document ``root/<date>.json``, an object or an array of objects; no such file gives no rows."""
    path = f"{root.rstrip('/')}/{date}.json"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_partition(spark: SparkSession, root: str, date: str, mailbox_type: str | None = None,
                   date_col: str = "ingestion_date", fmt: str = "parquet") -> DataFrame:
    """S3: one date (and optionally one mailbox type) of a partitioned table,
    as filters on the partition columns, so only those folders are listed
    and read. A missing table gives no rows rather than an error (S2)."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], S.RAW_MESSAGE).withColumn(date_col, F.lit(None).cast("string"))
    df = spark.read.format(fmt).load(root)
    df = df.where(F.col(date_col) == F.lit(date))
    if mailbox_type is not None:
        df = df.where(F.col("mailbox_type") == F.lit(mailbox_type))
    return df


def write_raw_batch(df: DataFrame, root: str, date: str, mailbox_type: str) -> str:
    """Append a batch of raw messages as JSON under one date/mailbox.

    An empty batch is an error, as in the reference (checked with a
    one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError("empty batch: nothing to write")
    path = f"{root.rstrip('/')}/ingestion_date={date}/mailbox_type={mailbox_type}"
    df.drop("ingestion_date", "mailbox_type").write.mode("append").json(path)
    return path


def write_raw_table(df: DataFrame, root: str) -> None:
    """S12 for a whole backfill: one job writes every (date, mailbox) folder
    (rows rebalanced by folder first, see ``write_partitions``)."""
    cols = ["ingestion_date", "mailbox_type"]
    df.hint("rebalance", *cols).write.mode("append").partitionBy(*cols).json(root)


def write_partitions(df: DataFrame, path: str, cols, fmt: str = "parquet", sort_by=None) -> None:
    """Overwrite only the partitions present in ``df``.

    ``partitionOverwriteMode=dynamic`` is set on the write itself, so other
    dates survive whatever the session default is (the reference's static
    overwrite deleted them).

    Rows are clustered by the partition columns with a REBALANCE hint rather
    than ``repartition(cols)``: each task then writes few files, and AQE
    splits a partition value that holds a large share of the rows (one busy
    day) over several tasks instead of sending it all to one.

    ``sort_by`` (e.g. the user id) sorts rows inside each written file, so
    Parquet row-group min/max statistics let a filter on that column skip
    most of a file (the index of the reference's row store).
    """
    cols = list(cols)
    x = df.hint("rebalance", *cols)
    if sort_by:
        # partition columns first: the writer needs them as the order's prefix,
        # otherwise it re-sorts and the inner order is lost
        x = x.sortWithinPartitions(*cols, *([sort_by] if isinstance(sort_by, str) else sort_by))
    (x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*cols).format(fmt).save(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite an unpartitioned table."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_daily(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """S13 + S4: the daily table for ``start..end`` (inclusive), missing -> empty."""
    d = read_or_empty(spark, root, S.DAILY, fmt="parquet")
    return d.where(F.col("metric_date").between(F.lit(start), F.lit(end)))


def write_daily_json(daily: DataFrame, root: str) -> None:
    """One JSON document per day, written by the executors
    (``metric_date=D/part-*.json``); maps and arrays stay JSON objects. Days that
    ``daily`` does not have keep their documents."""
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("metric_date").json(root)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """The run summary (a handful of rows) as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def list_partitions(df: DataFrame, cols) -> DataFrame:
    """Sorted distinct partition values (partition columns are
    answered from the file listing, no data is read)."""
    cols = list(cols)
    return df.select(*cols).distinct().orderBy(*cols)


def union_partitions(*frames: DataFrame) -> DataFrame:
    """Distinct union of partition names from several listings."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct().orderBy(*out.columns)


def read_features(spark: SparkSession, features_path: str, classified_path: str) -> DataFrame:
    """The ORC feature table, else the classified Parquet table."""
    if path_exists(spark, features_path):
        return spark.read.orc(features_path)
    return spark.read.parquet(classified_path)


# --- S9, S21: catalog ---------------------------------------------------------

DDL = {
    "emails_raw": ("message_id STRING, subject STRING, sender STRING, body_preview STRING, body STRING, "
                   "received_at TIMESTAMP, raw_headers STRING, attachment_count INT, cc_count INT, "
                   "ingestion_date STRING, mailbox_type STRING", "parquet", "ingestion_date, mailbox_type"),
    "emails_classified": ("message_id STRING, subject STRING, sender STRING, body_preview STRING, body STRING, "
                          "received_at TIMESTAMP, spam_label STRING, spam_score DOUBLE, topic STRING, "
                          "topic_confidence DOUBLE, urgency_score DOUBLE, sentiment_score DOUBLE, "
                          "ingestion_date STRING, mailbox_type STRING, classification_date STRING, label STRING",
                          "parquet", "classification_date"),
    "email_features": ("message_id STRING, label STRING, topic STRING, subject_tf_idf ARRAY<DOUBLE>, "
                       "body_tf_idf ARRAY<DOUBLE>, sender_domain STRING, received_at TIMESTAMP, "
                       "training_date STRING", "orc", None),
    "analytics_daily": ("metric_date STRING, daily_volume BIGINT, spam_count BIGINT, spam_rate DOUBLE, "
                        "ham_count BIGINT, topic_distribution MAP<STRING, BIGINT>, avg_urgency_score DOUBLE, "
                        "top_senders_by_domain ARRAY<STRUCT<domain: STRING, count: BIGINT>>, "
                        "updated_at TIMESTAMP", "parquet", "metric_date"),
    "model_registry": ("version STRING, training_date STRING, accuracy DOUBLE, f1 DOUBLE, model_path STRING, "
                       "is_champion BOOLEAN, created_at TIMESTAMP", "parquet", None),
}


def create_tables(spark: SparkSession, root: str, names=None, database: str | None = None) -> list[str]:
    """External tables over ``root/<name>`` (optionally in ``database``)."""
    made = []
    for name in names or DDL:
        cols, fmt, parts = DDL[name]
        part = f" PARTITIONED BY ({parts})" if parts else ""
        full = f"{database}.{name}" if database else name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({cols}) USING {fmt}{part} "
                  f"LOCATION '{root.rstrip('/')}/{name}'")
        made.append(full)
    return made


def register_partition(spark: SparkSession, table: str, spec: dict, location: str | None = None) -> None:
    """Add one partition to the catalog if it is not there yet."""
    kv = ", ".join(f"{k}='{v}'" for k, v in spec.items())
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({kv}){loc}")


def repair_partitions(spark: SparkSession, table: str) -> None:
    """S9 for a backfill: pick up every partition folder at once."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


# --- co-located merges --------------------------------------------------------

def write_bucketed(df: DataFrame, table: str, keys, buckets: int, path: str | None = None) -> None:
    """Store a large merge target (stored mail, stream results) as a catalog
    table bucketed and sorted by its key. Later joins on the key (insert of
    unseen rows, feedback, reclassification) read it without shuffling it:
    only the smaller side is hash-partitioned into the same buckets."""
    keys = list(keys)
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
