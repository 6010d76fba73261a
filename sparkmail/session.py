"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every sparkmail job relies on. All are runtime SQL confs, so they
# can also be applied to a session someone else built (see ``apply_conf``).
SQL_CONF = {
    # Dates in the data model are UTC; timestamps without zone stay as is.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, turn sort-merge joins into broadcast joins only when the
    # *measured* side is small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partitioned writes replace only the partitions present in the output.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Header arrays may repeat a name; the last value wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state (all-time id dedup can be large) lives in RocksDB on the
    # executors' disks and is checkpointed, not held in the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch uploads the changes of its state, not the files of each store
    # anew; snapshots are made beside it. Else each batch costs a flush and an
    # upload for every state partition, however few keys it brings.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Partition folder values stay strings (dates travel as yyyy-MM-dd text).
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def get_spark(app: str = "sparkmail", master: str | None = None,
              shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with sparkmail's settings.

    On a cluster ``master`` stays None and spark-submit decides; locally the
    default is ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", driver_memory or os.environ.get("SPARKMAIL_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local master (as in tests) gets a temporary folder; any other master is an
    error, since its executors would not see that folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sparkmail-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stage_table(df, name: str, fmt: str = "parquet"):
    """Write ``df`` to a fresh folder under the shared checkpoint folder and
    return it read back: an intermediate used several times is computed
    once, and its lineage is cut (a lost executor re-reads the files instead
    of recomputing the plan). Runs a job when called."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


_SHIPPED: set[int] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Make the ``sparkmail`` package importable in Python workers.

    Operators that run Python on executors (the MIME walk, the pandas UDF
    hook) pickle functions and rule objects by reference to this package.
    When the package is not installed on the workers (a session created
    outside this repository, spark-submit without ``--py-files``), zip it
    once per SparkContext and ship it with ``addPyFile``, which Spark
    distributes to every executor."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # A driver-side artifact, like a local --py-files path: Spark copies it to
    # every executor, which never read this folder themselves.
    fd, path = tempfile.mkstemp(prefix="sparkmail-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
