"""Session helpers: shared checkpoint folder, staged tables, settings."""

from pyspark.sql import functions as F

from sparkmail import session as SS


def test_checkpoint_dir_is_the_sessions(spark):
    d = SS.checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()
    assert SS.scratch_path(spark, "x").startswith(d.rstrip("/") + "/x-")
    assert SS.scratch_path(spark, "x") != SS.scratch_path(spark, "x")


def test_stage_table_cuts_lineage(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7).groupBy("k").count()
    staged = SS.stage_table(df, "staged-test")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "HashAggregate" not in plan
    assert staged.count() == 7


def test_apply_conf_sets_runtime_settings(spark):
    SS.apply_conf(spark)
    for k, v in SS.SQL_CONF.items():
        assert spark.conf.get(k) == v


def test_ensure_shipped_once(spark):
    SS.ensure_shipped(spark)
    SS.ensure_shipped(spark)
    assert id(spark.sparkContext._jsc) in SS._SHIPPED
