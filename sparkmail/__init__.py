"""sparkmail: message analytics as lazy Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column``)
built from ``pyspark.sql.functions``, Spark SQL, Structured Streaming and
Spark ML. Nothing collects to the driver.
"""

from sparkmail.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
