"""Session settings the operators expect: adaptive execution, UTC, and sizes that the caller may override."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "strandline", **settings: str) -> SparkSession:
    """A session with AQE and its skew handling on; keyword settings use ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a small input came in fewer; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
