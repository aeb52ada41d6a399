"""Shared intermediate tables.

Lineage is cut by writing Parquet below the folder that the session names in
``spark.checkpoint.dir``; see ``folioflow.scratch``, whose ``clear`` deletes what is left in the end.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from ..scratch import shared_folder

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While open, shuffle files go as soon as the query that wrote them has ended."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


class Scratch:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = shared_folder(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; executors may come and go afterwards."""
        where = f"{self.path}/{name}"
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
