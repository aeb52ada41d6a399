"""Shared folder for intermediate tables.

It lies below ``spark.checkpoint.dir``, which driver and executors share.  Where that setting is
absent a temporary folder is taken on a local master (tests, a laptop); elsewhere that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made by this driver.
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name that all executors see; it stays until ``clear``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-folioflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/folioflow/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Delete all intermediate tables that this driver has made; to be called once results are written.  The number of folders."""
    made, _MADE[:] = _MADE[:], []
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps don't compute it again, whatever executors are lost."""
    where = shared_folder(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
