"""A stored table cut by ranges of its key: a replacement rewrites the files that hold incoming keys, the others stay.

Each file owns the keys from its smallest one up to that of the next file.  A manifest, one row a
file, names the files that count; a new one is put beside it as a whole, so a reader sees the table
before a replacement or after it, and one that was broken off leaves no trace but unnamed files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bitmaps import without_keys
from .tables import latest

MANIFEST = "start string, file string, rows long"


class RangeTable:
    """A table of files below one folder that all executors share.

    The key is a string.  Rows without a key are left out, since nothing could replace them; columns
    beside the table's are left out too.  Repeated keys (passages of a document) lie in one file;
    ``rows_per_file`` is what a file holds about.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "external_id", rows_per_file: int = 1_000_000):
        self.spark, self.folder, self.schema, self.key, self.rows_per_file = spark, folder.rstrip("/"), schema, key, rows_per_file

    def _versions(self) -> list[int]:
        """Numbers of whole manifests."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{n}/_SUCCESS"))]
        return sorted(int(n) for n in done)

    def files(self) -> list[Row]:
        """(start, file, rows) of each file in order of keys."""
        versions = self._versions()
        if not versions:
            return []
        named = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{versions[-1]:09d}").collect()  # a row a file
        return sorted(named, key=lambda r: r.start)

    def _read(self, files: list[Row]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{f.file}" for f in files)).select(*self.schema.names)

    def current(self) -> DataFrame:
        return self._read(self.files())

    def lookup(self, keys: list[str]) -> DataFrame:
        """Rows of a few keys, from the files that own them."""
        known = self.files()
        own = {self._owner(known, k) for k in keys} if known else set()
        return self._read([known[i] for i in sorted(own)]).filter(F.col(self.key).isin(keys))

    @staticmethod
    def _owner(known: list[Row], key: str) -> int:
        starts = np.array([f.start for f in known], object)
        return max(0, int(np.searchsorted(starts, key, side="right")) - 1)

    def _piece(self, known: list[Row]) -> Column:
        """The number of the file that owns a key."""
        starts = np.array([f.start for f in known], object)

        @F.pandas_udf("int")
        def find(keys: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(0, np.searchsorted(starts, keys.to_numpy(), side="right") - 1))

        return find(self.key) if known else F.lit(0)

    def replace(self, incoming: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """Rows of the keys of ``incoming`` and ``gone`` give way to ``incoming``; the number of files ``rewritten`` and ``kept``.

        Keys of ``gone`` that ``incoming`` holds are put in.  A replay leaves the table as it is.
        Without keys nothing is written.
        """
        fresh = incoming.select(*self.schema.names).filter(F.col(self.key).isNotNull())
        keys = fresh.select(self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key).filter(F.col(self.key).isNotNull()))
        known, keys = self.files(), keys.distinct()
        hit = {r[0] for r in keys.select(self._piece(known).alias("p")).distinct().collect()}  # a row a file
        if not hit:
            return {"rewritten": 0, "kept": len(known)}
        touched, kept = [f for i, f in enumerate(known) if i in hit], [f for i, f in enumerate(known) if i not in hit]
        rows = without_keys(self._read(touched), keys, self.key).unionByName(fresh) if touched else fresh
        n = max(1, round((sum(f.rows for f in touched) + fresh.count()) / self.rows_per_file))  # half as much again before a file is cut
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        piece = rows.withColumn("_piece", self._piece(known))
        piece.repartitionByRange(n, "_piece", self.key).sortWithinPartitions("_piece", self.key).write.partitionBy("_piece").parquet(folder)
        there = self.spark.read.schema(self.schema).parquet(folder)
        made = there.groupBy(F.regexp_extract("_metadata.file_path", "/data/([^/]+/_piece=[0-9]+/[^/]+)$", 1).alias("file")).agg(F.min(self.key).alias("start"), F.count(F.lit(1)).alias("rows"))
        named = self.spark.createDataFrame(kept, MANIFEST).unionByName(made.select("start", "file", "rows"))
        number = (self._versions() or [0])[-1] + 1
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{number:09d}")
        return {"rewritten": len(touched), "kept": len(kept)}

    def upsert(self, incoming: DataFrame, order: str = "indexed_at") -> dict[str, int]:
        """Put in or replace rows whole, the latest of each key."""
        return self.replace(latest(incoming.select(*self.schema.names), [self.key], order))

    def delete(self, ids: DataFrame) -> dict[str, int]:
        return self.replace(self.spark.createDataFrame([], self.schema), ids)

    def vacuum(self) -> int:
        """Delete what the last manifest doesn't name: older manifests and files.  The number of files deleted."""
        named, versions = {f.file for f in self.files()}, self._versions()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for v in versions[:-1]:
            old = hadoop(f"{self.folder}/manifests/{v:09d}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        root = hadoop(f"{self.folder}/data")
        fs, deleted = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for f in fs.globStatus(hadoop(root, "*/*/*.parquet")) or []:
            if "/".join(f.getPath().toString().split("/")[-3:]) not in named:
                deleted += int(fs.delete(f.getPath(), False))
        return deleted
