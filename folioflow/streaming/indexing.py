"""Continuous indexing: micro-batches replace and delete documents by id; replaying one changes nothing.

The table is dealt into buckets by ranges of the key's hash.  A batch is written as deltas of the
buckets that it touches, deletions as tombstones, so what is written follows the batch.  A bucket of
many deltas has them merged into one, or, once they are a fair share of it, into its base; a base that
has grown too large is written as two buckets of half the range each (extendible hashing), the others
stay.  A manifest a batch names the files that count; files that no replay can ask for are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables

GONE = "_deleted"


@dataclass
class Bucket:
    """A range of hashes, named by its first bits, with its base and deltas: folders and their rows."""

    bits: str
    base: list | None = None
    deltas: list = field(default_factory=list)

    def rows(self) -> int:
        return (self.base[1] if self.base else 0) + sum(n for _, n in self.deltas)

    def start(self) -> int:
        return int(self.bits.ljust(64, "0"), 2)


class StreamTable:
    """A table of buckets below one folder.

    ``depth``: bits that name a bucket at first; ``most``: deltas of a bucket before they are merged;
    ``share``: deltas are merged into the base once they have so much of its rows; ``capacity``:
    rows of a base before it splits.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "external_id", order: str = "indexed_at", depth: int = 4, most: int = 8, share: float = 0.25, capacity: int = 1_000_000):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order
        self.schema = T.StructType([f for f in schema.fields if f.name != GONE])
        self.stored = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        self.depth, self.most, self.share, self.capacity = depth, most, share, capacity

    # --- files

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._path(path)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def _delete(self, path: str) -> None:
        fs, where = self._path(path)
        fs.delete(where, True)

    def manifests(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith("."))

    def state(self, before: int = 1 << 60) -> list[Bucket]:
        """The buckets as they stood before a batch; an entry a bucket."""
        known = [n for n in self.manifests() if n < before]
        if not known:
            return [Bucket(format(i, f"0{self.depth}b") if self.depth else "") for i in range(1 << self.depth)]
        fs, where = self._path(f"{self.folder}/manifests/{known[-1]:012d}.json")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Bucket(*b) for b in json.loads(text)]

    def _keep(self, batch: int, state: list[Bucket]) -> None:
        """Put the manifest of a batch in place as a whole."""
        text = json.dumps([[b.bits, b.base, b.deltas] for b in state])
        fs, part = self._path(f"{self.folder}/manifests/.{batch:012d}.part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, where = self._path(f"{self.folder}/manifests/{batch:012d}.json")
        fs.delete(where, False)
        fs.rename(part, where)

    # --- rows

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*(f"{self.folder}/{f}" for f in folders))

    def _bucket(self, state: list[Bucket]) -> Column:
        """The bits of the bucket that a key's hash falls into."""
        ordered = sorted(state, key=Bucket.start)
        starts, names = np.array([b.start() for b in ordered], np.uint64), np.array([b.bits for b in ordered], object)

        @F.pandas_udf("string")
        def find(h: pd.Series) -> pd.Series:
            return pd.Series(names[np.searchsorted(starts, h.to_numpy().astype(np.int64).view(np.uint64), side="right") - 1])

        return find(F.xxhash64(self.key))

    def _winners(self, df: DataFrame) -> DataFrame:
        """Of each key the latest version; of versions of one time a deletion counts first."""
        ranked = df.withColumn("_kept", F.coalesce(~F.col(GONE), F.lit(True)))
        return tables.latest(ranked, [self.key], self.order, first="_kept").drop("_kept")

    def _merged(self, state: list[Bucket]) -> DataFrame:
        """Rows of the buckets, tombstones too: base rows that no delta names pass without a shuffle."""
        base = self._read([b.base[0] for b in state if b.base])
        deltas = [f for b in state for f, _ in b.deltas]
        if not deltas:
            return base
        changed = self._read(deltas)
        keys = changed.select(self.key).distinct()
        touched = base.join(keys, self.key, "left_semi")
        return tables.without_keys(base, keys, self.key).unionByName(self._winners(touched.unionByName(changed)))

    def _write(self, df: DataFrame, state: list[Bucket], folder: str) -> dict[str, int]:
        """Write rows by bucket below a folder; the rows of each bucket that has any."""
        rows = df.withColumn("bucket", F.concat(F.lit("b"), self._bucket(state)))
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{folder}")
        names = [n for n in self._names(f"{self.folder}/{folder}") if n.startswith("bucket=")]
        if not names:
            return {}
        there = self.spark.read.schema(T.StructType([*self.stored.fields, T.StructField("bucket", T.StringType())])).parquet(f"{self.folder}/{folder}")
        return {r["bucket"][1:]: r["n"] for r in there.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket

    # --- batches

    def before(self, batch: int) -> DataFrame:
        """The table as it stood before a batch."""
        return self._merged(self.state(batch)).filter(~F.coalesce(F.col(GONE), F.lit(False))).drop(GONE)

    def current(self) -> DataFrame:
        return self.before(1 << 60)

    def apply(self, batch: int, df: DataFrame) -> None:
        """Put a batch in: the latest version of each key, inside it and across batches; rows that are true in ``_deleted`` delete.

        An older version that arrives late does not replace a newer one, nor bring back what was
        deleted since; a newer one does.  A batch without rows changes nothing.
        """
        state = self.state(batch)
        gone = F.col(GONE) if GONE in df.columns else F.lit(False)
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.coalesce(gone, F.lit(False)).alias(GONE))
        folder = f"data/batch={batch:012d}"
        counts = self._write(self._winners(rows), state, f"{folder}/deltas")
        for b in state:
            if b.bits in counts:
                b.deltas.append([f"{folder}/deltas/bucket=b{b.bits}", counts[b.bits]])
        full = [b for b in state if len(b.deltas) > self.most]
        major = [b for b in full if not b.base or sum(n for _, n in b.deltas) >= self.share * b.base[1]]
        state = self._compact(state, major, f"{folder}/bases", True)
        state = self._compact(state, [b for b in full if b not in major], f"{folder}/merged", False)
        self._keep(batch, state)
        self._forget(batch)

    def _compact(self, state: list[Bucket], these: list[Bucket], folder: str, major: bool) -> list[Bucket]:
        if not these:
            return state
        halves = lambda b: [Bucket(b.bits + "0"), Bucket(b.bits + "1")] if major and b.rows() > self.capacity and len(b.bits) < 63 else [Bucket(b.bits, None if major else b.base)]
        made = [h for b in these for h in halves(b)]
        rows = self._merged(these) if major else self._winners(self._read([f for b in these for f, _ in b.deltas]))
        stay = [b for b in state if b not in these]
        counts = self._write(rows, stay + made, folder)
        for b in made:
            if b.bits in counts:
                where = [f"{folder}/bucket=b{b.bits}", counts[b.bits]]
                if major:
                    b.base = where
                else:
                    b.deltas = [where]
        return stay + made

    def _forget(self, batch: int) -> None:
        """Delete manifests before the one that a replay of this batch reads, and files that neither names."""
        old = [n for n in self.manifests() if n < batch]
        for n in old[:-1]:
            self._delete(f"{self.folder}/manifests/{n:012d}.json")
        named = {f for n in (batch, batch + 1) for b in self.state(n) for f in [*([b.base[0]] if b.base else []), *(d for d, _ in b.deltas)]}
        for b in self._names(f"{self.folder}/data"):
            if int(b.split("=")[1]) > batch:
                continue
            left = 0
            for kind in self._names(f"{self.folder}/data/{b}"):
                for bucket in self._names(f"{self.folder}/data/{b}/{kind}"):
                    if f"data/{b}/{kind}/{bucket}" in named:
                        left += 1
                    elif bucket.startswith("bucket="):
                        self._delete(f"{self.folder}/data/{b}/{kind}/{bucket}")
            if not left:
                self._delete(f"{self.folder}/data/{b}")


def index_stream(stream: DataFrame, table: StreamTable, checkpoint: str) -> StreamingQuery:
    """Run available files through ``foreachBatch`` into the table; a boolean column ``_deleted`` of the stream marks deletions."""
    return stream.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else table.apply(n, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
