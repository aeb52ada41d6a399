"""Token ids in Arrow stream files of equal-length sequences.

Each partition of the documents, in order of id, becomes one file: record batches of
fixed-size lists (ids and a mask of what is text, the last sequence padded), so any
sequence is a slice of a memory map.  A second small stream beside it says where each
document starts.  Files are written under a temporary name and renamed, so a task that
runs twice leaves the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .scratch import Scratch

#: Ids of one sequence, sequences of one record batch, bytes of text of one file at most but for single texts.
LENGTH = 1024
BATCH = 256
FILE_BYTES = 256 << 20
END_ID = 0


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def put_in_place(fs: pa.fs.FileSystem, temp: str, final: str) -> None:
    """Rename a finished file; where an earlier attempt of the task has left its equal, that stays."""
    if fs.get_file_info(final).type == pa.fs.FileType.NotFound:
        fs.move(temp, final)
    else:
        fs.delete_file(temp)


def id_type(vocabulary: int) -> np.dtype:
    """The narrowest unsigned integers that hold all ids."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class SequenceWriter:
    """Packs a stream of documents into one file of sequences and one of document places."""

    def __init__(self, folder: str, name: str, attempt: str, dtype: np.dtype, length: int = LENGTH):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/{name}.ids.arrows", f"{root}/{name}.docs.arrows"]
        self.temp = [f"{p}.{attempt}" for p in self.final]
        self.dtype, self.length, self.total = dtype, length, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(p) for p in self.temp]
        self.files = [pa.ipc.new_stream(s, x) for s, x in zip(self.sinks, (self.schema, self.places), strict=True)]
        self.rest = np.zeros(0, dtype)

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.total + np.cumsum(sizes) - sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.places))
        self.total += int(sizes.sum())
        stream = np.concatenate([self.rest, *ids]).astype(self.dtype, copy=False)
        step = self.length * BATCH
        whole = len(stream) // step * step
        for at in range(0, whole, step):
            self._write(stream[at : at + step], step)
        self.rest = stream[whole:]

    def _write(self, ids: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, np.arange(len(ids)) < n), self.schema, strict=True)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> int:
        if n := len(self.rest):
            self._write(np.append(self.rest, np.zeros(-n % self.length, self.dtype)), n)
        for f, s, a, b in zip(self.files, self.sinks, self.temp, self.final, strict=True):
            f.close()
            s.close()
            put_in_place(self.fs, a, b)
        return self.total


def read_batches(fs: pa.fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
    """Record batches of a file one after the other; local files are mapped, others read as a stream."""
    source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_stream(path)
    yield from pa.ipc.open_stream(source)


class SequenceFile:
    """Random access to the sequences of one file; local files are mapped, others held in memory (their size is bounded by FILE_BYTES)."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _filesystem(folder)
        self.ids = list(read_batches(self.fs, f"{root}/{name}.ids.arrows"))
        self.views = [b.column(0).values.to_numpy(zero_copy_only=True) for b in self.ids]
        self.per = BATCH * self.ids[0].column(0).type.list_size if self.ids else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        b, k = divmod(i, BATCH)
        return tuple(self.ids[b].column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file's stream; no copy within one batch."""
        b, at = divmod(start, self.per)
        if at + n <= self.per and n:
            return self.views[b][at : at + n]
        parts = []
        while n > 0:
            part = self.views[b][at : at + n]
            parts.append(part)
            n, b, at = n - len(part), b + 1, 0
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_sequences(df: DataFrame, folder: str, vocabulary: int, length: int = LENGTH) -> DataFrame:
    """Write rows (doc_id, ids BINARY of 32-bit ids), already in order within partitions; one row for each file."""
    dtype = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, writer = f"part-{task.partitionId():06d}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or SequenceWriter(folder, name, f"tmp-{task.taskAttemptId()}", dtype, length)
            ids = [np.frombuffer(b or b"", "<u4").astype(dtype) for b in batch.column("ids").to_pylist()]
            writer.add(batch.column("doc_id").to_pylist(), ids)
        if writer:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "n": pa.array([writer.close()], pa.int64())})

    return df.select("doc_id", "ids").mapInArrow(run, "part int, name string, n long")


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """From files (name, before): doc_id, start, n_tokens and the crc of the ids of each document, read as streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                ids = (b.column(0).values.to_numpy(zero_copy_only=True) for b in read_batches(fs, f"{root}/{name}.ids.arrows"))
                held, at = np.zeros(0, np.uint16), 0
                for docs in read_batches(fs, f"{root}/{name}.docs.arrows"):
                    found = []
                    for n in docs.column(2).to_pylist():
                        crc = 0
                        while n:
                            if at == len(held):
                                held, at = next(ids), 0
                            part = held[at : at + n]
                            crc, at, n = zlib.crc32(part.astype("<u4"), crc), at + len(part), n - len(part)
                        found.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + before), docs.column(2), pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("name", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def order_key(df: DataFrame) -> list:
    return [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]


def sequence_report(spark: SparkSession, docs: DataFrame, path: str, vocabulary: int = 50257, partitions: int | None = None, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write all documents' ids, an end id after each, in order of doc_id; then the files' contents by document.

    There are as many files as partitions, or as FILE_BYTES asks for if that is more.  Null and empty texts are an end id alone.  Rows of equal doc_id follow by the hash of their text; rows without
    an id come first.  An empty table writes no file and gives no rows.
    """
    scratch = Scratch(spark, "sequences")
    folder = folder or f"{scratch.path}/files"
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0  # one row
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(parts, *order_key(rows)).sortWithinPartitions(*order_key(rows))
    ids = bpe.encode(ordered, path, drop_text=True).select("doc_id", F.concat("ids", F.lit(bytearray(END_ID.to_bytes(4, "little")))).alias("ids"))
    files = scratch.save(write_sequences(ids, folder, vocabulary, length), "manifest")
    # one row for each file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = files.select("name", F.coalesce(before, F.lit(0)).alias("before"))
    return read_documents(places.repartition(parts, "name"), folder)
