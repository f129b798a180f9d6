"""Token ids in Arrow files of equal-length sequences.

The documents of a shard, in ascending order of their key, are one stream of ids
that is cut into sequences of ``length`` ids. A shard has two files in Arrow's
stream-file format (the IPC file, whose footer locates each batch): ``ids``, a
fixed-size list of unsigned integers a row, with ``mask``, true for ids and false
for the padding at a shard's end; and an index of ``key``, ``start``, ``n_tokens``.
Nothing is compressed and every batch but the last has the same number of rows,
so sequence i is row i % rows of batch i // rows, read by mapping the file.

Files get a name of their own for each attempt of a task; the manifest, a table
that Spark commits, names those that count. A lost executor costs no more than
the tasks that it was running.

Defined cases: a null text counts as empty and has the end id alone; null keys
come first; rows with equal keys are in the order of their texts; an empty table
gives an empty manifest; columns other than the key and the text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onset.llm.common import bound_batches, new_path, release, written
from onset.llm.pieces import encoder, slices

LENGTH, ROWS = 1024, 256
#: Bytes of text that a shard gets, about; the number of shards follows from it.
SHARD_BYTES = 256 << 20
MANIFEST = "shard int, ids_file string, index_file string, n_docs long, n_tokens long"


def _open(uri: str):
    """File system and path of a folder of the shared store."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class ShardWriter:
    """The two files of one shard."""

    def __init__(self, folder: str, name: str, dtype: str, key_type: pa.DataType, length: int = LENGTH, rows: int = ROWS):
        fs, root = _open(folder)
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))], {"rows": str(rows)})
        self.index_schema = pa.schema([("key", key_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.names = f"{folder}/{name}.ids.arrow", f"{folder}/{name}.index.arrow"
        self.sinks = [fs.open_output_stream(f"{root}/{name}.{kind}.arrow") for kind in ("ids", "index")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.rest, self.n_docs, self.n_tokens = np.zeros(0, self.dtype), 0, 0

    def _put(self, ids: np.ndarray, n: int) -> None:
        """Full sequences, of whose ids the first ``n`` count."""
        mask = pa.array(np.arange(ids.size) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, keys: pa.Array, ids: np.ndarray, widths: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(widths) - widths
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(widths)], schema=self.index_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(keys), self.n_tokens + int(widths.sum())
        self.rest, step = np.append(self.rest, ids.astype(self.dtype)), self.length * self.rows
        full = self.rest.size // step * step
        for at in range(0, full, step):
            self._put(self.rest[at : at + step], step)
        self.rest = self.rest[full:].copy()

    def close(self) -> None:
        if n := self.rest.size:
            self._put(np.append(self.rest, np.zeros(-n % self.length, self.dtype)), n)
        for x in (self.ids, self.index, *self.sinks):
            x.close()


class ShardReader:
    """Random access to a shard. Sequences are views of the mapped file where the
    file system can map."""

    def __init__(self, ids_file: str, index_file: str):
        self.ids, self.index = (pa.ipc.open_file(self._source(x)) for x in (ids_file, index_file))
        self.length, self.rows = self.ids.schema.field("ids").type.list_size, int(self.ids.schema.metadata[b"rows"])
        self.batch, self.values = -1, np.zeros(0)

    @staticmethod
    def _source(uri: str):
        from pyarrow.fs import LocalFileSystem

        fs, path = _open(uri)
        return pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        batch = self.ids.get_batch(i // self.rows)
        at = i % self.rows * self.length
        return batch.column("ids").values.to_numpy(zero_copy_only=True)[at : at + self.length], batch.column("mask").values.slice(at, self.length)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``, across sequences and batches."""
        step, parts = self.length * self.rows, []
        while n > 0:
            if start // step != self.batch:
                self.batch = start // step
                self.values = self.ids.get_batch(self.batch).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = self.values[start % step : start % step + n]
            parts.append(part)
            start, n = start + part.size, n - part.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.values.dtype)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write_token_files(docs: DataFrame, path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", folder: str | None = None, length: int = LENGTH, rows: int = ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts by the tokenizer at ``path`` and write them; the manifest.

    Rows are dealt by ranges of the key, and of the text's hash where keys are
    equal; a shard is one range. Shards are numbered in ascending order. There are
    as many as shuffle partitions, more where that gives over ``shard_bytes`` each.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or new_path(spark, "tokens")
    fs, root = _open(folder)
    fs.create_dir(root)
    volume = docs.select(F.sum(F.octet_length(docs[text]).cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        to, by = None, encoder(path)
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                if to is None:
                    to = ShardWriter(folder, f"{shard:06d}-{uuid.uuid4().hex}", "<u2" if max(by.n_ids, (end_id or 0) + 1) <= 1 << 16 else "<u4", part.schema.field("key").type, length, rows)
                ids, at = by.encode(part.column("text"))
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(at.size)
                to.add(part.column("key"), ids, np.diff(at))
        if to:
            to.close()
            encoder.cache_clear()  # the worker may idle for long
            release()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "ids_file": [to.names[0]], "index_file": [to.names[1]], "n_docs": [to.n_docs], "n_tokens": [to.n_tokens]})

    dealt = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    return written(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (little-endian unsigned 32-bit integers), read back from the files."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "ids_file", "index_file", before.alias("before"))  # a row a shard, few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["ids_file"], row["index_file"])
                for docs in reader.documents():
                    starts, widths = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
                    at = 0
                    while at < len(starts):  # documents of about a million ids at a time
                        to = at + 1
                        while to < len(starts) and starts[to] + widths[to] - starts[at] < 1 << 20:
                            to += 1
                        ids = pa.array([reader.span(s, n).astype("<u4").tobytes() for s, n in zip(starts[at:to], widths[at:to], strict=True)], pa.binary())
                        yield pa.RecordBatch.from_pydict({"key": docs.column("key").slice(at, to - at), "start": pa.array([s + row["before"] for s in starts[at:to]], pa.int64()), "n_tokens": pa.array(widths[at:to], pa.int64()), "ids": ids})
                        at = to

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"key {key_type}, start long, n_tokens long, ids binary"
    return shards.repartition(n).mapInArrow(run, schema).withColumnRenamed("key", key)
