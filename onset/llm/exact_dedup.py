"""Exact deduplication as a stream with keyed state on disk.

Rows are written once to an arrivals table, with the digest of the normalised
text. A streaming query reads their digests and keeps, for each, how many rows had
it, the stable identifier of the row that stays and its content locator (file and
row of the arrivals table). The state is Spark's RocksDB store with a checkpoint
in the shared folder; it never expires, and a stream that is started again with
more arrivals goes on from it. Rows whose digest was met before are hits: their
whole texts are compared, and where texts differ they are grouped by the text
itself instead.

Defined cases: null counts as the empty text; of equal texts the row with the
largest key stays, of equal keys the one that stands last in the arrivals table;
rows without a key stay only if no row of the group has one; an empty table gives
an empty result; further columns are carried by :func:`drop_copies` and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from onset.llm.common import ascii_lower, bound_batches, new_path, table_rows, without, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Arrival files that one micro-batch takes.
FILES = 2000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: Column) -> Column:
    return F.coalesce(ascii_lower(text), F.lit(""))


def track(spark: SparkSession, arrivals: str, state: str, schema: StructType, key: str) -> DataFrame:
    """Run the stream over the folder ``arrivals`` until it has seen all files:
    ``digest``, ``n`` and ``keep`` (key, file, row), one row a digest.

    ``state`` is a folder for the checkpoint and for the states that each
    micro-batch changed; calling again with it takes only new files.
    """
    seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(arrivals)
    states = seen.select("digest", _locator(key)).groupBy("digest").agg(F.count("*").alias("n"), F.max("at").alias("keep"))

    def keep_changes(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/states/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = states.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(keep_changes).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"digest string, n long, keep {states.schema['keep'].dataType.simpleString()}, batch int").parquet(f"{state}/states")
    return changes.groupBy("digest").agg(F.max_by("n", "batch").alias("n"), F.max_by("keep", "batch").alias("keep"))


def _locator(key: str) -> Column:
    return F.struct(F.col(f"doc.`{key}`").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")


def contents(hits: DataFrame, text: str) -> DataFrame:
    """``digest`` and ``t`` of the rows at ``file`` and ``row``. Only the files'
    texts are read, where they lie; no text of any other row is shuffled. A task
    holds the row numbers of one file, which one task has written."""
    bound_batches(hits.sparkSession)
    column = f"doc.{text}"

    def read(file: str, digests: list[str], numbers: list[int]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(file)
        with fs.open_input_file(path) as source:
            parquet, first, wanted = pq.ParquetFile(source), 0, np.array(numbers)  # ascending
            for group in range(parquet.num_row_groups):
                end = first + parquet.metadata.row_group(group).num_rows
                if np.searchsorted(wanted, first) == np.searchsorted(wanted, end):
                    first = end
                    continue
                for batch in parquet.iter_batches(batch_size=1000, row_groups=[group], columns=[column]):
                    a, b = np.searchsorted(wanted, (first, first + batch.num_rows))
                    if a < b:
                        texts = batch.column(0).field(0).take(pa.array(wanted[a:b] - first))
                        yield pa.RecordBatch.from_pydict({"digest": digests[a:b], "t": texts.cast(pa.string())})
                    first += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "digest", "row")), strict=True))
        for file, some in groupby(rows, itemgetter(0)):
            _, digests, numbers = zip(*some, strict=True)
            yield from read(file, list(digests), list(numbers))

    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are few, what they locate is not
    return hits.select("digest", "file", "row").repartition(n, "file").sortWithinPartitions("file", "row").mapInArrow(run, "digest string, t string")


def _groups(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], arrivals: str | None, state: str | None) -> tuple[DataFrame, DataFrame, bool]:
    """Add ``docs`` to the arrivals and run the stream over them: the stored rows
    (``doc``, ``digest``, ``id``, ``at``, and the normalised text ``t``), the groups
    of more than one row (``of``, ``t``, ``n``, ``keep``), and whether any digest
    stands for different texts; ``t`` of a group is null where it doesn't."""
    spark = docs.sparkSession
    arrivals, state = arrivals or new_path(spark, "arrivals"), state or new_path(spark, "dedup-state")
    # drawn once and stored, so it tells the rows of this call apart
    numbered = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), digest(normalised(docs[text])).alias("digest"), F.monotonically_increasing_id().alias("id"))
    numbered.write.mode("append").parquet(arrivals)
    schema = spark.read.parquet(arrivals).schema
    stored = spark.read.schema(schema).parquet(arrivals)
    rows = stored.select("doc", "digest", "id", _locator(key), normalised(F.col(f"doc.`{text}`")).alias("t"))
    none = F.lit(None).cast("string")
    if not table_rows(stored):
        return rows, rows.select(F.col("digest").alias("of"), none.alias("t"), F.lit(1).cast("long").alias("n"), F.col("at").alias("keep")), False
    groups = written(track(spark, arrivals, state, schema, key).where("n > 1"), "copies")
    # whole texts of one digest are equal if the smallest is the largest
    found = contents(rows.select("digest", "at.file", "at.row").join(groups.select("digest"), "digest"), text)
    unlike = written(found.select("digest", normalised(F.col("t")).alias("t")).groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("digest"), "unlike")
    if not table_rows(unlike):
        return rows, groups.select(F.col("digest").alias("of"), none.alias("t"), "n", "keep"), False
    split = rows.select("digest", "t", "at").join(unlike, "digest").groupBy("digest", "t").agg(F.count("*").alias("n"), F.max("at").alias("keep"))
    whole = groups.join(unlike, "digest", "left_anti").select("digest", none.alias("t"), "n", "keep")
    return rows, split.unionByName(whole).withColumnRenamed("digest", "of"), True


def _with_groups(rows: DataFrame, groups: DataFrame, unlike: bool, how: str) -> DataFrame:
    groups = groups.withColumnRenamed("t", "_t").hint("merge")
    same = F.col("digest") == F.col("of")
    return rows.join(groups, same & (F.col("_t").isNull() | (F.col("_t") == F.col("t"))) if unlike else same, how)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, arrivals: str | None = None, state: str | None = None) -> DataFrame:
    """``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``: one row a
    document that has arrived. Further columns of ``docs`` are not read.

    ``arrivals`` and ``state`` are folders of the shared store that last: a later
    call with them adds its documents, and the stream goes on from its state. By
    default both are new.
    """
    rows, groups, unlike = _groups(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", digest, arrivals, state)
    full = F.col("digest") if digest is sha256 else sha256(F.col("t"))
    joined = _with_groups(rows.select("doc.key", "digest", "at", full.alias("full"), *(["t"] if unlike else [])), groups, unlike, "left")
    keep = F.coalesce("keep", "at")
    return joined.select(F.col("key").alias(key), keep["key"].alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (keep == F.col("at")).alias("kept"), F.col("full").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are copies of one that stays. Only the digests
    of the documents are shuffled; whole rows stay where they are as long as
    :func:`onset.llm.common.without` can broadcast the numbers of those that go."""
    rows, groups, unlike = _groups(docs, key, text, sha256, None, None)
    losers = _with_groups(rows.select("digest", "id", "at", *(["t"] if unlike else [])), groups, unlike, "inner").where("at <> keep")
    return without(rows.select("doc", F.col("id").alias("_row")), losers.select(F.col("id").alias("_row")), "_row").select("doc.*")
