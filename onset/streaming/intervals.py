"""First-appearance intervals of arriving observations.

An observation may arrive long after its capture date and change a key's first
present date, so a summary of the past is not enough: each micro-batch adds its
rows to the observations table and recomputes the keys that it touched, whole. That
table is in folders by a bucket of the key, and only those of the touched keys are
read. The result table holds one folder a batch; the latest row of a key counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from onset.operators.series import first_appearance


#: Folders that the observations are dealt over.
BUCKETS = 512


def start_intervals(stream: DataFrame, key: str, order: list[str], folder: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Run over what has arrived. A batch that runs again overwrites its folders. The
    number of buckets is that of the first run for good."""
    schema = StructType([*stream.schema.fields, StructField("bucket", IntegerType())])

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={number}")
        new = spark.read.schema(schema).parquet(f"{folder}/rows/batch={number}")
        some = [r[0] for r in new.select("bucket").distinct().collect()]  # no more than there are
        rows = spark.read.schema(schema).parquet(f"{folder}/rows").where(F.col("bucket").isin(some)).drop("bucket", "batch")
        touched = new.select(key).distinct()
        first_appearance(rows.join(touched, key, "left_semi"), key, order).write.mode("overwrite").parquet(f"{folder}/intervals/batch={number}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(add).start()


def latest_intervals(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each key, of the folders with their ``batch``."""
    rest = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
