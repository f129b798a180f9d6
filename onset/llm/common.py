"""What the operators share: the cluster's shared folder and written tables."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rule `[^\x20\x09-\x0D]+` sees it.
SPACES = " \t\n\x0b\x0c\r"
#: The same set inside a Java or RE2 character class.
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as
    in the tests, may leave it unset; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file:///tmp/checkpoints/{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of the scopes that are open, for :func:`scratch` to remove.
_scopes: list[list[str]] = []
#: Removes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at its end, but for those to keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a
    lost executor costs no more than the tasks that it was running. Its shuffle
    files go when it is written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that :func:`join_few` broadcasts at most; salts beyond.
FEW, SALTS = 100_000, 32


def join_few(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: str) -> DataFrame:
    """Join with a table that has each key once and few keys as a rule. It is
    written and counted first: up to ``FEW`` rows are broadcast, so ``left`` stays
    where it is; more are copied to ``SALTS`` salts, over which the rows of each
    key are dealt by their column ``spread``."""
    right = written(right, "few")
    if right.count() <= FEW:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


#: Keys that :func:`without` broadcasts at most: long integers, so 40 MB or so.
MANY = 1_000_000


def without(df: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key``, a long, is in the column of that name
    of ``losers``. The losers are written and counted first: up to ``MANY`` are
    broadcast and ``df`` stays where it is; more take a sort-merge join, which
    spills and splits hot keys. Rows without a key stay."""
    gone = written(losers.select(F.col(key).cast("long").alias("_gone")).where("_gone is not null").distinct(), "losers", keep=True)
    side = F.broadcast(gone) if gone.count() <= MANY else gone.hint("merge")
    return df.join(side, df[key].cast("long") == gone["_gone"], "left_anti")


def release() -> None:
    """Give freed memory back to the system; Python workers stay for other tasks. What
    Arrow takes from here on comes from the system as well."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def table_rows(df: DataFrame) -> bool:
    """Whether ``df`` has any row."""
    return bool(df.limit(1).count())


def bound_batches(spark: SparkSession, rows: int = 4000, bytes_: int = 4 << 20) -> None:
    """Keep the batches that go to Python small, whatever the length of the texts:
    the session's limits are lowered to these, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)):
        now = spark.sql(f"SET {key}").first()["value"]
        number = int("".join(c for c in now if c.isdigit() or c == "-") or 0)
        if not 0 < number <= most:
            spark.conf.set(key, str(most))


def ascii_lower(text):
    """Lower-case A-Z and nothing else. ``lower`` has a fast path for plain
    ASCII, where the two agree; only other texts go letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def beta_prior(n: float | None, bad: float | None, squares: float | None, spread: float | None, groups: int) -> tuple[float, float]:
    """Alpha and beta of the prior over group rates, by the method of moments.

    ``n`` and ``bad`` are totals over the groups, ``squares`` the sum of n_i^2,
    ``spread`` the sum of bad_i^2 / n_i. Without evidence of any difference
    between groups the prior is strong; with a single group it is worth ten
    observations. No observations at all: Beta(1, 1).
    """
    if not n:
        return 1.0, 1.0
    mean = min(max(bad / n, 1e-6), 1 - 1e-6)
    room = n - squares / n
    if groups < 2 or room <= 0:
        strength = 10.0
    else:
        between = (spread - n * mean * mean) / (mean * (1 - mean)) - (groups - 1)
        rho = min(max(between / (room - (groups - 1)) if room > groups - 1 else 0.0, 1e-3), 0.5)
        strength = (1 - rho) / rho
    return mean * strength, (1 - mean) * strength
