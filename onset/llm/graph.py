"""Connected components of a table of links: joined within tasks, then alternating stars.

A task joins the links that it holds and tells the stars of their forest, ``PART`` links
at once; up to ``PART`` links in all are then joined in one task. That is the usual case,
and a handful of jobs: what a job costs the driver (plans, broadcasts, closures) does not
depend on its rows, so many jobs over few links cost it memory for nothing.

More links go by alternating stars: each round hangs the neighbours of a node to the
smallest of them, first those above the node, then those below it, and tasks join again
what they hold. The nodes that hang on the smallest of their component stay there, and
each round adds some to them, so rounds end; a handful suffices. Rounds are written to
the shared folder, which ends their lineage.

Defined cases: null ends and loops are no links; repeated links count once; an empty
table of links gives no roots; other columns are not read. Ends are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onset.llm.common import release, table_rows, written

#: Links that a task joins at once: numbers, some 30 MB of a worker's memory.
PART = 1 << 18


class Forest:
    """Union of indexes, told in blocks of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(nodes.size)
    forest.join(at[: u.size], at[u.size :])
    hang = np.flatnonzero(forest.root != np.arange(nodes.size))
    return nodes[hang], nodes[forest.root[hang]]


def _joined(links: DataFrame, part: int) -> DataFrame:
    """``u`` > ``v``: links that connect what ``links`` connect. Each task joins its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(np.asarray(batch.column(c)) for c in ("u", "v")))
            n += batch.num_rows
            if n > part:
                now = stars(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [now], now[0].size
                if 2 * n > part:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, now)), ["u", "v"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held, strict=True))))), ["u", "v"])
        release()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _starred(links: DataFrame) -> bool:
    """Whether each node above hangs on one node, which hangs on none."""
    ends = links.select(F.col("u").alias("node"), "v", F.lit(0).alias("below")).unionByName(links.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("below")))
    nodes = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("below").alias("below"))
    return not table_rows(nodes.where("least < most or least is not null and below = 1"))


def components(links: DataFrame, a: str = "a", b: str = "b", part: int = PART) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node
    but the roots. Null ends and loops are no links."""
    ends = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    # written first: links that Python tells would take each task a second worker
    now = written(_joined(written(ends.where("u > v"), "links"), part), "links")
    while now.count() > part:
        if _starred(now):
            return written(now.distinct(), "links").toDF("node", "root")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(_joined(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), part), "links")
        # what hangs below: all v < u
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = written(_joined(small, part), "links")
    return written(_joined(now.coalesce(1), part), "links").toDF("node", "root")
