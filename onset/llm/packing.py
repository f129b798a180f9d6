"""Packing of documents into sequences by minimum bin slack.

A document's full windows are sequences of their own; what remains of it waits in
a pool. A window takes the longest waiting remainder and then, of all multisets of
waiting lengths, one whose sum comes closest to what the window has left. Sums
that can be reached are the bits of an integer, one for each length and power of
two of its count, and the counts are found by going back through those integers.
A remainder is cut only to fill what no sum could; a partition's last window is
cut into powers of two, which need no padding.

A partition's state is the pool: at most ``POOL`` remainders of under one window,
whatever the input. There is no shuffle, so a task that runs again gives the same
pieces.

Defined cases: a null text counts as empty and has the end id alone; documents of
any length are cut into windows; rows with equal keys are documents of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from onset.llm.common import bound_batches, release
from onset.llm.pieces import encoder, slices

WINDOW, POOL = 1024, 2048
#: Bytes of texts that are encoded at once, and rows that are told at once. Encoding takes
#: some 14 times the bytes; neither changes a result.
BYTES, ROWS = 1 << 20, 500


def best_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum is as close to ``room`` as
    can be without passing it. Lengths are tried in descending order, and trying
    ends when ``room`` itself is reached."""
    reached, keep, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reached))
            reached = (reached | reached << length * times) & keep
            left, times = left - times, times * 2
        if reached >> room:
            break
    total, taken = reached.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:  # not without these
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return taken


class Packer:
    """Documents in, pieces out: key, start, ids, length of the document,
    sequence, offset."""

    def __init__(self, first_sequence: int = 0, window: int = WINDOW, pool: int = POOL):
        # so many remainders fill a window, however short
        self.window, self.most, self.sequence = window, max(pool, window), first_sequence
        self.counts: dict[int, int] = {}
        self.waiting: dict[int, list] = {}  # by length: key, start, ids, length of the document
        self.n = 0

    def _wait(self, item: tuple) -> None:
        size = len(item[2])
        self.waiting.setdefault(size, []).append(item)
        self.counts[size] = self.counts.get(size, 0) + 1
        self.n += 1

    def _take(self, size: int) -> tuple:
        item = self.waiting[size].pop()
        self.n -= 1
        self.counts[size] -= 1
        if not self.counts[size]:
            del self.counts[size], self.waiting[size]
        return item

    def _lay(self, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for item in items:
            yield (*item, self.sequence, offset)
            offset += len(item[2])
        self.sequence += 1

    def _window(self) -> list[tuple]:
        items = [self._take(max(self.counts))]
        if room := self.window - len(items[0][2]):
            for size, times in best_multiset(self.counts, room).items():
                items += [self._take(size) for _ in range(times)]
        room = self.window - sum(len(x[2]) for x in items)
        if room and self.n:  # every waiting remainder is longer than the room: one is cut
            key, start, ids, size = self._take(max(self.counts))
            items.append((key, start, ids[:room], size))
            self._wait((key, start + room, ids[room:], size))
        return items

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        whole = ids.size // self.window * self.window
        for at in range(0, whole, self.window):
            yield from self._lay([(key, at, ids[at : at + self.window], ids.size)])
        if ids.size > whole:
            self._wait((key, whole, ids[whole:].copy(), ids.size))
        while self.n > self.most:
            yield from self._lay(self._window())

    def end(self) -> Iterator[tuple]:
        while self.n:
            items = self._window()
            used = sum(len(x[2]) for x in items)
            if used == self.window:
                yield from self._lay(items)
                continue
            while used:
                step, part = 1 << used.bit_length() - 1, []
                used -= step
                while step:
                    key, start, ids, size = items.pop(0)
                    part.append((key, start, ids[:step], size))
                    if ids.size > step:
                        items.insert(0, (key, start + step, ids[step:], size))
                    step -= part[-1][2].size
                yield from self._lay(part)


def pack(docs: DataFrame, path: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """``key``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit
    integers), ``doc_tokens``, ``sequence_id``, ``offset``: one row a piece."""
    bound_batches(docs.sparkSession)
    schema = f"key {docs.schema[key].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        keys, starts, ids, sizes, sequences, offsets = zip(*pieces, strict=True)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, kind), "start": long(starts), "length": long([len(x) for x in ids]), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "doc_tokens": long(sizes), "sequence_id": long(sequences), "offset": long(offsets)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        by, packer, kind, out = encoder(path), Packer(TaskContext.get().partitionId() << 32, window, pool), pa.null(), []
        for batch in batches:
            kind = batch.schema.field("key").type
            for part in slices(batch, "text", BYTES):
                ids, at = by.encode(part.column("text"))
                ids = ids.astype("<u4")
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], end_id), at + np.arange(at.size)
                for n, x in enumerate(part.column("key").to_pylist()):
                    for piece in packer.add(x, ids[at[n] : at[n + 1]]):
                        out.append(piece)
                        if len(out) >= ROWS:
                            yield rows(out, kind)
                            out = []
        for piece in packer.end():
            out.append(piece)
            if len(out) >= ROWS:
                yield rows(out, kind)
                out = []
        if out:
            yield rows(out, kind)
        encoder.cache_clear()  # the worker may idle for long
        release()

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)
