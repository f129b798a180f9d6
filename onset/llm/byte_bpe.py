"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file and the pattern is a parameter; no special token
exists, so their strings are ordinary text. Long texts are encoded in chunks that
end where a match of the pattern ends whatever follows, which gives the same ids
with bounded working memory. Decoding gives bytes, since the ids of a part of a
text need not be valid UTF-8.

Defined cases: a null text counts as empty and has no ids; null ids decode to no
bytes; repeated rows each return; an empty table gives an empty result; columns
other than the key and the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from onset.llm.common import bound_batches, release
from onset.llm.pieces import slices

CHUNK = 1 << 16
#: Places where a match ends and none reaches over: before white space that
#: follows anything else, and between letters, digits and signs except where a
#: contraction could be. Plain ranges only, which every Unicode version reads alike.
SAFE = regex.compile(r"(?<=[!-~¡-ɏͰ-ӿ぀-ヿ一-鿿가-힣])(?=[ \t\n\x0b\x0c\r])|(?<=[ぁ-ゖ一-鿋가-힣])(?=[。、，！？])|(?<=[A-Za-z])(?=[0-9!-/:-@])|(?<=[0-9])(?=[A-Za-z!-/:-@])")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of ``size`` characters or somewhat more, cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """One to a Python worker, which keeps it from task to task."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, path: str, pattern: str, size: int = CHUNK) -> list[int]:
    encoding = codec(path, pattern)
    if not text or len(text) <= size:
        return encoding.encode_ordinary(text or "")
    return [i for part in chunks(text, size) for i in encoding.encode_ordinary(part)]


def _lists(found: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.fromiter((i for ids in found for i in ids), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key``, ``ids`` and, if asked for, the bytes that the ids decode to."""
    bound_batches(docs.sparkSession)
    schema = f"key {docs.schema[key].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(path, pattern)
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                found = [encode_text(t, path, pattern) for t in rows.column("text").to_pylist()]
                columns = {"key": rows.column("key"), "ids": _lists(found)}
                if decoded:
                    columns["decoded"] = pa.array([encoding.decode_bytes(ids) for ids in found], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
        release()

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded``, the raw bytes of ``ids``."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "decoded": pa.array([encoding.decode_bytes(x or []) for x in batch.column("ids").to_pylist()], pa.binary())})

    schema = f"key {rows.schema[key].dataType.simpleString()}, decoded binary"
    return rows.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, schema).withColumnRenamed("key", key)
