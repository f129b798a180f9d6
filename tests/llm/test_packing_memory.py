from __future__ import annotations

import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from onset.llm import packing
from onset.llm.pieces import PieceEncoder, slices
from tests.llm.samples import documents


def peak(batch: pa.RecordBatch, **limit) -> tuple[list[int], float]:
    """The ids, and the MB that encoding took at once beside them."""
    encoder, ids, most = PieceEncoder(P.path("byte_bpe_50k.json")), [], 0
    for part in slices(batch, "text", **limit):
        tracemalloc.start()
        found, _ = encoder.encode(part.column("text"))
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        ids += found.tolist()
    return ids, most / 1e6


def test_packing_encodes_in_small_slices():
    texts = [t or "" for _, t in documents()]
    texts *= 1 + (4 << 20) // sum(len(t.encode()) for t in texts)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    ids, small = peak(batch, most=packing.BYTES)
    same, large = peak(batch)
    assert ids == same and small < 40 < large
