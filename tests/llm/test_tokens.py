from __future__ import annotations

import base64
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onset.llm import byte_bpe, packing, token_files
from onset.llm.pieces import PieceEncoder
from onset.llm.queries import op2_byte_bpe, op4_token_files, op5_packing
from tests.llm.samples import LONG, ODD, SCHEMA, SF, documents, odd, ordered

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@lru_cache
def plain():
    return Tokenizer.from_file(JSON)


@lru_cache
def ranks():
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})


def ids_of(text: str | None) -> list[int]:
    return plain().encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    letters = [*"abstmdrevlL '''\"  \t\n　 é中😀1٣²½!.\u0085​\u001c", "'s", "'re", "'ll", " '", "<|endoftext|>", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_the_librarys_added_tokens_are_kept():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", None, "x<|endoftext|>'s  <|endoftext|> ", "plain"]
    ids, at = PieceEncoder(JSON).encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts]
    assert ids_of(texts[0]) == [64, 220, 50256, 275]


@pytest.mark.parametrize("recent", [3, 600_000])
def test_pieces_are_the_librarys(recent):
    encoder = PieceEncoder(JSON, recent)
    for texts in (noise(1, 400), [None, "", LONG], noise(2, 400), []):
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts]


def test_a_slice_of_a_column():
    texts = pa.array(noise(3, 50), pa.string())
    ids, at = PieceEncoder(JSON).encode(texts.slice(7, 20))
    assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts.to_pylist()[7:27]]


def test_chunks_are_safe():
    for text in [*noise(4, 300), LONG]:
        for size in (1, 5, 1000):
            parts = list(byte_bpe.chunks(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in ranks().encode_ordinary(p)] == ranks().encode_ordinary(text)


def test_byte_bpe_query(spark):
    want = []
    for key, text in documents():
        ids = ranks().encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(op2_byte_bpe(spark, SF).collect()) == ordered(want)


def test_byte_bpe_odd_rows(spark):
    rows = byte_bpe.encode(odd(spark), RANKS, P.PATTERN)
    assert ordered((k, list(i)) for k, i in rows.collect()) == ordered((r[0], ranks().encode_ordinary(r[1] or "")) for r in ODD)
    back = byte_bpe.decode(rows, RANKS, P.PATTERN).collect()
    assert ordered((k, bytes(b).decode()) for k, b in back) == ordered((r[0], r[1] or "") for r in ODD)
    assert byte_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN, decoded=True).count() == 0


def test_token_files_query(spark):
    want, at = [], 0
    for key, text in sorted(documents()):
        ids = [*ids_of(text), 2]
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert ordered(op4_token_files(spark, SF).collect()) == ordered(want)


def test_token_files_are_equal_length_and_mapped(spark):
    manifest = token_files.write_token_files(odd(spark), JSON, length=16, rows=4)
    seen, total = {}, 0
    for row in sorted(manifest.collect(), key=lambda r: r["shard"]):
        reader = token_files.ShardReader(row["ids_file"], row["index_file"])
        for docs in reader.documents():
            for key, start, n in zip(*(docs.column(c).to_pylist() for c in ("key", "start", "n_tokens")), strict=True):
                seen.setdefault(key, []).append(list(reader.span(start, n)))
                assert start < row["n_tokens"]
        last = -(-row["n_tokens"] // 16) - 1
        ids, mask = reader.sequence(last)
        assert len(ids) == 16 and sum(mask.to_pylist()) == row["n_tokens"] - 16 * last
        total += row["n_tokens"]
    want = {}
    for r in ODD:
        want.setdefault(r[0], []).append([*ids_of(r[1]), 2])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    back = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r["start"] for r in back] == list(np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1]) and back[-1]["start"] + back[-1]["n_tokens"] == total
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in ODD), key=lambda x: -1 if x is None else x)
    empty = token_files.write_token_files(spark.createDataFrame([], SCHEMA), JSON)
    assert token_files.read_token_files(empty).count() == 0


def check_pieces(rows, docs):
    """Each id in one piece, sequences gapless, padding only by the rule."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return by_doc, padding


def test_packing_query(spark):
    rows = op5_packing(spark, SF).collect()
    by_doc, padding = check_pieces(rows, None)
    assert padding == 0
    for key, text in documents():
        ids, at = [*ids_of(text), 0], 0
        for r in sorted(by_doc[key, len(ids)], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert len(by_doc) == len(documents())


def test_packing_odd_rows(spark):
    rows = packing.pack(odd(spark), JSON).collect()
    _, padding = check_pieces(rows, None)
    assert padding == 0 and sum(r["length"] for r in rows) == sum(len(ids_of(r[1])) + 1 for r in ODD)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_best_multiset_is_best():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(6))}
        room = rng.randrange(1, 90)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums}
        taken = packing.best_multiset(counts, room)
        assert all(taken[x] <= counts[x] for x in taken)
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)


def test_packer_with_a_small_window():
    """Remainders are cut where no sum fits; nothing is padded or lost."""
    rng = random.Random(6)
    packer, pieces, sizes = packing.Packer(window=32, pool=1), [], [rng.choice([0, 1, 17, 18, 31, 32, 200]) for _ in range(500)]
    for key, size in enumerate(sizes):
        pieces += packer.add(key, np.arange(size))
        assert packer.n <= 32
    pieces += packer.end()
    seen, used = {}, {}
    for key, start, ids, size, sequence, offset in pieces:
        assert size == sizes[key] and list(ids) == list(range(start, start + len(ids))) and offset == used.get(sequence, 0)
        seen[key], used[sequence] = seen.get(key, 0) + len(ids), offset + len(ids)
    assert seen == {k: s for k, s in enumerate(sizes) if s}
    assert all(n <= 32 and n & (n - 1) == 0 for n in used.values())


def test_packing_prefers_whole_documents(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), (F.col("id") % 97 + 5).cast("int")).alias("text")).coalesce(1)
    rows = packing.pack(docs, JSON).collect()
    cut = sum(1 for r in rows if r["length"] < r["doc_tokens"])
    assert cut <= 20
