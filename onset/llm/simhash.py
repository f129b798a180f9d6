"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has the bits that are set in over half the hashes of its word
shingles. Fingerprints link at a Hamming distance of at most ``ERRORS``. Pairs are
found in binary tries: node pairs are followed down together, differing bits add
up, and a pair is dropped when they exceed the budget.

The top of the trie is dealt over the cluster. Of ``ERRORS + 1`` blocks of bits,
two linked fingerprints share one whole, so each fingerprint is turned so that
each block leads in turn, and fingerprints that share the leading block form a
bucket with a trie of its own. A bucket with over ``BUCKET`` fingerprints is dealt
again by the blocks of its remaining bits, which is exact for the same reason;
after the fifth time only 2^16 different fingerprints can share a bucket. A bucket
gives the links of a spanning forest, never all pairs.

Equal fingerprints are made one before, and documents find their class through
their fingerprint, so copies cost nothing however many there are.

Defined cases: a null text has no words; without words the fingerprint is zero and
is linked like any other; a row without a key links nothing, and its class is that
of its fingerprint or null; rows with equal keys each return; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.llm.common import bound_batches, join_few, release, scratch, without, written
from onset.llm.graph import Forest, components

SHINGLE, ERRORS, SEED = 3, 3, 42
#: Fixed bits of a bucket, by how often it was dealt: each time a quarter of the rest
#: more, rounded down, so that four blocks of that width find room in it.
FIXED = [16, 28, 37, 43, 48]
BUCKET = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of the shingles, in blocks."""
    words = text.translate(_LOWER).split()  # bytes split at exactly \x20 and \x09-\x0D
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        if words:
            yield np.array([h(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - k + 1, 1 << 15):
        some = words[at : at + (1 << 15) + k - 1]
        yield np.fromiter((h(b" ".join(x), SEED) for x in zip(*(some[i:] for i in range(k)), strict=False)), np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k):
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += hashes.size
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "fp": pa.array([fingerprint(t or b"", k) for t in texts], pa.int64())})
        release()

    schema = f"key {docs.schema[key].dataType.simpleString()}, fp long"
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)


def trie_join(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray, depth: int, errors: int = ERRORS, block: int = 1 << 17) -> Forest:
    """Link the codes (unsigned, ascending within each range [low, high), whose
    first ``depth`` bits are equal there) at up to ``errors`` differing bits.

    A node of a trie is a range of codes. Frontiers of node pairs are followed
    depth first in blocks of at most ``block`` pairs, so memory is bounded.
    """
    forest, sums = Forest(codes.size), {}
    many = highs - lows > 1
    frontier = (lows[many], highs[many], lows[many], highs[many], np.zeros(many.sum(), np.int64))
    stack = [(depth, frontier)]
    while stack:
        at, pairs = stack.pop()
        if pairs[0].size > block:
            half = pairs[0].size // 2
            stack += [(at, tuple(x[half:] for x in pairs)), (at, tuple(x[:half] for x in pairs))]
            continue
        al, ah, bl, bh, err = pairs
        # small pairs of nodes end here: their codes are compared
        few = (ah - al) * (bh - bl) <= 16
        if at == 64:
            few[:] = True
        if few.any():
            n = ((ah - al) * (bh - bl))[few]
            which = np.repeat(np.flatnonzero(few), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (bh - bl)[which]
            i, j = al[which] + k // wide, bl[which] + k % wide
            close = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= errors)
            forest.join(i[close], j[close])
        if few.all():
            continue
        al, ah, bl, bh, err = (x[~few] for x in pairs)
        if at not in sums:
            sums[at] = np.append(0, np.cumsum(codes >> np.uint64(63 - at) & np.uint64(1)).astype(np.int64))
        ones = sums[at]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        apart = ~same
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        parts.append((am[apart], ah[apart], bl[apart], bm[apart], err[apart] + 1))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= errors) & ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
        if live.any():
            stack.append((at + 1, tuple(x[live] for x in joined)))
    return forest


def _bucket_links(fixed: int, rows: int = 1 << 15):
    """For rows of ``path``, ``code``, ``rep`` in buckets that stand together:
    links ``a``, ``b`` between reps."""

    def links(path: np.ndarray, code: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        top = code >> np.uint64(64 - fixed)
        first = np.flatnonzero(np.append(True, (top[1:] != top[:-1]) | (path[1:] != path[:-1])))
        forest = trie_join(code, first, np.append(first[1:], code.size), fixed)
        hang = np.flatnonzero(forest.root != np.arange(code.size))
        return pa.RecordBatch.from_pydict({"a": rep[hang], "b": rep[forest.root[hang]]}) if hang.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64))
        for batch in batches:
            new = (np.asarray(batch.column("path")).astype(np.int64), np.asarray(batch.column("code")).view(np.uint64), np.asarray(batch.column("rep")))
            held = tuple(np.append(x, y) for x, y in zip(held, new, strict=True))
            if held[0].size >= rows:  # the last bucket may go on
                top = held[1] >> np.uint64(64 - fixed)
                cut = int(np.flatnonzero((top == top[-1]) & (held[0] == held[0][-1]))[0])
                if cut:
                    if (out := links(*(x[:cut] for x in held))) is not None:
                        yield out
                    held = tuple(x[cut:] for x in held)
        if held[0].size and (out := links(*held)) is not None:
            yield out

    return run


def _turned(code: Column, fixed: int, left: int, by: int) -> Column:
    """``code`` with its last ``left`` bits turned left by ``by``; the first
    ``fixed`` stay."""
    if not by:
        return code
    low = (1 << left) - 1
    top = code.bitwiseAND(F.lit(~low if fixed else 0).cast("long"))
    rest = code.bitwiseAND(F.lit(low).cast("long")) if fixed else code
    turned = F.shiftleft(rest, by).bitwiseOR(F.shiftrightunsigned(rest, left - by))
    return top.bitwiseOR(turned.bitwiseAND(F.lit(low).cast("long")) if fixed else turned)


def fingerprint_links(reps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a``, ``b``: links that connect all ``rep`` whose fingerprints ``fp`` are
    near. ``reps`` has each fingerprint once."""
    spark, found = reps.sparkSession, None
    bound_batches(spark, rows=1 << 15)
    rows, before = reps.select(F.lit(1).cast("long").alias("path"), F.col("fp").alias("code"), "rep"), 0
    for step, fixed in enumerate(FIXED):
        left, width = 64 - before, fixed - before
        blocks = [F.struct((F.col("path") * 4 + n).alias("path"), _turned(F.col("code"), before, left, n * width).alias("code")) for n in range(4)]
        dealt = rows.select(F.explode(F.array(*blocks)).alias("x"), "rep").select("x.path", "x.code", F.shiftrightunsigned("x.code", 64 - fixed).alias("top"), "rep")
        more = None
        if step + 1 < len(FIXED):
            big = written(dealt.groupBy("path", "top").count().where(F.col("count") > bucket).select("path", "top"), "buckets")
            if big.limit(1).count():
                more = written(dealt.join(big, ["path", "top"], "left_semi").select("path", "code", "rep"), "deeper")
                dealt = dealt.join(big, ["path", "top"], "left_anti")
        ordered = dealt.repartition("path", "top").sortWithinPartitions("path", "code").select("path", "code", "rep")
        links = written(ordered.mapInArrow(_bucket_links(fixed), "a long, b long"), "trie-links")
        found = links if found is None else found.unionByName(links)
        if more is None:
            return found
        rows, before = more, fixed
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key that is reachable:
    one row a document. Keys are integers."""
    prints = written(fingerprints(docs, key, text, k).select(F.col(key).cast("long").alias("key"), "fp"), "fingerprints")
    reps = written(prints.where("key is not null").groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "reps")
    # a key that stands in rows with different texts ties their fingerprints
    tied = prints.where("key is not null").groupBy("key").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp <> other").select("key")
    own = prints.join(tied, "key", "left_semi").join(reps, "fp").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    roots = components(fingerprint_links(reps, bucket).unionByName(own))
    classes = reps.join(roots, reps.rep == roots.node, "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "rep").alias("class"))
    # a fingerprint may be that of a third of all rows: few classes are broadcast, many salted
    return join_few(prints, classes, ["fp"], "left", "key").select(F.col("key").alias(key), "fp", F.coalesce("class", "key").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the rows of the smallest key of each class only; rows that
    repeat that key all stay."""
    with scratch(docs.sparkSession):
        return without(docs, near_duplicates(docs, key, text).where(F.col("component_id") != F.col(key)).select(key), key)
