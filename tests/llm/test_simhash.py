from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from onset.llm import simhash
from onset.llm.graph import components
from onset.llm.queries import op1_simhash
from tests.llm.samples import ODD, SCHEMA, SF, documents, odd, ordered


def brute_print(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows: list[tuple[int | None, int]], errors: int = 3) -> list[int]:
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= errors:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_against_brute_force(spark):
    rows = [(k, brute_print(t)) for k, t in documents()]
    want = [(k, f"{p:016x}", c) for (k, p), c in zip(rows, brute_classes(rows), strict=True)]
    assert ordered(op1_simhash(spark, SF).collect()) == ordered(want)


def test_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    rows = [(r[0], brute_print(r[1])) for r in ODD]
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in found}
    assert len(found) == len(ODD) and got == set(rows)
    zero = [r["component_id"] for r in found if r["fp"] == 0]
    assert zero == [1, 1, 1]
    assert {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}


@pytest.mark.parametrize(("bucket", "flips"), [(4096, 4), (3, 4), (1, 3)])
def test_links_against_brute_force(spark, bucket, flips):
    """Dense clusters, so that small buckets are dealt again and again."""
    rng = random.Random(bucket)
    codes = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    rows = [(n, c) for n, c in enumerate(sorted(codes))]
    reps = spark.createDataFrame([(n, c - (1 << 64) if c >> 63 else c) for n, c in rows], "rep long, fp long")
    root = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(reps, bucket)).collect()}
    assert [root.get(n, n) for n, _ in rows] == brute_classes(rows)


def test_trie_blocks_are_bounded_and_whole():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 10, 600, dtype=np.uint64) | np.uint64(5 << 48))
    small, large = (simhash.trie_join(codes, np.array([0]), np.array([codes.size]), 16, block=b).root for b in (8, 1 << 17))
    assert (small == large).all()


def test_hot_class_and_chain(spark):
    """A third of all rows in one class; a long chain of links."""
    chain = [((1 << (2 * n)) - 1, n) for n in range(30)]
    codes = spark.createDataFrame([(n, c - (1 << 64) if c >> 63 else c) for c, n in chain], "rep long, fp long")
    assert {r["root"] for r in components(simhash.fingerprint_links(codes)).collect()} == {0}
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same words again").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.md5(F.col("id").cast("string")), F.lit(" end"))).alias("text"))
    found = simhash.near_duplicates(docs)
    assert found.where("doc_id % 3 = 0").select("component_id").distinct().collect()[0][0] == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("doc_id = component_id").count()


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
