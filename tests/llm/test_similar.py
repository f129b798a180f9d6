from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from onset.llm import similar
from onset.llm.graph import components
from onset.llm.simhash import fingerprint_links
from tests.llm.samples import SCHEMA, SF, documents
from tests.llm.test_simhash import brute_classes


def brute_shingles(text: str | None) -> set:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(k, brute_shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def made() -> list[tuple[int, str | None]]:
    """Families of edited texts, at all similarities about the limit, that share
    a passage with all others."""
    rng, rows = random.Random(3), []
    for family in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 12, 60, 200]))] + "a line that all of the texts have at their end".split() * (family % 2)
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
            rows.append(" ".join(words))
    rows += [None, "", " \t", "one", "ONE", "one two", "a b c d e f", "A b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("sample", "common", "block", "listed"), [(10_000, 200_000, 2000, 1000), (5, 3, 2000, 1000), (5, 3, 3, 2), (10_000, 200_000, 1, 8)])
def test_classes_against_brute_force(spark, monkeypatch, sample, common, block, listed):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "LISTED", listed)
    rows = made()
    got = {r["node"]: r["root"] for r in similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), sample=sample, common=common).collect()}
    want = brute_roots(rows)
    assert len(set(want.values())) > 20 and {k: got.get(k, k) for k, _ in rows} == want


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, extra = rng.integers(0, 400), rng.integers(0, 300, 2)
        common, a, b = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, *extra))
        x, y = np.union1d(common, a), np.union1d(common, b)
        assert similar.sketch_distance(similar.sketch(x), similar.sketch(y)) <= np.setxor1d(x, y).size
    x, y = (np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2))
    assert 9 * similar.sketch_distance(similar.sketch(x), similar.sketch(y)) > x.size + y.size


def test_the_pipeline_drops_what_is_similar_at_0_8(spark):
    """Two pairs of the smallest table, at 0.83, differ by 7 and 11 bits of op1's
    fingerprints."""
    kept = {r[0] for r in corpus_pipeline.near(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").collect()}
    want = brute_roots(documents())
    assert kept == {k for k, r in want.items() if k == r} and not kept & {145, 177}


def test_empty_and_keyless_rows(spark):
    assert similar.drop_similar(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (2, "A b"), (2, "c")], "doc_id long, text string")
    assert sorted(map(str, (r[0] for r in similar.drop_similar(rows).collect()))) == ["1", "None", "None"]


def test_a_large_family_gives_no_row_for_each_pair(spark, monkeypatch):
    """Edits of one text at about the limit: 2333 of 44850 pairs are similar."""
    rng, base, counts = random.Random(5), [f"w{i}" for i in range(90)], []
    rows = []
    for n in range(300):
        words = list(base)
        for at in rng.sample(range(5, 85), 2 if n % 3 == 0 else 1):
            words[at] = f"v{n}x{at}"
        rows.append((n, " ".join(words)))

    def counted(links):
        counts.append(links.count())
        return components(links)

    monkeypatch.setattr(similar, "components", counted)
    got = {r["node"]: r["root"] for r in similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_roots(rows)
    assert len(set(want.values())) > 1 and {k: got.get(k, k) for k, _ in rows} == want
    assert counts[-1] < 3 * len(rows)


@pytest.mark.parametrize(("block", "shingles"), [(2000, 1 << 20), (7, 1 << 20), (2000, 300)])
def test_whole_sets_in_blocks(spark, monkeypatch, block, shingles):
    """Keys that repeat with other texts and with the same one; classes in many blocks."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "SHINGLES", shingles)
    rows = made()
    rows += [(k, rows[k + 40][1]) for k in range(3)] + rows[:5]
    texts = spark.createDataFrame(rows, "key long, text string")
    prefixes = similar._prefixes(texts, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    near = spark.createDataFrame([(k, 0) for k in range(1, len(made()))], "node long, root long")
    none = near.where("node < 0")
    got = {r["node"]: r["root"] for r in components(similar._similar_links(texts, near, none, prefixes)).collect()}
    want = brute_roots([(k, t) for k, t in made() if brute_shingles(t)])
    for k in range(3):  # such a key ties both texts
        low, high = sorted((want[k], want[k + 40])) if k in want and k + 40 in want else (k, k)
        want = {n: low if r == high else r for n, r in want.items()}
    assert {k: got.get(k, k) for k in want} == want


def test_the_stage_links_by_fingerprints_in_tries(spark, monkeypatch):
    """Pairs that connect all fingerprints of five-word sets at up to three differing
    bits, and nothing else; the stage compares them."""
    asked = []

    def linked(reps):
        asked.append(reps.count())
        return fingerprint_links(reps)

    monkeypatch.setattr(similar, "fingerprint_links", linked)
    docs = [*documents(), *((k + 100_000, t) for k, t in made())]
    prints = {}
    for k, t in docs:
        hashes = {xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in brute_shingles(t)}
        if hashes:
            prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    texts = spark.createDataFrame(docs, "key long, text string")
    pairs = similar.fingerprint_pairs(similar._prefixes(texts, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert pairs.count() < len(docs) and [got.get(k, k) for k in prints] == brute_classes(list(prints.items()))
    assert corpus_pipeline.near(spark, texts.selectExpr("key AS doc_id", "text"), SF).count() and len(asked) == 2
