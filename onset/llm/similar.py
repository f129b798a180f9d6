"""Near-duplicates by SimHash and the true similarity of word shingles.

Two texts link when the Jaccard similarity of their sets of ``SHINGLE`` words is at
least 4/5. First come the pairs that SimHash proposes: fingerprints of the sets, linked
by the self-join of binary tries at ``simhash.ERRORS`` differing bits, whose sets are
then compared. Texts at 4/5 differ by ten bits or so, beyond what tries can be dealt
by, so the rest is found exactly, whatever SimHash has missed: under any one order of all shingles, two such
sets of s and t shingles share one among the first s - ceil(4s/5) + 1 of the one and
as many of the other. The order is by rarity in a sample, then by hash; the sample
moves work, never results. Texts that share such a shingle, and whose sizes and
places of it allow 4/5, have their whole sets compared. Shingles stand for
themselves by 64-bit hashes. Before that, sketches are compared: which of some
buckets hold an odd number of a set's shingles. The sketches of two sets differ in at
most as many bits as the sets differ in shingles, so this loses no pair either.

Equal sets are made one before. Of texts that share a shingle, each is compared with
one neighbour by size to which it is not connected yet. In groups that still have several classes, the sketches
of all members of different classes are compared, block by block, and a spanning forest
of the pairs that these allow is told. Within each class of that forest, the whole sets
are compared, block by block again, and a spanning forest of the similar ones is told.
So either step tells fewer pairs than it reads members, however many pairs there are.

Defined cases: a text of fewer than ``SHINGLE`` words is one shingle; null and
wordless texts have none and equal each other; a row without a key links nothing
and stays; rows with equal keys tie their texts; an empty table gives no links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onset.llm.common import bound_batches, join_few, release, scratch, without, written
from onset.llm.graph import Forest, components
from onset.llm.simhash import fingerprint_links, shingle_hashes

SHINGLE = 5
#: Texts that tell how rare shingles are, and how many of the common ones are told.
SAMPLE, COMMON = 10_000, 200_000


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes, ascending."""
    blocks = list(shingle_hashes(text or b"", k))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > hashes.size, bitorder="little").view("<i8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of each of m buckets, m the power of two at or above twice the
    set's size (64 at least): a bit a bucket."""
    m = max(64, 1 << int(2 * hashes.size - 1).bit_length()) if hashes.size else 64
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """In how many buckets two sketches differ, the longer folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, x.size), axis=0)).sum())


def _sets(docs: DataFrame) -> DataFrame:
    """The rows with ``hashes`` in place of ``text``."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {"hashes": pa.array(sets, pa.list_(pa.int64()))})
        release()

    return docs.mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others), "hashes array<long>"]))


def _common(docs: DataFrame, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample has more than once, ascending, and how often."""
    every = max(1, docs.count() // sample)
    some = _sets(docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", "text"))
    rows = some.select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(most).collect()
    hashes, counts = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles, of which similar sets share one."""
    rank = np.zeros(hashes.size, np.int64)
    if common.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: hashes.size - -(-4 * hashes.size // 5) + 1]]


def _prefixes(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``key``, ``digest`` of the whole set, its ``size``, fingerprint ``fp``, ``sketch``
    and ``first`` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                "size": pa.array([s.size for s in sets], pa.int32()), "fp": pa.array([set_fingerprint(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) for s in sets], pa.binary()), "first": pa.array([prefix(s, common, counts).view(np.int64) for s in sets], pa.list_(pa.int64())),
            })
        release()

    return docs.mapInArrow(run, "key long, digest binary, size int, fp long, sketch binary, first array<long>")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs that connect all ``key`` of sets of some ``size`` whose
    fingerprints ``fp`` are equal or near; fewer than there are rows."""
    prints = sets.where("size > 0").select("key", "fp")
    least = written(prints.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "reps")
    same = join_few(prints, least.where("n > 1").select("fp", "rep"), ["fp"], "inner", "key").select(*_ends("key", "rep"))
    return same.unionByName(fingerprint_links(least.select("fp", "rep")).select(*_ends("a", "b"))).where("a < b").distinct()


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a similarity of 4/5: sets of s and t shingles
    may differ in a ninth of s + t. A key with several sets passes by any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("p", "q", "s", "t"))
            good = [9 * sketch_distance(p, q) <= s + t for p, q, s, t in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sketches.select("key", "sketch", "size")
    both = pairs.join(one.toDF("a", "p", "s"), "a").join(one.toDF("b", "q", "t"), "b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of keys ``a``, ``b`` whose whole sets are similar."""
    pairs = written(_plausible(pairs, sketches), "plausible")
    ends = pairs.select(F.col("a").alias("key")).distinct().union(pairs.select("b").distinct()).distinct()
    sets = written(_sets(join_few(docs, ends, ["key"], "inner", "text").select("key", "text")), "sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b").distinct()


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, common: int = COMMON) -> DataFrame:
    """``node`` and ``root``, the smallest key of its class, for every key but
    the roots. Keys are integers."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    rows = written(_prefixes(docs, *_common(docs, sample, common)), "prefixes")
    same = written(rows.groupBy("digest").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").select("digest", "a"), "same-sets")
    equal = rows.select("key", "digest").join(same, "digest").where("key > a").select("a", F.col("key").alias("b")).distinct()
    equal = written(equal, "equal-sets")
    # a key that only repeats a set has its first shingles told by the smallest key
    reps = join_few(rows, same.withColumnRenamed("a", "least"), ["digest"], "left", "key").where("least is null or key = least")
    tried = written(fingerprint_pairs(reps), "pairs")
    roots = components(_verified(docs, tried, rows).unionByName(equal))

    told = reps.select("key", "size", F.posexplode("first").alias("pos", "h"))
    # dealt out as two longs and the key, and most shingles stand in one text only
    told = told.select("h", "key", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("at")).repartition("h")
    told = told.select("h", "key", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    group = Window.partitionBy("h")
    shared = told.withColumns({"_least": F.min("key").over(group), "n": F.count("*").over(group), "_most": F.max("key").over(group)}).where("_least < _most")
    # a passage gives as many groups of the same texts as it has shingles: the one that
    # comes first in the order of all shingles stands for them
    sets = shared.where(F.col("n") <= LISTED).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("key", "size", "pos"))).alias("of"))
    sets = sets.groupBy(F.transform("of", lambda x: x["key"]).alias("keys")).agg(F.min_by(F.struct("h", "of"), F.struct(F.get("of", F.lit(0))["pos"], "h")).alias("x"))
    listed = sets.select("x.h", F.explode("x.of").alias("m")).select("h", "m.key", "m.size", "m.pos")
    members = written(listed.unionByName(shared.where(F.col("n") > LISTED).select("h", "key", "size", "pos")), "members")

    apart = written(_apart(members, roots), "apart")
    next_ = apart.select(F.struct("size", "key", "pos", "c").alias("p"), F.lag(F.struct("size", "key", "pos", "c")).over(group.orderBy("size", "key")).alias("q"))
    # of its neighbours a key takes the one that it meets in most groups
    met = next_.where("p.c <> q.c").where(FITS).groupBy(F.col("p.key").alias("p"), F.col("q.key").alias("q")).agg(F.count("*").alias("n"))
    pairs = met.groupBy("p").agg(F.max(F.struct("n", "q")).alias("x")).select(*_ends("p", "x.q")).distinct().join(tried, ["a", "b"], "left_anti")

    roots = components(roots.toDF("a", "b").unionByName(_verified(docs, written(pairs, "pairs"), rows)))
    near = components(_near_links(written(_apart(apart.drop("c"), roots), "apart"), rows))
    return components(roots.toDF("a", "b").unionByName(_similar_links(docs, near, roots, rows)))


#: What two members ``p`` and ``q`` of a group must fulfil to be similar.
FITS = "p.key <> q.key and 5 * least(p.size, q.size) >= 4 * greatest(p.size, q.size) and 9 * least(p.size - p.pos, q.size - q.pos) >= 4 * (p.size + q.size)"
#: Members of a group that one comparison takes on either side, and the bytes of a
#: sketch that go along with a membership. A larger set's sketch is folded to that.
BLOCK, SHORT = 2000, 1024
#: Shingles of whole sets that a comparison takes on either side, but for one text's.
SHINGLES = 1 << 20
#: Members of a group up to which groups of the same texts are made one.
LISTED = 1000


def _ends(p: str, q: str) -> tuple:
    return F.least(p, q).alias("a"), F.greatest(p, q).alias("b")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of groups of several classes, with their class ``c``."""
    known = members.join(roots.select(F.col("node").alias("_node"), "root"), F.col("key") == F.col("_node"), "left").drop("_node")
    group = Window.partitionBy("h")
    classes = known.withColumn("c", F.coalesce("root", "key")).drop("root").withColumns({"_least": F.min("c").over(group), "_most": F.max("c").over(group)})
    return classes.where("_least < _most").drop("_least", "_most")


def fold(sketch_: bytes, size: int) -> bytes:
    """A sketch of ``size`` bytes at most: equal buckets added up."""
    return sketch_ if len(sketch_) <= size else np.bitwise_xor.reduce(np.frombuffer(sketch_, np.uint8).reshape(-1, size), axis=0).tobytes()


def _block_pairs(key, cls, size, pos, sketches: list[bytes], block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the plausible pairs of different classes, of members of two blocks (of
    one, if all are of the same)."""
    width = np.array([len(x) for x in sketches])
    left, right = block == block.min(), block == block.max()
    same = bool((left & right).any())
    for m in np.unique(width):
        for n in np.unique(width):
            if max(m, n) > 2 * min(m, n) and max(m, n) < SHORT:
                continue  # sizes too far apart
            small = min(m, n)
            i, j = np.flatnonzero(left & (width == m)), np.flatnonzero(right & (width == n))
            if not i.size or not j.size:
                continue
            x, y = (np.frombuffer(b"".join(fold(sketches[k], small) for k in at), np.uint64).reshape(-1, small // 8) for at in (i, j))
            step = max(1, (4 << 20) // (j.size * small))
            for at in range(0, i.size, step):
                a = i[at : at + step]
                far = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(-1, dtype=np.int64)
                both = size[a][:, None] + size[j][None, :]
                ok = (9 * far <= both) & (cls[a][:, None] != cls[j][None, :]) & (5 * np.minimum(size[a][:, None], size[j][None, :]) >= 4 * np.maximum(size[a][:, None], size[j][None, :]))
                ok &= 9 * np.minimum((size - pos)[a][:, None], (size - pos)[j][None, :]) >= 4 * both
                if same:
                    ok &= key[a][:, None] < key[j][None, :]
                p, q = np.nonzero(ok)
                if p.size:
                    yield a[p], j[q]


def _near_links(apart: DataFrame, sketches: DataFrame) -> DataFrame:
    """``a``, ``b``: links that connect all keys of different classes that share a group
    and whose sketches are near. Large groups are dealt out as pairs of blocks of
    ``BLOCK`` members."""
    group = Window.partitionBy("h")
    rows = apart.withColumns({"least": F.min("key").over(group), "_i": F.floor((F.row_number().over(group.orderBy("key")) - 1) / BLOCK).cast("int"), "_n": F.ceil(F.count("*").over(group) / BLOCK).cast("int")})
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    held = sketches.groupBy("key").agg(F.min("sketch").alias("sketch"), F.count_distinct("sketch").alias("_k"))
    # a key with several sets passes by any of them: its sketch says nothing
    rows = rows.join(held, "key").withColumn("sketch", F.when(F.col("_k") == 1, F.col("sketch")))
    part = rows.select("least", "h", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.col("_i").alias("block"), "key", "c", "size", "pos", "sketch")
    # groups with the same smallest key are mostly of the same texts: their links meet in one task
    part = part.repartition("least", "i", "j").sortWithinPartitions("least", "h", "i", "j")

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        key, cls, size, pos, block = (np.asarray(table.column(c)).astype(np.int64) for c in ("key", "c", "size", "pos", "block"))
        known = [x or b"" for x in table.column("sketch").to_pylist()]
        there, forest = np.array([bool(x) for x in known]), Forest(key.size)
        for k in np.flatnonzero(~there):  # compared without sketches; such keys are few
            others = np.flatnonzero((cls != cls[k]) & (key != key[k]))
            forest.join(np.full(others.size, k), others)
        at = np.flatnonzero(there)
        if at.size > 1:
            for a, b in _block_pairs(key[at], cls[at], size[at], pos[at], [fold(known[k], SHORT) for k in at], block[at]):
                forest.join(at[a], at[b])
        hang = np.flatnonzero(forest.root != np.arange(key.size))
        return pa.RecordBatch.from_pydict({"a": key[hang], "b": key[forest.root[hang]]})

    return part.mapInArrow(_by_group(["least", "h", "i", "j"], links), "a long, b long")


def _by_group(names: list[str], links):
    """``links`` of the rows of each group; rows of a group stand together."""

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := links(held)).num_rows:
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            named = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], axis=1)
            starts = np.append(np.flatnonzero(np.append(True, (named[1:] != named[:-1]).any(axis=1))), batch.num_rows) if batch.num_rows else np.zeros(1, np.int64)
            for a, b in pairwise(starts.tolist()):
                if now is not None and tuple(named[a]) != now:
                    yield from told(held)
                    held = []
                now = tuple(named[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from told(held)
        release()

    return run


def set_links(cls: np.ndarray, sets: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes ``a``, ``b`` of similar sets that connect all similar sets of two blocks (of
    one, if all are of the same) and different classes: a spanning forest."""
    order = np.lexsort((np.array([x.size for x in sets], np.int64), block))
    sets = [sets[k] for k in order]
    size, (_, root), block = np.array([x.size for x in sets], np.int64), np.unique(cls[order], return_inverse=True), block[order]
    ends = np.append(0, np.cumsum(size))
    shingles, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = int(np.searchsorted(block, block.max()))  # the other block's
    mine, found = np.zeros(shingles.size, np.int64), []
    for k in range(first or size.size):
        # the sets of the sizes that allow it, which stand together
        low = first + int(np.searchsorted(size[first:], -(-4 * size[k] // 5))) if first else k + 1
        high = first + int(np.searchsorted(size[first:], 5 * size[k] // 4, "right"))
        others = low + np.flatnonzero(root[low:high] != root[k])
        if not others.size or not size[k]:
            continue
        mine[ids[ends[k] : ends[k + 1]]] = 1
        low, high = int(others[0]), int(others[-1]) + 1
        common = np.add.reduceat(mine[ids[ends[low] : ends[high]]], ends[low:high] - ends[low])[others - low]
        mine[ids[ends[k] : ends[k + 1]]] = 0
        for other in others[9 * common >= 4 * (size[k] + size[others])]:
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
                found.append((order[k], order[other]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return a, b


def _similar_links(docs: DataFrame, near: DataFrame, roots: DataFrame, rows: DataFrame) -> DataFrame:
    """``a``, ``b``: links between similar keys that connect all similar keys of a class of
    ``near``. Large classes are dealt out as pairs of blocks of ``BLOCK`` sets and
    ``SHINGLES`` shingles."""
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("key"), F.col("root").alias("p"))
    sizes = rows.groupBy("key").agg((F.sum("size") + F.count("*") * F.lit(SHINGLES // BLOCK)).alias("_w"))
    before = Window.partitionBy("p").orderBy("_w", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.join(sizes, "key").withColumn("block", F.floor(F.coalesce(F.sum("_w").over(before), F.lit(0)) / SHINGLES).cast("int"))
    placed = placed.withColumn("_n", F.max("block").over(Window.partitionBy("p"))).join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    placed = placed.select("key", "p", F.coalesce("root", "key").alias("c"), "block", "_n")
    dealt = _sets(join_few(docs, placed, ["key"], "inner", "text")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    dealt = dealt.select("p", F.least("block", "_j").alias("i"), F.greatest("block", "_j").alias("j"), "block", "key", "c", "hashes")

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        seen, kept = set(), []  # repeated rows count once
        for n, batch in enumerate(rows):
            at, flat = np.asarray(batch.column("hashes").offsets), np.asarray(batch.column("hashes").values)
            for m, k in enumerate(batch.column("key").to_pylist()):
                one = flat[at[m] : at[m + 1]]
                if (name := (k, hashlib.blake2b(one.tobytes(), digest_size=16).digest())) not in seen:
                    seen.add(name)
                    kept.append((k, batch.column("c")[m].as_py(), batch.column("block")[m].as_py(), one))
        key, cls, block = (np.array([x[c] for x in kept], np.int64) for c in range(3))
        a, b = set_links(cls, [x[3] for x in kept], block)
        return pa.RecordBatch.from_pydict({"a": key[a], "b": key[b]})

    dealt = dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    return dealt.mapInArrow(_by_group(["p", "i", "j"], links), "a long, b long")


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest key of each class only."""
    with scratch(docs.sparkSession):
        return without(docs, similar_classes(docs, key, text).select(F.col("node").alias(key)), key)
