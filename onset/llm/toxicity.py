"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; a later model has the log-odds of
all earlier ones among its features, in training those of models that did not see
the row (out of fold). Models are logistic, over the words that a text holds and the
``HEADS`` letters that words of more begin with, hashed; an L1 penalty leaves few
of them with a weight, so long texts don't add up noise. A category's threshold is
the one with the best F-measure out of fold.

Training takes at most ``SAMPLE`` labelled rows, half of them positive where there
are enough: those whose keys have the smallest hashes, so the choice is the same
every time. Sampled classes are weighed back to their shares of all labels. Of
documents with one key, the one whose word ids come first is taken.

Defined cases: a null text has no words; a key with several label rows is positive
if one of them is; a null label is left out; labels of a single class, or none,
give a constant model (nothing is flagged); repeated rows each return; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onset.llm.common import bound_batches, release

#: Categories in the order of the chain, and when a label row is positive.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]
SAMPLE = 6000
BITS, FOLDS, PENALTY, STEPS, MIN_DOCS = 18, 3, 1e-3, 120, 4
#: Lengths of the beginnings of words that are features.
HEADS = (4, 5, 6)
#: How many words with one beginning are a feature of their own, and an odd number
#: that hashes it.
OFTEN, _STEP = (2, 4, 8), 0x9E3779B1
_WORD = re.compile(r"[^\W\d_]+")


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) >> (32 - BITS)


def word_ids(text: str | None, known: dict[str, tuple[int, ...]]) -> set[int]:
    """Hashed words of a text and how they begin, one word or ``OFTEN`` different
    ones. ``known`` remembers some."""
    words: list[int] = []
    heads: list[int] = []
    for word in set(_WORD.findall(text.lower())) if text else ():
        ids = known.get(word)
        if ids is None:
            ids = _hash(word), *(_hash(f"{word[:n]}-") for n in HEADS if len(word) > n)
            if len(known) < 200_000:
                known[word] = ids
        words.append(ids[0])
        heads += ids[1:]
    out = {*words, *heads}
    if len(out) < len(words) + len(heads):
        often = Counter(heads)
        out.update((i * _STEP + n) % (1 << BITS) for i, k in often.items() if k > 1 for n in OFTEN if k >= n)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """``words``: weights by hashed word; ``chain``: of earlier log-odds."""

    words: dict[int, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)
    bias: float = 0.0

    def odds(self, ids: set[int], earlier: list[float]) -> float:
        return self.bias + sum(self.words[i] for i in self.words.keys() & ids) + sum(w * x for w, x in zip(self.chain, earlier, strict=True))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, ids: set[int]) -> list[float]:
        odds: list[float] = []
        for model in self.models:
            odds.append(model.odds(ids, odds))
        return [float(p) for p in _sigmoid(np.array(odds))]


def _fit(rows: np.ndarray, words: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient. ``rows``, ``words``:
    which word column stands in which row; ``extra``: dense columns."""
    w, v, b = np.zeros(d), np.zeros(extra.shape[1]), 0.0
    total = weight.sum()
    p = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    b = float(np.log(p / (1 - p)))
    if not 0 < y.sum() < n:
        return w, v, b
    # steps by the column: the curvature is at most a quarter of a column's weight
    # times the number of columns that stand together, taken from a typical row
    together = 1 + np.sqrt(max(1.0, rows.size / max(1, n)))
    mass = np.bincount(words, weight[rows], d) / total
    step_w = 4 / (together * np.maximum(mass, 1 / n))
    step_v = 4 / (together * np.maximum((weight[:, None] * extra**2).sum(0) / total, 1e-3))
    step_b = 4 / together
    at, t = (w, v, b), 1.0
    for _ in range(STEPS):
        z = at[2] + extra @ at[1] + np.bincount(rows, at[0][words], n)
        g = weight * (_sigmoid(z) - y) / total
        new_w = at[0] - step_w * np.bincount(words, g[rows], d)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step_w * PENALTY, 0)
        new_v, new_b = at[1] - step_v * (extra.T @ g), at[2] - step_b * g.sum()
        grow = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / grow
        # start anew when the last step went against the gradient
        if ((at[0] - new_w) * (new_w - w)).sum() > 0:
            pull, grow = 0.0, 1.0
        at = (new_w + pull * (new_w - w), new_v + pull * (new_v - v), new_b + pull * (new_b - b))
        w, v, b, t = new_w, new_v, new_b, grow
    return w, v, b


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f = 2 * hit / (all_ + (weight * y).sum())
    ends = np.append(p[order][1:] < p[order][:-1], True)  # equal scores stand or fall together
    best = int(np.argmax(np.where(ends, f, -1)))
    below = p[order][best + 1] if best + 1 < p.size else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(rows: list[tuple[list[int], list[float]]], names: list[str], weights: np.ndarray | None = None) -> Chain:
    """A chain from rows of word ids and labels (NaN: not known), in the order
    given. ``weights``: a row's share, by category."""
    n = len(rows)
    labels = np.array([y for _, y in rows], float).reshape(n, len(names))
    weights = np.ones_like(labels) if weights is None else weights
    all_words = np.concatenate([np.array(x, np.int64) for x, _ in rows]) if n else np.zeros(0, np.int64)
    all_rows = np.repeat(np.arange(n), [len(x) for x, _ in rows]) if n else np.zeros(0, np.int64)
    ids, column, often = np.unique(all_words, return_inverse=True, return_counts=True)
    stay = often >= min(MIN_DOCS, max(1, n // 20))
    new = np.cumsum(stay) - 1
    keep = stay[column] if n else np.zeros(0, bool)
    ids, column, row_of = ids[stay], new[column[keep]], all_rows[keep]
    fold = np.arange(n) % FOLDS
    models, thresholds, odds = [], [], np.zeros((n, 0))

    def fit(use: np.ndarray, y: np.ndarray, weight: np.ndarray):
        number = np.cumsum(use) - 1
        inside = use[row_of]
        return _fit(number[row_of[inside]], column[inside], int(use.sum()), odds[use], y[use], weight[use], ids.size)

    for c in range(len(names)):
        known = ~np.isnan(labels[:, c])
        y, weight = np.where(known, labels[:, c], 0.0), weights[:, c]
        if not known.any() or not 0 < y[known].sum() < known.sum():
            models.append(Linear(chain=[0.0] * c, bias=-30.0))
            thresholds.append(1.0)
            odds = np.column_stack([odds, np.full(n, -30.0)])
            continue
        out = np.zeros(n)
        for k in range(FOLDS):
            w, v, b = fit(known & (fold != k), y, weight)
            here = fold == k
            out[here] = (b + odds @ v + np.bincount(row_of, w[column], n))[here]
        w, v, b = fit(known, y, weight)
        models.append(Linear({int(i): float(x) for i, x in zip(ids[w != 0], w[w != 0], strict=True)}, [float(x) for x in v], float(b)))
        thresholds.append(_threshold(_sigmoid(out)[known], y[known], weight[known]))
        odds = np.column_stack([odds, np.clip(out, -30, 30)])
    return Chain(names, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]] = CATEGORIES, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit on a bounded sample of the labelled documents; it goes to the driver as
    word ids. The last category decides which labels are taken."""
    names = [c for c, _ in categories]
    flags = labels.select(F.col(key).alias("_key"), *(F.expr(f"CAST({e} AS INT)").alias(f"_y{i}") for i, (_, e) in enumerate(categories))).where("_key is not null")
    flags = flags.groupBy("_key").agg(*(F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(names))))
    last = f"_y{len(names) - 1}"
    # one row: how many there are of each kind
    totals = {r[0]: r[1] for r in flags.groupBy(last).count().collect()}
    parts = [flags.where(f"{last} = {y}").orderBy(F.xxhash64("_key"), "_key").limit(sample // 2) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = F.broadcast(chosen).join(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key")
    ys = [f"_y{i}" for i in range(len(names))]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [sorted(word_ids(t, known)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_key"), "ids": pa.array(found, pa.list_(pa.int32())), **{c: batch.column(c) for c in ys}})

    schema = f"_key {docs.schema[key].dataType.simpleString()}, ids array<int>, " + ", ".join(f"{c} int" for c in ys)
    # a row a key, made one before the shuffle, so the driver gets ``sample`` rows at most
    one = rows.select("_key", "_text", *ys).mapInArrow(ids, schema).groupBy("_key").agg(F.min("ids").alias("ids"), *(F.max(c).alias(c) for c in ys))
    table = one.toArrow().to_pylist()
    table.sort(key=lambda r: (zlib.crc32(str(r["_key"]).encode()), str(r["_key"]), r["ids"]))
    data = [(r["ids"], [np.nan if r[c] is None else float(r[c]) for c in ys]) for r in table]
    share = {y: totals.get(y, 0) / max(1, sum(1 for _, x in data if x[-1] == y)) for y in (0, 1)}
    weights = np.array([[share.get(x[-1], 1.0)] * len(names) for _, x in data]).reshape(len(data), len(names))
    return fit_chain(data, names, weights)


def classify(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, a probability ``p_<category>`` and a flag for each category: one
    row a document, no shuffle."""
    bound_batches(docs.sparkSession)
    names = chain.names
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"p{i} double, f{i} boolean" for i in range(len(names)))
    weighty = set().union(*(m.words for m in chain.models)) if chain.models else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            p = [chain.predict(word_ids(t, known) & weighty) for t in batch.column("text").to_pylist()]
            out = {"key": batch.column("key")}
            for i, limit in enumerate(chain.thresholds):
                out[f"p{i}"] = pa.array([x[i] for x in p], pa.float64())
                out[f"f{i}"] = pa.array([x[i] >= limit for x in p], pa.bool_())
            yield pa.RecordBatch.from_pydict(out)
        release()

    done = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema)
    return done.select(F.col("key").alias(key), *(F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)), *(F.col(f"f{i}").alias(n) for i, n in enumerate(names)))
