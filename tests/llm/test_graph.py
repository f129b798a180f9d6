from __future__ import annotations

import random
import uuid

import pytest

import corpus_pipeline
from onset.llm.graph import components
from tests.llm.samples import SF

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def brute_components(links: list[tuple[int | None, int | None]]) -> dict[int, int]:
    root = {}
    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((root.setdefault(a, a), root.setdefault(b, b)))
            root = {k: low if r == high else r for k, r in root.items()}
    return {k: r for k, r in root.items() if k != r}


def made() -> list[tuple[int | None, int | None]]:
    """Chains in any order, a star, a tangle, pairs; repeated links, loops, null ends."""
    rng = random.Random(11)
    names = rng.sample(range(-(10**15), 10**15), 700)
    links = [*zip(names[:200], names[1:200], strict=False), *((n, n + 1) for n in range(150)), *((names[200], x) for x in names[201:330])]
    links += [(rng.choice(names[330:450]), rng.choice(names[330:450])) for _ in range(150)] + list(zip(names[450:570:2], names[451:571:2], strict=True))
    links += [(b, a) for a, b in links[::3]] + links[::5] + [(names[600], names[600]), (None, names[601]), (names[602], None), (None, None)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize(("part", "batch"), [(1 << 18, 4000), (60, 4000), (40, 7), (2, 3)])
def test_components_against_brute_force(spark, part, batch):
    """In one task; in rounds, whose tasks hold all of their links or few at once."""
    links, before = made(), spark.conf.get(BATCH)
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    spark.conf.set(BATCH, str(batch))
    try:
        rows = components(table, part=part).collect()
        none = components(table.where("a is null"), part=part).count()
    finally:
        spark.conf.set(BATCH, before)
    want = brute_components(links)
    assert none == 0 and len(want) > 500 and len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want


def jobs(spark, work) -> int:
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_links_take_few_jobs(spark):
    """Each job costs the driver memory, whatever its rows; the stage's rounds over few
    links took it beyond its limit."""
    links = spark.createDataFrame(made(), "a long, b long")
    assert jobs(spark, lambda: components(links)) < 10
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert jobs(spark, lambda: corpus_pipeline.near(spark, docs, SF).count()) < 125
