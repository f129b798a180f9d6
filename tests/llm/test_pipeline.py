from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from onset.llm import pii
from tests.llm.samples import ODD, SCHEMA, SF, odd, ordered
from tests.llm.test_rules import brute_bad_hosts, brute_counts, brute_dedup
from tests.llm.test_similar import brute_roots
from tests.llm.test_tokens import check_pieces, crc, ids_of


def test_run_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {r[0] for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").collect()}
    assert kept == {k for k, t in docs if not brute_counts(t)[-1]}  # no source is rejected here
    docs = [d for d in docs if d[0] in kept]
    stay = {k for k, _, _, keep, _ in brute_dedup(docs) if keep}
    docs = [d for d in docs if d[0] in stay]
    roots = brute_roots(docs)
    docs = [(k, pii.replace(t, pii.session_key(spark))[0]) for k, t in docs if roots[k] == k]
    rows = corpus_pipeline.run(spark, SF).withColumn("crc", F.crc32("ids")).collect()
    by_doc, padding = check_pieces(rows, None)
    assert padding == 0 and {k for k, _ in by_doc} == {k for k, _ in docs}
    for key, text in docs:
        ids = [*ids_of(text), 0]
        at = 0
        for r in sorted(by_doc[key, len(ids)], key=lambda r: r["start"]):
            assert r["start"] == at and r["crc"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_columns_and_odd_rows(spark):
    """What each stage makes of nulls, repeated rows, clashing columns and no rows."""
    docs, key = odd(spark), pii.session_key(spark)
    good = [r[:2] for r in ODD if not brute_counts(r[1])[-1]]
    copies = brute_dedup([r[:2] for r in ODD])
    roots = brute_roots(list({r[0]: r[:2] for r in ODD if r[0] is not None}.values()))
    want = {
        "quality_rules": [k for k, _ in good], "exact_dedup": [k for k, _, _, kept, _ in copies if kept],
        "simhash": [r[0] for r in ODD if r[0] is None or roots[r[0]] == r[0]], "pii": [r[0] for r in ODD],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns
        assert ordered(done.select("doc_id").collect()) == ordered((k,) for k in want[name]), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    texts = corpus_pipeline.private(spark, docs, SF).select("doc_id", "text", "n_chars").collect()
    assert ordered((r[0], r[1]) for r in texts) == ordered((r[0], pii.replace(r[1], key)[0]) for r in ODD)
    assert all(r[2] == (None if r[1] is None else len(r[1])) for r in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    ids = Counter((r[0], len(ids_of(r[1])) + 1) for r in ODD)
    assert {(r[0], r[1]): r[2] for r in pieces} == {k: k[1] * n for k, n in ids.items()}


def test_bad_sources_go_whole(spark):
    """The quality stage takes a rejected source's good documents along, no others."""
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 3 else "short", "en", ("bad" if i % 10 else "ok") if i < 300 else "fine", 0) for i in range(600)]
    rows = [(i, "short" if s == "bad" and i % 30 != 1 else t, lang, s, n) for i, t, lang, s, n in rows]
    bad = brute_bad_hosts([(r[3], brute_counts(r[1])[-1]) for r in rows])
    assert bad == {"bad"}
    kept = corpus_pipeline.quality(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert ordered(kept.select("doc_id").collect()) == ordered((r[0],) for r in rows if r[3] not in bad and not brute_counts(r[1])[-1])
