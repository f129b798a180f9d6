"""The driver's queries over the corpus tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onset.llm import licenses, quality_rules, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from onset.llm.byte_bpe import encode

    rows = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.licenses import license_and_notice_scan

    return license_and_notice_scan(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from onset.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from onset.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.quality_rules import COUNTS, quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.url_filters import url_filters

    return url_filters(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.toxicity import classify, train

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from onset.llm.common import written
    from onset.llm.pii import table_collisions, with_surrogates

    rows = written(with_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text")), "surrogates")
    collisions = table_collisions(rows).count()  # over the whole table; 0 where all stay apart
    return rows.select("doc_id", F.size("pii").cast("long").alias("n_entities"), F.array_join("pii.type", ",").alias("types"), F.lit(collisions).alias("table_collisions"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_byte_bpe, op3_licenses, op4_token_files, op5_packing, op6_quality_rules, op7_exact_dedup, op8_url_filters, op9_toxicity, op10_pii)
}
ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op3_licenses": licenses.scan_sql(),
    "op6_quality_rules": quality_rules.rules_sql(),
    "op8_url_filters": url_filters.filters_sql(),
}
