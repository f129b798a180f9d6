"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept, and all but the last return the
columns of ``documents``. Defined cases, for all stages: a null text counts as empty
(the first stage drops it, since it has no words); an empty table gives an empty
result; further columns are carried, whatever they are called; texts of any length
are read whole. Repeated rows and rows without a key: see the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onset.llm.common import written
from onset.llm.exact_dedup import drop_copies
from onset.llm.packing import pack
from onset.llm.pii import with_surrogates
from onset.llm.quality_rules import drop_rejected
from onset.llm.similar import drop_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: repeated rows each by itself, rows without
    a key like any other, rows without a source by their own text alone."""
    return drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest key; of rows with
    that key one, and a row without a key only where no row of the group has one."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest key:
    five-word shingles, similarity of 0.8 or more. Rows that repeat the key that stays
    all stay, and so do rows without a key, which are near no other."""
    return drop_similar(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data, each row by itself; a null
    text stays null. ``n_chars`` follows the text."""
    done = with_surrogates(docs, found="_pii").drop("_pii")
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences; a null text is its end id alone,
    and repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("pii", private), ("packing", packing)]
#: SQL expresses neither the fingerprints' links nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
