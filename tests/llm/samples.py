"""Documents that hold the awkward cases, and a way to compare rows."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "x" * 40_000 + " " + "été123'll, " * 5_000

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "one", None, "b", 3), (5, "one two", "en", "b", 7),
    (6, "Same text HERE twice", "en", "b", 20), (7, "same text here twice", "en", "b", 20), (7, "same text here twice", "en", "b", 20), (8, "ÉTÉ same", "fr", "c", 8), (9, "été same", "fr", "c", 8),
    (10, LONG, "en", "c", len(LONG)), (11, "it's we'll <|endoftext|> 'quoted' 　x y 中文。字 😀", "zh", "d", 40), (None, "no key at all", "en", "d", 13), (None, "No key at all", "en", "d", 13),
    (12, "Mail Ann.B@mail.example.com or +1 (663) 555-6869, host 10.1.2.3, card 4111 1111 1111 1111", "en", "d", 88),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra: bool = True):
    """The odd rows; with columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("key", "n", "keep", "digest", "doc", "row", "host", "fp", "t", "ids", "_key", "at", "kept", "words", "lines")}) if extra else df


def documents() -> list[tuple[int, str]]:
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
