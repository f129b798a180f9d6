"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets the counts of :func:`signals` and the base rule. The rule's
failures are added up by host and host rates are shrunk towards an empirical beta
prior. The limit is fitted as well: it lies ``host_limit`` of the way from the prior's
mean to certain failure. A host whose failure rate is above it with a probability of
95 %, by its posterior, has all its documents rejected.

Defined cases: a null or blank text has no words and fails the base rule; a null
host is a group of no one, so it is never rejected; repeated rows each count and
each return; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.llm.common import SPACE_CLASS, SPACES, beta_prior, join_few, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Where the limit lies between the mean rate and 1, and standard deviations below
#: the posterior mean that must still pass it.
HOST_LIMIT, Z = 0.5, 1.645
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", carry: bool = False, hash_: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id``, ``host``, the five counts and ``base_failed``; no shuffle. With
    ``carry``, also ``row``, a struct of the document's columns.

    Windows are sorted by a 64-bit hash of their eight words. Most texts repeat
    none, which one distinct set shows; only the others pay for sorting. Windows
    with one hash are compared word by word, each with the one before; if two
    differ, the text's windows are sorted by their words instead.
    """
    n = F.col("n_words")
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    own = ["doc_id", "host", *(["row"] if carry else [])]
    raw = docs.select(docs[key].alias("doc_id"), docs[host].alias("host"), *row, F.coalesce(docs[text], F.lit("")).alias("t"))
    split = raw.select(*own, "t", F.btrim("t", F.lit(SPACES)).alias("inner"), F.filter(F.split("t", "\n", -1), lambda line: line.rlike(f"[^{SPACE_CLASS}]")).alias("lines"))
    words = split.select(
        *own, "lines",
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", f"[{SPACE_CLASS}]+", -1)).alias("words"),
    )
    windows = words.select(
        *own, "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: hash_(F.slice("words", i, WINDOW)))).alias("hashes"),
    )
    ordered = windows.select(
        "*",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    window = lambda w: F.slice("words", w["i"] + 1, WINDOW)
    clash = F.exists(F.transform("ordered", lambda w, k: (F.get("ordered", k - 1)["h"] == w["h"]) & (window(F.get("ordered", k - 1)) != window(w))), lambda x: F.coalesce(x, F.lit(False)))
    by_words = F.array_sort(F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("h"), (i - 1).alias("i"))))
    ordered = ordered.withColumn("_by_words", F.when(F.coalesce(clash, F.lit(False)), by_words))
    # equal windows get one number, that of the first of them
    numbered = F.transform("_by_words", lambda w, k: F.struct(F.when(F.get("_by_words", k - 1)["h"] == w["h"], None).otherwise(k).cast("long").alias("h"), w["i"].alias("i")))
    first = lambda a: F.aggregate(a, F.struct(F.array().cast("array<struct<h: bigint, i: int>>").alias("out"), F.lit(0).cast("long").alias("h")), lambda s, w: F.struct(F.array_append(s["out"], F.struct(F.coalesce(w["h"], s["h"]).alias("h"), w["i"].alias("i"))).alias("out"), F.coalesce(w["h"], s["h"]).alias("h")), lambda s: s["out"])
    ordered = ordered.withColumn("ordered", F.when(F.col("_by_words").isNotNull(), first(numbered)).otherwise(F.col("ordered")))
    # 0-based starts of the windows that have an equal one, in text order
    twice = ordered.select(
        "*",
        F.array_sort(F.filter(F.transform("ordered", lambda w, k: F.when((F.get("ordered", k - 1)["h"] == w["h"]) | (F.get("ordered", k + 1)["h"] == w["h"]), w["i"])), lambda i: i.isNotNull())).alias("starts"),
    )
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "starts", zero,
        lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("sum"), (i + WINDOW).alias("end")),
        lambda s: s["sum"],
    )
    counted = twice.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    return counted.select(*own, *COUNTS, failed.alias("base_failed"))


def host_rates(flags: DataFrame, host_limit: float = HOST_LIMIT, z: float = Z) -> DataFrame:
    """``host``, ``n``, ``bad``, the shrunk ``rate``, its lower ``bound`` and
    ``rejected`` from rows of ``host`` and ``base_failed``. Aggregation starts
    before the shuffle, so a host with a third of all rows costs as little as any
    other."""
    by_host = flags.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    total = by_host.agg(
        F.sum(F.col("n").cast("double")), F.sum(F.col("bad").cast("double")), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")), F.count("*"),
    ).first()  # one row
    alpha, beta = beta_prior(*total)
    mean = alpha / (alpha + beta)
    rate = (F.col("bad") + alpha) / (F.col("n") + (alpha + beta))
    rated = by_host.select("host", "n", "bad", rate.alias("rate"))
    bound = F.col("rate") - F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + (alpha + beta + 1))) * z
    return rated.withColumn("bound", bound).withColumn("rejected", F.col("bound") > mean + host_limit * (1 - mean))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row a document: ``key``, ``host``, the counts, ``base_failed``,
    ``host_rejected`` and ``kept``.

    The signals are written once, to the shared folder, since both the host sums
    and the verdicts read them.
    """
    flags = written(signals(docs, key, text, host), "quality")
    bad = host_rates(flags, host_limit).where("rejected").select("host", F.lit(True).alias("host_rejected"))
    joined = join_few(flags, bad, ["host"], "left", "doc_id")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select(F.col("doc_id").alias(key), "host", *COUNTS, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def drop_rejected(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` without the rows that :func:`quality_rules` rejects. The rows go
    along with their signals, so they are not joined by key."""
    flags = written(signals(docs, key, text, host, carry=True).select("row", "doc_id", "host", "base_failed"), "quality")
    bad = host_rates(flags.select("host", "base_failed"), host_limit).where("rejected").select("host")
    return join_few(flags.where(~F.col("base_failed")), bad, ["host"], "left_anti", "doc_id").select("row.*")


def rules_sql(host_limit: float = HOST_LIMIT, z: float = Z) -> str:
    """:func:`quality_rules` of the table ``documents`` in SQL: counts and verdicts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) > {WINDOW}), k AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM g),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM k) WHERE n > 1), v AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS word FROM c) GROUP BY 1),
f AS (SELECT w.r, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM w LEFT JOIN v ON v.r = w.r),
e AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f), h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS bad FROM e WHERE host IS NOT NULL GROUP BY 1),
m AS (SELECT sum(n) AS n, least(greatest(sum(bad) / sum(n), 1e-6), 1 - 1e-6) AS m, sum(n) - sum(n * n) / sum(n) AS room, sum(bad * bad / n) AS spread, count(*) AS g FROM h),
q AS (SELECT *, least(greatest(CASE WHEN room > g - 1 THEN ((spread - n * m * m) / (m * (1 - m)) - (g - 1)) / (room - (g - 1)) ELSE 0 END, 1e-3), 0.5) AS rho FROM m),
s AS (SELECT coalesce(m, 0.5) AS m, CASE WHEN n IS NULL THEN 2.0 WHEN g < 2 OR room <= 0 THEN 10.0 ELSE (1 - rho) / rho END AS s FROM q), x AS (SELECT host, n, s.m, s.s, (bad + s.m * s.s) / (n + s.s) AS rate FROM h, s),
b AS (SELECT host FROM x WHERE rate - sqrt(rate * (1 - rate) / (n + s + 1)) * {z} > m + {host_limit} * (1 - m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.host IS NULL AS kept FROM e LEFT JOIN b ON b.host = e.host"""
