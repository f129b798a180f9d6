"""Licence scans by canonical digest, in DataFrame functions only.

A text's canonical form drops case, punctuation, copyright lines and equivalent
spellings; its SHA-256 is looked up among the digests of known texts. Whole texts
are compared, so a long document that quotes a licence does not match; beside
that, whole lines of a document are looked up the same way, which finds notices.

Defined cases: a null text counts as empty; an empty canonical form (nothing but
punctuation or copyright lines) matches nothing; repeated rows each return; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onset.llm.license_texts import DIGESTS, TEXTS

#: Spellings that count as one, tried as whole words of the canonical form.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noninfringement", "non infringement"), ("sublicence", "sublicense"), ("owner", "holder"), ("https", "http"),
]
#: What a copyright line begins with: the word or a sign, with a year, a sign or a
#: place for one. A line that was wrapped before "copyright notice", or a clause (c), is none.
_STARTS = (
    r"copyright[ \t]*(?:\(c\)|©)", r"copyright[ \t,:]*(?:by[ \t]+)?[(<\[{]?(?:(?:19|20)\d\d|year|yyyy)\b", r"©", r"\(c\)[ \t]*(?:copyright\b|(?:19|20)\d\d)",
    r"copyright\b[^\n]{0,80}?\b(?:19|20)\d\d\b",
)
#: It ends with the line, or where the grant begins in a text of one line.
_ENDS = r"(permission (?:is hereby|to use)|redistribution and use|licensed under|this software is provided|everyone is permitted|$)"
COPYRIGHT = rf"^[^\p{{L}}\p{{N}}\n©(]*(?:{'|'.join(_STARTS)})[^\n]*?{_ENDS}"
RESERVED = r"all rights reserved"


def canonical(text: Column) -> Column:
    """Words of the text, one space between them."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    # most texts have no such line; a plain search is cheaper than the pattern
    hinted = lower.contains("copyright") | lower.contains("©") | lower.contains("(c)")
    kept = F.when(hinted, F.regexp_replace(lower, f"(?dm){COPYRIGHT}", "$1")).otherwise(lower)
    return F.btrim(F.regexp_replace(F.replace(F.replace(kept, F.lit(RESERVED), F.lit("")), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def same_spelling(words: Column) -> Column:
    """Equivalent spellings in a canonical form made one, word by word. Only forms
    that hold one of them are taken apart."""
    spelling = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    mapped = F.array_join(F.transform(F.split(words, " ", -1), lambda w: F.coalesce(F.try_element_at(spelling, w), w)), " ")
    return F.when(F.arrays_overlap(F.split(words, " ", -1), F.array(*(F.lit(old) for old, _ in SPELLINGS))), mapped).otherwise(words)


def digests(rows: DataFrame, text: str, out: str = "digest") -> DataFrame:
    """``rows`` with the digest of ``text``'s canonical form, null if it is empty.
    Each step is a column of its own, so that none is worked out twice."""
    plain = rows.withColumn("_plain", canonical(F.col(text)))
    mapped = plain.withColumn("_form", same_spelling(F.col("_plain"))).drop("_plain")
    return mapped.withColumn(out, F.when(F.col("_form") != "", F.sha2(F.col("_form"), 256))).drop("_form")


def known_licenses(spark: SparkSession, texts: list[tuple[str, str, str]] = TEXTS, known: list[tuple[str, str, str]] = DIGESTS) -> DataFrame:
    """``digest``, ``license_id``, ``kind``: one row a digest; of licences with
    the same form the first by name counts. ``known``: digests without their texts."""
    names = "license_id string, kind string"
    rows = digests(spark.createDataFrame(texts, f"{names}, text string"), "text").drop("text").unionByName(spark.createDataFrame(known, f"{names}, digest string"))
    return rows.where("digest is not null").groupBy("digest").agg(F.min_by("license_id", F.struct("license_id", "kind")).alias("license_id"), F.min_by("kind", F.struct("license_id", "kind")).alias("kind"))


def license_scan(docs: DataFrame, texts: list[tuple[str, str, str]] = TEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``digest``, ``license_id``, ``kind``: one row a document. The
    known digests are a list in the program, so they are few: broadcast."""
    rows = digests(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").drop("_text")
    found = rows.join(F.broadcast(known_licenses(docs.sparkSession, texts)), "digest", "left")
    return found.select(F.col("_key").alias(key), "digest", "license_id", "kind")


def _longest(text: str) -> str:
    """A word that all forms of the text hold as it is."""
    either = {w for pair in SPELLINGS for x in pair for w in x.split()}
    return max((w for w in re.findall(r"[a-z]+", text.lower()) if w not in either), key=len)


def notice_lines(docs: DataFrame, texts: list[tuple[str, str, str]] = TEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``line_no`` (from 0), ``license_id``, ``kind``: the lines that
    are, as a whole, a known text of one line."""
    short = [t for t in texts if "\n" not in t[2]]
    lines = docs.select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "_line"))
    found = digests(lines, "_line").join(F.broadcast(known_licenses(docs.sparkSession, short, [])), "digest")
    return found.select(F.col("_key").alias(key), "line_no", "license_id", "kind")


def license_and_notice_scan(docs: DataFrame, texts: list[tuple[str, str, str]] = TEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`license_scan`; a document that is no known text as a whole, but
    has lines of :func:`notice_lines`, gets their names in order, joined by commas,
    and the kind ``notice_line``. Rows stay where they are: the known lines are few."""
    lines = [t for t in texts if "\n" not in t[2]]
    short = known_licenses(docs.sparkSession, lines, []).collect()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if short:
        names = F.create_map(*(F.lit(x) for r in short for x in (r["digest"], r["license_id"])))
        forms = F.transform(F.split("_text", "\n", -1), canonical)
        found = F.transform(forms, lambda form: F.try_element_at(names, F.sha2(same_spelling(form), 256)))
        named = F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",")
        # only texts that hold the longest word of a notice are taken apart
        lower = F.lower("_text")
        hinted = F.lit(False)
        for word in sorted({_longest(t[2]) for t in lines}):
            hinted |= lower.contains(word)
        named = F.when(hinted, named)
    rows = rows.withColumn("_notices", F.nullif(named, F.lit("")) if short else F.lit(None).cast("string"))
    whole = license_scan(rows.select(F.struct("_key", "_notices").alias("_row"), "_text"), texts, "_row", "_text")
    line = F.col("license_id").isNull() & F.col("_row._notices").isNotNull()
    return whole.select(F.col("_row._key").alias(key), "digest", F.coalesce("license_id", "_row._notices").alias("license_id"), F.when(line, "notice_line").otherwise(F.col("kind")).alias("kind"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form_sql(text: str) -> str:
    """The canonical form in SQL."""
    spelling = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS) + "}"
    kept = f"replace(regexp_replace(lower(coalesce({text}, '')), {_quoted('(?m)' + COPYRIGHT)}, '\\1', 'g'), '{RESERVED}', '')"
    plain = f"trim(regexp_replace(replace({kept}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(map_extract({spelling}, w)[1], w)), ' ')"


def scan_sql(texts: list[tuple[str, str, str]] = TEXTS, known: list[tuple[str, str, str]] = DIGESTS) -> str:
    """:func:`license_and_notice_scan` of the table ``documents`` in SQL."""
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(t)})" for a, b, t in texts)
    more = "".join(f" UNION ALL SELECT {_quoted(a)}, {_quoted(b)}, {_quoted(d)}, false" for a, b, d in known)
    return f"""WITH t AS (SELECT * FROM (VALUES {rows}) v(license_id, kind, body)), kf AS (SELECT license_id, kind, {_form_sql('body')} AS form, NOT contains(body, chr(10)) AS short FROM t),
ka AS (SELECT license_id, kind, sha256(form) AS digest, short FROM kf WHERE form <> ''{more}), k AS (SELECT digest, min({{'l': license_id, 'k': kind}}) AS x FROM ka GROUP BY 1), ks AS (SELECT digest, min({{'l': license_id, 'k': kind}}) AS x FROM ka WHERE short GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS r, text, {_form_sql('text')} AS form FROM documents), w AS (SELECT doc_id, r, text, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM d),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w), n AS (SELECT r, string_agg(DISTINCT x.l, ',' ORDER BY x.l) AS ids FROM (SELECT r, sha256({_form_sql('line')}) AS digest FROM ln) JOIN ks USING (digest) GROUP BY 1)
SELECT doc_id, w.digest, coalesce(k.x.l, n.ids) AS license_id, CASE WHEN k.x IS NULL AND n.ids IS NOT NULL THEN 'notice_line' ELSE k.x.k END AS kind FROM w LEFT JOIN k ON k.digest = w.digest LEFT JOIN n ON n.r = w.r"""
