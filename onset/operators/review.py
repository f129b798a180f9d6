"""Machine-generated responses: text into rows, leniently or strictly.

Documents are rows of a key, a text and what was asked for. Items of a response are
checked as variants, where a wrong type stays visible: presence must be a JSON
boolean or null, numbers are numbers or null, and a key that is missing is not a
null. Both kinds of parsers read a document within its row, each text once: strict
ones all or nothing, lenient ones what is valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onset.functions.parse import BLANKS, once, strip

# The provider's lines, and the flags and sources of responses.
HEADER_LINE = r"Level\s*=\s*(\d+),\s*Path\s*=\s*([0-3]+)"
DATE_LINE = r"date\s*=\s*(\d{4}/\d{2}/\d{2}),\s*version\s*=\s*(\d+)"
AVAILABLE_DATE = r"\[\d+\]\s*(\d{4}/\d{2}/\d{2})"
TILE_DATE = r"Tile availability on\s+(\d{4}/\d{2}/\d{2})"
FLAGS = ["usable", "ambiguous", "unusable"]
FAILED_SOURCE = "gemini_failed"
MATRIX_KEYS = ["date_index", "target_label", "pv_present", "confidence", "quality_flag", "evidence", "notes"]
SEQUENCE_KEYS = ["confidence", "quality_flag", "review_notes", "observations"]
SEQUENCE_ITEM_KEYS = ["date_index", "pv_present", "pv_score", "evidence", "notes"]
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def decoded(raw: Column) -> Column:
    """Bytes of a provider as text: UTF-8 where it is that, else UTF-16 (little
    end first); also where over a twentieth of the letters are NUL, which go."""
    utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    nuls = F.char_length(utf8) - F.char_length(F.replace(utf8, F.lit("\x00"), F.lit("")))
    utf16 = F.decode(raw, "UTF-16LE")
    text = F.when(utf8.isNull() | (nuls > F.greatest(F.lit(1), F.floor(F.char_length(utf8) / 20))), utf16).otherwise(utf8)
    return F.replace(text, F.lit("\x00"), F.lit(""))


def header_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``level``, ``path``, ``capture_date``, ``version`` of each date line; the
    last header line above it holds for it, lines before any drop."""
    lines = df.select(key, F.posexplode(F.split(text, _LINES)).alias("pos", "line"))
    is_head = F.col("line").rlike(HEADER_LINE)
    level, path = (F.when(is_head, F.regexp_extract("line", HEADER_LINE, i)) for i in (1, 2))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(key, "pos", "line", is_head.alias("_head"), F.last(level, ignorenulls=True).over(w).try_cast("int").alias("level"), F.last(path, ignorenulls=True).over(w).alias("path"))
    found = rows.where(~F.col("_head") & F.col("line").rlike(DATE_LINE) & F.col("level").isNotNull())
    return found.select(key, "level", "path", F.try_to_date(F.regexp_extract("line", DATE_LINE, 1), "yyyy/MM/dd").alias("capture_date"), F.regexp_extract("line", DATE_LINE, 2).try_cast("int").alias("version"))


def available_dates(text: Column) -> Column:
    """All dates of an availability text, each once, ascending, as ISO texts."""
    every = F.concat(F.regexp_extract_all(text, F.lit(AVAILABLE_DATE), 1), F.regexp_extract_all(text, F.lit(TILE_DATE), 1))
    return F.sort_array(F.array_distinct(F.transform(every, lambda d: F.replace(d, F.lit("/"), F.lit("-")))))


def expand_dates(df: DataFrame, dates: str, date: str) -> DataFrame:
    """One row for each of the dates joined by ``;``, else for the row's own."""
    listed = F.filter(F.split(F.coalesce(F.col(dates), F.lit("")), ";"), lambda d: d != "")
    return df.withColumn(date, F.explode(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.substring(date, 1, 10)))))


def unfenced(text: Column) -> Column:
    """What stands between code fences that enclose the whole text, else the text."""
    spaces = F.lit(" \t\n\x0b\f\r")

    def inside(bare: Column) -> Column:
        n = F.char_length(bare)
        fenced = (n >= 6) & bare.startswith("```") & bare.endswith("```")
        return F.when(fenced, once(F.substring(bare, 4, n - 6), lambda t: F.btrim(F.when(t.startswith("json"), F.substring(t, 5, n)).otherwise(t), spaces))).otherwise(bare)

    return once(strip(text), inside)


def parse_json(text: Column) -> Column:
    """A variant; null unless the whole text is one JSON value. In an array of its own
    nothing can stand behind it."""
    only = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return once(only, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def strict_json(text: Column) -> Column:
    """The document as a variant; null unless all of it is JSON."""
    return parse_json(unfenced(text))


def json_object(text: Column) -> Column:
    """As :func:`strict_json`, else what stands from the first ``{`` to the last ``}``."""

    def found(bare: Column) -> Column:
        first, last = F.instr(bare, "{"), F.char_length(bare) - F.instr(F.reverse(bare), "}") + 1
        return F.coalesce(parse_json(bare), F.when((first > 0) & (last > first) & bare.contains("}"), parse_json(F.substring(bare, first, last - first + 1))))

    return once(unfenced(text), found)


def kind(v: Column, name: str) -> Column:
    """The type of a field; null where the key is missing, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def _fields(v: Column) -> Column:
    """The fields of an object by name, as variants; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _more(fields: Column, allowed: list[str]) -> Column:
    """Whether there are keys that are not allowed."""
    return F.coalesce(F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, allowed)))) > 0, F.lit(False))


def _number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE", "FLOAT", "VOID") | k.startswith("DECIMAL")


def _whole(v: Column) -> Column:
    """A whole number, a number whose fraction is cut off, or a text of digits."""
    text = F.try_variant_get(v, "$", "string")
    return once(F.schema_of_variant(v), lambda k: F.when(k == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.btrim(text).try_cast("int"))).when(_number(k), F.try_variant_get(v, "$", "double").try_cast("int")))


def item(v: Column, index: str, score: str = "confidence", flagged: bool = True, label: str | None = None, allowed: list[str] | None = None) -> Column:
    """The typed fields of an item, and whether they are ``valid``: its index, its
    score's type (within 0 to 1 without a flag), presence, flag, all there, and no
    further keys where only some are allowed."""

    def typed(fields: Column) -> Column:
        at = lambda name: F.try_element_at(fields, F.lit(name))
        get = lambda name, kind: F.try_variant_get(at(name), "$", kind)
        text = lambda name: F.coalesce(get(name, "string"), F.lit(""))
        seen = F.struct(_whole(at(index)).alias("i"), F.schema_of_variant(at("pv_present")).alias("p"), F.schema_of_variant(at(score)).alias("n"), get(score, "double").alias("value"), get("quality_flag", "string").alias("flag"))

        def checked(s: Column) -> Column:
            good = s["p"].isin("BOOLEAN", "VOID") & _number(s["n"]) & s["i"].isNotNull()
            good &= s["flag"].isin(FLAGS) if flagged else at("evidence").isNotNull() & (s["value"].isNull() | s["value"].between(0, 1))
            if label:
                good &= at(label).isNotNull()
            if allowed:
                good &= ~_more(fields, allowed)
            return F.struct(
                s["i"].alias(index), *([get(label, "string").alias(label)] if label else []), F.when(s["p"] == "BOOLEAN", get("pv_present", "boolean")).alias("pv_present"), s["value"].alias(score), s["flag"].alias("quality_flag"),
                text("evidence").alias("evidence"), text("notes").alias("notes"), F.coalesce(good, F.lit(False)).alias("valid"),
            )

        return once(seen, checked)

    return once(_fields(v), typed)


def json_items(text: Column, read: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """What ``read`` makes of the lines of a text that are JSON objects, in order, where
    it is to ``keep``. An expression of the row: lines are no rows, and none moves."""
    for mark in _BREAKS:  # one by one, since a pattern is slower; an empty line more is none
        text = F.replace(text, F.lit(mark), F.lit("\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("{") | F.ltrim(x, F.lit(BLANKS)).startswith("{"))
    return F.filter(F.transform(lines, lambda x: read(parse_json(x))), keep)


def lenient_lines(df: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """Valid JSON lines with an index of 1 to ``n``; the last of an index wins."""
    good = json_items(F.col(text), lambda v: item(v, "chip_index"), lambda r: r["valid"] & r["chip_index"].between(1, F.col(n)))
    # outer, since for an inner one the optimizer reads the lines before it as well
    rows = df.select(key, F.posexplode_outer(good).alias("pos", "r")).where("r is not null")
    best = rows.groupBy(key, F.col("r.chip_index").alias("chip_index")).agg(F.max_by(F.struct("r.pv_present", "r.confidence", "r.quality_flag"), "pos").alias("r"))
    return best.select(key, "chip_index", "r.*")


def missing_indices(df: DataFrame, found: DataFrame, key: str, n: str) -> DataFrame:
    """``missing``, the indices of 1 to ``n`` that a document lacks, joined by commas."""
    seen = found.groupBy(key).agg(F.collect_set("chip_index").alias("_seen"))
    every = F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))
    left = F.array_except(every, F.coalesce("_seen", F.array().cast("array<int>")))
    return df.select(key, n).join(seen, key, "left").select(key, F.array_join(left.cast("array<string>"), ",").alias("missing"))


def _items(document: Column) -> Column:
    return F.try_variant_get(document, "$.observations", "array<variant>")


def strict_documents(df: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """``ok`` of a document ``{"observations": [...]}``: each index of 1 to ``n``
    once, all valid, no further keys. Any fault makes the whole document invalid."""
    size, allowed = F.col(n), ["chip_index", *MATRIX_KEYS[2:]]
    items = F.transform(_items(strict_json(F.col(text))), lambda v: item(v, "chip_index", allowed=allowed))
    right = once(items, lambda i: (F.size(i) == size) & F.forall(i, lambda c: c["valid"] & c["chip_index"].between(1, size)) & (F.size(F.array_distinct(F.transform(i, lambda c: c["chip_index"]))) == size))
    return df.select(key, F.coalesce(right, F.lit(False)).alias("ok"))


def expected_cells(dates: Column, targets: Column) -> Column:
    """The cells of a matrix, by date and then by target: index, capture date, target
    identifier and label. ``dates``: ISO texts; ``targets``: structs of
    ``target_id`` and ``target_label``."""
    pairs = F.flatten(F.transform(dates, lambda d, i: F.transform(targets, lambda t: F.struct((i + 1).alias("date_index"), t["target_label"].alias("target_label"), d.alias("capture_date"), t["target_id"].alias("target_id")))))
    return F.transform(pairs, lambda c, i: F.struct((i + 1).alias("cell_index"), c["date_index"].alias("date_index"), c["target_label"].alias("target_label"), c["capture_date"].alias("capture_date"), c["target_id"].alias("target_id")))


def _same_cell(x: Column, c: Column) -> Column:
    return (x["date_index"] == c["date_index"]) & (x["target_label"] == c["target_label"])


def _in_grid(cells: Column, c: Column) -> Column:
    return F.exists(cells, lambda x: _same_cell(x, c))


def strict_cells(text: Column, cells: Column) -> Column:
    """The items of a document that has each cell of the grid once, all valid and
    without further keys; else null."""
    items = F.transform(_items(strict_json(text)), lambda v: item(v, "date_index", label="target_label", allowed=MATRIX_KEYS))
    names = lambda i: F.transform(i, lambda c: F.struct(c["date_index"], c["target_label"]))
    right = lambda i: (F.size(i) == F.size(cells)) & F.forall(i, lambda c: c["valid"] & _in_grid(cells, c)) & (F.size(F.array_distinct(names(i))) == F.size(cells))
    return once(items, lambda i: F.when(right(i), i))


def lenient_cells(text: Column, cells: Column) -> Column:
    """The valid lines for cells of the grid; the last of a cell wins."""
    items = json_items(text, lambda v: item(v, "date_index", label="target_label"), lambda r: r["valid"])
    last = lambda i: F.transform(cells, lambda c: F.try_element_at(F.filter(i, lambda r: _same_cell(r, c)), F.lit(-1)))
    return once(items, lambda i: F.array_distinct(F.filter(last(i), lambda r: r.isNotNull())))


def matrix_strict(df: DataFrame, key: str, text: str, cells: str) -> DataFrame:
    """``df`` with ``ok`` and ``found``, the :func:`strict_cells` of a text."""
    rows = df.withColumn("found", strict_cells(F.col(text), F.col(cells)))
    return rows.withColumn("ok", F.col("found").isNotNull())


def matrix_lenient(df: DataFrame, key: str, text: str, cells: str) -> DataFrame:
    """``df`` with ``found``, the :func:`lenient_cells` of a text."""
    return df.withColumn("found", lenient_cells(F.col(text), F.col(cells)))


def matrix_rows(df: DataFrame, more: list[str], cells: str = "cells", found: str = "found", source: str = "gemini_matrix", error: Column | None = None, about: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row a cell of the grid, in its order, with what the caller knows of it
    (``more`` of the document, ``about`` the cell); a cell that was not found is an
    explicit failure."""
    names = ["cell_index", "date_index", "target_label", "capture_date", "target_id"]
    own = {n: (lambda c, n=n: c[n]) for n in names} | {"r": lambda c: F.get(F.filter(found, lambda x: _same_cell(x, c)), F.lit(0))} | (about or {})
    each = F.transform(cells, lambda c: F.struct(*(make(c).alias(n) for n, make in own.items())))
    # outer, since for an inner one the optimizer makes the cells before it as well
    rows = df.select(*more, (error if error is not None else F.lit("missing cell")).alias("_e"), F.explode_outer(each).alias("c")).where("c is not null")
    rows = rows.select(*more, "c.*", "_e")
    there = F.col("r").isNotNull()
    return rows.select(
        *more, *(about or {}), "cell_index", "date_index", "target_label", "capture_date", "target_id", "r.pv_present", "r.confidence", F.when(there, F.col("r.quality_flag")).otherwise("unusable").alias("quality_flag"), F.when(there, F.col("r.evidence")).otherwise("").alias("evidence"),
        F.when(there, F.col("r.notes")).otherwise(F.concat(F.lit(f"{FAILED_SOURCE}: "), F.left("_e", F.lit(300)))).alias("notes"), F.when(there, source).otherwise(FAILED_SOURCE).alias("decision_source"),
    )


def sequence_summary(items: Column) -> tuple[Column, Column, Column, Column]:
    """Pattern (1, 0, ? by order), the first present item's date and index, and the
    consistency of ordered items."""
    mark = F.transform(items, lambda x: F.when(x["pv_present"], "1").when(~x["pv_present"], "0").otherwise("?"))
    first = F.get(F.filter(items, lambda x: x["pv_present"]), F.lit(0))
    bare = F.array_join(F.filter(mark, lambda m: m != "?"), "")
    state = F.when(bare.contains("10"), "non_monotonic_requires_review").when(F.array_contains(mark, "?"), "monotonic_with_unknown").otherwise("monotonic")
    return F.array_join(mark, "-"), first["capture_date"], first["date_index"], state


def sequence_strict(df: DataFrame, key: str, text: str, dates: str, source: str = "gemini_sequence") -> DataFrame:
    """``df`` with the sequence of one target: ``ok``, pattern, first present date,
    consistency, confidence, flag and notes, and ``items`` by date. A document with
    any fault is a failed sequence of unknowns."""
    n = F.size(dates)
    none = F.lit(None)

    def read(fields: Column) -> Column:
        at = lambda name, kind: F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", kind)
        confidence = F.schema_of_variant(F.try_element_at(fields, F.lit("confidence")))
        head = ~_more(fields, SEQUENCE_KEYS) & at("quality_flag", "string").isin(FLAGS) & once(confidence, lambda k: k.isNull() | _number(k))
        items = F.transform(at("observations", "array<variant>"), lambda v: item(v, "date_index", "pv_score", flagged=False, allowed=SEQUENCE_ITEM_KEYS))
        right = lambda i: head & (F.size(i) == n) & F.forall(i, lambda c: c["valid"] & c["date_index"].between(1, n)) & (F.size(F.array_distinct(F.transform(i, lambda c: c["date_index"]))) == n)
        ordered = lambda i: F.sort_array(F.transform(i, lambda c: F.struct(c["date_index"].alias("date_index"), F.get(dates, c["date_index"] - 1).alias("capture_date"), c["pv_present"].alias("pv_present"), c["pv_score"].alias("pv_score"), c["evidence"].alias("evidence"), c["notes"].alias("notes"))))
        return once(items, lambda i: F.when(right(i), F.struct(ordered(i).alias("items"), at("quality_flag", "string").alias("flag"), at("confidence", "double").alias("confidence"), F.coalesce(at("review_notes", "string"), F.lit("")).alias("notes"))))

    blank = F.transform(dates, lambda d, i: F.struct((i + 1).alias("date_index"), d.alias("capture_date"), none.cast("boolean").alias("pv_present"), none.cast("double").alias("pv_score"), F.lit("").alias("evidence"), F.lit(f"{FAILED_SOURCE}: invalid document").alias("notes")))
    rows = df.withColumn("_s", once(_fields(strict_json(F.col(text))), read))
    ok = F.col("_s").isNotNull()
    rows = rows.withColumns({"ok": ok, "items": F.when(ok, F.col("_s.items")).otherwise(blank)})
    pattern, first, index, state = sequence_summary(F.col("items"))
    ok = F.col("ok")
    return rows.withColumns({
        "sequence_pattern": pattern, "first_present_date": first, "first_present_date_index": index, "consistency_flag": F.when(ok, state).otherwise("sequence_failed"), "confidence": F.col("_s.confidence"),
        "quality_flag": F.when(ok, F.col("_s.flag")).otherwise("sequence_failed"), "review_notes": F.when(ok, F.col("_s.notes")).otherwise(f"{FAILED_SOURCE}: invalid document"), "decision_source": F.when(ok, source).otherwise(FAILED_SOURCE),
    }).drop("_s")


def best_response(attempts: DataFrame, key: list[str], attempt: str, found: str) -> DataFrame:
    """Of attempts with their valid items, a key's with most of them, the earlier of
    equal ones: a complete one always wins."""
    n = F.coalesce(F.size(found), F.lit(0))
    rest = [c for c in attempts.columns if c not in key]
    return attempts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(n, -F.col(attempt))).alias("_r")).select(*key, "_r.*")


def with_missing(expected: DataFrame, found: DataFrame, keys: list[str], source: str = "review") -> DataFrame:
    """Each expected row; those that were not found are explicit failures."""
    there = found.withColumn("_there", F.lit(True))
    joined = expected.join(there, keys, "left")
    return joined.withColumn("quality_flag", F.when(F.col("_there"), F.col("quality_flag")).otherwise("unusable")).withColumn("decision_source", F.when(F.col("_there"), source).otherwise(FAILED_SOURCE)).drop("_there")


def census_reference(picks: DataFrame, key: str, census: str, date: str = "capture_date", index: str = "chip_index") -> DataFrame:
    """The key's latest pick of six months before the census or later, the first of
    equal ones. The limit is a text whose day is not adjusted to its month."""
    year_, month = F.substring(census, 1, 4).cast("int"), F.substring(census, 6, 2).cast("int")
    limit = F.format_string("%04d-%02d-%s", F.when(month > 6, year_).otherwise(year_ - 1), F.when(month > 6, month - 6).otherwise(month + 6), F.substring(census, 9, 2))
    late = picks.where(F.col(date).cast("string") >= limit)
    return late.groupBy(key).agg(F.max_by(F.struct(index, date), F.struct(F.col(date), -F.col(index))).alias("_r")).select(key, "_r.*")
