"""Catalogs of dated versions: one row a date, the best zoom, picks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_by_date(df: DataFrame, key: list[str], version: str, order: list[str]) -> DataFrame:
    """The row of the lowest version of each key, with ``all_versions`` (sorted,
    joined by ;) and ``n_versions``. One exchange of the rows as they are and one
    sort of them; few keys repeat, so combining before would only cost."""
    w = Window.partitionBy(*key)
    versions = F.sort_array(F.collect_set(version).over(w))
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(version, *order)), "_v": versions})
    return ranked.where("_i = 1").select(*df.columns, F.array_join(F.col("_v").cast("array<string>"), ";").alias("all_versions"), F.size("_v").cast("long").alias("n_versions"))


def priority_union(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """All rows of the parts, the first part that has a key giving its row."""
    every = parts[0].withColumn("_rank", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_rank", F.lit(n)))
    rest = [c for c in parts[0].columns if c not in key]
    return every.groupBy(*key).agg(F.min_by(F.struct(*rest, "_rank"), F.struct("_rank", *order)).alias("_r")).select(*key, "_r.*").drop("_rank")


def first_success(attempts: DataFrame, key: list[str], position: str, ok: Column, payload: str) -> DataFrame:
    """A ladder of attempts: the first that is ok, else all failed."""
    return attempts.groupBy(*key).agg(F.when(F.count_if(ok) > 0, F.min(F.when(ok, F.struct(position, payload)))[payload]).alias("actual"), F.when(F.count_if(ok) > 0, "ok").otherwise("all_zooms_failed").alias("status"), F.count("*").alias("n_attempts"))


def even_picks(df: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    """At most ``count`` rows of a key, evenly spaced with both ends, numbered
    from 1 as ``chip_index``. Halves round to even."""
    w = Window.partitionBy(key)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / float(count - 1)).cast("int"))
    kept = ranked.where((F.col("_n") <= count) | F.array_contains(spots, F.col("_i")))
    return kept.withColumn("chip_index", F.row_number().over(w.orderBy("_i"))).drop("_i", "_n")


def chunks(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Consecutive blocks of a key's rows: ``chunk`` from 0, ``local_index`` from 1."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumns({"chunk": F.floor(F.col("_n") / size).cast("int"), "local_index": (F.col("_n") % size + 1).cast("int")}).drop("_n")


def first_rows(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def last_of(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """One row a key: the last by ``ordinal``, which tells rows apart."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*key, "_r.*")


def override(base: DataFrame, manual: DataFrame, first: list[str], second: list[str], fields: list[str], source: str = "decision_source", flag: str = "quality_flag", ordinal: str | None = None) -> DataFrame:
    """Left join with overrides by the keys ``first``, else ``second``, of which the
    first column is the same: one exchange of the base. Of overrides with one key the
    last by ``ordinal`` counts. A blank field of one leaves the base's; the source is
    replaced always, and a flag that is blank then becomes ``ok``."""
    shared, one, two = first[0], first[1:], second[1:]
    value = [*fields, source]
    order = [ordinal] if ordinal else value
    keyed = lambda names, tag: manual.select(shared, F.concat_ws("\x1f", F.lit(tag), *(F.col(c).cast("string") for c in names)).alias("_k"), F.struct(*value).alias("_m"), F.struct(*order).alias("_o")).where(F.expr(" and ".join(f"`{c}` is not null" for c in names)))
    # all overrides of the shared key, by their keys: looked up twice in one row
    kept = keyed(one, "a").unionByName(keyed(two, "b")).groupBy(shared, "_k").agg(F.max_by("_m", "_o").alias("_m"))
    index = kept.groupBy(shared).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_m"))).alias("_by"))
    look = lambda names, tag: F.when(F.expr(" and ".join(f"`{c}` is not null" for c in names)), F.try_element_at("_by", F.concat_ws("\x1f", F.lit(tag), *(F.col(c).cast("string") for c in names))))
    joined = base.join(index, shared, "left").withColumn("_m", F.coalesce(look(one, "a"), look(two, "b"))).drop("_by")
    there, kinds = F.col("_m").isNotNull(), dict(base.dtypes)
    given = {f: F.nullif(F.btrim(F.col(f"_m.{f}")), F.lit("")) if kinds[f] == "string" else F.col(f"_m.{f}") for f in fields}
    new = {f: F.coalesce(given[f], F.col(f)) for f in fields}
    if flag in new:
        new[flag] = F.when(there & (F.coalesce(new[flag], F.lit("")) == ""), "ok").otherwise(new[flag])
    new[source] = F.when(there, F.coalesce(F.nullif(F.col(f"_m.{source}"), F.lit("")), F.lit("manual"))).otherwise(F.col(source))
    return joined.withColumns(new).drop("_m")


def unscored(catalog: DataFrame, scored: DataFrame, key: str, date: str) -> DataFrame:
    """Dates of a catalog, each once, that were not scored."""
    return catalog.select(key, date).distinct().join(scored.select(key, date), [key, date], "left_anti")


def walk_back_dates(left: DataFrame, bounds: DataFrame, key: str, date: str, boundary: str, years: int) -> DataFrame:
    """Of unscored dates those before the key's boundary and at most ``years``
    calendar years back."""
    d, b = F.col(date), F.col(boundary)
    return left.join(bounds.select(key, boundary), key).where((d < b) & (F.year(d) >= F.year(b) - years)).select(key, date)


def tail_dates(left: DataFrame, bounds: DataFrame, key: str, date: str, boundary: str) -> DataFrame:
    """All unscored dates before the key's boundary."""
    return left.join(bounds.select(key, boundary), key).where(F.col(date) < F.col(boundary)).select(key, date)


def gap_dates(left: DataFrame, turns: DataFrame, key: str, date: str, absent: str = "absent_date", present: str = "present_date") -> DataFrame:
    """Unscored dates between the absent and the present end of a key's turn."""
    return left.join(turns.select(key, absent, present), key).where((F.col(date) > F.col(absent)) & (F.col(date) < F.col(present))).select(key, date)


def floor_rows(df: DataFrame, key: str, date: str, floor_year: int) -> DataFrame:
    """A key's rows of the floor year or later; all of them, ``degraded``, if there
    are none."""
    recent = F.year(date) >= floor_year
    any_ = F.max(recent).over(Window.partitionBy(key))
    return df.withColumn("degraded", ~any_).where(recent | F.col("degraded"))


def best_attempts(attempts: DataFrame, key: list[str], attempt: str, n_valid: str) -> DataFrame:
    """A key's attempt with most valid rows; the earlier of equal ones."""
    return attempts.groupBy(*key).agg(F.max_by(attempt, F.struct(n_valid, -F.col(attempt))).alias(attempt), F.max(n_valid).alias(n_valid))


def salvage(best: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the best attempt, and of the fallback for keys that it lacks."""
    return best.unionByName(fallback.join(best.select(*key), key, "left_anti"))


def resume(jobs: DataFrame, done: DataFrame, key: list[str], least: Column | int, window: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs that are pending, and rows to carry over: a job is complete with at least
    ``least`` done rows of its key and of its ``window`` columns."""
    keys = [*key, *(window or [])]
    counts = done.groupBy(*keys).agg(F.count("*").alias("_n"))
    complete = jobs.join(counts, keys).where(F.col("_n") >= least).select(*keys)
    return jobs.join(complete, keys, "left_anti"), done.join(complete, keys, "left_semi")


def task_quality(n_files: Column, n_dates: Column) -> tuple[Column, Column]:
    """Decision source and quality flag of a task by what its folder holds."""
    none = n_files == 0
    return F.when(none, "missing_chip").otherwise("manual_template"), F.when(none, "missing_chip").when(n_dates == 0, "no_date_metadata").when(n_dates > 1, "mixed_capture_dates").otherwise("needs_review")


def file_summary(files: DataFrame, key: list[str], path: str, date: str) -> DataFrame:
    """``n_files``, ``first_path``, ``dates`` (joined by ;), ``first_date``,
    ``n_dates`` of a task's files."""
    days = F.sort_array(F.collect_set(F.col(date).cast("string")))
    return files.groupBy(*key).agg(F.count(path).alias("n_files"), F.min(path).alias("first_path"), F.array_join(days, ";").alias("dates"), F.min(date).alias("first_date"), F.size(days).cast("long").alias("n_dates"))


def cell_status(files: DataFrame, key: list[str], requested_year: str, path: str, date: str) -> DataFrame:
    """One row a cell of a key and a year, of files that are left-joined to them: how
    many there are, their dominant date (the earliest of equally frequent ones) and
    ``status``. A cell's folder is missing where ``path`` is null, empty where it is
    blank."""
    keys = [*key, requested_year]
    days = files.groupBy(*keys, date).agg(F.count(F.when(F.col(path) != "", 1)).alias("_n"), F.count(path).alias("_there"))
    d = F.col(date)
    known = days.groupBy(*keys).agg(
        F.sum("_n").alias("n_tiles"), F.max("_there").alias("_there"), F.max_by(date, F.struct(F.when(d.isNotNull(), F.col("_n")), -F.unix_date(d))).alias("dominant_date"),
        F.count(date).alias("n_dates"), F.coalesce(F.bool_or(F.year(d) == F.col(requested_year)), F.lit(False)).alias("_hit"),
    )
    status = F.when(F.col("_there") == 0, "missing_folder").when(F.col("n_tiles") == 0, "empty").when(F.col("n_dates") == 0, "no_date_metadata").when(F.col("_hit"), "available").otherwise("drift")
    return known.select(*keys, "n_tiles", "n_dates", "dominant_date", status.alias("status"))


def cell_mark(status: Column) -> Column:
    return F.when(status == "available", "Y").when(status == "drift", "~").when(status.isNotNull(), ".").otherwise("?")


def year_pivot(cells: DataFrame, key: list[str], requested_year: str, value: Column, years: list[int], missing: str = "?") -> DataFrame:
    """One row a key, ``y<year>`` for each of ``years``."""
    wide = cells.withColumn("_v", value).groupBy(*key).pivot(requested_year, years).agg(F.first("_v"))
    return wide.select(*key, *(F.coalesce(F.col(f"`{y}`"), F.lit(missing)).alias(f"y{y}") for y in years))


def group_summary(sizes: DataFrame, size: str) -> DataFrame:
    """Of groups' sizes: how many, mean, median, largest, singles, rows a group, and
    the histogram as ``size:count`` in order."""
    n, k = F.col(size), F.col("_k")
    parts = sizes.groupBy(size).agg(F.count("*").alias("_k"))
    bars = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(n.cast("long").alias("n"), "_k"))), lambda x: F.concat(x["n"], F.lit(":"), x["_k"])), ",")
    mean = F.round(F.sum(n * k) / F.sum(k), 6)
    return parts.agg(F.sum(k).alias("n_groups"), mean.alias("mean_size"), F.percentile(n, 0.5, k).alias("median_size"), F.max(n).alias("max_size"), F.coalesce(F.sum(F.when(n == 1, k)), F.lit(0)).alias("n_single"), mean.alias("reduction"), bars.alias("histogram"))


def referenced(df: DataFrame, to: DataFrame, key: str) -> DataFrame:
    """Inner join that raises on a row whose key is missing in ``to``."""
    found = df.join(to.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("_there")
