"""Presence rows: observations from raw rows, tasks with their files and manual
decisions, matrices of dates and targets, and sequences of one target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onset.functions import parse as P
from onset.functions.parse import once
from onset.operators import catalog as C
from onset.operators import review as R

# Columns of dates and scores in order, flags that stay blank, the
# statuses of files that are there, and what a reviewer's labels stand for.
DATE_COLUMNS = ["capture_date", "actual_capture_date", "dominant_actual_date", "requested_date", "date"]
SCORE_COLUMNS = ["pv_score", "presence_score", "score", "prob", "pv_prob"]
BLANK_FLAGS = ["unusable", "unsure", "missing_chip"]
THERE = ["ok", "skipped_existing"]
DECISION_DATES = ["requested_date", "date", "capture_date", "actual_capture_date"]
LABELS = {"present": ("1", "1.0", "ok"), "absent": ("0", "0.0", "ok"), "unusable": ("", "", "unusable"), "unsure": ("", "", "ambiguous")}
NON_MONOTONIC = "non_monotonic_requires_review: usable binary series has present->absent transition"


def _text(df: DataFrame, name: str) -> Column:
    """A column as stripped text, blank where it is null or not there."""
    return P.strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def _stripped(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with columns as :func:`_text` has them, each stripped once, where those
    that are not there are blank."""
    return df.withColumns({n: _text(df, n) for n in names})


def _either(*texts: Column) -> Column:
    """The first that is not blank, else blank."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def observations(rows: DataFrame, threshold: float = 0.5, ordinal: str | None = None, check: str = "raise") -> DataFrame:
    """Typed observations of raw text rows. Rows without a key or any date are left
    out. A flag that says a chip was not scored allows no presence: such a row
    raises, or with ``check="mark"`` has ``violation``."""
    date = P.first_date([_text(rows, c) for c in DATE_COLUMNS])
    present, score = P.presence(_text(rows, "pv_present"), [_text(rows, c) for c in SCORE_COLUMNS], threshold)
    flag = _either(_text(rows, "quality_flag"), F.lit("ok"))
    found = rows.select(
        _text(rows, "anchor_id").alias("anchor_id"), date.alias("capture_date"), P.iso_date(_text(rows, "requested_date")).alias("requested_date"), present.alias("pv_present"), score.alias("pv_score"), flag.alias("quality_flag"),
        (F.col(ordinal).cast("long") if ordinal else F.lit(None).cast("long")).alias("source_row"),
    ).where("anchor_id <> '' and capture_date is not null")
    bad = F.col("quality_flag").isin(BLANK_FLAGS) & F.col("pv_present").isNotNull()
    if check == "mark":
        return found.withColumn("violation", bad)
    said = F.concat(F.lit("no presence is allowed with flag "), "quality_flag", F.lit(", anchor "), "anchor_id")
    return found.withColumn("pv_present", F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.col("pv_present")))


def task_anchor(tasks: DataFrame, anchors: DataFrame, on_missing: str = "raise") -> DataFrame:
    """``tasks`` with ``_anchor``: the first of their ``anchor_id``, ``grid_id`` and
    the part of ``task_name`` before a date that is an anchor. One exchange: the
    three are looked up as rows, and the first found is taken."""
    pattern = r"^(.+)_(\d{8})$"
    prefix = once(_text(tasks, "task_name"), lambda name: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)))
    numbered = tasks.withColumn("_id", F.struct(*(F.col(c) for c in tasks.columns)))
    tries = numbered.select("_id", F.posexplode(F.array(_text(tasks, "anchor_id"), _text(tasks, "grid_id"), prefix)).alias("_at", "_try"))
    known = anchors.select(_text(anchors, "anchor_id").alias("_try")).where("_try <> ''").distinct().withColumn("_there", F.lit(True))
    hits = tries.join(known, "_try", "left").groupBy("_id").agg(F.min(F.when(F.col("_there"), F.struct("_at", "_try"))).alias("_hit"), F.count("*").alias("_n"))
    # equal tasks met in one group: as many rows as there were
    rows = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_n") / 3).cast("int"))))
    anchor = F.col("_hit._try")
    if on_missing == "raise":
        anchor = F.when(anchor.isNull(), F.raise_error(F.concat(F.lit("no anchor for task "), F.coalesce("_id.task_name", F.lit(""))))).otherwise(anchor)
    return rows.select("_id.*", anchor.alias("_anchor"))


def manual_index(rows: DataFrame, ordinal: str) -> DataFrame:
    """Manual decisions by key and date, the first of four dates that is not blank;
    the last row of a key and date counts."""
    key = _either(_text(rows, "anchor_id"), _text(rows, "grid_id"))
    date = F.substring(_either(*(_text(rows, c) for c in DECISION_DATES)), 1, 10)
    kept = rows.select(key.alias("anchor_id"), date.alias("decision_date"), *(_text(rows, c).alias(c) for c in ("pv_present", "pv_score", "quality_flag", "notes", "decision_source")), F.col(ordinal).alias("_ordinal"))
    return C.last_of(kept.where("anchor_id <> '' and decision_date <> ''"), ["anchor_id", "decision_date"], "_ordinal").drop("_ordinal")


def label_rows(rows: DataFrame, label: str) -> DataFrame:
    """A reviewer's labels as manual decisions; an unknown one is ambiguous."""
    pick = lambda i, other: F.coalesce(*(F.when(F.col(label) == k, v[i]) for k, v in LABELS.items()), F.lit(other))
    return rows.withColumns({"pv_present": pick(0, ""), "pv_score": pick(1, ""), "quality_flag": pick(2, "ambiguous"), "decision_source": F.lit("manual")})


def presence_rows(anchors: DataFrame, tasks: DataFrame, files: DataFrame, manual: DataFrame | None = None, include_missing: bool = True, least_bytes: int = 1) -> DataFrame:
    """One row a task: its anchor, what its folder holds (``files``: ``chip_dir``,
    ``path``, ``length``, ``capture_date`` text or null), and the manual decision for
    its requested date, else for its capture date."""
    jobs = task_anchor(tasks, anchors)
    jobs = jobs.select(
        F.col("_anchor").alias("anchor_id"), F.substring(_either(_text(jobs, "date"), _text(jobs, "requested_date")), 1, 10).alias("requested_date"), _text(jobs, "task_name").alias("task_name"), _text(jobs, "save_to").alias("save_to"),
    ).withColumn("chip_dir", P.task_dir(F.col("save_to"), F.col("task_name")))
    held = C.file_summary(files.where(F.col("length") >= least_bytes), ["chip_dir"], "path", "capture_date")
    about = anchors.select(_text(anchors, "anchor_id").alias("anchor_id"), _text(anchors, "region_key").alias("region_key"), _text(anchors, "grid_id").alias("grid_id")).dropDuplicates(["anchor_id"])
    rows = jobs.join(held, "chip_dir", "left").na.fill(0, ["n_files", "n_dates"]).join(about, "anchor_id")
    if not include_missing:
        rows = rows.where("n_files > 0")
    source, flag = C.task_quality(F.col("n_files"), F.col("n_dates"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = rows.select(
        "anchor_id", "region_key", "grid_id", "requested_date", blank("first_date").alias("capture_date"), blank("dates").alias("actual_capture_dates"), F.lit("").alias("pv_score"), F.lit("").alias("pv_present"), source.alias("decision_source"), flag.alias("quality_flag"),
        "chip_dir", blank("first_path").alias("sample_chip_path"), F.col("n_files").alias("n_jpg"), "task_name", "save_to", F.lit("").alias("notes"),
    )
    if manual is None:
        return base
    by = manual.withColumns({"requested_date": F.col("decision_date"), "capture_date": F.col("decision_date")})
    return C.override(base, by, ["anchor_id", "requested_date"], ["anchor_id", "capture_date"], ["pv_present", "pv_score", "quality_flag", "notes"])


# --- targets and chips ---


def targets(rows: DataFrame, radius: float = 10.0) -> DataFrame:
    """Typed targets of a chip; raises where a name or a needed number is missing.
    Their order within a chip is by index, label and key."""
    need = lambda c: F.when(F.col(c) == "", F.raise_error(F.lit(f"target without {c}"))).otherwise(F.col(c))
    number = lambda c: once(P.number(F.col(c)), lambda v: P.required(v, c))
    rows = _stripped(rows, ["chip_id", "anchor_id", "target_label", "target_index", "region_key", "grid_id", "target_offset_x_m", "target_offset_y_m", "chip_size_m", "search_radius_m"])
    return rows.select(
        need("chip_id").alias("chip_id"), need("anchor_id").alias("target_id"), need("target_label").alias("target_label"), F.coalesce(P.whole_number(F.col("target_index")), F.lit(0)).alias("target_index"), "region_key", "grid_id",
        number("target_offset_x_m").alias("offset_x_m"), number("target_offset_y_m").alias("offset_y_m"), number("chip_size_m").alias("chip_size_m"), F.coalesce(P.number(F.col("search_radius_m")), F.lit(radius)).alias("search_radius_m"),
    )


def artifacts(rows: DataFrame) -> DataFrame:
    """Usable images of chips: those with a key, date and path whose status is blank
    or says that they are there."""
    rows = _stripped(rows, ["anchor_id", "chip_id", "capture_date", "version", "path", "actual_zoom", "zoom", "status"])
    found = rows.select(
        _either(F.col("anchor_id"), F.col("chip_id")).alias("chip_id"), F.substring("capture_date", 1, 10).alias("capture_date"), "version", "path",
        P.whole_number(_either(F.col("actual_zoom"), F.col("zoom"))).alias("actual_zoom"), _either(F.col("status"), F.lit("ok")).alias("status"),
    )
    return found.where((F.col("chip_id") != "") & (F.col("capture_date") != "") & (F.col("path") != "") & F.col("status").isin(THERE))


def review_images(rows: DataFrame) -> DataFrame:
    """Images for review; rows without key, chip, label or date are left out."""
    found = rows.select(
        *(_text(rows, c).alias(c) for c in ("anchor_id", "region_key", "grid_id", "chip_id", "target_label")), F.coalesce(P.whole_number(_text(rows, "date_index")), F.lit(0)).alias("date_index"), F.substring(_text(rows, "capture_date"), 1, 10).alias("capture_date"),
        _either(_text(rows, "review_png_path"), _text(rows, "image_path")).alias("review_png_path"), _either(_text(rows, "source_chip_path"), _text(rows, "chip_path")).alias("source_chip_path"), P.whole_number(_text(rows, "actual_zoom")).alias("actual_zoom"),
        _either(_text(rows, "render_status"), _text(rows, "status"), F.lit("ok")).alias("render_status"), _either(_text(rows, "render_notes"), _text(rows, "notes")).alias("render_notes"),
    )
    return found.where(" and ".join(f"{c} <> ''" for c in ("anchor_id", "chip_id", "target_label", "capture_date")))


def artifact_by_date(rows: DataFrame) -> DataFrame:
    """A chip's image of each date: the first by version, as text, and path."""
    rest = [c for c in rows.columns if c not in ("chip_id", "capture_date")]
    return rows.groupBy("chip_id", "capture_date").agg(F.min_by(F.struct(*rest), F.struct(F.col("version").cast("string"), "path")).alias("_r")).select("chip_id", "capture_date", "_r.*")


def review_manifest(target_rows: DataFrame, artifact_rows: DataFrame, dates: list[str], files: DataFrame | None = None) -> DataFrame:
    """Each target at each of ``dates`` with its source image; one that is not known,
    or not among ``files`` (``path``), is an explicit failure."""
    days = F.explode(F.array(*(F.struct(F.lit(i).alias("date_index"), F.lit(d).alias("capture_date")) for i, d in enumerate(dates, 1)))).alias("d")
    wanted = target_rows.select(F.col("target_id").alias("anchor_id"), "region_key", "grid_id", "chip_id", "target_label", "target_index", days).select("*", "d.*").drop("d")
    chosen = artifact_by_date(artifact_rows).select("chip_id", "capture_date", F.col("path").alias("source_chip_path"), "actual_zoom")
    rows = wanted.join(chosen, ["chip_id", "capture_date"], "left")
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("source_chip_path"), F.lit(True).alias("_there")).distinct(), "source_chip_path", "left")
    else:
        rows = rows.withColumn("_there", F.lit(True))
    note = F.when(F.col("source_chip_path").isNull(), "missing_source_artifact_for_date").when(F.col("_there").isNull(), "source_chip_missing").otherwise("")
    return rows.select("anchor_id", "region_key", "grid_id", "chip_id", "target_label", "target_index", "date_index", "capture_date", F.coalesce("source_chip_path", F.lit("")).alias("source_chip_path"), "actual_zoom", F.when(note == "", "ok").otherwise("failed").alias("render_status"), note.alias("render_notes"))


def matrix_jobs(target_rows: DataFrame, artifact_rows: DataFrame, max_dates: int = 5, max_targets: int = 4, hard_cells: int = 24) -> DataFrame:
    """Calls of chips that have both targets and images: blocks of targets, and of as
    many dates as the cells allow. ``chip_id``, ``target_chunk``, ``date_chunk`` (from
    1), ``dates``, ``paths`` and ``targets``."""
    t = F.struct("target_index", "target_label", "target_id", "region_key", "grid_id")
    a = F.struct("capture_date", "version", "path", "actual_zoom")
    groups = target_rows.groupBy("chip_id").agg(F.sort_array(F.collect_list(t)).alias("_t")).join(artifact_rows.groupBy("chip_id").agg(F.sort_array(F.collect_list(a)).alias("_a")), "chip_id")
    cut = lambda items, size: F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1), lambda i: F.slice(items, i * size + 1, size))
    by_target = groups.select("chip_id", "_a", F.posexplode(cut(F.col("_t"), F.lit(max_targets))).alias("_i", "targets"))
    size = F.least(F.lit(max_dates), F.greatest(F.lit(1), F.floor(F.lit(hard_cells) / F.size("targets")).cast("int")))
    both = by_target.withColumn("_size", size).select("chip_id", "targets", "_i", F.posexplode(cut(F.col("_a"), F.col("_size"))).alias("_j", "images"))
    return both.select("chip_id", (F.col("_i") + 1).alias("target_chunk"), (F.col("_j") + 1).alias("date_chunk"), F.transform("images", lambda x: x["capture_date"]).alias("dates"), "images", "targets")


def score_matrices(jobs: DataFrame, responses: Callable[[DataFrame], DataFrame], strict: bool = True, source: str = "gemini_matrix") -> DataFrame:
    """Presence rows of matrix calls. ``responses`` gives rows of the jobs' key
    (``chip_id``, ``target_chunk``, ``date_chunk``), ``attempt`` and ``raw``, or the
    jobs themselves with ``attempts``, an array of both, where no row has to meet
    another; of a call's attempts the one with most valid cells counts, and cells that
    it lacks are explicit failures. Calls without a response fail whole."""
    key = ["chip_id", "target_chunk", "date_chunk"]
    said = responses(jobs)
    if "attempts" not in said.columns:
        tries = said.groupBy(*key).agg(F.collect_list(F.struct("attempt", "raw")).alias("attempts"))
        said = jobs.join(tries, key, "left")
    asked = said.withColumn("cells", R.expected_cells(F.col("dates"), F.col("targets")))
    read = R.strict_cells if strict else R.lenient_cells
    tried = F.transform("attempts", lambda a: read(a["raw"], F.col("cells")))
    most = lambda t: F.array_max(F.transform(t, lambda f, i: F.struct(F.coalesce(F.size(f), F.lit(0)).alias("n"), (-F.get("attempts", i)["attempt"]).alias("earlier"), i.alias("i"))))["i"]
    asked = asked.withColumn("found", once(tried, lambda t: F.get(t, most(t))))
    about = {"image": lambda c: F.get("images", c["date_index"] - 1), "target": lambda c: F.get(F.filter("targets", lambda t: t["target_label"] == c["target_label"]), F.lit(0))}
    rows = R.matrix_rows(asked, key, source=source, about=about)
    image, target = F.col("image"), F.col("target")
    notes = F.concat_ws("; ", F.concat(F.lit("chip_id="), "chip_id"), F.concat(F.lit("target_label="), "target_label"), F.concat(F.lit("date_index="), "date_index"), F.concat(F.lit("actual_zoom="), F.coalesce(image["actual_zoom"].cast("string"), F.lit(""))), F.nullif("notes", F.lit("")))
    made = rows.select(
        F.col("target_id").alias("anchor_id"), target["region_key"].alias("region_key"), target["grid_id"].alias("grid_id"), "capture_date", P.tri_text(F.col("pv_present")).alias("pv_score"), P.tri_text(F.col("pv_present")).alias("pv_present"), "decision_source", "quality_flag",
        "chip_id", "target_label", F.col("date_index").alias("matrix_date_index"), F.col("cell_index").alias("matrix_cell_index"), image["actual_zoom"].alias("actual_zoom"), image["path"].alias("source_chip_path"), P.fixed(F.col("confidence"), 4).alias("confidence"), F.col("evidence"), notes.alias("notes"), "target_chunk", "date_chunk",
    )
    return flag_targets(made, source)


def flag_targets(rows: DataFrame, source: str = "gemini_matrix") -> DataFrame:
    """A note on all rows of a target that has, among scored usable ones, an absent
    date after a present one; once only."""
    use = (F.col("decision_source") == source) & (F.col("quality_flag") == "usable")
    w = Window.partitionBy("chip_id", "anchor_id")
    date = F.col("capture_date")
    at = F.struct(date, *(c for c in ("target_chunk", "date_chunk", "matrix_cell_index") if c in rows.columns))
    bad = F.max(F.when(use & (F.col("pv_present") == "0"), at)).over(w) > F.min(F.when(use & (F.col("pv_present") == "1"), at)).over(w)
    has = F.coalesce("notes", F.lit(""))
    return rows.withColumn("notes", F.when(F.coalesce(bad, F.lit(False)) & ~has.contains(NON_MONOTONIC), F.concat_ws("; ", F.nullif(has, F.lit("")), F.lit(NON_MONOTONIC))).otherwise(has))


SEQUENCE_KEY = ["chip_id", "anchor_id", "target_label"]


def window_rows(images: DataFrame, dates: list[str], files: DataFrame | None = None) -> DataFrame:
    """A target's image of each date of a window: the first usable row of a date, else
    the first. ``selected`` (by date, null where there is none) and ``missing``, the
    dates without a usable one, joined by commas."""
    there = images.where(F.col("capture_date").isin(dates)) if dates else images
    if files is not None:
        there = there.join(files.select(F.col("path").alias("review_png_path"), F.lit(True).alias("_there")).distinct(), "review_png_path", "left")
    else:
        there = there.withColumn("_there", F.lit(True))
    usable = F.coalesce(F.col("render_status").isin(THERE) & (F.col("review_png_path") != "") & F.col("_there"), F.lit(False))
    one = there.withColumn("usable", usable).groupBy(*SEQUENCE_KEY, "capture_date").agg(
        F.min(F.struct((~F.col("usable")).alias("worse"), "date_index", "review_png_path", "source_chip_path", "actual_zoom", "region_key", "grid_id")).alias("r")
    )
    rows = one.groupBy(*SEQUENCE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("capture_date", "r"))).alias("_by"))
    keys = images.select(*SEQUENCE_KEY).distinct()
    window = F.array(*map(F.lit, dates)).cast("array<string>")
    got = keys.join(rows, SEQUENCE_KEY, "left").withColumn("selected", F.transform(window, lambda d: F.try_element_at("_by", d)))
    lacking = F.filter(window, lambda d: F.coalesce(F.try_element_at("_by", d)["worse"], F.lit(True)))
    return got.withColumn("missing", F.array_join(lacking, ",")).withColumn("dates", window).drop("_by")


def score_sequences(images: DataFrame, dates: list[str], responses: Callable[[DataFrame], DataFrame], files: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """One row a target: its sequence over a window of dates. Targets that lack an
    image are pending, with a pattern of unknowns; those of ``done`` (a result of
    before, of the same window and as many items) are carried over. ``responses``
    gives ``attempt`` and ``raw`` of the others; the best valid attempt counts."""
    window = ",".join(dates)
    jobs = window_rows(images, dates, files)
    carried = None
    if done is not None:
        carried = done.where((F.col("date_window") == window) & (F.size("items") >= len(dates)))
        jobs = jobs.join(carried.select(*SEQUENCE_KEY), SEQUENCE_KEY, "left_anti")
    pending = jobs.where("missing <> ''")
    ready = jobs.where("missing = ''")
    raw = responses(ready).select(*SEQUENCE_KEY, "attempt", "raw")
    tries = ready.join(raw, SEQUENCE_KEY, "left")
    read = R.sequence_strict(tries, "anchor_id", "raw", "dates")
    rest = [c for c in read.columns if c not in SEQUENCE_KEY]
    best = read.groupBy(*SEQUENCE_KEY).agg(F.max_by(F.struct(*rest), F.struct("ok", -F.coalesce("attempt", F.lit(0)))).alias("r")).select(*SEQUENCE_KEY, "r.*")
    names = ["sequence_pattern", "first_present_date", "first_present_date_index", "confidence", "consistency_flag", "decision_source", "quality_flag", "review_notes", "items"]
    about = [F.get(F.filter("selected", lambda x: x.isNotNull()), F.lit(0))[c].alias(c) for c in ("region_key", "grid_id")]
    fixed = [F.lit(window).alias("date_window"), F.lit(len(dates)).alias("n_dates")]
    scored = best.select(*SEQUENCE_KEY, *about, *fixed, F.lit(0).alias("n_missing_review_png"), *names, "selected")
    note = F.concat(F.lit("missing review PNG for dates: "), "missing")
    none = F.lit(None)
    blank = F.transform("dates", lambda d, i: F.struct((i + 1).alias("date_index"), d.alias("capture_date"), none.cast("boolean").alias("pv_present"), none.cast("double").alias("pv_score"), F.lit("").alias("evidence"), note.alias("notes")))
    waiting = pending.select(
        *SEQUENCE_KEY, *about, *fixed, F.size(F.split("missing", ",")).alias("n_missing_review_png"), F.array_join(F.transform("dates", lambda d: F.lit("?")), "-").alias("sequence_pattern"), none.cast("string").alias("first_present_date"), none.cast("int").alias("first_present_date_index"),
        none.cast("double").alias("confidence"), F.lit("monotonic_with_unknown").alias("consistency_flag"), F.lit("sequence_pending").alias("decision_source"), F.lit("sequence_pending_missing_review_png").alias("quality_flag"), note.alias("review_notes"), blank.alias("items"), "selected",
    )
    rows = scored.unionByName(waiting)
    return rows if carried is None else rows.unionByName(carried.select(*rows.columns))


def sequence_long(rows: DataFrame) -> DataFrame:
    """The results of :func:`score_sequences` by date, with the images."""
    each = rows.select("*", F.explode("items").alias("x")).withColumn("i", F.get("selected", F.col("x.date_index") - 1))
    parent = F.regexp_replace(F.coalesce("i.source_chip_path", F.lit("")), r"/[^/]*$", "")
    return each.select(
        *SEQUENCE_KEY, "region_key", "grid_id", F.col("x.capture_date").alias("requested_date"), F.col("x.capture_date").alias("capture_date"), P.fixed(F.col("x.pv_score"), 4).alias("pv_score"), P.tri_text(F.col("x.pv_present")).alias("pv_present"), "decision_source", "quality_flag", parent.alias("chip_dir"),
        F.coalesce("i.review_png_path", F.lit("")).alias("review_png_path"), F.coalesce("i.source_chip_path", F.lit("")).alias("source_chip_path"), F.when(F.coalesce("i.review_png_path", F.lit("")) != "", 1).otherwise(0).alias("n_jpg"), F.col("chip_id").alias("task_name"), F.col("review_notes").alias("notes"),
        F.col("x.date_index").alias("date_index"), F.col("i.actual_zoom").alias("actual_zoom"), "sequence_pattern", P.fixed(F.col("confidence"), 4).alias("sequence_confidence"), F.col("consistency_flag").alias("sequence_consistency_flag"), F.col("x.evidence").alias("evidence"), F.col("x.notes").alias("item_notes"),
    )


# --- rounds ---


def dense_remap(rows: DataFrame, key: list[str], index: str, ok: Column, size: int | None = None) -> DataFrame:
    """The rows that are ok, numbered densely from 1 as ``batch_index`` (in blocks of
    ``size`` as ``chunk``, from 0, and ``local_index``, from 1), by their index."""
    kept = rows.where(ok).withColumn("batch_index", F.row_number().over(Window.partitionBy(*key).orderBy(index)))
    if size is None:
        return kept
    at = F.col("batch_index") - 1
    return kept.withColumns({"chunk": F.floor(at / size).cast("int"), "local_index": (at % size + 1).cast("int")})


def map_back(scores: DataFrame, remapped: DataFrame, key: list[str], index: str, local: list[str]) -> DataFrame:
    """Scores by their local index with the original one."""
    return scores.join(remapped.select(*key, *local, index), [*key, *local])


def round_results(picks: DataFrame, outcomes: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Picks with their download and their score; where either is missing, an
    explicit failure that says so."""
    there = outcomes.withColumn("_down", F.col("status").isin(THERE) & F.col("path").isNotNull())
    rows = picks.join(there, key, "left").join(scores.withColumn("_scored", F.lit(True)), key, "left")
    down, seen = F.coalesce("_down", F.lit(False)), F.col("_scored").isNotNull()
    note = F.when(~down, F.concat(F.lit("download_failed: status="), F.coalesce("status", F.lit("")), F.lit(" error="), F.coalesce("error", F.lit("")))).when(~seen, "missing observation in batch results").otherwise(F.coalesce("notes", F.lit("")))
    good = down & seen
    return rows.withColumns({
        "pv_present": F.when(good, F.col("pv_present")), "confidence": F.when(good, F.col("confidence")), "quality_flag": F.when(good, F.col("quality_flag")).otherwise("unusable"), "decision_source": F.when(good, F.col("decision_source")).otherwise(R.FAILED_SOURCE),
        "notes": F.left(note, F.lit(300)), "chip_path": F.when(down, F.col("path")).otherwise(""),
    }).drop("_down", "_scored", "status", "error", "path")
