"""Operators over dated tri-state series. All windows are by the key alone, so a
chain of them and the sums that follow need one exchange. ``order`` is a total
order within a key; rows without presence stand last in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onset.functions.parse import appears_confidence, census_confidence, midpoint


def _window(key: str, order: list[str], present: str):
    return Window.partitionBy(key).orderBy(F.col(present).isNull(), *order)


def repair_dips(df: DataFrame, key: str, order: list[str], present: str = "pv_present", score: str = "pv_score", least: float = 0.5) -> DataFrame:
    """Absent rows with a sure present row anywhere before and after become
    present; ``flipped`` says which."""
    # between the first and the last sure row of the key: no running frame, no sort
    sure = F.col(present) & (F.col(score).isNull() | (F.col(score) >= least))
    w, at = Window.partitionBy(key), F.struct(*order)
    first, last = (f(F.when(sure, at)).over(w) for f in (F.min, F.max))
    flipped = F.coalesce(~F.col(present) & (at > first) & (at < last), F.lit(False))
    return df.withColumn("flipped", flipped).withColumn(present, F.col(present) | F.col("flipped"))


def transitions(df: DataFrame, key: str, order: list[str], date: str = "capture_date", present: str = "pv_present") -> DataFrame:
    """``absent_date``, ``present_date`` of each scored row that is present right
    after an absent one."""
    scored = df.where(F.col(present).isNotNull())
    w = Window.partitionBy(key).orderBy(*order)
    steps = scored.select(key, F.lag(date).over(w).alias("absent_date"), F.lag(present).over(w).alias("before"), F.col(date).alias("present_date"), F.col(present).alias("now"))
    return steps.where("now and not before").select(key, "absent_date", "present_date")


def reversals(df: DataFrame, key: str, order: list[str], present: str = "pv_present") -> DataFrame:
    """``n_reversals`` of keys that have an absent row right after a present one."""
    scored = df.where(F.col(present).isNotNull()).select(key, F.col(present).alias("now"), F.lag(present).over(Window.partitionBy(key).orderBy(*order)).alias("before"))
    return scored.where("before and not now").groupBy(key).agg(F.count("*").alias("n_reversals"))


def _stable(key: str, order: list[str], present: str, run: int) -> Column:
    return F.count_if(F.col(present)).over(_window(key, order, present).rowsBetween(0, run - 1)) == run


def stable_start(df: DataFrame, key: str, order: list[str], run: int, date: str = "capture_date", present: str = "pv_present") -> DataFrame:
    """``start_date`` of the first run of ``run`` present rows, by key that has one."""
    at = df.select(key, *order, date, _stable(key, order, present, run).alias("_s")).where("_s")
    return at.groupBy(key).agg(F.min_by(date, F.struct(*order)).alias("start_date"))


def patterns(df: DataFrame, key: str, order: list[str], date: str = "capture_date", present: str = "pv_present") -> DataFrame:
    """``pattern`` (1, 0, ? by order), ``first_present`` and ``consistency``."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = F.coalesce(F.max(F.coalesce(F.col(present), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    mark = F.when(F.col(present), "1").when(~F.col(present), "0").otherwise("?")
    rows = df.select(key, F.struct(*order).alias("_o"), F.col(date).alias("_d"), F.col(present).alias("_p"), mark.alias("_m"), (seen & ~F.col(present)).alias("_bad"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_m"))), lambda x: x["_m"]), "-")
    state = F.when(F.coalesce(F.bool_or("_bad"), F.lit(False)), "non_monotonic_requires_review").when(F.bool_or(F.col("_p").isNull()), "monotonic_with_unknown").otherwise("monotonic")
    return rows.groupBy(key).agg(text.alias("pattern"), F.min(F.when(F.col("_p"), F.col("_d"))).alias("first_present"), state.alias("consistency"))


def flag_reversed(df: DataFrame, key: str | list[str], order: list[str], use: Column, present: str = "pv_present", notes: str = "notes", note: str = "non_monotonic") -> DataFrame:
    """Append ``note`` to all rows of a key that, among rows where ``use`` holds,
    has an absent one after a present one; once only."""
    keys = [key] if isinstance(key, str) else key
    p = F.when(use, F.col(present))
    earlier = F.max(F.coalesce(p, F.lit(False))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_bad", F.coalesce(~p & earlier, F.lit(False)))
    bad = F.max("_bad").over(Window.partitionBy(*keys))
    has = F.coalesce(F.col(notes), F.lit(""))
    return marked.withColumn(notes, F.when(bad & ~has.contains(note), F.concat_ws(" | ", F.nullif(has, F.lit("")), F.lit(note))).otherwise(has)).drop("_bad")


def first_appearance(df: DataFrame, key: str, order: list[str], run: int = 1, date: str = "capture_date", present: str = "pv_present") -> DataFrame:
    """The interval in which each key first appeared: one row a key."""
    rows = df.select(key, F.col(date).alias("_d"), F.col(present).alias("_p"), F.struct(F.col(present).isNull(), *order).alias("_o"), _stable(key, order, present, run).alias("_s"))
    start = F.min(F.when(F.col("_s"), F.struct("_o", "_d"))).over(Window.partitionBy(key))
    rows = rows.withColumn("_i", start)
    p, before, after = F.col("_p"), F.col("_o") < F.col("_i._o"), F.col("_o") > F.col("_i._o")
    sums = rows.groupBy(key).agg(
        F.count("_p").alias("n_observations"), F.count_if(p).alias("n_present"), F.count_if(~p).alias("n_absent"),
        F.max(F.when(p.isNotNull(), F.col("_d"))).alias("_last"), F.max(F.when(~p, F.col("_d"))).alias("_absent"), F.min(F.when(p, F.col("_d"))).alias("_present"),
        F.max("_i._d").alias("_at"), F.max(F.when(~p & before, F.col("_d"))).alias("_before"), F.coalesce(F.bool_or(~p & after), F.lit(False)).alias("_after"),
    )
    case = (
        F.when(F.col("n_observations") == 0, "no_valid_observations").when(F.col("n_present") == 0, "not_seen").when(F.col("_at").isNull(), "ambiguous_sporadic_positive")
        .when(F.col("_after"), "ambiguous_nonmonotonic").when(F.col("_before").isNull(), "already_present").otherwise("appears")
    )
    s = F.col("status")
    low = F.when(s == "not_seen", F.col("_last")).when(s == "ambiguous_sporadic_positive", F.col("_absent")).otherwise(F.col("_before"))
    high = F.when(s == "ambiguous_sporadic_positive", F.col("_present")).otherwise(F.col("_at"))
    return sums.withColumn("status", case).select(
        key, "status", low.alias("latest_absent_date"), high.alias("earliest_present_date"), low.alias("interval_start"), high.alias("interval_end"),
        F.when(s.isin("already_present", "appears"), "high").when(s == "not_seen", "medium").otherwise("low").alias("confidence"), "n_observations", "n_absent", "n_present",
    )


def repair_states(df: DataFrame, key: str, order: list[str], status: str = "status", date: str = "capture_date", present: str = "pv_present", score: str = "pv_score", quality: str = "quality_flag", notes: str = "notes", least: float = 0.5) -> DataFrame:
    """Rows of scanned keys with their dips repaired and the status that follows.

    Among usable rows of keys with three or more, absent ones between sure present
    ones are dips. All absent rows of a dip's date become present, unusable ones
    too, and are noted. A key that was ended as non-monotonic and is so no longer
    gets the status of its rows; ``repaired_dates`` (joined by commas, else null)
    says what changed. One exchange.
    """
    w, at, p = Window.partitionBy(key), F.struct(*order), F.col(present)
    usable = (F.col(quality) == "usable") & p.isNotNull()
    sure = usable & p & (F.col(score).isNull() | (F.col(score) >= least))
    first, last = (f(F.when(sure, at)).over(w) for f in (F.min, F.max))
    dip = usable & ~p & (at > first) & (at < last) & (F.count_if(usable).over(w) >= 3)
    marked = df.withColumn("_dip", F.coalesce(dip, F.lit(False)))
    flips = F.max("_dip").over(Window.partitionBy(key, date)) & ~p
    marked = marked.withColumn("flipped", F.coalesce(flips, F.lit(False)))
    done = marked.withColumns({
        present: p | F.col("flipped"), notes: F.when(F.col("flipped"), F.concat_ws(" | ", F.nullif(F.col(notes), F.lit("")), F.lit("repaired_isolated_dip"))).otherwise(F.col(notes)),
        "repaired_dates": F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("_dip"), F.col(date).cast("string"))).over(w)), ","), F.lit("")),
    })
    t, f = (F.when(usable & x, at) for x in (p, ~p))
    ends = {"_t0": F.min(t).over(w), "_t1": F.max(t).over(w), "_f0": F.min(f).over(w), "_f1": F.max(f).over(w)}
    monotonic = F.coalesce(F.col("_f1") < F.col("_t0"), F.lit(True))
    new = F.when(F.col("_f0") < F.col("_t1"), "done_appears").when(F.col("_f0").isNull() & F.col("_t0").isNotNull(), ALREADY_PRESENT).otherwise(F.col(status))
    again = F.col("repaired_dates").isNotNull() & (F.col(status) == "done_ambiguous_nonmonotonic") & monotonic
    return done.withColumns(ends).withColumn(status, F.when(again, new).otherwise(F.col(status))).drop("_dip", *ends)


# Fixed value: the status of keys that were present from the first date on.
ALREADY_PRESENT = "done_already_present_before_geid_history"


def scan_intervals(df: DataFrame, key: str, census: Column, status: str = "status", date: str = "capture_date", present: str = "pv_present", quality: str | None = None, state_notes: str | None = None) -> DataFrame:
    """Intervals of scanned keys by their final status; ``df`` has the rows of a key
    with its status, or one row without presence. Rows that are not usable by
    ``quality`` only count; ``state_notes`` are the key's own, which come first."""
    p = F.col(present) if quality is None else F.when(F.col(quality) == "usable", F.col(present))
    a = df.groupBy(key).agg(
        F.first(status).alias("_s"), F.max(F.when(~p, F.col(date))).alias("_a"), F.min(F.when(p, F.col(date))).alias("_p"), F.min(F.when(p.isNotNull(), F.col(date))).alias("_first"),
        F.count(date).alias("n_observations"), F.count_if(p).alias("n_present"), F.count_if(~p).alias("n_absent"), F.count_if(F.col(date).isNotNull() & p.isNull()).alias("n_unusable"), (F.first(state_notes) if state_notes else F.lit("")).alias("_notes"),
    )
    s, lo, hi = F.col("_s"), F.col("_a"), F.col("_p")
    appears, during, already = (s == x for x in ("done_appears", "done_installed_during_census", ALREADY_PRESENT))
    dated = appears & (lo <= hi)
    within = during & (lo < census)
    missed = during & (lo >= census)
    start = F.when(dated | within, lo)
    end = F.when(dated, hi).when(within, census).when(already, F.col("_first"))
    note = (
        F.when((appears & (lo.isNull() | hi.isNull())) | (during & lo.isNull()), "inconsistent").when(appears & (lo > hi), "inverted_interval").when(missed, "marker_missed_pv")
        .when(s == "scanning", "scan_in_progress").when(appears | during | already | s.startswith("done_ambiguous_"), None).otherwise(F.concat(F.lit("unknown_status="), F.coalesce(s, F.lit(""))))
    )
    return a.select(
        key, F.when(missed, "done_ambiguous_marker_missed_pv").otherwise(s).alias("status"),
        F.when((appears & lo.isNotNull() & hi.isNotNull()) | during, lo).alias("latest_absent_date"), F.when(appears & lo.isNotNull() & hi.isNotNull(), hi).when(already, F.col("_first")).alias("earliest_present_date"),
        start.alias("interval_start"), end.alias("interval_end"), F.when(dated, midpoint(lo, hi)).when(within, census).alias("mid_estimate"),
        F.when(dated, appears_confidence(F.datediff(hi, lo))).when(within, census_confidence(F.datediff(census, lo))).otherwise("low").alias("confidence"), F.concat_ws(" | ", F.nullif("_notes", F.lit("")), note).alias("notes"),
        "n_observations", "n_present", "n_absent", "n_unusable",
    )


def state_intervals(states: DataFrame, census: Column, repair: bool = True, least: float = 0.5) -> DataFrame:
    """Intervals of state documents: dips repaired, then the status read. Documents
    without results stay, with their status."""
    from onset.operators.scan import flat_results

    rows = flat_results(states).withColumn("capture_date", F.col("capture_date").cast("date"))
    about = states.select("anchor_id", "region_key", "grid_id", "status", F.coalesce("notes", F.lit("")).alias("_said"), F.size("rounds").alias("n_rounds"))
    joined = about.join(rows, "anchor_id", "left")
    if repair:
        joined = repair_states(joined, "anchor_id", ["capture_date", "source_row"], score="confidence", least=least)
        n = F.size(F.split("repaired_dates", ","))
        joined = joined.withColumn("_said", F.when(F.col("repaired_dates").isNotNull(), F.concat_ws(" | ", F.nullif("_said", F.lit("")), F.concat(F.lit("repaired_isolated_dip x"), n, F.lit(": "), "repaired_dates"))).otherwise(F.col("_said")))
    found = scan_intervals(joined, "anchor_id", census, quality="quality_flag", state_notes="_said")
    return found.join(about.select("anchor_id", "region_key", "grid_id", "n_rounds"), "anchor_id")
