"""The adaptive scan: which dates of a catalog to score next, until a key is dated.

A key's state is one row: its status and an array of rounds, each with its picks and
their results. The next step is a pure function of the state and of the key's
catalog, ``vintages``, so it is an expression over one row: all keys go a round
further at once, without a shuffle, and a scan that was broken off goes on from its
states. Only a scorer that is a table or a program makes the rows of a round meet
their results, by a join on the key.

Dates are ISO text, whose order is that of the dates. Keys without a catalog, or
still unfinished after the last round, end as ``done_ambiguous_orchestrator_error``
and keep their rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.functions.parse import once
from onset.sources.config import ScanConfig
from onset.sources.shared import new_path, optional_table, spread, stored, written

# Statuses, kinds of rounds, flags and sources of state documents.
SCANNING = "scanning"
APPEARS = "done_appears"
DURING_CENSUS = "done_installed_during_census"
ALREADY_PRESENT = "done_already_present_before_geid_history"
NONMONOTONIC = "done_ambiguous_nonmonotonic"
REVIEW_FAILED = "done_ambiguous_gemini_failed"
NO_RECENT = "done_ambiguous_no_recent_anchor"
ERROR = "done_ambiguous_orchestrator_error"
MARKER_MISSED = "done_ambiguous_marker_missed_pv"
TERMINAL = [APPEARS, DURING_CENSUS, ALREADY_PRESENT, NONMONOTONIC, REVIEW_FAILED, NO_RECENT, ERROR, MARKER_MISSED]
ROUND_KINDS = ["initial", "walk_back", "bisection", "tail", "anchor_recovery"]
QUALITY = ["usable", "ambiguous", "unusable"]
SOURCES = ["gemini_batch", "gemini_per_image", "gemini_failed", "dry_run_stub", "manual"]
PROFILES = ["appears_2015", "appears_2018", "appears_2020", "appears_2023", "all_present", "all_absent"]

VINTAGE = "struct<capture_date:string,version:int>"
PICK = "struct<chip_index:int,capture_date:string,version:int,requested_zoom:int>"
RESULT = "struct<chip_index:int,capture_date:string,version:int,pv_present:boolean,confidence:double,quality_flag:string,decision_source:string,evidence:string,notes:string,chip_path:string,actual_zoom:int>"
ROUND = f"struct<round_id:int,round_type:string,window_start_date:string,window_end_date:string,picks:array<{PICK}>,results:array<{RESULT}>,completed:boolean,failed:boolean,notes:string>"
STATE = f"anchor_id string, region_key string, grid_id string, status string, rounds array<{ROUND}>, next_action string, started_at string, updated_at string, spec_version string, notes string"
STATE_COLUMNS = ["anchor_id", "region_key", "grid_id", "status", "rounds", "next_action", "started_at", "updated_at", "spec_version", "notes"]
MAX_ROUNDS = 32
FAILED = "gemini_failed"


def new_states(anchors: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """States of anchors that were not scanned yet."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return anchors.select(
        *(F.col(c).cast("string").alias(c) for c in ("anchor_id", "region_key", "grid_id")), F.lit(SCANNING).alias("status"), F.array().cast(f"array<{ROUND}>").alias("rounds"), F.lit(None).cast("string").alias("next_action"),
        now.alias("started_at"), now.alias("updated_at"), F.lit((config or ScanConfig()).spec_version).alias("spec_version"), F.lit("").alias("notes"),
    )


def with_catalog(states: DataFrame, catalog: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``states`` with the array ``vintages`` of a catalog of ``anchor_id``,
    ``capture_date``, ``version`` and further columns. The one exchange of a scan."""
    rows = catalog.select(F.col("anchor_id").cast("string").alias("anchor_id"), F.struct(F.col("capture_date").cast("string").alias("capture_date"), F.col("version").cast("int").alias("version"), *(more or [])).alias("v"))
    return states.join(rows.groupBy("anchor_id").agg(F.sort_array(F.collect_list("v")).alias("vintages")), "anchor_id", "left").withColumn("vintages", F.coalesce("vintages", F.array()))


def all_results(rounds: Column) -> Column:
    """The results of all rounds, in order."""
    return F.flatten(F.transform(rounds, lambda r: r["results"]))


def flat_results(states: DataFrame) -> DataFrame:
    """One row a result: the key, the round's number and kind, ``source_row`` (the
    result's place in the document) and the result's fields."""
    rounds = states.select("anchor_id", F.posexplode("rounds").alias("_r", "r"))
    rows = rounds.select("anchor_id", "_r", F.col("r.round_id").alias("round_id"), F.col("r.round_type").alias("round_type"), F.posexplode("r.results").alias("_i", "x"))
    return rows.select("anchor_id", "round_id", "round_type", (F.col("_r").cast("long") * 1_000_000 + F.col("_i")).alias("source_row"), "x.*")


def is_usable(x: Column) -> Column:
    return (x["quality_flag"] == "usable") & x["pv_present"].isNotNull()


def failure_percent(results: Column) -> Column:
    """100 x failed / all; 0 of none."""
    failed = F.size(F.filter(results, lambda x: x["decision_source"] == FAILED))
    return F.coalesce(F.try_divide(100.0 * failed, F.size(results)), F.lit(0.0))


def latest_date(vintages: Column) -> Column:
    return F.array_max(F.transform(vintages, lambda v: v["capture_date"]))


def count_rounds(rounds: Column, kind: str) -> Column:
    return F.size(F.filter(rounds, lambda r: r["round_type"] == kind))


def next_round_id(rounds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rounds, lambda r: r["round_id"])), F.lit(0)) + 1


def find_round(rounds: Column, number: int) -> Column:
    return F.get(F.filter(rounds, lambda r: r["round_id"] == number), F.lit(0))


def year(date: Column) -> Column:
    return F.substring(date, 1, 4).cast("int")


def even_spots(n: Column, count: int) -> Column:
    """Which of ``n`` places, from 0: both ends and those between them at even
    steps, halves to even; all where there are at most ``count``."""
    inner = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (n - 1) / float(count - 1)).cast("int")) if count > 2 else F.array(F.lit(0), n - 1)
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= count, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array_distinct(inner))


def _picks(chosen: Column, zoom: int) -> Column:
    return F.transform(chosen, lambda v, i: F.struct((i + 1).alias("chip_index"), v["capture_date"].alias("capture_date"), v["version"].alias("version"), F.lit(zoom).alias("requested_zoom")))


def floor_window(vintages: Column, floor_year: int) -> Column:
    """Those of the floor year or later; all if there is none."""
    recent = F.filter(vintages, lambda v: year(v["capture_date"]) >= floor_year)
    return F.when(F.size(recent) > 0, recent).otherwise(vintages)


def candidates(states: DataFrame, config: ScanConfig) -> DataFrame:
    """``states`` with what the decision needs, in columns that begin with ``_``: the
    dates still to score in each window that a round may have."""
    c = F.col
    df = states.withColumn("_results", all_results(c("rounds"))).withColumn("_scored", F.transform("_results", lambda x: x["capture_date"]))
    usable = F.transform(F.filter("_results", is_usable), lambda x, i: F.struct(x["capture_date"].alias("d"), i.alias("i"), x["pv_present"].alias("p")))
    df = df.withColumns({
        "_usable": F.sort_array(usable), "_left": F.filter(F.sort_array("vintages"), lambda v: ~F.array_contains("_scored", v["capture_date"])), "_last": F.get("rounds", F.size("rounds") - 1),
    })
    step = lambda x, i: F.get("_usable", i + 1)
    turns = F.filter(F.transform("_usable", lambda x, i: F.when(~x["p"] & step(x, i)["p"], F.struct(x["d"].alias("a"), step(x, i)["d"].alias("b")))), lambda t: t.isNotNull())
    back = F.exists(F.transform("_usable", lambda x, i: F.coalesce(x["p"] & ~step(x, i)["p"], F.lit(False))), lambda x: x)
    df = df.withColumns({"_turn": F.get(turns, F.lit(0)), "_back": back, "_edge": c("_last.window_start_date")})
    df = df.withColumn("_older", F.filter("_left", lambda v: v["capture_date"] < c("_edge")))
    return df.withColumns({
        "_window": F.filter("_older", lambda v: year(v["capture_date"]) >= year(c("_edge")) - config.walk_back_years),
        "_gap": F.filter("_left", lambda v: (v["capture_date"] > c("_turn.a")) & (v["capture_date"] < c("_turn.b"))),
    })


def plan(df: DataFrame, config: ScanConfig) -> DataFrame:
    """``_plan``: the kind of the next round, or the status to end with, of the rows
    of :func:`candidates`."""
    c = F.col
    recoveries = count_rounds(c("rounds"), "anchor_recovery")
    recover = F.when((recoveries >= config.max_recoveries) | (F.size("_left") == 0), NO_RECENT).otherwise("anchor_recovery")
    newest_absent = F.exists("_results", lambda x: (x["capture_date"] == latest_date(c("vintages"))) & is_usable(x) & ~x["pv_present"])
    appears = F.when((count_rounds(c("rounds"), "bisection") > 0) | (F.size("_gap") == 0), APPEARS).otherwise("bisection")
    absent = F.when(F.size("vintages") == 0, ERROR).when(newest_absent, DURING_CENSUS).otherwise(recover)
    n_window = F.size("_window")
    present = (
        F.when((c("_last.round_type") == "tail") | c("_edge").isNull() | (F.size("_older") == 0), ALREADY_PRESENT)
        .when((n_window < config.tail_below) | (n_window == 0), "tail").otherwise("walk_back")
    )
    chosen = (
        F.when(c("status").isin(TERMINAL), c("status"))
        .when(F.size("rounds") == 0, F.when(F.size("vintages") == 0, ERROR).otherwise("initial"))
        .when(failure_percent(c("_results")) > config.failure_percent, REVIEW_FAILED)
        .when(F.size("_usable") == 0, recover).when(c("_back"), NONMONOTONIC).when(c("_turn").isNotNull(), appears)
        .when(~F.exists("_usable", lambda x: x["p"]), absent).otherwise(present)
    )
    return df.withColumn("_plan", chosen)


def decide(states: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """``states`` (with ``vintages``) with ``action`` (``execute_round`` or
    ``terminate``), ``next_status`` and ``next_round``, a round without results. Write
    it before it is filtered: a filter that the optimizer moves below these columns
    takes the whole of their expressions along."""
    config, c = config or ScanConfig(), F.col
    df = plan(candidates(states, config), config)
    # spread evenly: the first round over the recent years, walk-backs over their window
    pool = F.when(c("_plan") == "initial", floor_window(F.sort_array("vintages"), config.floor_year)).when(c("_plan") == "walk_back", c("_window"))
    df = df.withColumn("_pool", pool)
    even = F.transform(even_spots(F.size("_pool"), config.picks), lambda i: F.get("_pool", i))
    chosen = F.when(c("_plan").isin("initial", "walk_back"), even).when(c("_plan") == "tail", c("_older")).when(c("_plan") == "bisection", c("_gap")).when(c("_plan") == "anchor_recovery", F.slice("_left", -1, 1))
    df = df.withColumn("_picks", _picks(chosen, config.download_zooms[0]))
    first, last = F.get("_picks", F.lit(0))["capture_date"], F.get("_picks", F.size("_picks") - 1)["capture_date"]
    bisect, runs = c("_plan") == "bisection", c("_plan").isin(ROUND_KINDS)
    degraded = (c("_plan") == "initial") & (year(latest_date(c("vintages"))) < config.floor_year)
    notes = F.when(degraded, f"round1_floor_degraded=true (no vintage >= {config.floor_year})").otherwise("")
    end = F.when(bisect, c("_turn.b")).when(c("_plan").isin("walk_back", "tail"), c("_edge")).otherwise(last)
    rnd = F.struct(
        next_round_id(c("rounds")).alias("round_id"), c("_plan").alias("round_type"), F.when(bisect, c("_turn.a")).otherwise(first).alias("window_start_date"), end.alias("window_end_date"),
        c("_picks").alias("picks"), F.array().cast(f"array<{RESULT}>").alias("results"), F.lit(False).alias("completed"), F.lit(False).alias("failed"), notes.alias("notes"),
    )
    return df.select(*states.columns, F.when(runs, "execute_round").otherwise("terminate").alias("action"), F.when(runs, c("status")).otherwise(c("_plan")).alias("next_status"), F.when(runs, rnd).cast(ROUND).alias("next_round"))


Executor = Callable[[DataFrame], DataFrame]


def by_column(score: Callable[[Column], Column]) -> Executor:
    """Results as a column: ``score`` makes the struct ``RESULT`` of a pick, from it
    and the columns of the state."""
    return lambda decided: decided.withColumn("_scores", F.transform("next_round.picks", score).cast(f"array<{RESULT}>")).withColumn("_error", F.lit(None).cast("string"))


def failed_result(pick: Column, notes: str) -> Column:
    """An explicit row for a pick without a result."""
    none = F.lit(None)
    return F.struct(
        pick["chip_index"].alias("chip_index"), pick["capture_date"].alias("capture_date"), pick["version"].alias("version"), none.cast("boolean").alias("pv_present"), none.cast("double").alias("confidence"), F.lit("unusable").alias("quality_flag"),
        F.lit(FAILED).alias("decision_source"), F.lit("").alias("evidence"), F.lit(notes).alias("notes"), F.lit("").alias("chip_path"), none.cast("int").alias("actual_zoom"),
    )


_FOUND = {"pv_present": "boolean", "confidence": "double", "quality_flag": "string", "decision_source": "string", "evidence": "string", "notes": "string", "chip_path": "string", "actual_zoom": "int"}
_LEFT = {"quality_flag": "unusable", "decision_source": FAILED, "evidence": "", "notes": "missing observation in batch results", "chip_path": ""}


def by_table(scorer: Callable[[DataFrame], DataFrame]) -> Executor:
    """Results from ``scorer``: a function from rows of ``anchor_id``, ``round_id``
    and a pick's fields to rows of ``anchor_id``, ``chip_index``, the fields of a
    result and, if it has any, ``error``. A pick without a row becomes an explicit
    failure; a key with an error ends there."""

    def run(decided: DataFrame) -> DataFrame:
        decided = written(decided, "decided")
        picks = decided.where("next_round is not null").select("anchor_id", F.col("next_round.round_id").alias("round_id"), F.explode("next_round.picks").alias("p")).select("anchor_id", "round_id", "p.*")
        found = scorer(picks)
        error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
        have = found.select("anchor_id", "chip_index", *((F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in _FOUND.items()), error.alias("error"), F.lit(True).alias("_there"))
        rows = picks.join(have, ["anchor_id", "chip_index"], "left")
        fields = [F.when(F.col("_there"), F.coalesce(c, F.lit("")) if c in ("evidence", "notes", "chip_path") else F.col(c)).otherwise(F.lit(_LEFT.get(c))).alias(c) for c in _FOUND]
        made = rows.select("anchor_id", "error", F.struct("chip_index", "capture_date", "version", *fields).alias("x"))
        scores = made.groupBy("anchor_id").agg(F.sort_array(F.collect_list("x")).cast(f"array<{RESULT}>").alias("_scores"), F.max("error").alias("_error"))
        return decided.join(scores, "anchor_id", "left")

    return run


def isolated(score: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "anchor_id string, chip_index int, pv_present boolean, confidence double, quality_flag string, decision_source string, evidence string, notes string, chip_path string, actual_zoom int") -> Callable[[DataFrame], DataFrame]:
    """A scorer for :func:`by_table` from a Python function over a key's picks. An
    exception ends that key alone."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            found = score(rows).astype(object)
            return found.where(found.notna(), None).assign(error=pd.Series([None] * len(found), index=found.index, dtype=object))
        except Exception as fault:  # the key's own, whatever it is
            names = [*(x.strip().split(" ")[0] for x in schema.split(",")), "error"]
            row = dict.fromkeys(names) | {"anchor_id": rows["anchor_id"].iloc[0], "chip_index": int(rows["chip_index"].iloc[0]), "error": f"{type(fault).__name__}: {fault}"}
            return pd.DataFrame([row], columns=names, dtype=object)

    return lambda picks: picks.groupBy("anchor_id").applyInPandas(run, f"{schema}, error string")


def advance(decided: DataFrame, execute: Executor) -> DataFrame:
    """States after their next step: a round more, or ended."""
    names = [c for c in decided.columns if c not in ("action", "next_status", "next_round")]
    df = execute(decided)
    r = F.col("next_round")
    done = r.withField("results", F.coalesce("_scores", F.array().cast(f"array<{RESULT}>"))).withField("completed", F.lit(True)).cast(ROUND)  # alone: a cast of all rounds copies them
    runs, failed = F.col("action") == "execute_round", F.col("_error").isNotNull()
    said = F.when(failed, F.concat(F.lit("orchestrator_error: "), "_error")).when(~runs & (F.col("next_status") == ERROR) & (F.col("status") != ERROR), "orchestrator_error: no vintages")
    return df.withColumns({
        "notes": F.when(said.isNotNull(), F.concat_ws(" | ", F.nullif("notes", F.lit("")), said)).otherwise(F.col("notes")),
        "rounds": F.when(runs & ~failed, F.concat("rounds", F.array(done))).otherwise(F.col("rounds")),
        "status": F.when(failed, ERROR).otherwise(F.col("next_status")),
        "next_action": F.when(runs & ~failed, "decide_next_action"),
    }).select(*names)


def run_scan(states: DataFrame, execute: Executor, config: ScanConfig | None = None, folder: str | None = None, most: int = MAX_ROUNDS) -> DataFrame:
    """All states (with ``vintages``) to their end. Each round is a table in
    ``folder``; a run that was broken off goes on after the last whole one, and a
    lost executor costs no more than its tasks. Only unfinished keys are carried."""
    spark, config = states.sparkSession, config or ScanConfig()
    folder = folder or new_path(spark, "scan")
    terminal = F.col("status").isin(TERMINAL)
    schema = states.schema
    marks = lambda: optional_table(spark, f"{folder}/marks", "step int")
    last = marks().agg(F.max("step")).first()[0]
    if last is None:
        last = 0
        now = stored(spread(states.select(*schema.names), "anchor_id"), f"{folder}/steps/0")
        stored(spark.createDataFrame([(0,)], "step int"), f"{folder}/marks/0")
    tables = [spark.read.schema(schema).parquet(f"{folder}/steps/{n}") for n in range(last + 1)]
    now = tables[-1]
    while True:
        active = now.where(~terminal)
        if active.isEmpty():
            break
        if last >= most + 1:  # the last round's decision was not an end
            over = F.concat_ws(" | ", F.nullif("notes", F.lit("")), F.lit(f"orchestrator_error: more than {most} rounds"))
            tables.append(active.withColumns({"status": F.lit(ERROR), "notes": over}))
            break
        last += 1
        now = stored(advance(decide(active, config), execute), f"{folder}/steps/{last}")
        stored(spark.createDataFrame([(last,)], "step int"), f"{folder}/marks/{last}")
        tables.append(now)
    done = tables[0].where(terminal)
    for table in tables[1:]:
        done = done.unionByName(table.where(terminal))
    return done


# --- a scan without imagery ---


def anchor_hash(anchor_id: Column) -> Column:
    """The first 32 bits of the SHA-256 of the identifier."""
    return F.conv(F.substring(F.sha2(anchor_id.cast("string"), 256), 1, 8), 16, 10).cast("long")


def dry_run_profile(anchor_id: Column) -> Column:
    return F.get(F.array(*(F.lit(p) for p in PROFILES)), (anchor_hash(anchor_id) % len(PROFILES)).cast("int"))


def dry_run_vintages(anchor_id: Column) -> Column:
    """A made-up catalog from 2009-04 to 2025-03: a first day of a month every four to
    eight months, as the month and the hash say; some are left out."""
    dates, end = [], 16 * 12 + 3  # months since 2009-01
    for seed in range(35):  # the steps know the hash by its remainders of 5 and 7 only
        months, m = [], 3
        while m < end:
            if (m % 12 + 1 + seed) % 7 != 0:
                months.append(m)
            m += 4 + (m % 12 + 1 + seed) % 5
        dates.append(F.lit(",".join(f"{2009 + m // 12:04d}-{m % 12 + 1:02d}-01" for m in months)))
    every = lambda seed: F.split(F.get(F.array(*dates), (seed % 35).cast("int")), ",")
    return once(anchor_hash(anchor_id), lambda seed: F.transform(every(seed), lambda d, i: F.struct(d.alias("capture_date"), (100 + seed % 50 + i).cast("int").alias("version"))))


def dry_run_score(pick: Column) -> Column:
    """Present from the profile's date on, always or never."""
    return once(dry_run_profile(F.col("anchor_id")), lambda profile: _profile_score(profile, pick))


def _profile_score(profile: Column, pick: Column) -> Column:
    since = F.concat(F.substring(profile, 9, 4), F.lit("-06-15"))
    present = F.when(profile == "all_present", True).when(profile == "all_absent", False).otherwise(pick["capture_date"] >= since)
    return F.struct(
        pick["chip_index"].alias("chip_index"), pick["capture_date"].alias("capture_date"), pick["version"].alias("version"), present.alias("pv_present"), F.lit(0.95).alias("confidence"), F.lit("usable").alias("quality_flag"),
        F.lit("dry_run_stub").alias("decision_source"), F.concat(F.lit("stub evidence for "), profile).alias("evidence"), F.concat(F.lit("dry_run profile="), profile).alias("notes"), F.lit("").alias("chip_path"), pick["requested_zoom"].alias("actual_zoom"),
    )


def exit_code(states: DataFrame) -> int:
    """1 if any key ended in an error, else 0."""
    return 0 if states.where(F.col("status").startswith(ERROR)).isEmpty() else 1


def summary(states: DataFrame) -> DataFrame:
    """Keys, rounds and observations by status."""
    return states.groupBy("status").agg(F.count("*").alias("n_anchors"), F.sum(F.size("rounds")).alias("n_rounds"), F.sum(F.size(all_results(F.col("rounds")))).alias("n_observations"))
