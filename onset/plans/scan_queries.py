"""Queries of the adaptive scan, and the same scans as recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from onset.functions.parse import census_confidence
from onset.operators import scan
from onset.operators import series as S
from onset.plans.registry import query
from onset.sources.config import ScanConfig
from onset.sources.shared import spread, written
from onset.sources.tables import table

REPLAY = ScanConfig(floor_year=1999, walk_back_years=2)


def _scan_sql(base: str, config: ScanConfig) -> str:
    """A scan by the rules, over ``base``: ``anchor_id`` and ``v``, a list by date of
    date ``d``, presence ``p``, flag ``q`` and source ``s``."""
    k, zero = config.picks, "[]::VARCHAR[]"
    return f"""b AS ({base}),
sc AS (SELECT anchor_id, v, []::STRUCT(kind VARCHAR, w0 VARCHAR, w1 VARCHAR, picks VARCHAR[])[] AS rounds, 'scanning' AS status FROM b
UNION ALL
SELECT anchor_id, v, CASE WHEN plan IN ('initial', 'walk_back', 'tail', 'bisection', 'anchor_recovery') THEN list_append(rounds, {{'kind': plan, 'w0': CASE WHEN plan = 'bisection' THEN ta ELSE picks[1] END,
  'w1': CASE plan WHEN 'bisection' THEN tb WHEN 'walk_back' THEN edge WHEN 'tail' THEN edge ELSE picks[len(picks)] END, 'picks': picks}}) ELSE rounds END,
  CASE WHEN plan IN ('initial', 'walk_back', 'tail', 'bisection', 'anchor_recovery') THEN 'scanning' ELSE plan END
FROM (SELECT *, CASE plan WHEN 'tail' THEN older WHEN 'bisection' THEN gap WHEN 'anchor_recovery' THEN lft[len(lft):len(lft)] ELSE
    CASE WHEN len(pool) <= {k} THEN pool ELSE list_transform(list_sort(list_distinct([round_even(x * (len(pool) - 1) / {k - 1}.0, 0)::INTEGER FOR x IN range({k})])), lambda i: pool[i + 1]) END END AS picks
  FROM (SELECT *, CASE plan WHEN 'initial' THEN CASE WHEN len(recent) > 0 THEN recent ELSE dates END WHEN 'walk_back' THEN win ELSE {zero} END AS pool
    FROM (SELECT *, CASE WHEN len(rounds) = 0 THEN CASE WHEN len(v) = 0 THEN 'done_ambiguous_orchestrator_error' ELSE 'initial' END
      WHEN len(res) > 0 AND 100.0 * len(list_filter(res, lambda x: x.s = 'gemini_failed')) / len(res) > {config.failure_percent} THEN 'done_ambiguous_gemini_failed'
      WHEN len(us) = 0 THEN recover WHEN contains(pat, '10') THEN 'done_ambiguous_nonmonotonic'
      WHEN contains(pat, '01') THEN CASE WHEN n_bis > 0 OR len(gap) = 0 THEN 'done_appears' ELSE 'bisection' END
      WHEN NOT contains(pat, '1') THEN CASE WHEN len(list_filter(us, lambda x: x.d = dates[len(dates)] AND NOT x.p)) > 0 THEN 'done_installed_during_census' ELSE recover END
      WHEN last_kind = 'tail' OR edge IS NULL OR len(older) = 0 THEN 'done_already_present_before_geid_history'
      WHEN len(win) < {config.tail_below} THEN 'tail' ELSE 'walk_back' END AS plan
      FROM (SELECT *, CASE WHEN n_rec >= {config.max_recoveries} OR len(lft) = 0 THEN 'done_ambiguous_no_recent_anchor' ELSE 'anchor_recovery' END AS recover,
        list_filter(older, lambda x: x[1:4]::INTEGER >= edge[1:4]::INTEGER - {config.walk_back_years}) AS win, list_filter(lft, lambda x: x > ta AND x < tb) AS gap
        FROM (SELECT *, list_filter(lft, lambda x: x < edge) AS older, us[instr(pat, '01')].d AS ta, us[instr(pat, '01') + 1].d AS tb, list_filter(dates, lambda x: x[1:4]::INTEGER >= {config.floor_year}) AS recent
          FROM (SELECT *, list_filter(dates, lambda x: NOT list_contains(scored, x)) AS lft, list_filter(v, lambda x: list_contains(scored, x.d)) AS res,
            list_filter(v, lambda x: list_contains(scored, x.d) AND x.q = 'usable' AND x.p IS NOT NULL) AS us,
            coalesce(array_to_string(list_transform(list_filter(v, lambda x: list_contains(scored, x.d) AND x.q = 'usable' AND x.p IS NOT NULL), lambda x: CASE WHEN x.p THEN '1' ELSE '0' END), ''), '') AS pat
            FROM (SELECT *, flatten(list_transform(rounds, lambda r: r.picks)) AS scored, list_transform(v, lambda x: x.d) AS dates, len(list_filter(rounds, lambda r: r.kind = 'anchor_recovery')) AS n_rec, len(list_filter(rounds, lambda r: r.kind = 'bisection')) AS n_bis,
              rounds[len(rounds)].w0 AS edge, rounds[len(rounds)].kind AS last_kind FROM sc WHERE status = 'scanning'))))))))"""


_OUT = "SELECT anchor_id, status, len(rounds)::INTEGER AS n_rounds, coalesce(array_to_string(list_transform(rounds, lambda r: r.kind || ':' || r.w0 || '..' || r.w1), '>'), '') AS kinds, coalesce(array_to_string(list_transform(rounds, lambda r: array_to_string(r.picks, ',')), '|'), '') AS picks FROM sc WHERE status <> 'scanning'"


def _out(done):
    r = F.col("rounds")
    kinds = F.array_join(F.transform(r, lambda x: F.concat(x["round_type"], F.lit(":"), x["window_start_date"], F.lit(".."), x["window_end_date"])), ">")
    picks = F.array_join(F.transform(r, lambda x: F.array_join(F.transform(x["results"], lambda y: y["capture_date"]), ",")), "|")
    return done.select("anchor_id", "status", F.size("rounds").alias("n_rounds"), kinds.alias("kinds"), picks.alias("picks"))


# months from 2009-01; m = 3 is 2009-04, the last is 2025-03
_DRY = """RECURSIVE h AS (SELECT CAST(c_custkey AS VARCHAR) AS anchor_id, CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS seed FROM customer),
gen AS (SELECT anchor_id, seed, 3::BIGINT AS m FROM h UNION ALL SELECT anchor_id, seed, m + 4 + (m % 12 + 1 + seed) % 5 FROM gen WHERE m + 4 + (m % 12 + 1 + seed) % 5 < 195),
dv AS (SELECT anchor_id, seed, printf('%04d-%02d-01', 2009 + m // 12, m % 12 + 1) AS d, CAST(100 + seed % 50 + row_number() OVER (PARTITION BY anchor_id ORDER BY m) - 1 AS INTEGER) AS version FROM gen WHERE (m % 12 + 1 + seed) % 7 <> 0)"""
_DRY_BASE = """SELECT h.anchor_id, coalesce(list({'d': d, 'p': CASE h.seed % 6 WHEN 4 THEN true WHEN 5 THEN false ELSE d >= CASE h.seed % 6 WHEN 0 THEN '2015' WHEN 1 THEN '2018' WHEN 2 THEN '2020' ELSE '2023' END || '-06-15' END, 'q': 'usable', 's': 'dry_run_stub'} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS v
FROM h LEFT JOIN dv ON dv.anchor_id = h.anchor_id GROUP BY 1"""


def _dry_states(spark, sf_dir):
    anchors = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("anchor_id"), F.col("c_nationkey").cast("string").alias("region_key"), F.lit("g").alias("grid_id"))
    return scan.new_states(spread(anchors, "anchor_id")).withColumn("vintages", scan.dry_run_vintages(F.col("anchor_id")))


@query(f"WITH {_DRY} SELECT anchor_id, d AS capture_date, version FROM dv")
def dry_run_catalog(spark, sf_dir):
    # outer, since for an inner one the optimizer makes the dates before it as well
    return _dry_states(spark, sf_dir).select("anchor_id", F.inline_outer("vintages")).where("capture_date is not null")


@query(f"WITH {_DRY}, {_scan_sql(_DRY_BASE, ScanConfig())} {_OUT}")
def adaptive_scan_dry_run(spark, sf_dir):
    return _out(scan.run_scan(_dry_states(spark, sf_dir), scan.by_column(scan.dry_run_score)))


# parts as keys, their ship dates as the catalog; presence from a date on for most
_REPLAY_BASE = """SELECT CAST(l_partkey AS VARCHAR) AS anchor_id, list({'d': d, 'p': p, 'q': q, 's': s} ORDER BY d) AS v FROM (
  SELECT l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, CAST(min(l_suppkey * 10 + l_linenumber) AS INTEGER) AS ver, bool_or(l_returnflag = 'R' AND l_partkey % 3 = 0) AS bad, bool_or(l_returnflag = 'R') AS ret,
    CASE WHEN bool_or(l_returnflag = 'R' AND l_partkey % 3 = 0) THEN NULL WHEN l_partkey % 11 = 0 THEN min(l_linestatus) = 'O' ELSE CAST(l_shipdate AS DATE) >= DATE '1995-01-01' + CAST((l_partkey * 37) % 3000 - 250 AS INTEGER) END AS p,
    CASE WHEN bool_or(l_returnflag = 'R' AND l_partkey % 3 = 0) THEN 'unusable' ELSE 'usable' END AS q, CASE WHEN bool_or(l_returnflag = 'R' AND l_partkey % 6 = 0) THEN 'gemini_failed' ELSE 'gemini_batch' END AS s
  FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)) GROUP BY 1"""


def _replay(spark, sf_dir):
    day, part = F.col("l_shipdate").cast("date"), F.col("l_partkey")
    returned = F.bool_or(F.col("l_returnflag") == "R")
    rows = table(spark, sf_dir, "lineitem").groupBy(part, day.alias("day")).agg(F.min(F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("version"), returned.alias("r"), F.min("l_linestatus").alias("ls"))
    bad = F.col("r") & (part % 3 == 0)
    since = F.date_add(F.lit("1995-01-01").cast("date"), ((part * 37) % 3000 - 250).cast("int"))
    present = F.when(bad, None).when(part % 11 == 0, F.col("ls") == "O").otherwise(F.col("day") >= since)
    catalog = rows.select(part.cast("string").alias("anchor_id"), F.col("day").alias("capture_date"), "version", present.alias("p"), F.when(bad, "unusable").otherwise("usable").alias("q"), F.when(F.col("r") & (part % 6 == 0), "gemini_failed").otherwise("gemini_batch").alias("s"))
    anchors = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("anchor_id"), F.lit("r").alias("region_key"), F.lit("g").alias("grid_id"))
    anchors = anchors.join(catalog.select("anchor_id").distinct(), "anchor_id", "left_semi")
    return scan.with_catalog(scan.new_states(anchors, REPLAY), catalog, ["p", "q", "s"])


def _known_score(pick):
    v = F.get(F.filter("vintages", lambda x: x["capture_date"] == pick["capture_date"]), F.lit(0))
    return F.struct(
        pick["chip_index"].alias("chip_index"), pick["capture_date"].alias("capture_date"), pick["version"].alias("version"), v["p"].alias("pv_present"), F.lit(0.9).alias("confidence"), v["q"].alias("quality_flag"), v["s"].alias("decision_source"),
        F.lit("").alias("evidence"), F.lit("").alias("notes"), F.lit("").alias("chip_path"), pick["requested_zoom"].alias("actual_zoom"),
    )


@query(f"WITH RECURSIVE {_scan_sql(_REPLAY_BASE, REPLAY)} {_OUT}")
def adaptive_scan_replay(spark, sf_dir):
    return _out(scan.run_scan(_replay(spark, sf_dir), scan.by_column(_known_score), REPLAY))


@query(f"WITH {_DRY}, {_scan_sql(_DRY_BASE, ScanConfig())} SELECT anchor_id, rounds[1].picks[i] AS capture_date, i::INTEGER AS chip_index FROM sc, (SELECT unnest(range(1, 6)) AS i) WHERE status = 'scanning' AND len(rounds) = 1 AND i <= len(rounds[1].picks)")
def initial_round_plan(spark, sf_dir):
    picks = written(scan.decide(written(_dry_states(spark, sf_dir), "states")), "decided").where("action = 'execute_round'").select("anchor_id", F.explode("next_round.picks").alias("p"))
    return picks.select("anchor_id", "p.capture_date", "p.chip_index")


@query(f"WITH RECURSIVE {_scan_sql(_REPLAY_BASE, REPLAY)} SELECT status, count(*) AS n_anchors, sum(len(rounds))::BIGINT AS n_rounds, sum(len(flatten(list_transform(rounds, lambda r: r.picks))))::BIGINT AS n_observations FROM sc WHERE status <> 'scanning' GROUP BY 1")
def scan_summary(spark, sf_dir):
    return scan.summary(scan.run_scan(_replay(spark, sf_dir), scan.by_column(_known_score), REPLAY))


@query(f"""WITH RECURSIVE {_scan_sql(_REPLAY_BASE, REPLAY)},
x AS (SELECT anchor_id, status, len(rounds) AS n_rounds, unnest(flatten(list_transform(rounds, lambda r: r.picks))) AS d FROM sc WHERE status <> 'scanning'),
y AS (SELECT x.anchor_id, status, n_rounds, CAST(x.d AS DATE) AS d, o.p, o.q, x.d AS t FROM x JOIN (SELECT anchor_id, unnest(v, recursive := true) FROM b) o ON o.anchor_id = x.anchor_id AND o.d = x.d),
z AS (SELECT *, q = 'usable' AND p IS NOT NULL AS us FROM y),
f AS (SELECT *, us AND NOT p AND count(*) FILTER (WHERE us) OVER (PARTITION BY anchor_id) >= 3 AND min(d) FILTER (WHERE us AND p) OVER (PARTITION BY anchor_id) < d AND max(d) FILTER (WHERE us AND p) OVER (PARTITION BY anchor_id) > d AS dip FROM z),
g AS (SELECT *, p OR coalesce(dip, false) AS p2 FROM f),
k AS (SELECT anchor_id, status, n_rounds, bool_or(coalesce(dip, false)) AS rp, max(d) FILTER (WHERE us AND NOT p2) AS lo, min(d) FILTER (WHERE us AND p2) AS hi, min(d) FILTER (WHERE us) AS fd, count(*) FILTER (WHERE us AND p2) AS n_present, count(*) FILTER (WHERE us AND NOT p2) AS n_absent, count(*) AS n_observations FROM g GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN rp AND status = 'done_ambiguous_nonmonotonic' AND NOT coalesce(lo > hi, false) THEN CASE WHEN lo < hi THEN 'done_appears' WHEN lo IS NULL THEN 'done_already_present_before_geid_history' ELSE status END ELSE status END AS s FROM k)
SELECT anchor_id, CASE WHEN s = 'done_installed_during_census' AND lo >= DATE '2001-06-30' THEN 'done_ambiguous_marker_missed_pv' ELSE s END AS status, CASE WHEN s = 'done_appears' AND lo <= hi THEN lo WHEN s = 'done_installed_during_census' AND lo < DATE '2001-06-30' THEN lo END AS interval_start,
CASE WHEN s = 'done_appears' AND lo <= hi THEN hi WHEN s = 'done_installed_during_census' AND lo < DATE '2001-06-30' THEN DATE '2001-06-30' WHEN s = 'done_already_present_before_geid_history' THEN fd END AS interval_end, n_observations, n_present, n_absent, CAST(n_rounds AS INTEGER) AS n_rounds FROM m""")
def scan_to_intervals(spark, sf_dir):
    """The flagship: a scan of all parts, its dips repaired, its intervals."""
    done = scan.run_scan(_replay(spark, sf_dir), scan.by_column(_known_score), REPLAY)
    rows = S.state_intervals(done.drop("vintages"), F.lit("2001-06-30").cast("date"))
    return rows.select("anchor_id", "status", "interval_start", "interval_end", "n_observations", "n_present", "n_absent", "n_rounds")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS anchor_id, CAST(c_custkey * 7 % 900 AS INTEGER) AS days, CASE WHEN c_custkey * 7 % 900 <= 365 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN c_custkey * 7 % 900 <= 183 THEN 'high' WHEN c_custkey * 7 % 900 <= 730 THEN 'medium' ELSE 'low' END AS appears FROM customer""")
def confidence_bands(spark, sf_dir):
    from onset.functions.parse import appears_confidence

    days = (F.col("c_custkey") * 7 % 900).cast("int")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("anchor_id"), days.alias("days"), census_confidence(days).alias("confidence"), appears_confidence(days).alias("appears"))
