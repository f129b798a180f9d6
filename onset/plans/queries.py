"""The driver's queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from onset.functions import parse
from onset.operators import catalog as C
from onset.operators import series as S
from onset.plans.registry import ORACLE_SQL, QUERIES, query
from onset.sources.tables import ORDER, catalog, observations, table

KEY = "anchor_id"
CENSUS = "2000-06-30"

_OBS = """o AS (SELECT l_orderkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date, CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'O' END AS pv_present,
  l_discount * 10 AS pv_score, CASE WHEN l_returnflag <> 'R' THEN 'usable' ELSE 'unusable' END AS quality_flag, l_linenumber AS line_no, l_partkey AS version, l_suppkey AS supplier, l_extendedprice AS price FROM lineitem)"""
_CAT = """c AS (SELECT l_orderkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date, CASE WHEN l_suppkey % 2 = 0 THEN 19 ELSE 18 END AS zoom,
  l_partkey AS version, l_linenumber AS line_no, l_suppkey AS supplier, l_extendedprice AS price, l_returnflag AS flag FROM lineitem)"""
_BY = "capture_date, line_no, version, supplier, price"


def _legacy_sql(run: int) -> str:
    return f"""WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY {_BY}) AS rn FROM o WHERE pv_present IS NOT NULL),
k AS (SELECT *, count(*) FILTER (WHERE pv_present) OVER (PARTITION BY anchor_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND {run - 1} FOLLOWING) = {run} AS st FROM r),
i AS (SELECT anchor_id, min(rn) FILTER (WHERE st) AS i FROM k GROUP BY 1),
a AS (SELECT r.anchor_id, count(*) AS n, count(*) FILTER (WHERE pv_present) AS np, count(*) FILTER (WHERE NOT pv_present) AS na, max(capture_date) AS last_d,
  max(capture_date) FILTER (WHERE NOT pv_present) AS ab, min(capture_date) FILTER (WHERE pv_present) AS pr, max(i.i) AS i,
  min(capture_date) FILTER (WHERE rn = i.i) AS at_d, max(capture_date) FILTER (WHERE NOT pv_present AND rn < i.i) AS bef, count(*) FILTER (WHERE NOT pv_present AND rn > i.i) AS aft FROM r JOIN i USING (anchor_id) GROUP BY 1),
s AS (SELECT k.anchor_id, coalesce(n, 0) AS n, coalesce(np, 0) AS np, coalesce(na, 0) AS na, last_d, ab, pr, at_d, bef,
  CASE WHEN n IS NULL THEN 'no_valid_observations' WHEN np = 0 THEN 'not_seen' WHEN i IS NULL THEN 'ambiguous_sporadic_positive' WHEN aft > 0 THEN 'ambiguous_nonmonotonic' WHEN bef IS NULL THEN 'already_present' ELSE 'appears' END AS status
  FROM (SELECT DISTINCT anchor_id FROM o) k LEFT JOIN a USING (anchor_id)),
f AS (SELECT *, CASE status WHEN 'not_seen' THEN last_d WHEN 'ambiguous_sporadic_positive' THEN ab ELSE bef END AS lo, CASE status WHEN 'ambiguous_sporadic_positive' THEN pr ELSE at_d END AS hi FROM s)
SELECT anchor_id, status, lo AS latest_absent_date, hi AS earliest_present_date, lo AS interval_start, hi AS interval_end,
  CASE WHEN status IN ('already_present', 'appears') THEN 'high' WHEN status = 'not_seen' THEN 'medium' ELSE 'low' END AS confidence, n AS n_observations, na AS n_absent, np AS n_present FROM f"""


@query(_legacy_sql(1))
def interval_legacy(spark, sf_dir):
    return S.first_appearance(observations(spark, sf_dir), KEY, ORDER)


@query(_legacy_sql(2))
def interval_legacy_k2(spark, sf_dir):
    return S.first_appearance(observations(spark, sf_dir), KEY, ORDER, run=2)


_DIP = f"""{_OBS}, q AS (SELECT *, pv_present AND pv_score >= 0.5 AS sure, row_number() OVER (PARTITION BY anchor_id ORDER BY {_BY}) AS rn FROM o WHERE pv_present IS NOT NULL),
d AS (SELECT *, NOT pv_present AND coalesce(bool_or(sure) OVER (PARTITION BY anchor_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  AND coalesce(bool_or(sure) OVER (PARTITION BY anchor_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS flipped FROM q),
rep AS (SELECT anchor_id, {_BY}, pv_present OR flipped AS pv_present, pv_score, flipped FROM d UNION ALL SELECT anchor_id, {_BY}, pv_present, pv_score, false FROM o WHERE pv_present IS NULL)"""


@query(f"WITH {_DIP} SELECT anchor_id, capture_date, line_no, version, supplier, pv_present, flipped FROM rep")
def dip_repair(spark, sf_dir):
    return S.repair_dips(observations(spark, sf_dir), KEY, ORDER).select(KEY, "capture_date", "line_no", "version", "supplier", "pv_present", "flipped")


@query(f"""WITH {_OBS}, t AS (SELECT anchor_id, lag(capture_date) OVER w AS absent_date, lag(pv_present) OVER w AS b, capture_date AS present_date, pv_present AS n FROM o WHERE pv_present IS NOT NULL
WINDOW w AS (PARTITION BY anchor_id ORDER BY {_BY})) SELECT anchor_id, absent_date, present_date FROM t WHERE n AND NOT b""")
def transitions(spark, sf_dir):
    return S.transitions(observations(spark, sf_dir), KEY, ORDER)


@query(f"""WITH {_OBS}, t AS (SELECT anchor_id, lag(pv_present) OVER (PARTITION BY anchor_id ORDER BY {_BY}) AS b, pv_present AS n FROM o WHERE pv_present IS NOT NULL)
SELECT anchor_id, count(*) AS n_reversals FROM t WHERE b AND NOT n GROUP BY 1""")
def nonmonotonic_keys(spark, sf_dir):
    return S.reversals(observations(spark, sf_dir), KEY, ORDER)


@query(f"""WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY {_BY}) AS rn FROM o WHERE pv_present IS NOT NULL),
k AS (SELECT *, count(*) FILTER (WHERE pv_present) OVER (PARTITION BY anchor_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 AS st FROM r)
SELECT anchor_id, arg_min(capture_date, rn) AS start_date FROM k WHERE st GROUP BY 1""")
def stable_run_k2(spark, sf_dir):
    return S.stable_start(observations(spark, sf_dir), KEY, ORDER, 2)


@query(f"""WITH {_OBS}, r AS (SELECT *, row_number() OVER w AS rn, coalesce(bool_or(coalesce(pv_present, false)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM o WINDOW w AS (PARTITION BY anchor_id ORDER BY {_BY}))
SELECT anchor_id, string_agg(CASE WHEN pv_present THEN '1' WHEN NOT pv_present THEN '0' ELSE '?' END, '-' ORDER BY rn) AS pattern, min(capture_date) FILTER (WHERE pv_present) AS first_present,
CASE WHEN coalesce(bool_or(seen AND NOT pv_present), false) THEN 'non_monotonic_requires_review' WHEN bool_or(pv_present IS NULL) THEN 'monotonic_with_unknown' ELSE 'monotonic' END AS consistency FROM r GROUP BY 1""")
def sequence_pattern(spark, sf_dir):
    return S.patterns(observations(spark, sf_dir), KEY, ORDER)


@query(f"""WITH {_OBS}, u AS (SELECT *, CASE WHEN quality_flag = 'usable' AND line_no <= 4 THEN pv_present END AS p FROM o),
m AS (SELECT *, coalesce(NOT p AND coalesce(bool_or(coalesce(p, false)) OVER (PARTITION BY anchor_id ORDER BY {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false), false) AS bad FROM u)
SELECT anchor_id, capture_date, line_no, version, supplier, CASE WHEN bool_or(bad) OVER (PARTITION BY anchor_id) THEN quality_flag || ' | non_monotonic' ELSE quality_flag END AS notes FROM m""")
def flag_nonmonotonic(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("notes", F.col("quality_flag"))
    done = S.flag_reversed(rows, KEY, ORDER, (F.col("quality_flag") == "usable") & (F.col("line_no") <= 4))
    return done.select(KEY, "capture_date", "line_no", "version", "supplier", "notes")


_STATUS = f"""{_OBS}, st AS (SELECT o_orderkey AS anchor_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'done_appears' WHEN '2-HIGH' THEN 'done_installed_during_census' WHEN '3-MEDIUM' THEN 'done_already_present_before_geid_history'
  WHEN '4-NOT SPECIFIED' THEN 'done_ambiguous_nonmonotonic' ELSE 'scanning' END AS st0 FROM orders),
q AS (SELECT anchor_id, st0, {_BY}, pv_present, pv_score, quality_flag, pv_present IS NOT NULL AND quality_flag = 'usable' AS us, row_number() OVER (PARTITION BY anchor_id ORDER BY pv_present IS NULL, {_BY}) AS rn FROM o JOIN st USING (anchor_id)),
d AS (SELECT *, us AND NOT pv_present AND count(*) FILTER (WHERE us) OVER (PARTITION BY anchor_id) >= 3 AND count(*) FILTER (WHERE us AND pv_present AND pv_score >= 0.5) OVER (PARTITION BY anchor_id ORDER BY rn ROWS UNBOUNDED PRECEDING) > 0
  AND count(*) FILTER (WHERE us AND pv_present AND pv_score >= 0.5) OVER (PARTITION BY anchor_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 AS dip FROM q),
e AS (SELECT *, bool_or(coalesce(dip, false)) OVER (PARTITION BY anchor_id, capture_date) AND NOT pv_present AS flipped FROM d),
rep AS (SELECT anchor_id, st0, {_BY}, quality_flag, us, rn, dip, coalesce(flipped, false) AS flipped, pv_present OR coalesce(flipped, false) AS p FROM e),
stp AS (SELECT *, lag(CASE WHEN us THEN p END) OVER (PARTITION BY anchor_id ORDER BY rn) AS bp FROM rep),
k AS (SELECT anchor_id, max(st0) AS st0, bool_or(coalesce(dip, false)) AS rp, coalesce(bool_or(bp AND us AND NOT p), false) AS back, coalesce(bool_or(NOT bp AND us AND p), false) AS turn, count(*) FILTER (WHERE us AND NOT p) AS na, count(*) FILTER (WHERE us AND p) AS np FROM stp GROUP BY 1),
r AS (SELECT anchor_id, CASE WHEN rp AND st0 = 'done_ambiguous_nonmonotonic' AND NOT back AND turn THEN 'done_appears' WHEN rp AND st0 = 'done_ambiguous_nonmonotonic' AND NOT back AND na = 0 AND np > 0 THEN 'done_already_present_before_geid_history' ELSE st0 END AS s FROM k),
a AS (SELECT anchor_id, s, max(capture_date) FILTER (WHERE us AND NOT p) AS lo, min(capture_date) FILTER (WHERE us AND p) AS hi, min(capture_date) FILTER (WHERE us) AS f,
  count(*) AS n_observations, count(*) FILTER (WHERE us AND p) AS n_present, count(*) FILTER (WHERE us AND NOT p) AS n_absent, count(*) FILTER (WHERE NOT us) AS n_unusable FROM rep JOIN r USING (anchor_id) GROUP BY 1, 2),
g AS (SELECT *, DATE '{CENSUS}' AS cd, coalesce(s = 'done_appears' AND lo <= hi, false) AS dated, coalesce(s = 'done_installed_during_census' AND lo < DATE '{CENSUS}', false) AS within, coalesce(s = 'done_installed_during_census' AND lo >= DATE '{CENSUS}', false) AS missed FROM a)"""


def _states(spark, sf_dir):
    status = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'done_appears' WHEN '2-HIGH' THEN 'done_installed_during_census' WHEN '3-MEDIUM' THEN 'done_already_present_before_geid_history' WHEN '4-NOT SPECIFIED' THEN 'done_ambiguous_nonmonotonic' ELSE 'scanning' END")
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(KEY), status.alias("status"))
    return S.repair_states(observations(spark, sf_dir).withColumn("notes", F.lit("")).join(states, KEY), KEY, ORDER)


@query(f"""WITH {_STATUS} SELECT anchor_id, capture_date, line_no, version, supplier, p AS pv_present, flipped, s AS status, CASE WHEN flipped THEN 'repaired_isolated_dip' ELSE '' END AS notes FROM rep JOIN r USING (anchor_id)""")
def repaired_states(spark, sf_dir):
    return _states(spark, sf_dir).select(KEY, "capture_date", "line_no", "version", "supplier", "pv_present", "flipped", "status", "notes")


@query(f"""WITH {_STATUS} SELECT anchor_id, CASE WHEN missed THEN 'done_ambiguous_marker_missed_pv' ELSE s END AS status,
CASE WHEN (s = 'done_appears' AND lo IS NOT NULL AND hi IS NOT NULL) OR s = 'done_installed_during_census' THEN lo END AS latest_absent_date,
CASE WHEN s = 'done_appears' AND lo IS NOT NULL AND hi IS NOT NULL THEN hi WHEN s = 'done_already_present_before_geid_history' THEN f END AS earliest_present_date,
CASE WHEN dated OR within THEN lo END AS interval_start, CASE WHEN dated THEN hi WHEN within THEN cd WHEN s = 'done_already_present_before_geid_history' THEN f END AS interval_end,
CASE WHEN dated THEN lo + CAST(floor((hi - lo) / 2) AS INTEGER) WHEN within THEN cd END AS mid_estimate,
CASE WHEN dated THEN CASE WHEN hi - lo <= 183 THEN 'high' WHEN hi - lo <= 730 THEN 'medium' ELSE 'low' END WHEN within THEN CASE WHEN cd - lo <= 365 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
CASE WHEN (s = 'done_appears' AND (lo IS NULL OR hi IS NULL)) OR (s = 'done_installed_during_census' AND lo IS NULL) THEN 'inconsistent' WHEN s = 'done_appears' AND lo > hi THEN 'inverted_interval' WHEN missed THEN 'marker_missed_pv' WHEN s = 'scanning' THEN 'scan_in_progress' ELSE '' END AS notes,
n_observations, n_present, n_absent, n_unusable FROM g""")
def interval_phase0(spark, sf_dir):
    return S.scan_intervals(_states(spark, sf_dir), KEY, F.lit(CENSUS).cast("date"), quality="quality_flag")


@query(f"WITH w AS ({_legacy_sql(1)}) SELECT status, confidence, count(*) AS n FROM w GROUP BY 1, 2")
def status_histogram(spark, sf_dir):
    return interval_legacy(spark, sf_dir).groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query(f"""WITH {_CAT}, g AS (SELECT anchor_id, capture_date, string_agg(DISTINCT version, ';' ORDER BY version) AS all_versions, count(DISTINCT version) AS n_versions FROM c GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, capture_date ORDER BY version, line_no, supplier, price, flag) AS rn FROM c)
SELECT anchor_id, capture_date, version, zoom, all_versions, n_versions FROM b JOIN g USING (anchor_id, capture_date) WHERE rn = 1""")
def catalog_dedupe(spark, sf_dir):
    return C.dedupe_by_date(catalog(spark, sf_dir), [KEY, "capture_date"], "version", ["line_no", "supplier", "price", "flag"]).select(KEY, "capture_date", "version", "zoom", "all_versions", "n_versions")


_AVAIL = "SELECT DISTINCT anchor_id, zoom, capture_date FROM c WHERE flag <> 'R'"


@query(f"WITH {_CAT} SELECT anchor_id, capture_date, zoom, version, line_no, supplier FROM c SEMI JOIN ({_AVAIL}) USING (anchor_id, zoom, capture_date)")
def availability_semi(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return rows.join(rows.where("flag <> 'R'").select(KEY, "zoom", "capture_date"), [KEY, "zoom", "capture_date"], "left_semi").select(KEY, "capture_date", "zoom", "version", "line_no", "supplier")


@query(f"""WITH {_CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, capture_date ORDER BY zoom DESC, version, line_no, supplier, price, flag) AS rn FROM c)
SELECT anchor_id, capture_date, zoom, version FROM r WHERE rn = 1""")
def catalog_priority_union(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    return C.priority_union([rows.where("zoom = 19"), rows.where("zoom = 18")], [KEY, "capture_date"], ["version", "line_no", "supplier", "price", "flag"]).select(KEY, "capture_date", "zoom", "version")


@query(f"""WITH {_CAT}, t AS (SELECT anchor_id, line_no, version, supplier, capture_date, z.position, (supplier + z.position) % 3 = 0 AS ok, 20 - z.position AS actual FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS position) z)
SELECT anchor_id, line_no, version, supplier, arg_min(actual, position) FILTER (WHERE ok) AS actual, CASE WHEN bool_or(ok) THEN 'ok' ELSE 'all_zooms_failed' END AS status, count(*) AS n_attempts FROM t GROUP BY 1, 2, 3, 4""")
def ladder_first_success(spark, sf_dir):
    tries = catalog(spark, sf_dir).select(KEY, "line_no", "version", "supplier", F.explode(F.array(*map(F.lit, range(3)))).alias("position")).withColumn("zoom", 20 - F.col("position"))
    return C.first_success(tries, [KEY, "line_no", "version", "supplier"], "position", (F.col("supplier") + F.col("position")) % 3 == 0, "zoom")


@query(f"""WITH {_OBS}, m AS (SELECT l_orderkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date, max(CASE WHEN l_linestatus = 'O' THEN 'present' ELSE '' END) AS flag FROM lineitem WHERE l_tax = 0 GROUP BY 1, 2),
b AS (SELECT *, capture_date + INTERVAL 1 DAY AS req FROM o)
SELECT b.anchor_id, b.capture_date, line_no, version, supplier, CASE WHEN x.anchor_id IS NOT NULL THEN coalesce(nullif(x.flag, ''), quality_flag) WHEN y.anchor_id IS NOT NULL THEN coalesce(nullif(y.flag, ''), quality_flag) ELSE quality_flag END AS quality_flag,
CASE WHEN x.anchor_id IS NOT NULL OR y.anchor_id IS NOT NULL THEN 'manual' ELSE 'scorer' END AS decision_source
FROM b LEFT JOIN m x ON x.anchor_id = b.anchor_id AND x.capture_date = CAST(b.req AS DATE) LEFT JOIN m y ON y.anchor_id = b.anchor_id AND y.capture_date = b.capture_date""")
def override_merge(spark, sf_dir):
    manual = table(spark, sf_dir, "lineitem").where("l_tax = 0").groupBy(F.col("l_orderkey").alias(KEY), F.col("l_shipdate").cast("date").alias("capture_date")).agg(F.max(F.when(F.col("l_linestatus") == "O", "present").otherwise("")).alias("quality_flag"))
    manual = manual.withColumns({"requested_date": F.col("capture_date"), "decision_source": F.lit("")})
    base = observations(spark, sf_dir).withColumns({"requested_date": F.date_add("capture_date", 1), "decision_source": F.lit("scorer")})
    return C.override(base, manual, [KEY, "requested_date"], [KEY, "capture_date"], ["quality_flag"]).select(KEY, "capture_date", "line_no", "version", "supplier", "quality_flag", "decision_source")


@query("""SELECT o_orderkey AS anchor_id, make_date(y, 6, 15) AS requested_date, o_orderkey || '_' || y || '0615' AS task_name FROM orders CROSS JOIN (SELECT unnest(range(2018, 2021)) AS y) WHERE o_orderstatus = 'P'""")
def task_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias(KEY), F.explode(F.sequence(F.lit(2018), F.lit(2020))).alias("y"))
    return rows.select(KEY, F.make_date("y", F.lit(6), F.lit(15)).alias("requested_date"), F.concat(F.col(KEY), F.lit("_"), F.col("y"), F.lit("0615")).alias("task_name"))


@query("""WITH f AS (SELECT o_orderkey AS anchor_id, count(l_orderkey) AS n_files, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates, min(CAST(l_shipdate AS DATE)) AS first_date FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' GROUP BY 1)
SELECT *, CASE WHEN n_files = 0 THEN 'missing_chip' ELSE 'manual_template' END AS decision_source, CASE WHEN n_files = 0 THEN 'missing_chip' WHEN n_dates = 0 THEN 'no_date_metadata' WHEN n_dates > 1 THEN 'mixed_capture_dates' ELSE 'needs_review' END AS quality_flag FROM f""")
def task_quality(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").cast("string").alias("path"), F.col("l_shipdate").cast("date").alias("d"))
    found = C.file_summary(files, ["l_orderkey"], "path", "d").select("l_orderkey", "n_files", "n_dates", "first_date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(KEY)).join(found, F.col(KEY) == F.col("l_orderkey"), "left").drop("l_orderkey").na.fill(0, ["n_files", "n_dates"])
    source, flag = C.task_quality(F.col("n_files"), F.col("n_dates"))
    return rows.withColumns({"decision_source": source, "quality_flag": flag})


_CELLS = """f AS (SELECT o_custkey AS anchor_id, CAST(y AS INTEGER) AS requested_year, CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'P' AND o_custkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS path,
  CASE WHEN o_custkey % 50 <> 0 AND NOT (o_orderstatus = 'P' AND o_custkey % 7 = 0) AND o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS d FROM orders, (SELECT unnest(range(1995, 2002)) AS y) WHERE year(o_orderdate) BETWEEN y - 1 AND y),
k AS (SELECT anchor_id, requested_year, d, count(*) FILTER (WHERE path <> '') AS n, count(path) AS there FROM f GROUP BY 1, 2, 3),
cells AS (SELECT anchor_id, requested_year, sum(n)::BIGINT AS n_tiles, count(d) AS n_dates, arg_max(d, n * 1000000 - date_diff('day', DATE '1970-01-01', d)) FILTER (WHERE d IS NOT NULL) AS dominant_date,
  CASE WHEN max(there) = 0 THEN 'missing_folder' WHEN sum(n) = 0 THEN 'empty' WHEN count(d) = 0 THEN 'no_date_metadata' WHEN bool_or(year(d) = requested_year) THEN 'available' ELSE 'drift' END AS status FROM k GROUP BY 1, 2)"""
YEARS = list(range(1995, 2002))


def _cells(spark, sf_dir):
    """Folders of customers and years: a few missing, empty or without dates, others
    with files of the year or the one before."""
    o = table(spark, sf_dir, "orders")
    none, empty = F.col("o_custkey") % 50 == 0, (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 7 == 0)
    path = F.when(none, None).when(empty, "").otherwise(F.col("o_orderkey").cast("string"))
    d = F.when(~none & ~empty & (F.col("o_orderpriority") != "5-LOW"), F.col("o_orderdate").cast("date"))
    y = F.year("o_orderdate")
    files = o.select(F.col("o_custkey").alias(KEY), F.explode(F.filter(F.array(y, y + 1), lambda x: x.between(YEARS[0], YEARS[-1]))).alias("requested_year"), path.alias("path"), d.alias("d"))
    return C.cell_status(files, [KEY], "requested_year", "path", "d")


@query(f"WITH {_CELLS} SELECT * FROM cells")
def cell_status(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"WITH {_CELLS} SELECT anchor_id, " + ", ".join(f"coalesce(max(CASE status WHEN 'available' THEN 'Y' WHEN 'drift' THEN '~' ELSE '.' END) FILTER (WHERE requested_year = {y}), '?') AS y{y}" for y in YEARS) + " FROM cells GROUP BY 1")
def year_pivot(spark, sf_dir):
    return C.year_pivot(_cells(spark, sf_dir), [KEY], "requested_year", C.cell_mark(F.col("status")), YEARS)


@query(f"WITH {_CELLS} SELECT anchor_id, " + ", ".join(f"coalesce(max(CAST(dominant_date AS VARCHAR)) FILTER (WHERE requested_year = {y}), '') AS y{y}" for y in YEARS) + " FROM cells GROUP BY 1")
def year_pivot_dates(spark, sf_dir):
    return C.year_pivot(_cells(spark, sf_dir), [KEY], "requested_year", F.col("dominant_date").cast("string"), YEARS, missing="")


@query("""SELECT l_orderkey AS anchor_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates, count(DISTINCT year(l_shipdate)) AS n_years, CAST(min(year(l_shipdate)) AS INTEGER) AS min_year, CAST(max(year(l_shipdate)) AS INTEGER) AS max_year, string_agg(DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ';' ORDER BY CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS dates FROM lineitem GROUP BY 1""")
def key_dates_rollup(spark, sf_dir):
    d = F.col("l_shipdate").cast("date")
    days = F.sort_array(F.collect_set(d))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(KEY)).agg(F.size(days).cast("long").alias("n_dates"), F.size(F.array_distinct(F.transform(days, F.year))).cast("long").alias("n_years"), F.year(F.min(d)).alias("min_year"), F.year(F.max(d)).alias("max_year"), F.array_join(F.transform(days, parse.date_text), ";").alias("dates"))


@query("""SELECT r_name AS region_key, count(DISTINCT c_custkey) AS n_anchors, round(avg(o_totalprice), 4) AS mean_price, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def region_summary(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    by = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    rows = t("customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region_key")).agg(F.count("*").alias("n_anchors"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_price"), F.min("a").cast("date").alias("first_date"), F.max("b").cast("date").alias("last_date"))


@query(f"WITH {_CELLS} SELECT n_name AS region_key, requested_year, count(DISTINCT anchor_id) AS n_anchors, count(*) FILTER (WHERE status = 'available') AS n_hits FROM cells JOIN customer ON c_custkey = anchor_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def year_coverage(spark, sf_dir):
    """A cell is an anchor's year, so they are counted without being told apart."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region_key"))
    where = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(nations), "n_nationkey")  # nations are 25
    rows = _cells(spark, sf_dir).join(where, KEY)
    return rows.groupBy("region_key", "requested_year").agg(F.count("*").alias("n_anchors"), F.count_if(F.col("status") == "available").alias("n_hits"))


@query("SELECT p_brand, p_type, p_partkey, p_size, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 2")
def topn_per_stratum(spark, sf_dir):
    return C.first_rows(table(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_size", "p_partkey"], 2).select("p_brand", "p_type", "p_partkey", "p_size", "rank")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, median(n) AS median_size, max(n) AS max_size, count(*) FILTER (WHERE n = 1) AS n_single, round(sum(n) / count(*), 6) AS reduction,
(SELECT string_agg(n || ':' || k, ',' ORDER BY n) FROM (SELECT n, count(*) AS k FROM g GROUP BY 1)) AS histogram FROM g""")
def group_summary(spark, sf_dir):
    return C.group_summary(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query(f"""WITH {_CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY {_BY}, flag) - 1 AS i, count(*) OVER (PARTITION BY anchor_id) AS n FROM c),
k AS (SELECT * FROM r WHERE n <= 5 OR list_contains([round_even(x * (n - 1) / 4.0, 0)::INTEGER FOR x IN [0, 1, 2, 3, 4]], i::INTEGER))
SELECT anchor_id, capture_date, version, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY i) AS INTEGER) AS chip_index FROM k""")
def even_picks(spark, sf_dir):
    return C.even_picks(catalog(spark, sf_dir), KEY, [*ORDER, "flag"], 5).select(KEY, "capture_date", "version", "chip_index")


@query(f"""WITH {_CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY {_BY}, flag) - 1 AS i FROM c)
SELECT anchor_id, capture_date, version, CAST(i // 3 AS INTEGER) AS chunk, CAST(i % 3 + 1 AS INTEGER) AS local_index FROM r""")
def chunk_plan(spark, sf_dir):
    return C.chunks(catalog(spark, sf_dir), [KEY], [*ORDER, "flag"], 3).select(KEY, "capture_date", "version", "chunk", "local_index")


_LEFT = """d AS (SELECT DISTINCT l_partkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date FROM lineitem), sc AS (SELECT DISTINCT l_partkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber <= 2),
b AS (SELECT anchor_id, median(capture_date)::DATE AS boundary, min(capture_date) AS absent_date, max(capture_date) AS present_date FROM sc GROUP BY 1), lft AS (SELECT * FROM d ANTI JOIN sc USING (anchor_id, capture_date))"""


def _left(spark, sf_dir):
    """Catalog dates of parts, those scored, and what is left."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias(KEY), F.col("l_shipdate").cast("date").alias("capture_date"), "l_returnflag", "l_linenumber")
    scored = rows.where("l_returnflag = 'N' and l_linenumber <= 2").select(KEY, "capture_date").distinct()
    days = F.median(F.unix_date("capture_date"))
    bounds = scored.groupBy(KEY).agg(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(days).cast("int")).alias("boundary"), F.min("capture_date").alias("absent_date"), F.max("capture_date").alias("present_date"))
    return C.unscored(rows, scored, KEY, "capture_date"), bounds


@query(f"WITH {_LEFT} SELECT anchor_id, capture_date FROM lft JOIN b USING (anchor_id) WHERE capture_date < boundary AND year(capture_date) >= year(boundary) - 2")
def walk_back_candidates(spark, sf_dir):
    left, bounds = _left(spark, sf_dir)
    return C.walk_back_dates(left, bounds, KEY, "capture_date", "boundary", 2)


@query(f"WITH {_LEFT} SELECT anchor_id, capture_date FROM lft JOIN b USING (anchor_id) WHERE capture_date < boundary")
def tail_candidates(spark, sf_dir):
    left, bounds = _left(spark, sf_dir)
    return C.tail_dates(left, bounds, KEY, "capture_date", "boundary")


@query(f"WITH {_LEFT} SELECT anchor_id, capture_date FROM lft JOIN b USING (anchor_id) WHERE capture_date > absent_date AND capture_date < present_date")
def bisection_candidates(spark, sf_dir):
    left, bounds = _left(spark, sf_dir)
    return C.gap_dates(left, bounds, KEY, "capture_date")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS anchor_id, CAST(l_shipdate AS DATE) AS capture_date FROM lineitem), k AS (SELECT *, count(*) FILTER (WHERE year(capture_date) >= 1999) OVER (PARTITION BY anchor_id) AS n FROM d)
SELECT anchor_id, capture_date, n = 0 AS degraded FROM k WHERE n = 0 OR year(capture_date) >= 1999""")
def floor_year_picks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(KEY), F.col("l_shipdate").cast("date").alias("capture_date")).distinct()
    return C.floor_rows(rows, KEY, "capture_date", 1999)


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(nullif(trim(regexp_replace(event_type || ' ' || user_id || '!', '[^A-Za-z0-9_.-]+', '_', 'g'), '._-'), ''), 'task') AS token, printf('%.4f', value) AS value_text, sha256(props) AS digest FROM events""")
def scalar_parsers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"), F.lit("!"))
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), parse.token(raw).alias("token"), parse.fixed(F.col("value"), 4).alias("value_text"), F.sha2("props", 256).alias("digest"))


_ATTEMPT = "SELECT l_orderkey AS doc, l_linenumber AS attempt, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_valid FROM lineitem GROUP BY 1, 2"


@query(f"WITH a AS ({_ATTEMPT}) SELECT doc, CAST(arg_max(attempt, n_valid * 1000 - attempt) AS INTEGER) AS attempt, max(n_valid) AS n_valid FROM a GROUP BY 1")
def best_attempt_salvage(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("attempt")).agg(F.count_if(F.col("l_returnflag") != "R").alias("n_valid"))
    return C.best_attempts(a, ["doc"], "attempt", "n_valid")


_JOBS = """j AS (SELECT l_orderkey AS anchor_id, year(o_orderdate) AS w, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), dn AS (SELECT l_orderkey AS anchor_id, year(l_shipdate) AS w, l_linenumber AS line_no, l_partkey AS version FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT anchor_id, w FROM dn GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", KEY)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(KEY), F.year("o_orderdate").cast("long").alias("w"))
    jobs = rows.groupBy(KEY).agg(F.count("*").alias("n")).join(orders, KEY).select(KEY, "w", "n")
    done = rows.where("l_returnflag = 'N'").select(KEY, F.year("l_shipdate").cast("long").alias("w"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("version"))
    return C.resume(jobs, done, [KEY], 2, ["w"])


@query(f"WITH {_JOBS} SELECT anchor_id, w, n FROM j ANTI JOIN c USING (anchor_id, w)")
def resume_pending(spark, sf_dir):
    return _jobs(spark, sf_dir)[0]


@query(f"WITH {_JOBS} SELECT anchor_id, w, line_no, version FROM dn SEMI JOIN (SELECT * FROM c SEMI JOIN j USING (anchor_id, w)) x USING (anchor_id, w)")
def resume_carried(spark, sf_dir):
    return _jobs(spark, sf_dir)[1]


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2""")
def neighbor_pairs(spark, sf_dir):
    from onset.operators.spatial import near_pairs

    points = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    return near_pairs(points, "vec_id", "x", "y", 2.0)


def _responses(spark, sf_dir):
    """A response a document; some lines have the wrong type, index or form."""
    present = F.when(F.col("l_returnflag") == "R", "null").when(F.col("l_tax") == 0, "1").when(F.col("l_linestatus") == "O", "true").otherwise("false")
    line = F.format_string('{"chip_index": %d, "pv_present": %s, "confidence": %s, "quality_flag": "usable"}', "l_linenumber", present, F.col("l_discount").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.when(F.col("l_suppkey") % 10 == 0, F.lit("```json")).otherwise(line).alias("line"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("text")).withColumn("n", F.lit(5))


@query("""WITH r AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS chip_index, CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'O' END AS pv_present, l_discount AS confidence, 'usable' AS quality_flag,
row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_suppkey % 10 <> 0 AND l_linenumber <= 5 AND (l_returnflag = 'R' OR l_tax <> 0))
SELECT doc, chip_index, pv_present, confidence, quality_flag FROM r WHERE rn = 1""")
def jsonl_lenient(spark, sf_dir):
    from onset.operators.review import lenient_lines

    return lenient_lines(_responses(spark, sf_dir), "doc", "text", "n")


@query("""WITH g AS (SELECT l_orderkey AS doc, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' OR l_tax <> 0) AS good, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS hi, min(l_linenumber) AS lo FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1)
SELECT doc, good = n AND d = n AND hi = n AND lo = 1 AS ok FROM g""")
def strict_doc_validity(spark, sf_dir):
    from onset.operators.review import strict_documents

    lines = _responses(spark, sf_dir).withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.startswith("{"))).where(F.size("_l") > 0)
    docs = lines.select("doc", F.size("_l").alias("n"), F.concat(F.lit('```json\n{"observations": ['), F.array_join("_l", ","), F.lit("]}\n```")).alias("text"))
    return strict_documents(docs, "doc", "text", "n")


from onset.plans import parse_queries, place_queries, presence_queries, scan_queries, task_queries  # noqa: E402, F401
