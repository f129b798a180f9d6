"""Queries of tasks, reports and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from onset.operators import reports, scan, tasks
from onset.operators import series as S
from onset.plans.registry import query
from onset.plans.scan_queries import _DRY, _DRY_BASE, _dry_states, _scan_sql
from onset.sources import files as X
from onset.sources.config import ScanConfig
from onset.sources.shared import new_path
from onset.sources.tables import table


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("anchor_id"), F.concat(F.lit("r "), "c_nationkey").alias("region_key"), F.lit("g").alias("grid_id"), *((k / d).alias(c) for c, d in zip(tasks.BOX, (50.0, -40.0, 60.0, -30.0), strict=True)))


_BOX_SQL = "printf('%.10f', least(k / 50.0, k / 60.0)) AS left_longitude, printf('%.10f', greatest(k / 50.0, k / 60.0)) AS right_longitude, printf('%.10f', greatest(k / -40.0, k / -30.0)) AS top_latitude, printf('%.10f', least(k / -40.0, k / -30.0)) AS bottom_latitude"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, d FROM customer, (SELECT unnest(['2020-06-15', '2021-02-03']) AS d))
SELECT k::VARCHAR AS grid_id, k || '_' || replace(d, '-', '') AS task_name, 'D:\\chips\\r_' || n || '\\g\\' || k || '\\' || d[1:4] AS save_to, '' AS map_type, d AS date, 19::INTEGER AS zoom_from, 20::INTEGER AS zoom_to, {_BOX_SQL} FROM c""")
def anchor_tasks(spark, sf_dir):
    return tasks.task_rows(_boxes(spark, sf_dir), ["2020-06-15", "2021-02-03"], "D:\\chips\\", 19, 20)


@query(f"""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS st, 'reg' || c_nationkey AS region, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 3, c_custkey::VARCHAR) AS rn FROM customer), a AS (SELECT k, region, 'REG_' || st[1:3] || '_' || k AS id, y FROM s, (SELECT unnest(range(2015, 2018)) AS y) WHERE rn <= 2)
SELECT id AS grid_id, id || '_' || y AS task_name, 'D:\\p\\' || region || '\\' || id || '\\' || y AS save_to, '' AS map_type, y || '-06-15' AS date, 19::INTEGER AS zoom_from, 20::INTEGER AS zoom_to, {_BOX_SQL} FROM a""")
def probe_tasks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("anchor_id"), F.concat(F.lit("reg"), "c_nationkey").alias("region_key"), F.col("c_mktsegment").alias("suggested_stratum"), (F.col("c_custkey") % 3).alias("candidate_rank"), F.col("c_custkey").cast("string").alias("gridcell_id"))
    sample = c.join(_boxes(spark, sf_dir).select("anchor_id", *tasks.BOX), "anchor_id")
    return tasks.probe_tasks(sample, 2, 2015, 2017, "06-15", "D:\\p", 19, 20)


@query("""SELECT c_custkey AS key, CASE c_nationkey % 3 WHEN 0 THEN '2024-06-30' WHEN 1 THEN '2025-01-31' END AS census_date FROM customer""")
def census_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit(" "), F.col("c_nationkey") % 3).alias("region_key"))
    dates = spark.createDataFrame([("0", "old", "2010-01-01"), ("0", "new", "2024-06-30"), ("1", "new", "2025-01-31")], "region_key string, layer string, census_date string")
    return tasks.census_dates(rows, {"0": "new", "1": "new"}, dates).select("key", "census_date")


def _scan(spark, sf_dir):
    return scan.run_scan(_dry_states(spark, sf_dir), scan.by_column(scan.dry_run_score))


@query(f"""WITH {_DRY}, {_scan_sql(_DRY_BASE, ScanConfig())}, f AS (SELECT anchor_id, v, rounds, unnest(range(1, len(rounds) + 1)) AS i FROM sc WHERE status <> 'scanning'), p AS (SELECT anchor_id, v, i, rounds[i].kind AS kind, unnest(list_sort(rounds[i].picks)) AS d, unnest(range(0, len(rounds[i].picks))) AS position FROM f)
SELECT anchor_id, i::INTEGER AS round_id, kind AS round_type, position::INTEGER AS position, d AS capture_date, CASE WHEN list_filter(v, lambda x: x.d = d)[1].p THEN 'present' ELSE 'absent' END AS verdict FROM p""")
def chip_report(spark, sf_dir):
    return reports.chip_report(_scan(spark, sf_dir)).select("anchor_id", "round_id", "round_type", "position", "capture_date", "verdict")


@query(f"""WITH {_DRY}, {_scan_sql(_DRY_BASE, ScanConfig())}, x AS (SELECT anchor_id, status, unnest(flatten(list_transform(rounds, lambda r: r.picks))) AS d, v FROM sc WHERE status <> 'scanning'), y AS (SELECT anchor_id, status, d, list_filter(v, lambda z: z.d = d)[1].p AS p FROM x),
g AS (SELECT anchor_id, status, max(d) FILTER (WHERE NOT p) AS lo, min(d) FILTER (WHERE p) AS hi, min(d) AS f FROM y GROUP BY 1, 2)
SELECT anchor_id, CASE WHEN status = 'done_installed_during_census' AND lo >= '2024-06-30' THEN 'low' WHEN status = 'done_installed_during_census' THEN CASE WHEN date_diff('day', lo::DATE, DATE '2024-06-30') <= 365 THEN 'high' ELSE 'medium' END WHEN status = 'done_appears' THEN CASE WHEN date_diff('day', lo::DATE, hi::DATE) <= 183 THEN 'high' WHEN date_diff('day', lo::DATE, hi::DATE) <= 730 THEN 'medium' ELSE 'low' END ELSE 'low' END AS confidence_class,
CASE WHEN anchor_id::INTEGER % 4 = 0 THEN 'status=' || status || ' (no interval row available)' ELSE 'interval=[' || CASE status WHEN 'done_appears' THEN lo WHEN 'done_installed_during_census' THEN CASE WHEN lo < '2024-06-30' THEN lo ELSE '-' END ELSE '-' END || ', ' || CASE status WHEN 'done_appears' THEN hi WHEN 'done_installed_during_census' THEN CASE WHEN lo < '2024-06-30' THEN '2024-06-30' ELSE '-' END ELSE f END || ']' END AS summary FROM g""")
def anchor_report(spark, sf_dir):
    """Every fourth key has no interval row."""
    done = _scan(spark, sf_dir)
    every = S.state_intervals(done, F.lit("2024-06-30").cast("date"))
    lacking = F.col("anchor_id").cast("int") % 4 == 0
    rows = reports.anchor_report(done, every.where(~lacking)).join(every.select("anchor_id", F.col("confidence").alias("_c")), "anchor_id")
    return rows.select("anchor_id", F.when(lacking, F.col("_c")).otherwise(F.col("confidence_class")).alias("confidence_class"), F.regexp_replace("summary", r"\].*$", "]").alias("summary"))


@query("SELECT event_id, event_type, props FROM events UNION ALL SELECT event_id, event_type, props FROM events WHERE event_id % 2 = 0")
def json_log(spark, sf_dir):
    """Appended twice to a log of JSON lines in folders by kind, and read back."""
    e, path = table(spark, sf_dir, "events").select("event_id", "event_type", "props"), new_path(spark, "log")
    X.append_json(e, path, ["event_type"])
    X.append_json(e.where("event_id % 2 = 0"), path, ["event_type"])
    return spark.read.schema("event_id long, event_type string, props string").json(path)


@query("SELECT c_custkey::VARCHAR AS anchor_id, c_name AS name FROM customer ORDER BY c_custkey::VARCHAR LIMIT 25")
def limited_anchors(spark, sf_dir):
    """The first rows of a CSV table in a total order: a limit is the feature."""
    path = new_path(spark, "anchors")
    X.write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("anchor_id"), F.col("c_name").alias("name")), path, ["anchor_id", "name"], strict=True)
    return X.first_rows(X.read_csv(spark, path), ["anchor_id"], 25)
