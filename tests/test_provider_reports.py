"""The provider by a runner, tasks, reports and the entry points."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from onset.__main__ import main
from onset.operators import reports, scan, tasks
from onset.operators import series as S
from onset.sources import files, provider

ANCHORS = "anchor_id string, region_key string, grid_id string, centroid_lon double, centroid_lat double, chip_lon_min double, chip_lat_min double, chip_lon_max double, chip_lat_max double"
INFO = "date=2000/01/01, version=1\nLevel = 19, Path = 0123\n date=2020/01/02, version=7\n date=2020/01/02, version=5\nLevel=18, Path=p3\n date=2021/03/04, version=9\n"


def anchors(spark, names=("a", "b")):
    return spark.createDataFrame([(n, "r", "g", 28.5, -26.25, 28.6, -26.3, 28.4, -26.2) for n in names], ANCHORS)


def test_versions_come_from_the_runner(spark):
    def runner(command):
        if command[2].startswith("-99"):
            raise TimeoutError("slow")
        assert command[:3] == ["info", "--location", "-26.2500000000,28.5000000000"] and command[3:] == ["--zoom", "19", "--provider", "TM"]
        return 0, INFO.encode(), b""

    far = anchors(spark, ("lost",)).withColumn("centroid_lat", F.lit(-99.0))
    rows = provider.fetch_vintages(anchors(spark).unionByName(far), runner).orderBy("anchor_id", "capture_date").collect()
    assert [(r["anchor_id"], str(r["capture_date"]), r["version"], r["zoom"], r["path"], r["all_versions"]) for r in rows] == [(k, d, v, 19, "0123", a) for k in "ab" for d, v, a in (("2020-01-02", 5, "5;7"), ("2021-03-04", 9, "9"))]
    with pytest.raises(PySparkException, match="provider ended with 2: no such tile"):
        provider.fetch_vintages(anchors(spark), lambda c: (2, b"", b"no such tile")).collect()


def test_availability_and_the_chooser(spark):
    text = "[1] 2020/01/02\n[2] 2019/05/06\nTile availability on 2021/01/01\n".encode("utf-16-le")
    seen = provider.fetch_availability(anchors(spark, "a"), lambda c: (134, text, b"Cannot read keys when"), 18, "2009-01-01", "2025-12-31")
    assert sorted(r["capture_date"] for r in seen.collect()) == ["2019-05-06", "2020-01-02", "2021-01-01"]
    assert "--lower-left -26.3000000000,28.4000000000 --upper-right -26.2000000000,28.6000000000 --zoom 18 --min-date 2009/01/01" in seen.first()["command"]
    info = [(19, provider.fetch_vintages(anchors(spark, "a"), lambda c: (0, INFO.encode(), b""))), (18, spark.createDataFrame([("a", "2020-01-02", "1"), ("a", "2019-05-06", "3"), ("a", "2018-01-01", "")], "anchor_id string, capture_date string, version string"))]
    both = provider.catalog_of(info).collect()
    assert sorted((r["capture_date"], r["version"], r["zoom"]) for r in both) == [("2019-05-06", 3, 18), ("2020-01-02", 5, 19), ("2021-03-04", 9, 19)]
    gated = provider.catalog_of(info, {19: seen, 18: seen}).collect()
    assert sorted((r["capture_date"], r["zoom"]) for r in gated) == [("2019-05-06", 18), ("2020-01-02", 19)]


def test_tasks(spark):
    rows = tasks.task_rows(anchors(spark, ("a b",)), ["2020-06-15", "2021-06-15"], "D:\\chips", 19, 20).orderBy("date").collect()
    assert [(r["task_name"], r["save_to"], r["left_longitude"], r["top_latitude"]) for r in rows] == [(f"a_b_{y}0615", f"D:\\chips\\r\\g\\a_b\\{y}", "28.4000000000", "-26.2000000000") for y in (2020, 2021)]
    with pytest.raises(PySparkException, match="missing chip_lon_min"):
        tasks.task_rows(anchors(spark).withColumn("chip_lon_min", F.lit(None).cast("double")), ["2020-06-15"], "/x", 1, 2).collect()
    with pytest.raises(ValueError):
        tasks.task_rows(anchors(spark), ["2020-02-30"], "/x", 1, 2)
    sample = anchors(spark, "abc").select("*", F.lit("urban").alias("suggested_stratum"), F.when(F.col("anchor_id") == "c", 1).otherwise(2).alias("candidate_rank"), F.col("anchor_id").alias("gridcell_id")).withColumn("region_key", F.lit("cape_town"))
    found = tasks.probe_tasks(sample, 2, 2019, 2020, "06-15", "D:\\p", 19, 20, short={"cape_town": "CPT"}).collect()
    assert sorted((r["task_name"], r["save_to"]) for r in found) == [(f"CPT_urb_{k}_{y}", f"D:\\p\\cape_town\\CPT_urb_{k}\\{y}") for k in "ac" for y in (2019, 2020)]
    dates = spark.createDataFrame([("r", "one", "2024-06-30"), ("r", "two", "2020-01-01")], "region_key string, layer string, census_date string")
    assert tasks.census_dates(anchors(spark, "a"), {"r": "one"}, dates).first()["census_date"] == "2024-06-30"
    assert tasks.census_dates(anchors(spark, "a"), {"q": "one"}, dates).first()["census_date"] is None
    assert tasks.census_dates(anchors(spark, "a"), {}, dates, override="1999-01-01").first()["census_date"] == "1999-01-01"


def test_reports(spark):
    start = scan.new_states(anchors(spark, ("x<1>", "y"))).withColumn("vintages", scan.dry_run_vintages(F.col("anchor_id")))
    done = scan.run_scan(start, scan.by_column(scan.dry_run_score))
    intervals = S.state_intervals(done, F.lit("2024-06-30").cast("date")).where("anchor_id = 'y'")
    rows = {r["anchor_id"]: r for r in reports.anchor_report(done, intervals).collect()}
    assert rows["y"]["summary"].startswith("interval=[") and rows["x<1>"]["summary"].endswith("(no interval row available)")
    chips = reports.chip_report(done).where("anchor_id = 'y' and round_id = 1").orderBy("position").collect()
    assert [c["capture_date"] for c in chips] == sorted(c["capture_date"] for c in chips) and {c["verdict"] for c in chips} <= {"present", "absent"}
    pages = {r["anchor_id"]: r["html"] for r in reports.html_sections(done, intervals).collect()}
    assert "x&lt;1&gt;" in pages["x<1>"] and pages["y"].count("<li") == sum(len(r["results"]) for r in rows["y"]["rounds"])
    label = spark.createDataFrame([("usable", None, "s"), ("unusable", True, "s"), ("usable", False, "s")], "q string, p boolean, s string").select(reports.verdict_label(F.col("q"), F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in label] == ["unusable (s)", "unusable (s)", "absent"]


def test_entry_points(spark, tmp_path):
    files.write_csv(anchors(spark, [f"k{i}" for i in range(8)]), f"file://{tmp_path}/anchors", ["anchor_id", "region_key", "grid_id"])
    assert main(["scan", "--anchors", f"file://{tmp_path}/anchors", "--states", f"file://{tmp_path}/states", "--limit", "6"]) == 0
    assert main(["intervals", "--states", f"file://{tmp_path}/states", "--output", f"file://{tmp_path}/intervals"]) == 0
    rows = files.read_csv(spark, f"file://{tmp_path}/intervals").collect()
    assert sorted(r["anchor_id"] for r in rows) == [f"k{i}" for i in range(6)] and all(r["status"].startswith("done_") for r in rows)
    assert main(["report", "--states", f"file://{tmp_path}/states", "--output", f"file://{tmp_path}/report"]) == 0
    assert spark.read.text(f"file://{tmp_path}/report").count() == 6
