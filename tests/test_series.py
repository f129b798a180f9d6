"""The scenarios of the decision tables, one small series each."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from onset.functions import parse
from onset.operators import catalog as C
from onset.operators import series as S

SCHEMA = "anchor_id string, capture_date date, pv_present boolean, pv_score double"


def yearly(spark, **series):
    """Keys by name; a value is T, F or N, and may have a score."""
    rows = []
    for name, marks in series.items():
        for i, mark in enumerate(marks.split()):
            rows.append((name, date(2018 + i, 6, 15), {"T": True, "F": False, "N": None}[mark[0]], float(mark[1:]) if mark[1:] else None))
    return spark.createDataFrame(rows, SCHEMA)


def test_first_appearance_by_table(spark):
    df = yearly(spark, appears="F F T T", already="T T", mixed="F T F", back="T F T", absent="F F", unknown="N N")
    got = {r["anchor_id"]: (r["status"], r["confidence"], r["interval_start"] and r["interval_start"].year, r["interval_end"] and r["interval_end"].year) for r in S.first_appearance(df, "anchor_id", ["capture_date"]).collect()}
    assert got == {
        "appears": ("appears", "high", 2019, 2020), "already": ("already_present", "high", None, 2018), "mixed": ("ambiguous_nonmonotonic", "low", 2018, 2019),
        "back": ("ambiguous_nonmonotonic", "low", None, 2018), "absent": ("not_seen", "medium", 2019, None), "unknown": ("no_valid_observations", "low", None, None),
    }


def test_a_run_of_two_is_asked_for(spark):
    df = yearly(spark, late="F T F T T", never="F T F", edge="F T")
    got = {r["anchor_id"]: (r["status"], r["interval_end"].year) for r in S.first_appearance(df, "anchor_id", ["capture_date"], run=2).collect()}
    assert got == {"late": ("appears", 2021), "never": ("ambiguous_sporadic_positive", 2019), "edge": ("ambiguous_sporadic_positive", 2019)}


@pytest.mark.parametrize(("marks", "flipped"), [("T.95 F.0 T.98", [1]), ("F F T.95", []), ("F T F", []), ("T.9 F F T.9", [1, 2]), ("T.3 F T.3", []), ("T.9 N F.0 T.9", [2]), ("T F T", [1])])
def test_dips(spark, marks, flipped):
    rows = S.repair_dips(yearly(spark, a=marks), "anchor_id", ["capture_date"]).orderBy("capture_date").collect()
    assert [i for i, r in enumerate(rows) if r["flipped"]] == flipped
    assert all(rows[i]["pv_present"] for i in flipped)
    assert [r["pv_present"] for r in rows if not r["flipped"]] == [{"T": True, "F": False, "N": None}[m[0]] for i, m in enumerate(marks.split()) if i not in flipped]


def test_repair_then_infer(spark):
    fixed = S.repair_dips(yearly(spark, a="T F T"), "anchor_id", ["capture_date"])
    assert S.first_appearance(fixed, "anchor_id", ["capture_date"]).first()["status"] == "already_present"


CASES = [
    ("done_appears", [("2020-04-15", False), ("2020-08-15", True)], ("done_appears", "2020-06-15", "high", "")),
    ("done_appears", [("2019-01-01", False), ("2020-12-01", True)], ("done_appears", "2019-12-17", "medium", "")),
    ("done_appears", [("2014-01-01", False), ("2024-01-01", True)], ("done_appears", "2019-01-01", "low", "")),
    ("done_appears", [("2022-06-15", True), ("2024-01-15", False)], ("done_appears", None, "low", "inverted_interval")),
    ("done_appears", [("2022-06-15", True)], ("done_appears", None, "low", "inconsistent")),
    ("done_installed_during_census", [("2024-03-01", False)], ("done_installed_during_census", "2024-06-30", "high", "")),
    ("done_installed_during_census", [("2024-06-30", False)], ("done_ambiguous_marker_missed_pv", None, "low", "marker_missed_pv")),
    ("done_already_present_before_geid_history", [("2014-04-15", True), ("2009-04-15", True)], ("done_already_present_before_geid_history", None, "low", "")),
    ("scanning", [("2014-04-15", True)], ("scanning", None, "low", "scan_in_progress")),
    ("odd", [("2014-04-15", True)], ("odd", None, "low", "unknown_status=odd")),
]


@pytest.mark.parametrize(("status", "rows", "want"), CASES)
def test_scan_intervals(spark, status, rows, want):
    df = spark.createDataFrame([("a", status, date.fromisoformat(d), p) for d, p in rows], "anchor_id string, status string, capture_date date, pv_present boolean")
    r = S.scan_intervals(df, "anchor_id", F.lit("2024-06-30").cast("date")).first()
    assert (r["status"], str(r["mid_estimate"]) if r["mid_estimate"] else None, r["confidence"], r["notes"]) == want


def test_intervals_take_one_exchange(spark):
    """Repair, runs, interval: one partitioning by the key serves all."""
    df = spark.range(100).select((F.col("id") % 7).cast("string").alias("anchor_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("capture_date"), (F.col("id") % 3 == 0).alias("pv_present"), F.lit(0.9).alias("pv_score"))
    plan = S.first_appearance(S.repair_dips(df, "anchor_id", ["capture_date"]), "anchor_id", ["capture_date"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_flag_is_appended_once(spark):
    df = yearly(spark, a="F T F", b="F T").withColumn("notes", F.lit(""))
    once = S.flag_reversed(df, "anchor_id", ["capture_date"], F.lit(True))
    twice = S.flag_reversed(once, "anchor_id", ["capture_date"], F.lit(True))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {(r["anchor_id"], r["notes"]) for r in twice.collect()} == {("a", "non_monotonic"), ("b", "")}


def test_dedupe_and_priority(spark):
    rows = [("a1", "2015-08-30", 296), ("a1", "2015-08-30", 277), ("a1", "2015-11-30", 277)]
    df = spark.createDataFrame(rows, "anchor_id string, capture_date string, version int")
    got = sorted(tuple(r) for r in C.dedupe_by_date(df, ["anchor_id", "capture_date"], "version", []).collect())
    assert got == [("a1", "2015-08-30", 277, "277;296", 2), ("a1", "2015-11-30", 277, "277", 1)]
    high = spark.createDataFrame([("a", "2020", 1902)], "k string, d string, v int")
    low = spark.createDataFrame([("a", "2020", 1803), ("a", "2010", 1801)], "k string, d string, v int")
    assert sorted(tuple(r) for r in C.priority_union([high, low], ["k", "d"], ["v"]).collect()) == [("a", "2010", 1801), ("a", "2020", 1902)]


@pytest.mark.parametrize(("n", "want"), [(2, [0, 1]), (6, [0, 1, 2, 4, 5]), (7, [0, 2, 3, 4, 6]), (11, [0, 2, 5, 8, 10]), (12, [0, 3, 6, 8, 11]), (15, [0, 4, 7, 10, 14])])
def test_even_picks(spark, n, want):
    df = spark.range(n).withColumn("k", F.lit("a"))
    rows = C.even_picks(df, "k", ["id"], 5).orderBy("chip_index").collect()
    assert [r["id"] for r in rows] == want and [r["chip_index"] for r in rows] == list(range(1, len(want) + 1))


def test_missing_reference_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert C.referenced(a.where("k = 1"), b, "k").collect()[0]["v"] == "x"
    with pytest.raises(Exception, match="missing key"):
        C.referenced(a, b, "k").collect()


def test_scalars(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    lit = lambda x: F.lit(x).cast("string")
    assert [value(parse.iso_date(lit(x))) for x in ("2020-1-1", " 2020-01-02T03", "2020", "2021-02-30", "nan", "", None)] == [date(2020, 1, 1), date(2020, 1, 2), None, None, None, None, None]
    assert [value(parse.flag(lit(x))) for x in (" PV ", "absent", "1", "No", "maybe", None)] == [True, False, True, False, None, None]
    assert [value(parse.number(lit(x))) for x in ("0.73", "1.5d", "nan", "-inf", " 2e3 ", "")] == [0.73, None, None, float("-inf"), 2000.0, None]
    assert value(parse.whole_number(lit("19.9"))) == 19
    assert [value(parse.token(lit(x))) for x in ("a b!c", "..x..", "!!")] == ["a_b_c", "x", "task"]
    assert [value(parse.join_path(lit(r), lit("t"))) for r in ("/a/b/", "D:\\x\\", "\\\\h\\s")] == ["/a/b/t", "D:\\x\\t", "\\\\h\\s\\t"]
    assert value(parse.drive_to_mount(lit("D:\\x\\y"))) == "/mnt/d/x/y"
    p, s = parse.presence(lit(""), [lit("bad"), lit("0.73")])
    assert value(p) is True and value(s) == 0.73
