"""The scan's decisions, one case a rule, its loop and its documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from onset.operators import scan
from onset.operators import series as S
from onset.sources import files
from onset.sources.config import ScanConfig, check_matrix, config_from, date_list, load_config, load_env, zoom_ladder
from onset.sources.shared import new_path

DATES = [f"{y}-06-15" for y in range(2012, 2024)]


def result(date, present=True, flag="usable", source="manual", confidence=0.9):
    return {"chip_index": 1, "capture_date": date, "version": 1, "pv_present": present, "confidence": confidence, "quality_flag": flag, "decision_source": source, "evidence": "", "notes": "", "chip_path": "", "actual_zoom": 19}


def rnd(number, kind, results, start=None, end=None):
    return {"round_id": number, "round_type": kind, "window_start_date": start, "window_end_date": end, "picks": [], "results": results, "completed": True, "failed": False, "notes": ""}


def states(spark, rows):
    """Rows of rounds, catalog dates and status."""
    made = [(f"k{i}", "r", "g", status, rounds, None, "", "", "phase0_v2", "", [{"capture_date": d, "version": n} for n, d in enumerate(dates)]) for i, (rounds, dates, status) in enumerate(rows)]
    return spark.createDataFrame(made, f"{scan.STATE}, vintages array<{scan.VINTAGE}>")


def yearly(years, present):
    return [result(f"{y}-06-15", p) for y, p in zip(years, present, strict=True)]


CASES = [
    ([], DATES, "done_appears", "terminate", "done_appears", None),
    ([], DATES, "scanning", "initial", None, ["2018-06-15", "2019-06-15", "2020-06-15", "2022-06-15", "2023-06-15"]),
    ([], DATES[:4], "scanning", "initial", None, DATES[:4]),
    ([], [], "scanning", "terminate", scan.ERROR, None),
    ([rnd(1, "initial", [result("2018-06-15"), result("2019-06-15", None, "unusable", scan.FAILED)])], DATES, "scanning", "walk_back", None, None),
    ([rnd(1, "initial", [result("2018-06-15"), *(result(d, None, "unusable", scan.FAILED) for d in DATES[7:9])])], DATES, "scanning", "terminate", scan.REVIEW_FAILED, None),
    ([rnd(1, "initial", [result("2023-06-15", None, "unusable")])], DATES, "scanning", "anchor_recovery", None, ["2022-06-15"]),
    ([rnd(1, "initial", [result("2023-06-15", None, "ambiguous")]), *(rnd(n, "anchor_recovery", []) for n in (2, 3))], DATES, "scanning", "terminate", scan.NO_RECENT, None),
    ([rnd(1, "initial", yearly((2018, 2019, 2020), (True, False, True)))], DATES, "scanning", "terminate", scan.NONMONOTONIC, None),
    ([rnd(1, "initial", yearly((2012, 2016), (False, True)))], DATES, "scanning", "bisection", None, ["2013-06-15", "2014-06-15", "2015-06-15"]),
    ([rnd(1, "initial", yearly((2015, 2016), (False, True)))], DATES, "scanning", "terminate", scan.APPEARS, None),
    ([rnd(1, "initial", yearly((2012, 2016), (False, True))), rnd(2, "bisection", [])], DATES, "scanning", "terminate", scan.APPEARS, None),
    ([rnd(1, "initial", yearly((2018, 2023), (False, False)))], DATES, "scanning", "terminate", scan.DURING_CENSUS, None),
    ([rnd(1, "initial", [*yearly((2018, 2022), (False, False)), result("2023-06-15", None, "unusable")])], DATES, "scanning", "anchor_recovery", None, ["2021-06-15"]),
    ([rnd(1, "initial", yearly((2018, 2023), (True, True)), "2018-06-15")], DATES, "scanning", "walk_back", None, ["2013-06-15", "2014-06-15", "2015-06-15", "2016-06-15", "2017-06-15"]),
    ([rnd(1, "initial", yearly((2014, 2023), (True, True)), "2014-06-15")], DATES, "scanning", "tail", None, ["2012-06-15", "2013-06-15"]),
    ([rnd(1, "initial", yearly((2018, 2023), (True, True)), "2018-06-15")], ["2001-01-01", "2002-01-01", *DATES[6:]], "scanning", "tail", None, ["2001-01-01", "2002-01-01"]),
    ([rnd(1, "initial", yearly((2012, 2023), (True, True)), "2012-06-15")], DATES, "scanning", "terminate", scan.ALREADY_PRESENT, None),
    ([rnd(1, "initial", yearly((2018, 2023), (True, True)), None)], DATES, "scanning", "terminate", scan.ALREADY_PRESENT, None),
    ([rnd(1, "initial", yearly((2018, 2023), (True, True)), "2018-06-15"), rnd(2, "tail", yearly((2012,), (True,)), "2012-06-15")], [*DATES, "2000-01-01"], "scanning", "terminate", scan.ALREADY_PRESENT, None),
]


def test_each_rule_of_the_decision(spark):
    # the fifth case: 50 % failures are not over the limit, so the rest counts
    rows = {r["anchor_id"]: r for r in scan.decide(states(spark, [c[:3] for c in CASES])).collect()}
    for i, (rounds, _, status, what, ends, picks) in enumerate(CASES):
        r = rows[f"k{i}"]
        if what == "terminate":
            assert (r["action"], r["next_status"], r["next_round"]) == ("terminate", ends, None), i
            continue
        if i == 4:
            assert r["next_status"] == scan.ALREADY_PRESENT  # no boundary
            continue
        new = r["next_round"]
        assert (r["action"], new["round_type"], new["round_id"]) == ("execute_round", what, len(rounds) + 1), i
        if picks:
            assert [p["capture_date"] for p in new["picks"]] == picks, i
        assert [p["chip_index"] for p in new["picks"]] == list(range(1, len(new["picks"]) + 1))
    windows = {i: (rows[f"k{i}"]["next_round"]["window_start_date"], rows[f"k{i}"]["next_round"]["window_end_date"]) for i in (1, 9, 14, 15)}
    assert windows == {1: ("2018-06-15", "2023-06-15"), 9: ("2012-06-15", "2016-06-15"), 14: ("2013-06-15", "2018-06-15"), 15: ("2012-06-15", "2014-06-15")}
    assert "round1_floor_degraded=true" in rows["k2"]["next_round"]["notes"] and rows["k1"]["next_round"]["notes"] == ""


@pytest.mark.parametrize(("n", "spots"), [(0, []), (1, [0]), (5, [0, 1, 2, 3, 4]), (6, [0, 1, 2, 4, 5]), (7, [0, 2, 3, 4, 6]), (11, [0, 2, 5, 8, 10]), (12, [0, 3, 6, 8, 11]), (15, [0, 4, 7, 10, 14])])
def test_even_spots(spark, n, spots):
    assert spark.range(1).select(scan.even_spots(F.lit(n), 5)).first()[0] == spots


def _known(present):
    return scan.by_column(lambda p: F.struct(
        p["chip_index"].alias("chip_index"), p["capture_date"].alias("capture_date"), p["version"].alias("version"), present(p).alias("pv_present"), F.lit(0.9).alias("confidence"), F.lit("usable").alias("quality_flag"), F.lit("manual").alias("decision_source"),
        F.lit("").alias("evidence"), F.lit("").alias("notes"), F.lit("").alias("chip_path"), p["requested_zoom"].alias("actual_zoom"),
    ))


def test_a_scan_goes_on_where_it_was_broken_off(spark):
    start = states(spark, [([], DATES, "scanning")] * 3 + [([], [], "scanning")])
    present = lambda p: p["capture_date"] >= "2014-01-01"
    whole = scan.run_scan(start, _known(present))
    folder, calls = new_path(spark, "scan"), []

    def breaks(decided):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return _known(present)(decided)

    with pytest.raises(RuntimeError):
        scan.run_scan(start, breaks, folder=folder)
    again = scan.run_scan(start, _known(present), folder=folder)
    key = lambda df: sorted((r["anchor_id"], r["status"], str(r["rounds"])) for r in df.collect())
    assert key(again) == key(whole)
    assert {r["status"] for r in whole.collect()} == {scan.APPEARS, scan.ERROR}
    assert key(scan.run_scan(start, _known(present), folder=folder)) == key(whole)  # nothing is left to do
    assert scan.exit_code(whole) == 1 and scan.exit_code(whole.where("size(vintages) > 0")) == 0


def test_scorers_that_fail_end_their_key_alone(spark):
    def score(rows):
        if rows["anchor_id"].iloc[0] == "k1":
            raise ValueError("no imagery")
        rows = rows[rows["chip_index"] != 2].copy()  # one pick gets no answer
        return rows.assign(pv_present=True, confidence=0.5, quality_flag="usable", decision_source="manual", evidence="", notes="", chip_path="c", actual_zoom=19)[["anchor_id", "chip_index", "pv_present", "confidence", "quality_flag", "decision_source", "evidence", "notes", "chip_path", "actual_zoom"]]

    done = {r["anchor_id"]: r for r in scan.run_scan(states(spark, [([], DATES, "scanning")] * 2), scan.by_table(scan.isolated(score))).collect()}
    assert done["k1"]["status"] == scan.ERROR and "ValueError: no imagery" in done["k1"]["notes"] and done["k1"]["rounds"] == []
    first = done["k0"]["rounds"][0]["results"]
    assert done["k0"]["status"] == scan.ALREADY_PRESENT
    assert [x["quality_flag"] for x in first] == ["usable", "unusable", "usable", "usable", "usable"] and first[1]["decision_source"] == scan.FAILED


def test_too_many_rounds_are_an_error(spark):
    done = scan.run_scan(states(spark, [([], DATES, "scanning")]), _known(lambda p: p["capture_date"] >= "2000-01-01"), most=1).first()
    assert done["status"] == scan.ERROR and "more than 1 rounds" in done["notes"] and len(done["rounds"]) == 2


def test_documents_come_back(spark, tmp_path):
    done = scan.run_scan(states(spark, [([], DATES, "scanning")] * 2), _known(lambda p: p["capture_date"] >= "2014-01-01"))
    path = f"file://{tmp_path}/states"
    files.save_states(done, path)
    back, faults = files.load_states(spark, path)
    key = lambda df: sorted((r["anchor_id"], r["status"], str(r["rounds"])) for r in df.collect())
    assert key(back) == key(done) and faults.count() == 0
    assert files.load_states(spark, path, terminal_only=True)[0].count() == 2


def test_faults_of_documents(spark, tmp_path):
    good = {"anchor_id": "a", "region_key": "r", "grid_id": "g", "spec_version": "phase0_v2", "rounds": [rnd(1, "initial", [result("2020-01-01")])]}
    bad = [dict(good, spec_version="x"), dict(good, rounds=[dict(rnd(1, "initial", []), picks=[{"chip_index": 1, "colour": 2}])]), dict(good, rounds=[rnd(1, "later", [])]), dict(good, status="gone")]
    for i, d in enumerate([good, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "9.json").write_text("{broken")
    path = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="cannot be read"):
        files.load_states(spark, path, whole_files=True)
    states_, faults = files.load_states(spark, path, on_fault="keep", whole_files=True)
    assert states_.count() == 1 and faults.count() == 5 and states_.first()["status"] == "scanning"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.json").write_text("\n")
    with pytest.raises(ValueError, match="no state documents"):
        files.load_states(spark, f"{path}/empty", whole_files=True)


def test_repair_derives_the_status_anew(spark):
    """A dip between sure rows; a low score is no flank; unusable rows of a dip's date
    change too; other statuses stay."""
    dip = [(d, p, c, "usable") for d, p, c in (("2018-06-15", False, 0.9), ("2019-06-15", True, 0.9), ("2020-06-15", False, 0.9), ("2021-06-15", True, 0.9))]
    series = {
        "a": ("done_ambiguous_nonmonotonic", dip), "b": ("done_ambiguous_nonmonotonic", dip[1:]), "c": ("done_ambiguous_gemini_failed", dip), "d": ("done_ambiguous_nonmonotonic", [(*x[:2], 0.3, x[3]) for x in dip]),
        "e": ("done_ambiguous_nonmonotonic", [*dip, ("2020-06-15", False, 0.9, "ambiguous")]), "f": ("done_ambiguous_nonmonotonic", [dip[1], dip[2]]), "g": ("done_ambiguous_nonmonotonic", [*dip, ("2022-06-15", False, 0.9, "usable")]),
    }
    rows = [(k, s, d, p, c, q, i, "") for k, (s, obs) in series.items() for i, (d, p, c, q) in enumerate(obs)]
    df = spark.createDataFrame(rows, "k string, status string, capture_date string, pv_present boolean, pv_score double, quality_flag string, n int, notes string")
    out = {}
    for r in S.repair_states(df, "k", ["capture_date", "n"]).orderBy("k", "n").collect():
        out.setdefault(r["k"], []).append(r)
    assert {k: v[0]["status"] for k, v in out.items()} == {"a": "done_appears", "b": scan.ALREADY_PRESENT, "c": "done_ambiguous_gemini_failed", **dict.fromkeys("dfg", "done_ambiguous_nonmonotonic"), "e": "done_appears"}
    assert [r["flipped"] for r in out["e"]] == [False, False, True, False, True] and out["e"][4]["notes"] == "repaired_isolated_dip"
    assert out["a"][0]["repaired_dates"] == "2020-06-15" and out["d"][0]["repaired_dates"] is None and out["f"][0]["repaired_dates"] is None


def test_one_key_with_many_rows(spark):
    import time

    df = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("n"), (F.col("id") % 3 > 0).alias("pv_present"), F.lit(0.9).alias("pv_score")).cache()
    df.count()
    S.repair_dips(df, "k", ["n"]).agg(F.sum(F.col("flipped").cast("int"))).first()
    began = time.perf_counter()
    assert S.repair_dips(df, "k", ["n"]).agg(F.sum(F.col("flipped").cast("int"))).first()[0] == 13332
    assert time.perf_counter() - began < 3


def test_settings(tmp_path):
    assert load_config(tmp_path / "none.yaml") == ScanConfig()
    assert config_from({"info_zoom": 18}).discovery_zooms == (18,) and config_from({"info_zoom": 18, "discovery_zoom_ladder": [20]}).discovery_zooms == (20,)
    (tmp_path / "c.yaml").write_text("adaptive_scan:\n  picks_per_round: 7\n  download_zoom_ladder: [19, 18]\n  case_e_failure_pct: 25\nother: 1\n")
    found = load_config(tmp_path / "c.yaml")
    assert (found.picks, found.download_zooms, found.failure_percent) == (7, (19, 18), 25.0)
    assert zoom_ladder("20, 19") == [20, 19] and date_list("2020-01-01, 2021-01-01,2020-01-01") == ["2020-01-01", "2021-01-01"]
    for bad in (lambda: zoom_ladder(" , "), lambda: date_list("2020-13-01"), lambda: check_matrix(6, 1), lambda: check_matrix(1, 5), lambda: check_matrix(0, 1)):
        with pytest.raises(ValueError):
            bad()
    check_matrix(5, 4)
    (tmp_path / ".env").write_text("# c\nA = 'x y'\nB=\"z\"\n\nC\n=d\n")
    assert load_env(tmp_path / ".env") == {"A": "x y", "B": "z"} and load_env(tmp_path / "no") == {}
