"""Presence rows, tasks and sequences where SQL shows too little."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from onset.functions import parse as P
from onset.operators import catalog as C
from onset.operators import presence as W
from onset.operators import review as R


def test_an_unscored_chip_has_no_presence(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", "1", "unsure")], "anchor_id string, capture_date string, pv_present string, quality_flag string")
    with pytest.raises(PySparkException, match="no presence is allowed"):
        W.observations(rows).collect()
    assert W.observations(rows, check="mark").first()["violation"]
    fine = rows.withColumn("pv_present", F.lit(""))
    assert W.observations(fine).first()["pv_present"] is None


def test_dates_and_scores_come_from_the_first_that_parses(spark):
    rows = spark.createDataFrame([("a", "bad", None, "2020-1-2", "x", "0.4", "1"), (" ", "2020-01-01", "", "", "", "", ""), ("b", "", "", "", "", "", "")], "anchor_id string, capture_date string, actual_capture_date string, requested_date string, pv_score string, score string, prob string")
    got = W.observations(rows).collect()
    assert [(r["anchor_id"], str(r["capture_date"]), r["pv_score"], r["pv_present"], r["quality_flag"]) for r in got] == [("a", "2020-01-02", 0.4, False, "ok")]


def test_tasks_find_their_anchor_or_raise(spark):
    anchors = spark.createDataFrame([("A1",), ("G2",), ("x_y",)], "anchor_id string")
    tasks = spark.createDataFrame([("A1", "G2", "t"), ("no", "G2", "t"), ("", "", "x_y_20200615"), ("", "", "x_y_20200615")], "anchor_id string, grid_id string, task_name string")
    assert sorted(r["_anchor"] for r in W.task_anchor(tasks, anchors).collect()) == ["A1", "G2", "x_y", "x_y"]
    lost = spark.createDataFrame([("", "", "x_y_2020")], "anchor_id string, grid_id string, task_name string")
    with pytest.raises(PySparkException, match="no anchor for task x_y_2020"):
        W.task_anchor(lost, anchors).collect()
    assert W.task_anchor(lost, anchors, on_missing="null").first()["_anchor"] is None


def test_the_last_decision_of_a_day_counts_and_blanks_leave_the_base(spark):
    raw = spark.createDataFrame([("a", "2020-01-01", "1", "ok", 1), ("a", "2020-01-01x", "0", "", 2), ("", "2020-01-01", "1", "", 3), ("b", "", "1", "", 4)], "anchor_id string, requested_date string, pv_present string, quality_flag string, n int")
    index = W.manual_index(raw, "n")
    assert [(r["anchor_id"], r["decision_date"], r["pv_present"]) for r in index.collect()] == [("a", "2020-01-01", "0")]
    base = spark.createDataFrame([("a", "2020-01-01", "", "", "f", "s"), ("a", "2021-01-01", "2020-01-01", "", "", "s"), ("c", None, None, "", "f", "s")], "anchor_id string, requested_date string, capture_date string, pv_present string, quality_flag string, decision_source string")
    by = index.withColumns({"requested_date": F.col("decision_date"), "capture_date": F.col("decision_date")})
    got = C.override(base, by, ["anchor_id", "requested_date"], ["anchor_id", "capture_date"], ["pv_present", "quality_flag"]).collect()
    assert sorted((r["anchor_id"], r["requested_date"] or "", r["pv_present"], r["quality_flag"], r["decision_source"]) for r in got) == [("a", "2020-01-01", "0", "f", "manual"), ("a", "2021-01-01", "0", "ok", "manual"), ("c", "", "", "f", "s")]


def test_targets_raise_without_what_they_need(spark):
    whole = {"chip_id": "c", "anchor_id": "t", "target_label": "T01", "target_index": "1.9", "region_key": "", "grid_id": "", "target_offset_x_m": "1", "target_offset_y_m": "2", "chip_size_m": "36", "search_radius_m": ""}
    got = W.targets(spark.createDataFrame([whole])).first()
    assert (got["target_index"], got["search_radius_m"]) == (1, 10.0)
    for lack in ("anchor_id", "chip_size_m"):
        with pytest.raises(PySparkException):
            W.targets(spark.createDataFrame([dict(whole, **{lack: ""})])).collect()


def test_chunks_of_six_dates_and_five_targets(spark):
    t = spark.createDataFrame([("c", f"t{i}", f"T0{i}", i, "r", "g") for i in range(1, 6)], "chip_id string, target_id string, target_label string, target_index int, region_key string, grid_id string")
    a = spark.createDataFrame([("c", f"20{10 + i}-01-01", "1", f"p{i}", 19) for i in range(6)], "chip_id string, capture_date string, version string, path string, actual_zoom int")
    jobs = W.matrix_jobs(t, a).collect()
    assert sorted((len(j["dates"]), len(j["targets"])) for j in jobs) == sorted([(5, 4), (1, 4), (5, 1), (1, 1)])


def test_sequences_are_carried_over(spark):
    images = spark.createDataFrame([("c", k, "T01", "r", "g", 1, d, f"{k}{d}", "s", 19, "ok", "") for k in "ab" for d in ("2020", "2021")], "chip_id string, anchor_id string, target_label string, region_key string, grid_id string, date_index int, capture_date string, review_png_path string, source_chip_path string, actual_zoom int, render_status string, render_notes string")
    asked = []

    def responses(ready):
        asked.append(sorted(r["anchor_id"] for r in ready.select("anchor_id").collect()))
        text = '{"confidence": 1, "quality_flag": "usable", "observations": [{"date_index": 1, "pv_present": false, "pv_score": 0, "evidence": ""}, {"date_index": 2, "pv_present": true, "pv_score": 1, "evidence": ""}]}'
        return ready.select("chip_id", "anchor_id", "target_label", F.lit(1).alias("attempt"), F.lit(text).alias("raw"))

    first = W.score_sequences(images.where("anchor_id = 'a'"), ["2020", "2021"], responses).cache()
    rows = W.score_sequences(images, ["2020", "2021"], responses, done=first)
    assert sorted((r["anchor_id"], r["sequence_pattern"], r["first_present_date"]) for r in rows.collect()) == [("a", "0-1", "2021"), ("b", "0-1", "2021")]
    assert asked == [["a"], ["b"]]
    other = W.score_sequences(images, ["2020"], responses, done=first).collect()  # another window
    assert {r["decision_source"] for r in other} == {R.FAILED_SOURCE} and asked[-1] == ["a", "b"]


def test_yearly_dates_and_small_parsers(spark):
    one = spark.range(1)
    assert [str(d) for d in one.select(P.yearly(F.lit(2019), F.lit(2021), 6, 15)).first()[0]] == ["2019-06-15", "2020-06-15", "2021-06-15"]
    with pytest.raises(PySparkException):
        one.select(P.yearly(F.lit(2019), F.lit(2020), 2, 29)).collect()
    with pytest.raises(PySparkException, match="missing width"):
        one.select(P.required(F.lit(None).cast("double"), "width")).collect()
    got = one.select(P.slash_text(P.slash_date(F.lit(" 2020/03/04\n"))), P.join_path(F.lit("C:\\a\\"), F.lit("b")), P.drive_to_mount(F.lit("D:\\x\\y")), P.fixed(F.lit(float("nan")), 2), P.whole_number(F.lit("7.9"))).first()
    assert tuple(got) == ("2020/03/04", "C:\\a\\b", "/mnt/d/x/y", "", 7)


def test_text_of_either_encoding(spark):
    rows = [(1, "é date".encode()), (2, "Tile availability on 2020/01/02".encode("utf-16-le")), (3, b""), (4, b"a\0b" + b"c" * 100)]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k int, b binary").select("k", R.decoded(F.col("b")).alias("t")).collect()}
    assert got == {1: "é date", 2: "Tile availability on 2020/01/02", 3: "", 4: "ab" + "c" * 100}


def test_json_is_read_whole_or_not_at_all(spark):
    texts = {"a": '{"x": 1}', "b": '```json\n{"x": 1}\n```', "c": '{"x": 1},', "d": '{"x": 1} {"x": 2}', "e": "said: {\"x\": 1} ok", "f": "{", "g": "", "h": None, "i": '{"x": 1, "x": 2}'}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    x = lambda c: F.try_variant_get(c, "$.x", "int")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", x(R.strict_json(F.col("t"))), x(R.json_object(F.col("t")))).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (None, 1), "d": (None, None), "e": (None, 1), "f": (None, None), "g": (None, None), "h": (None, None), "i": (None, None)}
