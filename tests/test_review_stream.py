from __future__ import annotations

from datetime import date

from onset.operators import review as R
from onset.operators.series import first_appearance
from onset.streaming.intervals import latest_intervals, start_intervals


def test_lines_before_any_header_are_dropped(spark):
    text = " date=2001/01/01, version=1\r\nLevel=19, Path=0201\n date=2018/03/30, version=277\n date=2021/04/30, version=300\nLevel=20, Path=7\nnoise\n date=2024/02/29, version=9\nLevel = 20, Path = 31\n date=2024/03/01, version=9"
    rows = R.header_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert sorted(map(tuple, rows)) == [(1, 19, "0201", date(2018, 3, 30), 277), (1, 19, "0201", date(2021, 4, 30), 300), (1, 19, "0201", date(2024, 2, 29), 9), (1, 20, "31", date(2024, 3, 1), 9)]  # 7 is no digit to base 4


def line(index, present, flag="usable", confidence="0.5"):
    return f'{{"chip_index": {index}, "pv_present": {present}, "confidence": {confidence}, "quality_flag": "{flag}"}}'


def test_lenient_takes_the_last_valid_line(spark):
    text = "\n".join(["```json", line(1, "true"), line(1, "false"), line(2, "1"), line(3, '"yes"'), line(9, "true"), line(4, "null"), "{bad", line(5, "true", "odd"), '{"chip_index": 6, "confidence": 1, "quality_flag": "usable"}', "```"])
    rows = R.lenient_lines(spark.createDataFrame([(1, text, 8)], "k int, t string, n int"), "k", "t", "n").collect()
    assert sorted((r["chip_index"], r["pv_present"]) for r in rows) == [(1, False), (4, None)]


def test_strict_is_all_or_nothing(spark):
    def doc(*lines):
        return '```json\n{"observations": [' + ",".join(lines) + "]}\n```"

    extra = line(2, "null").replace("}", ', "capture_date": "x"}')
    docs = [doc(line(1, "true"), line(2, "null")), doc(line(1, "true"), extra), doc(line(1, "true")), doc(line(1, "true"), line(1, "true")), doc(line(1, "true"), line(2, "1")), "{", '{"observations": 3}', None, doc(line(1, "true"), line(3, "true"))]
    rows = R.strict_documents(spark.createDataFrame([(i, d, 2) for i, d in enumerate(docs)], "k int, t string, n int"), "k", "t", "n").collect()
    assert {r["k"] for r in rows if r["ok"]} == {0} and len(rows) == len(docs)


def test_missing_rows_are_explicit(spark):
    want = spark.createDataFrame([(1,), (2,)], "i int")
    got = R.with_missing(want, spark.createDataFrame([(1, True, "usable")], "i int, p boolean, quality_flag string"), ["i"]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, True, "usable", "review"), (2, None, "unusable", "gemini_failed")]


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    """The second batch brings an earlier capture date for a known key."""
    schema = "anchor_id string, capture_date date, pv_present boolean"
    rows = [[("a", date(2020, 1, 1), False), ("a", date(2021, 1, 1), True), ("b", date(2020, 1, 1), True)], [("a", date(2019, 1, 1), True), ("c", date(2020, 1, 1), None)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start_intervals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "anchor_id", ["capture_date"], f"{tmp_path}/out").awaitTermination()
    streamed = latest_intervals(spark.read.parquet(f"{tmp_path}/out/intervals"), "anchor_id")
    batch = first_appearance(spark.createDataFrame(rows[0] + rows[1], schema), "anchor_id", ["capture_date"])
    assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
