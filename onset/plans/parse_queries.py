"""Queries of the response parsers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from onset.functions import parse as P
from onset.operators import review as R
from onset.plans.registry import query
from onset.sources.files import content_token
from onset.sources.tables import table

#: A number to base 4, as SQL and as a column: digits from the highest on.
_BASE4 = "coalesce(nullif(ltrim(" + " || ".join(f"((l_suppkey // {4**i}) % 4)::VARCHAR" for i in range(9, -1, -1)) + ", '0'), ''), '0')"


def _base4(n):
    return F.conv(n.cast("string"), 10, 4)


@query(f"""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS level, l_suppkey, l_returnflag AS f, l_partkey, CAST(l_shipdate AS DATE) AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_partkey % 5 = 0 AS odd, {_BASE4} AS path FROM lineitem),
h AS (SELECT *, max(CASE WHEN NOT odd THEN i END) OVER (PARTITION BY doc ORDER BY i) AS hi FROM l)
SELECT a.doc, b.level, b.path, a.d AS capture_date, CAST(a.l_partkey AS INTEGER) AS version FROM h a JOIN l b ON a.doc = b.doc AND a.hi = b.i WHERE a.f <> 'R'""")
def parse_info_text(spark, sf_dir):
    """Line items printed as a provider's text, then read back. A header whose path is
    not to base 4 is none: the one before it holds on."""
    odd = F.col("l_partkey") % 5 == 0
    head = F.when(odd, F.format_string("Level=%d, Path=p%d", "l_linenumber", "l_suppkey")).otherwise(F.format_string("Level = %d, Path = %s", "l_linenumber", _base4(F.col("l_suppkey"))))
    line = F.concat(head, F.lit("\n"), F.when(F.col("l_returnflag") != "R", F.format_string(" date=%s, version=%d", F.date_format("l_shipdate", "yyyy/MM/dd"), "l_partkey")).otherwise(" none"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line")).alias("x"))
    texts = rows.groupBy("doc").agg(F.concat(F.lit(" date=2000/01/01, version=1\r\n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("text"))
    return R.header_lines(texts, "doc", "text")


@query("""SELECT l_orderkey AS doc, string_agg(DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS dates FROM lineitem GROUP BY 1""")
def parse_availability_text(spark, sf_dir):
    day = F.date_format("l_shipdate", "yyyy/MM/dd")
    line = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("[%d] %s", "l_linenumber", day)).otherwise(F.concat(F.lit("Tile availability on  "), day, F.lit(" 1999/9/9")))
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return texts.select("doc", F.array_join(R.available_dates(F.col("text")), ",").alias("dates"))


@query("""WITH g AS (SELECT l_orderkey AS doc, min(CAST(l_shipdate AS DATE)) AS own, string_agg(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ';') FILTER (WHERE l_returnflag = 'A') AS listed FROM lineitem GROUP BY 1)
SELECT doc, unnest(CASE WHEN listed IS NULL THEN [CAST(own AS VARCHAR)] ELSE string_split(listed, ';') END) AS capture_date FROM g""")
def expand_candidate_dates(spark, sf_dir):
    day = F.col("l_shipdate").cast("date").cast("string")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.min(day).alias("capture_date"), F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "A", day)), ";").alias("all_dates"))
    return R.expand_dates(rows, "all_dates", "capture_date").select("doc", "capture_date")


def _cells(spark, sf_dir):
    """Matrices of two dates and two targets: what an order's lines say of them."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_discount", "l_linestatus")).alias("x"))
    n = F.col("n").cast("int")
    return rows.select("doc", "n", F.expr("(n - 1) div 2 + 1").cast("int").alias("date_index"), F.when(n % 2 == 1, "T01").otherwise("T02").alias("target_label"), "x.*")


_CELL_SQL = """x AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf, l_tax AS tax, l_discount AS dis, l_linestatus AS ls, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_tax, l_discount, l_linestatus) AS rn FROM lineitem WHERE l_linenumber <= 4),
c AS (SELECT doc, n, CAST((n - 1) // 2 + 1 AS INTEGER) AS date_index, CASE WHEN n % 2 = 1 THEN 'T01' ELSE 'T02' END AS target_label, pk, sk, CASE WHEN rf = 'R' THEN NULL ELSE ls = 'O' END AS p, dis AS confidence, pk % 13 = 0 AS bad, pk % 17 = 0 AS extra FROM x WHERE rn = 1)"""


def _cell_line():
    present = F.when(F.col("l_partkey") % 13 == 0, '"yes"').when(F.col("l_returnflag") == "R", "null").when(F.col("l_linestatus") == "O", "true").otherwise("false")
    extra = F.when(F.col("l_partkey") % 17 == 0, ', "capture_date": "1990-01-01"').otherwise("")
    return F.format_string('{"date_index": %d, "target_label": "%s", "pv_present": %s, "confidence": %s, "quality_flag": "usable"%s}', "date_index", "target_label", present, F.col("l_discount").cast("string"), extra)


def _grid():
    targets = F.array(*(F.struct(F.lit(f"id{i}").alias("target_id"), F.lit(f"T0{i}").alias("target_label")) for i in (1, 2)))
    return R.expected_cells(F.array(F.lit("2020-06-15"), F.lit("2021-06-15")), targets)


def _matrices(spark, sf_dir, shape):
    lines = _cells(spark, sf_dir).select("doc", F.struct("n", _cell_line().alias("line")).alias("o"))
    return lines.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list("o")), lambda x: x["line"]).alias("l")).select("doc", shape(F.col("l")).alias("text"), _grid().alias("cells"))


_GRID_SQL = "(SELECT unnest([1, 1, 2, 2]) AS date_index, unnest(['T01', 'T02', 'T01', 'T02']) AS target_label, unnest([1, 2, 3, 4])::INTEGER AS cell_index, unnest(['2020-06-15', '2020-06-15', '2021-06-15', '2021-06-15']) AS capture_date) g"
_CELL_OUT = """k.doc, cell_index, g.date_index::INTEGER AS date_index, g.target_label, g.capture_date, f.p AS pv_present, f.confidence, CASE WHEN f.doc IS NULL THEN 'unusable' ELSE 'usable' END AS quality_flag, CASE WHEN f.doc IS NULL THEN 'gemini_failed' ELSE 'gemini_matrix' END AS decision_source"""


def _cell_out(rows):
    return R.matrix_rows(rows, ["doc"]).select("doc", "cell_index", "date_index", "target_label", "capture_date", "pv_present", "confidence", "quality_flag", "decision_source")


@query(f"""WITH {_CELL_SQL}, f AS (SELECT * FROM c WHERE NOT bad) SELECT {_CELL_OUT} FROM (SELECT DISTINCT doc FROM c) k CROSS JOIN {_GRID_SQL} LEFT JOIN f ON f.doc = k.doc AND f.date_index = g.date_index AND f.target_label = g.target_label""")
def matrix_lenient(spark, sf_dir):
    docs = _matrices(spark, sf_dir, lambda lines: F.concat(F.lit('```\n{"date_index": 3, "target_label": "T01"}\nnoise\n'), F.array_join(lines, "\n"), F.lit("\n```")))
    return _cell_out(R.matrix_lenient(docs, "doc", "text", "cells"))


@query(f"""WITH {_CELL_SQL}, o AS (SELECT doc FROM c GROUP BY 1 HAVING count(*) = 4 AND NOT bool_or(bad) AND NOT bool_or(extra)), f AS (SELECT * FROM c SEMI JOIN o USING (doc))
SELECT {_CELL_OUT} FROM (SELECT DISTINCT doc FROM c) k CROSS JOIN {_GRID_SQL} LEFT JOIN f ON f.doc = k.doc AND f.date_index = g.date_index AND f.target_label = g.target_label""")
def matrix_strict(spark, sf_dir):
    docs = _matrices(spark, sf_dir, lambda lines: F.concat(F.lit('```json\n{"observations": ['), F.array_join(F.reverse(lines), ", "), F.lit("]}\n```")))
    return _cell_out(R.matrix_strict(docs, "doc", "text", "cells"))


_SEQ_SQL = """x AS (SELECT l_orderkey AS doc, l_linenumber AS n, min({'pk': l_partkey, 'sk': l_suppkey, 'rf': l_returnflag, 'tax': l_tax, 'dis': l_discount, 'ls': l_linestatus}) AS x FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
s AS (SELECT doc, n, CASE WHEN x.rf = 'R' THEN NULL ELSE x.ls = 'O' END AS p, x.dis * 10 AS sc, x.pk % 13 = 0 AS bad, x.pk % 17 = 0 AS extra FROM x),
k AS (SELECT doc, count(*) = 4 AND NOT bool_or(bad OR extra OR sc > 0.85) AND doc % 9 <> 0 AS ok, string_agg(CASE WHEN p THEN '1' WHEN NOT p THEN '0' ELSE '?' END, '-' ORDER BY n) AS pat, min(n) FILTER (WHERE p) AS fp FROM s GROUP BY 1)"""


@query(f"""WITH {_SEQ_SQL} SELECT doc, ok, CASE WHEN ok THEN pat ELSE '?-?-?-?' END AS sequence_pattern, CASE WHEN ok AND fp IS NOT NULL THEN (2019 + fp) || '-06-15' END AS first_present_date,
CASE WHEN NOT ok THEN 'sequence_failed' WHEN contains(replace(replace(pat, '?', ''), '-', ''), '10') THEN 'non_monotonic_requires_review' WHEN contains(pat, '?') THEN 'monotonic_with_unknown' ELSE 'monotonic' END AS consistency_flag,
CASE WHEN ok THEN 'usable' ELSE 'sequence_failed' END AS quality_flag, CASE WHEN ok THEN 'gemini_sequence' ELSE 'gemini_failed' END AS decision_source FROM k""")
def sequence_strict(spark, sf_dir):
    """Some documents have a wrong type, a score over 1, a further key or too few items."""
    x = F.col("x")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_discount", "l_linestatus")).alias("x"))
    present = F.when(x["l_partkey"] % 13 == 0, "1").when(x["l_returnflag"] == "R", "null").when(x["l_linestatus"] == "O", "true").otherwise("false")
    score = F.when(x["l_discount"] * 10 > 0.85, "1.5").otherwise((x["l_discount"] * 10).cast("string"))
    line = F.format_string('{"date_index": %d, "pv_present": %s, "pv_score": %s, "evidence": "e"%s}', "n", present, score, F.when(x["l_partkey"] % 17 == 0, ', "version": 3').otherwise(""))
    lines = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), line.alias("line")))).alias("l"))
    top = F.when(F.col("doc") % 9 == 0, ', "capture_date": "x"').otherwise("")
    text = F.format_string('{"confidence": 0.5, "quality_flag": "usable", "observations": [%s]%s}', F.array_join(F.transform("l", lambda o: o["line"]), ","), top)
    docs = lines.select("doc", text.alias("text"), F.array(*(F.lit(f"{y}-06-15") for y in range(2020, 2024))).alias("dates"))
    return R.sequence_strict(docs, "doc", "text", "dates").select("doc", "ok", "sequence_pattern", "first_present_date", "consistency_flag", "quality_flag", "decision_source")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE event_type END AS kind FROM events""")
def extract_json_object(spark, sf_dir):
    """Bare, fenced, broken and enclosed objects."""
    e = table(spark, sf_dir, "events")
    body = F.format_string('{"kind": "%s", "n": {"a": 1}}', "event_type")
    m = F.col("event_id") % 4
    text = F.when(m == 0, body).when(m == 1, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` "))).when(m == 2, F.concat(F.lit("said {"), body)).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" - done")))
    return e.select("event_id", F.try_variant_get(R.json_object(text), "$.kind", "string").alias("kind"))


@query("""WITH w AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS chip_index, CAST(l_shipdate AS DATE) AS capture_date FROM lineitem), m AS (SELECT doc, max({'d': capture_date, 'i': -chip_index}) AS x FROM w WHERE capture_date >= DATE '1997-12-31' GROUP BY 1) SELECT doc, -x.i AS chip_index, x.d AS capture_date FROM m""")
def census_reference(spark, sf_dir):
    picks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("chip_index"), F.col("l_shipdate").cast("date").alias("capture_date"), F.lit("1998-06-31").alias("census"))
    return R.census_reference(picks, "doc", "census")


@query("""WITH s AS (SELECT l_orderkey AS doc, string_agg(DISTINCT l_linenumber, ',') AS x, list(DISTINCT l_linenumber) AS seen FROM lineitem GROUP BY 1) SELECT doc, array_to_string([i FOR i IN range(1, 8) IF NOT list_contains(seen, i)], ',') AS missing FROM s""")
def missing_indices(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("chip_index"))
    asked = found.select("doc").distinct().withColumn("n", F.lit(7))
    return R.missing_indices(asked, found, "doc", "n")


@query("""SELECT c_custkey AS key, CASE c_custkey % 8 WHEN 0 THEN DATE '2020-01-01' WHEN 1 THEN NULL WHEN 2 THEN DATE '2020-02-29' WHEN 3 THEN NULL WHEN 4 THEN DATE '2021-12-31' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE DATE '1999-07-04' END AS day,
CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL WHEN 5 THEN true WHEN 6 THEN false ELSE NULL END AS flag,
CASE c_custkey % 8 WHEN 0 THEN 1.5 WHEN 1 THEN NULL WHEN 2 THEN -0.25 WHEN 3 THEN 1000.0 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 7.0 ELSE NULL END::DOUBLE AS number, CASE c_custkey % 8 WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1000 WHEN 6 THEN 7 END::INTEGER AS whole,
CASE c_custkey % 8 WHEN 0 THEN '2020-01-01' WHEN 2 THEN '2020-02-29' WHEN 4 THEN '2021-12-31' WHEN 7 THEN '1999-07-04' ELSE '' END AS day_text,
CASE c_custkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN '1' WHEN 6 THEN '0' ELSE '' END AS flag_text FROM customer""")
def cell_parsers(spark, sf_dir):
    """Dates, flags and numbers as they come, with white space of all kinds."""
    pick = lambda *x: F.get(F.array(*(F.lit(v) for v in x)), (F.col("c_custkey") % 8).cast("int"))
    day = P.iso_date(pick("\n2020-1-1", "2020", "2020-02-29T10:00", "2021-02-29", "\t2021-12-31 ", "nan", "", "1999-07-04"))
    flag = P.flag(pick("\tyes\n", "Non-PV", " PV", "absent", "maybe", "T", "0", ""))
    number = P.number(pick("1.5\n", "1.5d", "-.25", "1e3", "nan", "NaT", "7.", "x"))
    whole = P.whole_number(pick("1.5\n", "1.5d", "-.25", "1e3", "nan", "NaT", "7.", "x"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), day.alias("day"), flag.alias("flag"), number.alias("number"), whole.alias("whole"), P.date_text(day).alias("day_text"), P.tri_text(flag).alias("flag_text"))


@query("""SELECT c_custkey AS key, printf('%.10f,%.10f', -c_custkey / 1000.0, c_acctbal / 100.0) AS location, printf('%.10f,%.10f', least(-c_custkey / 1000.0, c_custkey / 500.0), least(c_acctbal / 100.0, 28.0)) AS lower, printf('%.10f,%.10f', greatest(-c_custkey / 1000.0, c_custkey / 500.0), greatest(c_acctbal / 100.0, 28.0)) AS upper,
'tag_' || c_custkey AS inventory_token, 'a_b-' || c_custkey AS task_token, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE '.a_b-' || c_custkey || '.' END AS sequence_token, CASE WHEN c_custkey % 2 = 0 THEN '/mnt/d/chips/a_b' ELSE '/data/chips/a_b' END AS dir, substr(sha1('{"a":' || c_custkey || ',"b":"x"}'), 1, 10) AS content FROM customer""")
def path_tokens(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = F.col("c_acctbal") / 100.0, -k / 1000.0
    lower, upper = P.box_args(lon, lat, F.lit(28.0), k / 500.0)
    root = F.when(k % 2 == 0, "D:\\chips").otherwise("/data/chips/")
    return table(spark, sf_dir, "customer").select(
        k.alias("key"), P.location_arg(lon, lat).alias("location"), lower.alias("lower"), upper.alias("upper"), P.token(F.concat(F.lit("  _Tag!! "), k.cast("string"), F.lit("_")), charset="A-Za-z0-9", edge="_", default="inventory", lower=True).alias("inventory_token"),
        P.token(F.concat(F.lit("..a  b-"), k.cast("string"), F.lit("_."))).alias("task_token"), P.token(F.when(k % 2 == 0, " __ ").otherwise(F.concat(F.lit(" _.a  b-"), k.cast("string"), F.lit("._"))), edge="_", default="unknown").alias("sequence_token"), P.task_dir(root, F.lit("a_b")).alias("dir"), content_token(F.struct(k.alias("a"), F.lit("x").alias("b"))).alias("content"),
    )
