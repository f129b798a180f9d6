"""Packing against the whole table at once, projections, rings, files and polygons."""

from __future__ import annotations

import math
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from onset.operators import spatial as G
from onset.sources import files

SCHEMA = "source_idx long, anchor_id string, source_grid string, grid_id string, x double, y double, area_m2 double, width_m double, height_m double, x0 double, y0 double, x1 double, y1 double"


def greedy(points, chip, most):
    """All targets in one list, in the order of seeds."""
    order = sorted(points, key=lambda p: (math.floor(p[5] / chip), math.floor(p[4] / chip), p[2], p[0]))
    taken, groups = set(), []
    for seed in order:
        if seed[0] in taken:
            continue
        box, members = list(seed[9:13]), [seed]
        near = [p for p in points if p[0] not in taken and p[0] != seed[0] and abs(p[4] - seed[4]) <= chip / 2 and abs(p[5] - seed[5]) <= chip / 2]
        for p in sorted(near, key=lambda p: ((p[4] - seed[4]) ** 2 + (p[5] - seed[5]) ** 2, p[2], p[0])):
            if len(members) == most:
                break
            new = [min(box[0], p[9]), min(box[1], p[10]), max(box[2], p[11]), max(box[3], p[12])]
            if new[2] - new[0] <= chip and new[3] - new[1] <= chip:
                members.append(p)
                box = new
        taken |= {p[0] for p in members}
        groups.append((sorted(p[0] for p in members), tuple(box)))
    return groups


@pytest.mark.parametrize(("n", "side", "chip", "most"), [(400, 30.0, 4.0, 3), (300, 200.0, 4.0, 5), (200, 6.0, 4.0, 2), (60, 5.0, 1.0, 4), (1, 1.0, 4.0, 1)])
def test_packing_is_that_of_the_whole_table(spark, n, side, chip, most):
    rng = random.Random(n)
    points = []
    for i in range(n):
        x, y, w, h = rng.uniform(-side, side), rng.uniform(-side, side), rng.uniform(0.1, chip / 2), rng.uniform(0.1, chip / 2)
        if i % 40 == 39:
            x, y = points[-1][4:6]  # ties
        points.append((i, f"t{i}", f"G{i % 3}", f"G{i % 3}", x, y, w * h, w, h, x - w / 2, y - h / 2, x + w / 2, y + h / 2))
    packed = G.pack_chips(spark.createDataFrame(points, SCHEMA), chip, most, tag="In Tag")
    rows = packed.collect()
    got = {}
    for r in rows:
        got.setdefault(r["chip_id"], []).append(r)
    want = greedy(points, chip, most)
    assert [(sorted(r["source_idx"] for r in got[k]), tuple(got[k][0][c] for c in ("gx0", "gy0", "gx1", "gy1"))) for k in sorted(got)] == want
    assert sorted(got) == [f"in_tag_c{i:07d}" for i in range(1, len(want) + 1)]
    targets = {r["anchor_id"]: r for r in G.target_rows(packed).collect()}
    first = sorted(r["source_idx"] for r in rows if r["chip_id"] == "in_tag_c0000001")
    assert [targets[f"t{i}"]["target_label"] for i in first] == [f"T{k:02d}" for k in range(1, len(first) + 1)]
    group = G.group_rows(packed, chip).where("chip_id = 'in_tag_c0000001'").first()
    assert group["n_targets"] == len(first) and group["source_feature_id"] == ";".join(map(str, first[:20]))


def test_packing_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for args in ((0, 1), (1, 0), (1, 3, 2)):
        with pytest.raises(ValueError):
            G.pack_chips(empty, *args)
    assert G.pack_chips(empty, 1.0, 2).count() == 0


def forward(lon, lat, zone=35):
    """Transverse Mercator by the series forth, at the poles' side in the south."""
    a, f = G.A_AXIS, G.FLATTENING
    n = f / (2 - f)
    radius, _, _ = G._series()
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    y = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return 500000 + 0.9996 * radius * x, 10000000 + 0.9996 * radius * y


def test_the_projection_comes_back(spark):
    places = [(27 + dx, lat) for dx in (-3.0, -1.25, 0.0, 0.5, 2.9) for lat in (-34.5, -26.2, -10.0, -0.5)]
    df = spark.createDataFrame([(*forward(*p), *p) for p in places], "x double, y double, lon double, lat double")
    lon, lat = G.utm_inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r["lon"] - r["a"]) < 1e-9 and abs(r["lat"] - r["b"]) < 1e-9
    box = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 100).alias("x1"), (F.col("y") + 100).alias("y1"))
    four, two = (df.select(G.box_to_degrees(box, corners=n).alias("b")).select("b.*").collect() for n in (4, 2))
    assert all(a["x0"] <= b["x0"] and a["x1"] >= b["x1"] and a["y0"] <= b["y0"] for a, b in zip(four, two, strict=True)) and four != two


def test_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    bow, line, far = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)], [(x + 7e6, y + 5e5) for x, y in square]
    rows = [(1, square), (2, square[:-1]), (3, bow), (4, line), (5, None), (6, []), (7, far)]
    df = spark.createDataFrame(rows, "k int, r array<struct<x: double, y: double>>")
    r = F.col("r")
    assert {x["k"] for x in df.where(G.ring_valid(r)).select("k").collect()} == {1, 7}
    got = {x["k"]: x for x in df.where("k in (1, 7)").select("k", G.ring_area(r).alias("a"), G.ring_centroid(r).alias("c")).collect()}
    assert got[1]["a"] == got[7]["a"] == 4.0 and tuple(got[1]["c"]) == (1.0, 1.0) and tuple(got[7]["c"]) == (7000001.0, 500001.0)


def _blob(rings, multi=False, envelope=1):
    part = lambda rs: struct.pack("<BII", 1, 3, len(rs)) + b"".join(struct.pack("<I", len(x)) + b"".join(struct.pack("<2d", *p) for p in x) for x in rs)
    body = struct.pack("<BII", 1, 6, len(rings)) + b"".join(part([x]) for x in rings) if multi else part(rings)
    return b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", 32735) + (struct.pack("<4d", 0, 0, 0, 0) if envelope else b"") + body


def test_polygons_of_a_geopackage(spark, tmp_path):
    square, small = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom')")
        db.execute("CREATE TABLE sites (fid INTEGER PRIMARY KEY, geom BLOB, confidence REAL, source_grid TEXT)")
        db.executemany("INSERT INTO sites VALUES (?, ?, ?, ?)", [(1, _blob([square, small]), 0.9, "G1"), (2, None, 0.1, None), (3, _blob([small, square], multi=True, envelope=0), None, "G2"), (5, _blob([small]), 0.4, "")])
    rows = files.read_geopackage(spark, str(tmp_path / "a.gpkg"), "sites", ["confidence", "source_grid"], rows=2).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == [0, 1, 2, 4] and [None if r["ring"] is None else len(r["ring"]) for r in rows] == [5, None, 5, 4]
    assert [r["confidence"] for r in rows] == ["0.9", "0.1", None, "0.4"] and tuple(rows[3]["ring"][1]) == (6.0, 5.0)


def test_images_and_folders(spark, tmp_path):
    jpeg = lambda mark, pad=0: b"\xff\xd8\xff" + b"x" * pad + mark
    put = {"a1/2019/one.jpg": jpeg(b"*AD*2019:06:15*"), "a1/2019/two.jpg": jpeg(b"none"), "a1/2020/far.jpg": jpeg(b"*AD*2020:01:01*", 3000), "a1/2020/empty.jpg": b"", "a1/notes/x.jpg": jpeg(b"*AD*2001:01:01*"), "a2/2019/png.jpg": b"\x89PNG*AD*2019:01:01*"}
    for name, data in put.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.list_images(spark, f"file://{tmp_path}")
    assert {r["path"].split("/", len(str(tmp_path).split("/")))[-1]: r["capture_date"] for r in found.collect()} == {"a1/2019/one.jpg": "2019-06-15", "a1/2019/two.jpg": None, "a1/2020/far.jpg": "2020-01-01", "a1/notes/x.jpg": "2001-01-01", "a2/2019/png.jpg": None}
    assert files.list_images(spark, f"file://{tmp_path}", window=2048).where("path like '%far.jpg'").first()["capture_date"] is None
    years = files.years_of(found, str(tmp_path)).groupBy("anchor_id", "requested_year").count().collect()
    assert {tuple(r) for r in years} == {("a1", 2019, 2), ("a1", 2020, 1), ("a2", 2019, 1)}


def test_tables_at_the_edges(spark, tmp_path):
    df = spark.createDataFrame([("b", None, True, ["x", "y"]), ("a", "1, \"2\"\n3", None, None)], "k string, t string, f boolean, l array<string>")
    path = f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match=r"extra columns \['f', 'l'\], missing columns \['z'\]"):
        files.write_csv(df, path, ["k", "t", "z"], strict=True)
    files.write_csv(df, path, ["k", "t", "f", "l", "z"], order=["k"], single=True)
    assert [tuple(r) for r in files.read_csv(spark, path).collect()] == [("a", '1, "2"\n3', "", "", ""), ("b", "", "1", "x;y", "")]
    assert files.optional_csv(spark, f"{path}-none", ["k"]).count() == 0 and files.optional_csv(spark, path, ["k", "t", "f", "l", "z"]).count() == 2
    assert files.one_column(df, "k").count() == 2 and files.with_values(df, ["t"]).count() == 1
    with pytest.raises(ValueError, match="no column q"):
        files.one_column(df, "q")
    files.append_json(df, f"file://{tmp_path}/log", ["k"])
    files.append_json(df, f"file://{tmp_path}/log", ["k"])
    assert spark.read.json(f"file://{tmp_path}/log").where("k = 'a'").count() == 2
    catalog = spark.createDataFrame([("r", "g1"), ("r", "g2"), ("s", "g3")], "region_key string, grid_id string")
    some, lacking = files.entries(catalog, "r", ["g1", "g3"])
    assert some.count() == 1 and lacking == ["g3"] and files.entries(catalog, "r")[0].count() == 2
