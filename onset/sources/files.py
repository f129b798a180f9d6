"""Tables at the edges: CSV and JSON lines, state documents, images, polygons.

Inside, a missing value is null; in CSV it is a blank. Readers take a policy for
documents that they cannot read: to fail, or to go on and return them apart.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from onset.functions.parse import strip, token
from onset.operators.review import parse_json
from onset.operators.scan import PICK, RESULT, ROUND_KINDS, SCANNING, STATE, STATE_COLUMNS, TERMINAL
from onset.sources.config import ScanConfig

NEVER = "\x00"


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all text, blanks kept as such."""
    reader = spark.read.option("header", True).option("nullValue", NEVER).option("emptyValue", "").option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", False)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def first_rows(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first rows in a total order; all without a limit."""
    return df if n is None else df.orderBy(*order).limit(n)


def with_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are not blank."""
    return df.where(" and ".join(f"coalesce(trim(`{c}`), '') <> ''" for c in columns))


def one_column(df: DataFrame, column: str) -> DataFrame:
    """A manifest's column without blanks; raises where there is none of that name."""
    if column not in df.columns:
        raise ValueError(f"no column {column}; there are {', '.join(df.columns)}")
    return df.select(F.btrim(column).alias(column)).where(F.col(column) != "")


def conform(df: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """Columns by name and order. Further ones go and lacking ones are blank; a strict
    call raises for either."""
    extra, lacking = sorted(set(df.columns) - set(fields)), sorted(set(fields) - set(df.columns))
    if strict and (extra or lacking):
        raise ValueError(f"extra columns {extra}, missing columns {lacking}")
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        value = F.when(F.col(f"`{c}`"), "1").when(~F.col(f"`{c}`"), "0") if kinds[c] == "boolean" else F.array_join(F.col(f"`{c}`").cast("array<string>"), ";") if kinds[c].startswith("array") else F.col(f"`{c}`").cast("string")
        return F.coalesce(value, F.lit(""))

    return df.select(*(text(c).alias(c) for c in fields))


def write_csv(df: DataFrame, path: str, fields: list[str], strict: bool = False, order: list[str] | None = None, single: bool = False) -> None:
    """Replace ``path`` with CSV files of these fields, with a header. ``single``: one
    file, for tables that are read by hand."""
    rows = conform(df, fields, strict)
    if order:
        rows = rows.orderBy(*order)
    if single:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append JSON lines, nulls included, in a folder for each value of ``by``."""
    writer = df.write.mode("append").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table; an empty one where there is no file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return read_csv(spark, path, columns)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


# --- state documents ---


def _names(kind: str) -> list[str]:
    return re.findall(r"(\w+):", kind)


def save_states(states: DataFrame, path: str) -> None:
    """State documents as JSON lines, stamped; a commit replaces what was there."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    states.withColumn("updated_at", now).select(*STATE_COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parse_states(texts: DataFrame, spec: str = ScanConfig.spec_version) -> DataFrame:
    """``state`` (null where it cannot be read) and ``fault`` of documents in column
    ``value``: they must be JSON, of this version, with known keys in their picks and
    results, known kinds of rounds and a known status."""
    loose = "anchor_id string, spec_version string, status string, rounds array<struct<round_type:string,picks:array<map<string,string>>,results:array<map<string,string>>>>"
    doc = parse_json(F.col("value"))
    rows = texts.withColumn("_l", F.from_json("value", loose)).withColumn("_s", F.from_json("value", STATE))
    known = lambda field, kind: F.exists("_l.rounds", lambda r: F.exists(F.coalesce(r[field], F.array()), lambda m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, _names(kind))))) > 0))
    status = F.coalesce("_s.status", F.lit(SCANNING))
    fault = (
        F.when(doc.isNull(), "not JSON").when(F.coalesce("_l.spec_version", F.lit("")) != spec, F.concat(F.lit("spec_version "), F.coalesce("_l.spec_version", F.lit("missing"))))
        .when(F.col("_l.anchor_id").isNull(), "no anchor_id").when(known("picks", PICK), "unknown key in a pick").when(known("results", RESULT), "unknown key in a result")
        .when(F.exists("_l.rounds", lambda r: ~F.coalesce(r["round_type"].isin(ROUND_KINDS), F.lit(False))), "unknown kind of round").when(~status.isin(SCANNING, *TERMINAL), F.concat(F.lit("unknown status "), status))
    )
    rows = rows.withColumn("fault", fault)
    filled = F.col("_s")
    for name, other in (("status", F.lit(SCANNING)), ("rounds", F.array()), ("notes", F.lit("")), ("started_at", F.lit("")), ("updated_at", F.lit(""))):
        filled = filled.withField(name, F.coalesce(F.col(f"_s.{name}"), other))
    return rows.withColumn("state", F.when(F.col("fault").isNull(), filled)).drop("_l", "_s")


def load_states(spark: SparkSession, path: str, on_fault: str = "raise", terminal_only: bool = False, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """States and the documents that cannot be read (``file``, ``fault``). By default
    these raise, and so does a folder without documents: rows never drop in silence.
    ``whole_files``: a document a file, else a document a line."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file")).where(strip(F.col("value")) != "")
    read = parse_states(texts)
    faults = read.where("fault is not null").select("file", "fault")
    if on_fault == "raise":
        bad = faults.orderBy("file").limit(20).collect()
        if bad:
            raise ValueError("state documents that cannot be read: " + "; ".join(f"{r['file']}: {r['fault']}" for r in bad))
    states = read.where("fault is null").select("state.*", F.col("file").alias("scan_state_path"))
    if terminal_only:
        states = states.where(F.col("status").isin(TERMINAL))
    if states.isEmpty():
        raise ValueError(f"no state documents in {path}")
    return states, faults


# --- images ---

DATE_MARK = r"\*AD\*(\d{4}):(\d{2}):(\d{2})\*"


def capture_date(content: Column, window: int = 4096) -> Column:
    """The date in the first bytes of a JPEG as ISO text; null without one."""
    head = F.substring(content, 1, window)
    text = F.decode(head, "ISO-8859-1")
    date = F.concat_ws("-", *(F.regexp_extract(text, DATE_MARK, i) for i in (1, 2, 3)))
    return F.when(F.hex(F.substring(content, 1, 3)) == "FFD8FF", F.when(text.rlike(DATE_MARK), date))


def list_images(spark: SparkSession, root: str, least_bytes: int = 1, window: int = 4096) -> DataFrame:
    """``chip_dir`` (two folders may hold each other), ``path``, ``length``,
    ``capture_date`` of the JPEG files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.where(F.col("length") >= least_bytes).select(F.regexp_replace(path, "/[^/]*$", "").alias("chip_dir"), path.alias("path"), "length", capture_date(F.col("content"), window).alias("capture_date"))


def years_of(files: DataFrame, root: str) -> DataFrame:
    """Files below ``root/<anchor>/<year>/`` with both; folders that are no year drop."""
    rest = F.substring("path", len(root.rstrip("/")) + 2, 100_000)
    parts = F.split(rest, "/")
    return files.withColumns({"anchor_id": F.get(parts, F.lit(0)), "requested_year": F.when(F.get(parts, F.lit(1)).rlike(r"^\d+$"), F.get(parts, F.lit(1)).try_cast("int"))}).where("requested_year is not null")


# --- polygons of a GeoPackage ---


def _ring(data: bytes, at: int, order: str) -> tuple[list[tuple[float, float]], int]:
    (n,) = struct.unpack_from(f"{order}I", data, at)
    flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
    return list(zip(flat[::2], flat[1::2], strict=True)), at + 4 + 16 * n


def read_polygons(blob: bytes | None) -> list[list[tuple[float, float]]]:
    """Outer rings of a GeoPackage geometry; none of other types or of an empty one."""
    if not blob or blob[:2] != b"GP":
        return []
    envelope = [0, 32, 48, 48, 64][(blob[3] >> 1) & 7]
    at, rings = 8 + envelope, []

    def polygon(at: int) -> int:
        order = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", blob, at + 1)
        if kind % 1000 == 6:
            at += 9
            for _ in range(n):
                at = polygon(at)
            return at
        if kind != 3:
            raise ValueError(f"geometry type {kind}")
        at += 9
        for i in range(n):
            ring, at = _ring(blob, at, order)
            if i == 0 and ring:
                rings.append(ring)
        return at

    if at < len(blob):
        polygon(at)
    return rings


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, [f.name for f in schema][2:]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("rows", 50_000))
        with self._open() as db:
            last = db.execute(f'SELECT coalesce(max(rowid), 0) FROM "{self.options["layer"]}"').fetchone()[0]
        return [_Rows(at, min(at + size, last + 1)) for at in range(0, last + 1, size)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with self._open() as db:
            (column,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [self.options["layer"]]).fetchone()
            more = "".join(f', CAST("{n}" AS TEXT)' for n in self.names)
            for number, blob, *values in db.execute(f'SELECT rowid, "{column}"{more} FROM "{self.options["layer"]}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', [partition.first, partition.last]):
                rings = read_polygons(blob)
                largest = max(rings, key=len) if rings else None
                yield number - 1, None if largest is None else [{"x": x, "y": y} for x, y in largest], *values


class GeoPackage(DataSource):
    """Polygons of a layer: ``ordinal`` (from 0, by the source's own row number, so
    filters don't change it), ``ring`` (of the part with most points) and the columns
    of option ``columns`` as text. Partitions are ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> str:
        names = [c for c in self.options.get("columns", "").split(",") if c]
        return "ordinal long, ring array<struct<x: double, y: double>>" + "".join(f", `{c}` string" for c in names)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: list[str] | None = None, rows: int = 50_000) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    return spark.read.format("polygons").options(path=path, layer=layer, columns=",".join(columns or []), rows=rows).load()


def entries(catalog: DataFrame, region: str, grids: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A region's entries, of some grids if given, and the grids that it lacks."""
    found = catalog.where(F.col("region_key") == region)
    if grids is None:
        return found, []
    some = found.where(F.col("grid_id").isin(grids))
    there = {r[0] for r in some.select("grid_id").distinct().collect()}  # no more than were asked for
    return some, sorted(set(grids) - there)


# --- paths that are made from what they hold ---


def content_token(fields: Column, digits: int = 10) -> Column:
    """The first digits of the SHA-1 of a struct's JSON, nulls included. The struct's
    fields are in the order of their names."""
    return F.substring(F.sha1(F.to_json(fields, {"ignoreNullFields": "false"})), 1, digits)


def markers_token(markers: Column, chip_m: Column, digits: int = 10) -> Column:
    """The token of a chip's markers: an array of structs with ``target_id``,
    ``target_label``, ``offset_x_m``, ``offset_y_m`` and ``search_radius_m``."""
    near = lambda x: F.round(x, 6)
    each = F.transform(markers, lambda m: F.struct(near(m["offset_x_m"]).alias("offset_x_m"), near(m["offset_y_m"]).alias("offset_y_m"), near(m["search_radius_m"]).alias("search_radius_m"), m["target_id"].alias("target_id"), m["target_label"].alias("target_label")))
    return content_token(F.struct(near(chip_m).alias("chip_size_m"), each.alias("targets")), digits)


def artifact_path(root: Column, anchor: Column, zoom: Column, date: Column, version: Column) -> Column:
    """Where an image is kept, by what it shows."""
    name = token(anchor)
    day = F.replace(F.substring(date.cast("string"), 1, 10), F.lit("-"), F.lit(""))
    return F.concat(root, F.lit("/"), name, F.lit("/z"), zoom.cast("string"), F.lit("/"), name, F.lit("_"), day, F.lit("_v"), F.coalesce(F.nullif(F.btrim(version.cast("string")), F.lit("")), F.lit("noversion")), F.lit(".tif"))


def state_path(root: Column, anchor: Column) -> Column:
    return F.concat(root, F.lit("/"), anchor, F.lit(".json"))
