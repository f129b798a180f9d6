"""Catalogs of anchors from a provider's command, by an injected runner.

A runner is a function from a list of arguments to (return code, output, errors) as
bytes; it is called once an anchor, in a task. A runner that raises costs its anchor
its rows and no more; a return code that is not zero stops the job, but for the one
that a provider's chooser leaves behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.functions import parse as P
from onset.operators import catalog as C
from onset.operators import review as R

Runner = Callable[[list[str]], tuple[int, bytes, bytes]]
#: Fixed value: what a provider says that has no keyboard for its chooser.
CHOOSER = "Cannot read keys"


def info_args(zoom: int, provider: str = "TM", no_cache: bool = False) -> Column:
    """Arguments that list an anchor's versions."""
    place = P.location_arg(F.col("centroid_lon"), F.col("centroid_lat"))
    return F.array(F.lit("info"), F.lit("--location"), place, F.lit("--zoom"), F.lit(str(zoom)), F.lit("--provider"), F.lit(provider), *([F.lit("--no-cache")] if no_cache else []))


def availability_args(zoom: int, min_date: str, max_date: str, parallel: int = 4, complete: bool = True, provider: str = "TM", no_cache: bool = False) -> Column:
    """Arguments that list the dates of an anchor's box."""
    lower, upper = P.box_args(*(F.col(c) for c in ("chip_lon_min", "chip_lat_min", "chip_lon_max", "chip_lat_max")))
    fixed = ["--zoom", str(zoom), "--min-date", min_date.replace("-", "/"), "--max-date", max_date.replace("-", "/"), "--parallel", str(parallel), "--provider", provider, *(["--complete"] if complete else []), *(["--no-cache"] if no_cache else [])]
    return F.array(F.lit("availability"), F.lit("--lower-left"), lower, F.lit("--upper-right"), upper, *map(F.lit, fixed))


def run_all(anchors: DataFrame, args: Column, runner: Runner) -> DataFrame:
    """``anchors`` with ``command``, ``code``, ``output`` and ``errors`` (bytes), and
    ``fault`` where the runner raised."""
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for command in batch.column("command").to_pylist():
                try:
                    done.append((*runner(command), None))
                except Exception as fault:  # this anchor's alone
                    done.append((None, None, None, f"{type(fault).__name__}: {fault}"))
            code, output, errors, fault = zip(*done, strict=True) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(output, pa.binary()), pa.array(errors, pa.binary()), pa.array(fault, pa.string())], [*batch.schema.names, "code", "output", "errors", "fault"])

    rows = anchors.select(*names, args.alias("command"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, code int, output binary, errors binary, fault string")


def succeeded(code: Column, errors: Column, chooser: bool = False) -> Column:
    """True; raises on another return code than zero, with what was said."""
    said = R.decoded(errors)
    good = (code == 0) | said.contains(CHOOSER) if chooser else code == 0
    return F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("provider ended with "), code.cast("string"), F.lit(": "), F.left(said, F.lit(300)))).cast("boolean"))


def _outputs(anchors: DataFrame, args: Column, runner: Runner, chooser: bool) -> DataFrame:
    done = run_all(anchors.select("anchor_id", "region_key", "grid_id", args.alias("_args")), F.col("_args"), runner).where("fault is null")
    checked = done.where(succeeded(F.col("code"), F.col("errors"), chooser))
    return checked.select("anchor_id", "region_key", "grid_id", F.array_join("command", " ").alias("command"), F.sha2("output", 256).alias("sha256"), R.decoded(F.col("output")).alias("text"))


def _placed(anchors: DataFrame, args: Column) -> DataFrame:
    return anchors.select("*", args.alias("_command"))


def fetch_vintages(anchors: DataFrame, runner: Runner, zoom: int = 19, provider: str = "TM", no_cache: bool = False) -> DataFrame:
    """Versions of anchors: one row a date, the lowest version of it."""
    rows = _placed(anchors, info_args(zoom, provider, no_cache))
    said = _outputs(rows, F.col("_command"), runner, chooser=False)
    found = R.header_lines(said.withColumn("_key", F.struct("anchor_id", "region_key", "grid_id", "command", "sha256")), "_key", "text")
    flat = found.select("_key.*", F.lit(provider).alias("provider"), F.col("level").alias("zoom"), "path", "capture_date", "version")
    return C.dedupe_by_date(flat, ["anchor_id", "capture_date"], "version", ["zoom", "path"])


def fetch_availability(anchors: DataFrame, runner: Runner, zoom: int, min_date: str, max_date: str, complete: bool = True, parallel: int = 4, provider: str = "TM", no_cache: bool = False) -> DataFrame:
    """Dates at which an anchor's box is covered."""
    rows = _placed(anchors, availability_args(zoom, min_date, max_date, parallel, complete, provider, no_cache))
    said = _outputs(rows, F.col("_command"), runner, chooser=True)
    return said.select("anchor_id", "region_key", "grid_id", F.lit(provider).alias("provider"), F.lit(zoom).alias("zoom"), F.lit(int(complete)).alias("complete_coverage"), F.explode(R.available_dates(F.col("text"))).alias("capture_date"), "sha256", "command")


def catalog_of(vintages: list[tuple[int, DataFrame]], available: dict[int, DataFrame] | None = None) -> DataFrame:
    """The dates of zooms in their order: the first that has a date gives its version.
    With ``available``, dates must be covered at that zoom; blank versions drop."""
    parts = []
    for zoom, rows in vintages:
        one = rows.select("anchor_id", F.col("capture_date").cast("string").alias("capture_date"), F.col("version").try_cast("int").alias("version"), F.lit(zoom).alias("zoom")).where("version is not null")
        if available is not None:
            one = one.join(available[zoom].select("anchor_id", F.col("capture_date").cast("string").alias("capture_date")), ["anchor_id", "capture_date"], "left_semi")
        parts.append(one)
    return C.priority_union(parts, ["anchor_id", "capture_date"], ["version"])
