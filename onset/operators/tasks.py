"""Tasks of anchors and dates, and probes of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onset.functions import parse as P
from onset.operators import catalog as C

BOX = ["chip_lon_min", "chip_lat_min", "chip_lon_max", "chip_lat_max"]


def _box(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> list[Column]:
    ten = lambda c: P.fixed(c, 10)
    return [ten(F.least(lon0, lon1)).alias("left_longitude"), ten(F.greatest(lon0, lon1)).alias("right_longitude"), ten(F.greatest(lat0, lat1)).alias("top_latitude"), ten(F.least(lat0, lat1)).alias("bottom_latitude")]


def task_rows(anchors: DataFrame, dates: list[str], root: str, zoom_from: int, zoom_to: int) -> DataFrame:
    """Each anchor at each date; raises where an anchor lacks its name or a corner."""
    from datetime import date

    days = [date.fromisoformat(d) for d in dates]
    key = P.strip(F.col("anchor_id"))
    named = F.when(key == "", F.raise_error(F.lit("anchor without anchor_id"))).otherwise(P.required(key, "anchor_id"))
    corners = [P.required(P.number(F.col(c).cast("string")), c) for c in BOX]
    day = F.explode(F.array(*(F.struct(F.lit(d.isoformat()).alias("date"), F.lit(f"{d:%Y%m%d}").alias("code"), F.lit(str(d.year)).alias("year")) for d in days)))
    rows = anchors.select(named.alias("grid_id"), P.token(F.col("region_key"), default="unknown_region").alias("_r"), P.token(F.col("grid_id"), default="unknown_grid").alias("_g"), *(c.alias(n) for c, n in zip(corners, BOX, strict=True)), day.alias("d"))
    path = F.lit(root)
    for part in (F.col("_r"), F.col("_g"), P.token(F.col("grid_id")), F.col("d.year")):
        path = P.join_path(path, part)
    return rows.select("grid_id", P.token(F.concat("grid_id", F.lit("_"), "d.code")).alias("task_name"), path.alias("save_to"), F.lit("").alias("map_type"), F.col("d.date").alias("date"), F.lit(zoom_from).alias("zoom_from"), F.lit(zoom_to).alias("zoom_to"), *_box(*(F.col(c) for c in BOX)))


def probe_tasks(sample: DataFrame, per_stratum: int, start: int, end: int, month_day: str, root: str, zoom_from: int, zoom_to: int, regions: list[str] | None = None, short: dict[str, str] | None = None) -> DataFrame:
    """Probes of the first cells of each region and stratum at each year. The sample
    has ``region_key``, ``suggested_stratum``, ``candidate_rank``, ``gridcell_id`` and
    the corners of :data:`BOX`."""
    if start > end:
        raise ValueError("the years begin after they end")
    some = sample.where(F.col("region_key").isin(regions)) if regions else sample
    chosen = C.first_rows(some, ["region_key", "suggested_stratum"], ["candidate_rank", "gridcell_id"], per_stratum)
    code = F.upper(F.left("region_key", F.lit(3)))
    if short:
        code = F.coalesce(F.create_map(*(F.lit(x) for pair in short.items() for x in pair))[F.col("region_key")], code)
    anchor = F.concat(code, F.lit("_"), F.left("suggested_stratum", F.lit(3)), F.lit("_"), F.col("gridcell_id").cast("string"))
    rows = chosen.select(anchor.alias("grid_id"), "region_key", *BOX, F.explode(F.sequence(F.lit(start), F.lit(end))).alias("year"))
    year = F.col("year").cast("string")
    return rows.select("grid_id", F.concat("grid_id", F.lit("_"), year).alias("task_name"), F.concat_ws("\\", F.lit(root), "region_key", "grid_id", year).alias("save_to"), F.lit("").alias("map_type"), F.concat(year, F.lit(f"-{month_day}")).alias("date"), F.lit(zoom_from).alias("zoom_from"), F.lit(zoom_to).alias("zoom_to"), *_box(*(F.col(c) for c in BOX)))


def census_dates(anchors: DataFrame, layers: dict[str, str], dates: DataFrame, override: str | None = None) -> DataFrame:
    """``anchors`` with ``census_date``: that of their region's layer (``dates``:
    ``region_key``, ``layer``, ``census_date``), null where there is none. A region has
    one layer, so ``dates`` is as small as there are regions."""
    if override:
        return anchors.withColumn("census_date", F.lit(override))
    layer = F.create_map(*(F.lit(x) for pair in layers.items() for x in pair))[F.btrim("region_key")] if layers else F.lit(None).cast("string")
    known = dates.select(F.col("region_key").alias("_region"), F.col("layer").alias("_layer"), "census_date")
    rows = anchors.withColumn("_wanted", layer)
    return rows.join(known, (F.btrim("region_key") == F.col("_region")) & (F.col("_wanted") == F.col("_layer")), "left").drop("_region", "_layer", "_wanted")
