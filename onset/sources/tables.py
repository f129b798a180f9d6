"""The driver's tables, seen as observations, catalogs and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of a key's observations.
ORDER = ["capture_date", "line_no", "version", "supplier", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item; returned ones are unusable and have no presence."""
    usable = F.col("l_returnflag") != "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("anchor_id"), F.col("l_shipdate").cast("date").alias("capture_date"),
        F.when(usable, F.col("l_linestatus") == "O").alias("pv_present"), (F.col("l_discount") * 10).alias("pv_score"),
        F.when(usable, "usable").otherwise("unusable").alias("quality_flag"),
        F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("version"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated versions at two zooms."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("anchor_id"), F.col("l_shipdate").cast("date").alias("capture_date"), F.when(F.col("l_suppkey") % 2 == 0, 19).otherwise(18).alias("zoom"),
        F.col("l_partkey").alias("version"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
    )
