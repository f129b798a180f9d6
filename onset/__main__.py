"""Entry points: ``python -m onset <command>``, or the same by spark-submit.

    scan       --anchors a.csv --states folder [--config c.yaml] [--limit n]   a dry run
    intervals  --states folder --output folder [--census 2024-06-30] [--no-repair] [--allow-faults]
    report     --states folder --output folder [--census 2024-06-30]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from onset.operators import reports, scan
from onset.operators import series as S
from onset.sources import files
from onset.sources.config import load_config

INTERVALS = ["anchor_id", "region_key", "grid_id", "status", "latest_absent_date", "earliest_present_date", "interval_start", "interval_end", "mid_estimate", "n_observations", "n_absent", "n_present", "n_unusable", "n_rounds", "confidence", "notes"]


def scan_command(spark: SparkSession, args: argparse.Namespace) -> int:
    config = load_config(args.config)
    anchors = files.first_rows(files.read_csv(spark, args.anchors), ["anchor_id"], args.limit)
    if anchors.isEmpty():
        raise SystemExit("no anchors")
    states = scan.new_states(anchors, config).withColumn("vintages", scan.dry_run_vintages(F.col("anchor_id")))
    done = scan.run_scan(states, scan.by_column(scan.dry_run_score), config).cache()
    files.save_states(done, args.states)
    scan.summary(done).orderBy("status").show(100, truncate=False)
    return scan.exit_code(done)


def _intervals(spark: SparkSession, args: argparse.Namespace):
    states, faults = files.load_states(spark, args.states, "keep" if args.allow_faults else "raise")
    return states, S.state_intervals(states, F.lit(args.census).cast("date"), repair=not args.no_repair), faults


def intervals_command(spark: SparkSession, args: argparse.Namespace) -> int:
    _, rows, faults = _intervals(spark, args)
    files.write_csv(rows, args.output, INTERVALS, strict=True, order=["anchor_id"])
    rows.groupBy("status", "confidence").count().orderBy("status", "confidence").show(100, truncate=False)
    faults.show(truncate=False)
    return 0


def report_command(spark: SparkSession, args: argparse.Namespace) -> int:
    states, rows, _ = _intervals(spark, args)
    reports.html_sections(states, rows).orderBy("anchor_id").select("html").write.mode("overwrite").text(args.output)
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="onset", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "intervals", "report"):
        one = commands.add_parser(name)
        one.add_argument("--states", required=True)
        if name == "scan":
            one.add_argument("--anchors", required=True)
            one.add_argument("--config")
            one.add_argument("--limit", type=int)
        else:
            one.add_argument("--output", required=True)
            one.add_argument("--census", default="2024-06-30")
            one.add_argument("--no-repair", action="store_true")
            one.add_argument("--allow-faults", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"onset {args.command}").getOrCreate()
    return {"scan": scan_command, "intervals": intervals_command, "report": report_command}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
