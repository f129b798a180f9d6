"""What is worked out once, and dealt to all cores, whatever the tables' size."""

from __future__ import annotations

from onset.operators import scan
from onset.plans.queries import QUERIES
from onset.plans.scan_queries import _dry_states

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_made_up_catalog_takes_one_hash_a_key_and_all_cores(spark):
    assert plan(QUERIES["dry_run_catalog"](spark, DATA)).count("sha2(") == 1
    assert _dry_states(spark, DATA).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_text_is_parsed_once(spark):
    for name in ("jsonl_lenient", "matrix_lenient", "matrix_strict", "sequence_strict", "strict_doc_validity"):
        assert plan(QUERIES[name](spark, DATA)).count("parseJson") == 1, name


def test_scored_matrices_meet_by_chip_alone(spark):
    df = QUERIES["matrix_presence"](spark, DATA)
    said = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in said.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION" not in x]
    assert len(dealt) == 2 and all("hashpartitioning(chip_id" in x for x in dealt)


def test_a_round_copies_no_earlier_ones(spark):
    states = _dry_states(spark, DATA).select(*scan.STATE_COLUMNS, "vintages")
    once = scan.advance(scan.decide(states), scan.by_column(scan.dry_run_score))
    assert once.schema["rounds"].dataType.simpleString() == states.schema["rounds"].dataType.simpleString()
    assert f"AS ARRAY<{scan.ROUND[:20]}".upper() not in plan(once).upper()


def test_a_task_folder_is_worked_out_once(spark):
    assert plan(QUERIES["presence_rows"](spark, DATA)).count("^([A-Za-z]):") == 3  # told, and its two parts
