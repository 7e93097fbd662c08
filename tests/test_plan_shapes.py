"""Plans that must hold at any scale: what is pushed down, shuffled, joined and sorted."""

from __future__ import annotations

import re

import pytest

from trialspark.bindings import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Queries whose work happens while they are built (loads, archives, stored pieces).
BUILT_EAGERLY = {
    "expand_archives", "archive_report", "load_report", "training_tables",
    "asof_before", "asof_after", "low_episodes", "weighted_range",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def query_plan(spark, name: str) -> str:
    return plan(QUERIES[name](spark, FOLDER))


LAZY = sorted(n for n in QUERIES if not n.startswith("ingest_") and n not in BUILT_EAGERLY)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_window(spark, name):
    text = query_plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Window" not in text
    assert "BatchEvalPython" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = query_plan(spark, "between_filter")
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThan(l_shipdate" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert read.count(":") == 4
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["glucose_summary", "treatment_breakdown", "baseline_change", "numeric_text_avg"])
def test_one_shuffle_after_partial_aggregation(spark, name):
    text = query_plan(spark, name)
    assert text.count("Exchange") == 1
    before_shuffle = text[text.index("Exchange") :]
    assert re.search(r"(Hash|Sort|ObjectHash)Aggregate", before_shuffle)


def test_results_are_folded_before_the_join(spark):
    """Between the orders scan and the join there is a partial aggregate below the exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = query_plan(spark, "join_breakdown")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orders_side = text[text.rindex("SortMergeJoin") :]
    assert "partial_sum" in orders_side and "partial_count" in orders_side
    # subjects, folded results, regrouping, final sort
    assert text.count("Exchange") == 4


def test_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in query_plan(spark, "page_rows")


def test_compare_needs_one_shuffle_per_comparison(spark):
    text = query_plan(spark, "results_equal")
    assert text.count("hashpartitioning") == 2


def test_answers_are_parsed_once(spark):
    text = query_plan(spark, "sft_rows")
    assert "Generate inline" in text
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert not any("try_parse_json" in line or "parse_json" in line for line in filters)


def test_pages_without_catalog_stay_in_the_jvm(spark):
    from trialspark.sources.catalog_pages import extract_datasets

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    text = plan(extract_datasets(pages, "page_id"))
    assert "StringContains(html,ctl00_CphMain_GridViewPublicDataSets)" in text


def test_hot_subject_is_split_in_the_outcome_join(spark):
    """A third of all outcomes belong to one subject: its partition is read by several tasks."""
    from pyspark.sql import functions as F

    from trialspark.operators.cohorts import link_outcomes

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        people = spark.range(3000).selectExpr("id as pt_id", "id % 2 as sex")
        outcomes = spark.range(0, 300000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 3000).alias("subject"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        linked = link_outcomes(people, "pt_id", outcomes, "subject")
        assert linked.agg(F.count("payload")).first()[0] == 300000
        linked.collect()
        assert "skew=true" in plan(linked)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
