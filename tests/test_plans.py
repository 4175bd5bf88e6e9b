"""Plans: filters reach the scan, only needed columns are read, nothing is crossed."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from galewise.functions.vectors import sum_vectors
from galewise.operators import forecast, itemcf, positives
from galewise.plans import queries
from galewise.plans.registry import all_queries
from galewise.session import cut_lineage
from galewise.sources import tables as t

RELATIONAL = sorted(n for n, f in all_queries().items() if f.__module__ == queries.__name__)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join(spark, name):
    text = plan(all_queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_box_filter_and_columns_reach_the_grid_scan(spark):
    wide = t.forecast_grid(spark, SF).withColumn("unused", F.lit("x"))
    text = plan(forecast.forecast_features(cut_lineage(wide, "grid")))
    scan = text[text.index("FileScan"):]
    assert "GreaterThanOrEqual(lat_idx,243)" in scan and "LessThanOrEqual(lon_idx,497)" in scan
    assert "In(variable" in scan and "unused" not in scan.split("ReadSchema:")[1].split("\n")[0]


def test_stored_grid_reads_only_the_wanted_leads(spark, tmp_path):
    grid = t.forecast_grid(spark, SF)
    stored = forecast.store_grid(grid, str(tmp_path / "grid"))
    features = forecast.forecast_features(stored)
    scan = plan(features)
    assert "PartitionFilters: [isnotnull(lead" in scan and "lead#" in scan.split("PartitionFilters:")[1]
    assert sorted(features.collect()) == sorted(forecast.forecast_features(grid).collect())


def test_vector_scan_reads_two_columns(spark):
    text = plan(queries.fn_dot(spark, SF))
    assert text.split("ReadSchema:")[1].startswith(" struct<vec_id:bigint,embedding:array<float>>")


def test_flag_filters_reach_the_scan(spark):
    stored = cut_lineage(t.course_documents(spark, SF), "docs")
    text = plan(stored.where((F.col("vip_status") == 2) & (F.col("status") == 1)).select("course_id"))
    assert "EqualTo(vip_status,2)" in text and "needbuy_status" not in text.split("ReadSchema:")[1]


def test_sums_are_combined_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), F.array(F.col("id").cast("double")).alias("v"))
    text = plan(rows.groupBy("k").agg(sum_vectors(F.col("v"), 1).alias("s")))
    assert "partial_sum" in text


def test_lists_are_shuffled_by_list_not_by_context(spark):
    samples = spark.range(100).select((F.col("id") % 3).alias("c_idx"), F.col("id").alias("p_idx"))
    assert "hashpartitioning(c_idx#" in plan(positives.positives_per_context(samples))
    text = plan(positives.positives_per_context(samples))
    assert "REPARTITION_BY_COL" in text and ", part#" in text


def test_similarity_pairs_are_not_left_in_the_partitions_of_the_join(spark):
    sim = cut_lineage(t.course_sim(spark, SF), "sim")
    items = cut_lineage(sim.select("sim").distinct(), "items")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(itemcf.best_per_item(sim, items, t.course_documents(spark, SF).select("course_id"), 1024))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "LeftSemi" in text and re.search(r"hashpartitioning\(course_id#\d+L, sim#\d+L.*REPARTITION_BY_COL", text)


def test_line_items_and_pairs_are_moved_once_each(spark, tmp_path):
    lines = [(o, p, n) for o in range(4) for p, n in ((5, 1), (9, 2), (9, 2), (None, 2), (3, 2), (7, None), (5, 4), (o, 4), (8, 9))] + [(None, 1, 1), (None, 2, 2), (11, 4, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = set()
    for order in range(4):
        items = [p for _, _, p in sorted((n, p is not None, p) for o, p, n in lines if o == order and n is not None)]
        want |= {pair for a, b in zip(items, items[1:]) if None not in (a, b) and a != b for pair in ((a, b), (b, a))}
    found = t.item_pairs(spark, str(tmp_path))
    text = plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_numbered_pairs_go_both_ways(spark):
    sample, mapping = t.sim_matrix_nce(spark, SF)
    pairs = {(r.left_video_id, r.right_video_id) for r in t.sim_matrix(spark, SF).collect()}
    numbers = {r.video_id: r.p_idx for r in mapping.collect()}
    got = [tuple(r) for r in sample.select("left_video_id", "c_idx", "p_right_video_id", "p_idx").collect()]
    assert sorted(got) == sorted((a, numbers[a], b, numbers[b]) for a, b in pairs) and sorted(numbers.values()) == list(range(len(numbers)))


def test_only_contexts_with_several_lists_are_looked_up(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(positives, "cut_lineage", lambda df, label: stored.append(cut_lineage(df, label)) or stored[-1])
    hot = spark.range(50).select(F.lit(7).cast("long").alias("c_idx"), F.col("id").alias("p_idx"))
    cold = spark.range(3000).select((F.col("id") % 300 + 10).alias("c_idx"), F.col("id").alias("p_idx"))
    lists = positives.positives_per_context(hot.unionByName(cold), list_rows=20).collect()
    assert [tuple(r) for r in stored[0].collect()] == [(7, 3)]
    assert len(lists) == 303 and sum(len(r.positives) for r in lists) == 3050
