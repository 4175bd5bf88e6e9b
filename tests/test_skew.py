"""Adaptive execution can split a hot key in the joins of the operators."""

import pytest
from pyspark.sql import functions as F

from galewise.functions.vectors import random_vector
from galewise.operators import gradients, itemcf, positives, ranking
from galewise.session import cut_lineage

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows have the key 7."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
    yield cut_lineage(
        spark.range(0, ROWS, 1, 8).select(key.cast("long").alias("a"), F.col("id").alias("b")), "hot"
    )
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_gradient_joins(spark, hot):
    vecs = cut_lineage(spark.range(5000).select("id", random_vector(F.col("id"), 4, 1).alias("vec")), "vecs")
    rows = hot.select(
        F.col("a").alias("t"), (F.col("b") % 5000).alias("p"), (F.col("b") * 7 % 5000).alias("n"), F.lit(1.0).alias("weight")
    )
    got, text = run(gradients.total(gradients.bpr_parts(rows, vecs, vecs, 4), 4))
    assert "skew=true" in text
    assert sum(r.loss for r in got) == pytest.approx(ROWS * 0.6931, rel=0.01)


def test_lists_of_positives(hot):
    lists = positives.positives_per_context(hot.select(F.col("a").alias("c_idx"), F.col("b").alias("p_idx")))
    got, text = run(lists)
    assert "skew=true" in text
    assert sum(len(r.positives) for r in got) == ROWS and max(len(r.positives) for r in got) < 1300


def test_ranking_gradients(hot):
    rows = hot.select(
        F.col("b").alias("row_id"), F.col("a").alias("group"), (F.col("b") % 3).cast("int").alias("relevance"),
        (F.col("b") * 7919 % 10_007 / 1000).alias("score"),
    )
    got, text = run(ranking.lambda_gradients(rows))
    assert "skew=true" in text
    assert len(got) == ROWS and sum(r["lambda"] for r in got) == pytest.approx(0, abs=1e-6)


def test_similarity_candidates(spark, hot):
    docs = spark.range(ROWS).select(
        F.col("id").alias("course_id"), F.lit(2).alias("vip_status"), F.lit(0).alias("needbuy_status"), F.lit(1).alias("status")
    )
    seeds = spark.range(6000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("course_id"))
    sim = hot.select(F.col("b").alias("course_id"), F.col("a").alias("sim"))
    out = itemcf.itemcf_candidates(seeds, sim, docs, size=40)
    got = {}
    for r in out.collect():
        got.setdefault(r.user_id, []).append(r.course_id)
    best = sorted((r.b for r in hot.where("a = 7").collect()), reverse=True)[:40]
    assert all(sorted(got[u], reverse=True) == best for u in range(0, 6000, 300))
    assert len(got[3]) == 40
    items = cut_lineage(seeds.select(F.col("course_id").alias("sim")).distinct(), "items")
    ranked, text = run(itemcf.best_per_item(sim, items, docs.select("course_id"), 40))
    assert "skew=true" in text and sorted((r.course_id for r in ranked if r.sim == 7), reverse=True) == best
