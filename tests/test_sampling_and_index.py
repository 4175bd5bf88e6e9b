from pyspark.sql import functions as F

from galewise.operators import sampling
from galewise.operators.indexing import dense_index
from galewise.operators.positives import positives_per_context


def test_split_is_disjoint_complete_and_independent_of_partitions(spark):
    rows = spark.range(5000)
    train, test = sampling.train_test_split(rows, "id", 0.3, seed=4)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b and len(a | b) == 5000 and abs(len(b) / 5000 - 0.3) < 0.03
    again = sampling.train_test_split(rows.repartition(13), "id", 0.3, seed=4)[1]
    assert {r.id for r in again.collect()} == b


def test_seeds_are_distinct_and_repeat(spark):
    items = spark.range(457).select(F.lit(1).alias("user_id"), F.col("id").alias("course_id"))
    picks = [
        sorted(r.course_id for r in sampling.pick_seeds(items.repartition(n), "user_id", "course_id", 20).collect())
        for n in (1, 5)
    ]
    assert picks[0] == picks[1] and len(set(picks[0])) == 20
    other = sampling.pick_seeds(items, "user_id", "course_id", 20, seed=8)
    assert sorted(r.course_id for r in other.collect()) != picks[0]


def test_batches_change_with_the_epoch_and_keep_all_rows(spark):
    rows = spark.range(2000)
    first = sampling.with_batch(rows, "id", 1, 8).orderBy("id").collect()
    second = sampling.with_batch(rows, "id", 2, 8).orderBy("id").collect()
    assert len(first) == 2000 and {r.batch_id for r in first} == set(range(8))
    assert [r.batch_id for r in first] != [r.batch_id for r in second]


def test_dense_index_is_a_bijection_for_any_key_type(spark):
    for key in (F.col("id") * 977, F.concat(F.lit("k"), F.col("id"))):
        ids = spark.range(3000).select(key.alias("k"))
        rows = dense_index(ids, "k", "idx", buckets=16).collect()
        assert sorted(r.idx for r in rows) == list(range(3000))
        assert len({r.k for r in rows}) == 3000


def test_hot_context_is_split_but_whole(spark):
    hot = spark.range(5000).select(F.lit(0).alias("c_idx"), F.col("id").alias("p_idx"))
    cold = spark.range(10).select(F.lit(1).alias("c_idx"), F.col("id").alias("p_idx"))
    lists = positives_per_context(hot.unionByName(cold), list_rows=500).collect()
    by_context = {}
    for r in lists:
        by_context.setdefault(r.c_idx, []).append(r.positives)
        assert r.positives == sorted(r.positives)
    assert sorted(x for part in by_context[0] for x in part) == list(range(5000))
    assert len(by_context[0]) == 10 and max(map(len, by_context[0])) < 700
    assert by_context[1] == [list(range(10))]
