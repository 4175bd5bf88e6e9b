"""Seed picks, train/test splits and mini-batches that repeat exactly.

Every choice is a hash of the row's own key, so it does not depend on how the rows
happen to be partitioned or on a task being run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.functions.hashing import hash28, hash_bucket
from galewise.operators.indexing import dense_index
from galewise.operators.topk import top_per_group


def pick_seeds(items: DataFrame, group: str, item: str, n: int = 20, seed: int = 7) -> DataFrame:
    """``n`` items of each group, without replacement, in hash order.

    A group with very many items sends only ``n`` candidates per task.
    """
    order = [hash28(F.col(item), F.lit(seed)), item]
    return top_per_group(items.select(group, item), group, order, n, item).drop("rn")


def is_test(key: Column, seed: Column | int, test_per_mille: int) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return hash_bucket(1000, key, seed) < test_per_mille


def train_test_split(df: DataFrame, key: str, test_ratio: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete train and test sets."""
    test = is_test(F.col(key), seed, round(test_ratio * 1000))
    return df.where(~test), df.where(test)


def split_counts(df: DataFrame, key: str, repeats: int = 10, test_ratio: float = 0.2) -> DataFrame:
    """Sizes of the train and test sets of each repeat."""
    repeat = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("exp")
    test = is_test(F.col(key), F.col("exp"), round(test_ratio * 1000))
    return (
        df.select(key, repeat)
        .groupBy("exp", test.alias("is_test"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_batch(df: DataFrame, key: str, epoch: Column | int, batches: int) -> DataFrame:
    """Assign each row to a mini-batch, reshuffled every epoch."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return df.withColumn("batch_id", hash_bucket(batches, F.col(key), epoch))


def permuted(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """``(key, column)`` with the values of ``column`` dealt anew to the rows, whose keys are unique.

    The n-th row in one hash order gets the value of the n-th in another. Both orders are numbered inside hash buckets, so no task sorts them
    all, and a rerun on any partitioning deals alike.
    """
    place = dense_index(df.select(key), key, "__place")
    drawn = df.select(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).alias("__drawn"), column)
    values = dense_index(drawn, "__drawn", "__place").select("__place", column)
    return place.join(values, "__place").select(key, column)
