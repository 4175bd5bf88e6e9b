"""The best rows of every group, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE_STEP = 64


def top_per_group(df: DataFrame, group: str, order: list[Column | str], k: int, spread_by: str, rank: str = "rn") -> DataFrame:
    """First ``k`` rows of each group by ``order``, with their rank.

    Spark keeps only ``k`` rows per group and task before the shuffle, for any ``k`` up to a
    threshold of the session, which ``build_session`` sets; beyond it the result is the same. With a larger ``k``
    the survivors of a group from all tasks are still many, so they are first compared in
    as many pieces as there are shuffle partitions, and the best of each piece again.
    """
    conf = df.sparkSession.conf

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)

    if k <= ONE_STEP:
        return best(df, group)
    pieces = int(conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("__piece", F.pmod(F.xxhash64(spread_by), F.lit(pieces)))
    return best(best(cut, group, "__piece").drop("__piece", rank), group)
