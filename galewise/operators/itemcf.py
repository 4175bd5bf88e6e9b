"""Candidates from item similarity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.operators.topk import top_per_group
from galewise.session import cut_lineage


def long_form(documents: DataFrame) -> DataFrame:
    """Documents with a list field ``sim`` as one row per course and similar item."""
    return documents.select("course_id", F.explode("sim").alias("sim"))


def best_per_item(sim: DataFrame, items: DataFrame, allowed: DataFrame, size: int) -> DataFrame:
    """The ``size`` highest allowed courses whose list holds each of the given items."""
    asked = sim.join(items, "sim", "left_semi")
    # by pair: the partitions of the join would leave a hot item in one task
    pairs = asked.repartition("course_id", "sim").distinct()
    listed = pairs.join(allowed, "course_id", "left_semi")
    return top_per_group(listed, "sim", [F.desc("course_id")], size, "course_id").drop("rn")


def itemcf_candidates(
    seeds: DataFrame,
    sim: DataFrame,
    documents: DataFrame,
    size: int = 1024,
    vip: tuple[int, ...] = (2,),
    needbuy: tuple[int, ...] = (0,),
    status: int = 1,
    score: float = 2.0,
) -> DataFrame:
    """For each user, courses whose ``sim`` list meets the user's seeds.

    ``seeds`` is ``(user_id, course_id)`` and ``sim`` is ``(course_id, sim)``. All
    courses have the same score, so the answer is ordered by ``course_id`` alone and a
    seed can only contribute its ``size`` highest courses. Keeping just those per seed
    loses nothing and bounds the join on an item that is in very many lists. Lists of
    items that nobody has as a seed are left out before anything is ranked.
    """
    allowed = documents.where(
        F.col("vip_status").isin(*vip)
        & F.col("needbuy_status").isin(*needbuy)
        & (F.col("status") == status)
    ).select("course_id")
    # the inputs of the joins are stored: Spark splits a hot key only between plain shuffles
    wanted = cut_lineage(seeds.select("user_id", F.col("course_id").alias("sim")), "seeds")
    items = cut_lineage(wanted.select("sim").distinct(), "seed-items")
    useful = cut_lineage(best_per_item(sim, items, allowed, size), "useful")
    hits = wanted.join(useful, "sim").select("user_id", "course_id").distinct()
    return top_per_group(hits, "user_id", [F.desc("course_id")], size, "course_id").select(
        "user_id", "course_id", F.lit(score).alias("score")
    )
