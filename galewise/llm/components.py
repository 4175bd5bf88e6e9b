"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.session import Versions


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(0x7FFFFFFF)).alias("h")).first()
    return row.n, row.h or 0


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its smallest node.

    Loops, repeated links and links of null count for nothing. A node's minimum is combined before the
    shuffle and stored, so the join that hands it to the neighbours is one between two plain shuffles,
    which adaptive execution splits where a node has very many of them. Steps repeat until the links
    no longer change; every table lies in the shared folder.
    """
    versions = Versions(links.sparkSession, "llm-stars")
    edges = versions.store(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = versions.store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large")
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = versions.store(large.distinct(), "wide")
        lowest = versions.store(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = versions.store(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
