"""Positive targets gathered per context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions.hashing import hash28
from galewise.session import cut_lineage

LIST_ROWS = 1024


def positives_per_context(samples: DataFrame, context: str = "c_idx", target: str = "p_idx", list_rows: int = LIST_ROWS) -> DataFrame:
    """All targets of a context as sorted lists ``(context, part, positives)``.

    A context with more than ``list_rows`` targets gets several lists, its targets
    spread over them by hash, so no list grows with a hot context and none is cut short.
    """
    counts = samples.groupBy(context).agg(
        F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("__parts")
    )
    # only of contexts with several lists, so that the samples seldom move for it; stored, because Spark splits a hot key only between two plain shuffles
    counts = cut_lineage(counts.where("__parts > 1"), "positive-counts")
    part = F.coalesce(F.pmod(hash28(F.col(target)), F.col("__parts")), F.lit(0)).alias("part")
    return (
        samples.join(counts, context, "left")
        .select(context, part, target)
        # by list, not by context: else the join's partitions would be kept as they are
        .repartition(context, "part")
        .groupBy(context, "part")
        .agg(F.array_sort(F.collect_list(target)).alias("positives"))
    )
