"""Learning-to-rank gradients for NDCG at a cut-off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.operators.metrics import dcg, top_ranked
from galewise.session import Versions, cut_lineage

GROUP_ROWS = 1 << 14  # a group of more rows is ranked by joins
BLOCK_ROWS = 4096  # rows of whole groups that lie in a block
TASK_ROWS = 1 << 20  # rows in the blocks of a file
BLOCKS = "held boolean, sizes array<int>, rel array<double>, bins binary, score array<double>, lambda array<double>, weight array<double>"


def lambda_gradients(
    scored: DataFrame, k: int = 5, group: str = "group", relevance: str = "relevance",
    score: str = "score", row_id: str = "row_id", tables: Versions | None = None,
) -> DataFrame:
    """Gradient and curvature of every row: ``(row_id, lambda, weight)``.

    Swapping two rows changes NDCG at ``k`` only if one of them is in the first ``k``.
    So each row meets the at most ``k`` first rows of its group, which is exact and
    grows with the rows, not with their square. A job with many rounds gives its
    ``tables`` to keep one copy of the partners only.
    """
    rows = scored.select(
        F.col(row_id).alias("id"), F.col(group).alias("grp"),
        (F.pow(F.lit(2.0), F.col(relevance)) - 1).alias("gain"),
        F.col(relevance).alias("rel"), F.col(score).alias("s"),
    )
    head = top_ranked(rows, "grp", F.desc("s"), "id", k)
    ideal = dcg(top_ranked(rows, "grp", F.desc("rel"), "id", k), "grp", "rel", "ideal")
    top = head.join(ideal.where("ideal > 0"), "grp").select(
        "grp", "ideal",
        F.struct("id", "gain", "rel", "s", (1 / F.log2(F.col("rank") + 1)).alias("d")).alias("t"),
    )
    # at most k partners per group; stored, because Spark splits a hot group only between
    # two plain shuffles
    partners = (tables.store if tables else cut_lineage)(
        top.groupBy("grp", "ideal").agg(F.collect_list("t").alias("top")), "partners"
    )
    met = rows.join(partners, "grp", "left").select(
        "id", "gain", "rel", "s", "ideal",
        F.get(F.filter("top", lambda x: x["id"] == F.col("id")), F.lit(0))["d"].alias("own"), F.explode_outer("top").alias("t"),
    )
    higher = F.col("rel") > F.col("t.rel")
    gap = F.when(higher, F.col("s") - F.col("t.s")).otherwise(F.col("t.s") - F.col("s"))
    rho = 1 / (1 + F.exp(gap))
    change = F.abs(F.col("gain") - F.col("t.gain")) * F.abs(F.coalesce("own", F.lit(0.0)) - F.col("t.d")) / F.col("ideal")
    paired = met.withColumn("rho", rho).withColumn(
        "change", F.when(F.col("rel") == F.col("t.rel"), 0.0).otherwise(F.coalesce(change, F.lit(0.0)))
    )
    pull = F.coalesce(F.col("rho"), F.lit(0.0)) * F.col("change") * F.when(higher, 1.0).otherwise(-1.0)
    bend = F.coalesce(F.col("rho") * (1 - F.col("rho")), F.lit(0.0)) * F.col("change")
    parts = paired.select("id", "own", F.col("t.id").alias("tid"), pull.alias("pull"), bend.alias("bend"))
    own_part = F.struct(F.col("id").alias("id"), F.col("pull").alias("l"), F.col("bend").alias("w"))
    other_part = F.struct(F.col("tid").alias("id"), (-F.col("pull")).alias("l"), F.col("bend").alias("w"))
    both = F.when(F.col("own").isNull() & F.col("tid").isNotNull(), F.array(own_part, other_part)).otherwise(
        F.array(own_part)
    )
    return parts.select(F.inline(both)).groupBy(F.col("id").alias(row_id)).agg(
        F.sum("l").alias("lambda"), F.sum("w").alias("weight")
    )


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``held``, ``grp``, …) of groups that a task may hold, and all others: those of large groups and those without a group."""
    sizes = rows.where("grp is not null").groupBy("held", "grp").count()
    large = cut_lineage(sizes.where(F.col("count") > GROUP_ROWS).select("held", "grp"), "large-groups")
    if large.isEmpty():
        return rows.where("grp is not null"), rows.where("grp is null")
    return (
        rows.where("grp is not null").join(large, ["held", "grp"], "left_anti"),
        rows.join(large, ["held", "grp"], "left_semi").unionByName(rows.where("grp is null").select("held", "grp", *[c for c in rows.columns if c not in ("held", "grp")])),
    )


def blocks_of_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (``id, grp, rel, held, bins``) as blocks of whole groups with scores of 0, for which each round is a map.

    The rows are moved once. A block is a row with the ``sizes`` of its groups, whose rows lie behind each other in the order of their ids.
    """
    count = rows.count()
    files = min(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS)), -(-count // BLOCK_ROWS))
    dealt = rows.select("held", "grp", "id", F.col("rel").cast("double").alias("rel"), "bins")
    dealt = dealt.repartition(max(1, files), "held", "grp").sortWithinPartitions("held", "grp", "id").drop("id")

    def cut(whole: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = whole["held"].to_numpy(zero_copy_only=False).astype(bool)[starts]
        share = starts // BLOCK_ROWS
        edges = np.flatnonzero(np.concatenate(([True], (share[1:] != share[:-1]) | (held[1:] != held[:-1]))))
        for lo, hi in zip(edges, [*edges[1:], len(starts)]):
            end = starts[hi] if hi < len(starts) else whole.num_rows
            own = whole.slice(starts[lo], end - starts[lo])
            sizes = np.diff(np.append(starts[lo:hi], end)).astype(np.int32)
            zeros = arrow.list_column(np.zeros((1, own.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bool(held[lo])]), pa.array([sizes], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own["rel"]),
                    pa.array([b"".join(own["bins"].to_pylist())], pa.binary()), zeros, zeros, zeros,
                ],
                ["held", "sizes", "rel", "bins", "score", "lambda", "weight"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            whole = b if rest is None else arrow.joined([rest, b])
            starts = _group_starts(whole)
            if starts[-1] >= BLOCK_ROWS:
                yield from cut(whole.slice(0, starts[-1]), starts[:-1])
                whole = whole.slice(starts[-1])
            rest = whole
        if rest is not None:
            yield from cut(rest, _group_starts(rest))

    return dealt.mapInArrow(run, BLOCKS)


def _group_starts(part: pa.RecordBatch) -> np.ndarray:
    other = [pc.not_equal(part[c].slice(1), part[c].slice(0, part.num_rows - 1)).to_numpy(zero_copy_only=False) for c in ("held", "grp")]
    return np.concatenate(([0], 1 + np.flatnonzero(other[0].astype(bool) | other[1].astype(bool))))


class Groups:
    """Some whole groups behind each other, the rows of each in the order of their ids; an unknown relevance is NaN and has no gain."""

    def __init__(self, sizes: np.ndarray, rel: np.ndarray):
        self.sizes, self.rel, self.gain = sizes, rel, 2.0**rel - 1
        self.first, self.group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)

    @staticmethod
    def of(block: pa.RecordBatch) -> Groups:
        return Groups(block["sizes"].flatten().to_numpy(), block["rel"].flatten().to_numpy(zero_copy_only=False))

    def ranked(self, by: np.ndarray) -> np.ndarray:
        """The rows of each group from the largest on; equal ones by their ids."""
        return np.lexsort((-by, self.group))

    def dcg(self, order: np.ndarray, k: int) -> np.ndarray:
        """As :func:`galewise.operators.metrics.dcg` of the first ``k``: missing where none of them has a gain."""
        rank = np.arange(len(order)) - self.first[self.group]
        gain = self.gain[order]
        own = np.flatnonzero((rank < k) & ~np.isnan(gain))
        total = np.bincount(self.group[own], gain[own] / np.log2(rank[own] + 2), len(self.sizes))
        return np.where(np.bincount(self.group[own], minlength=len(self.sizes)) > 0, total, np.nan)

    def ndcg(self, score: np.ndarray, k: int) -> np.ndarray:
        """NDCG at ``k`` of the groups that have any gain."""
        got, ideal = self.dcg(self.ranked(score), k), self.dcg(self.ranked(self.rel), k)
        return (got[ideal > 0] / ideal[ideal > 0])[~np.isnan(got[ideal > 0])]

    def gradients(self, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of every row, as :func:`lambda_gradients` gives them."""
        n, order, rel, gain = len(self.rel), self.ranked(score), self.rel, self.gain
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - self.first[self.group]
        own, ideal = np.where(rank < k, 1 / np.log2(rank + 2), 0.0), self.dcg(self.ranked(rel), k)[self.group]
        pull, bend = np.zeros(n), np.zeros(n)
        for place in range(k):
            met = np.flatnonzero((self.sizes[self.group] > place) & (ideal > 0))
            top = order[self.first[self.group[met]] + place]
            higher = rel[met] > rel[top]
            gap = np.where(higher, score[met] - score[top], score[top] - score[met])
            with np.errstate(over="ignore"):
                rho = 1 / (1 + np.exp(gap))
            change = np.abs(gain[met] - gain[top]) * np.abs(own[met] - own[top]) / ideal[met]
            change = np.where((rel[met] == rel[top]) | np.isnan(change), 0.0, change)
            moved, curved = rho * change * np.where(higher, 1.0, -1.0), rho * (1 - rho) * change
            pull[met] += moved
            bend[met] += curved
            # a first row that meets another has a part of its own for it
            far = rank[met] >= k
            pull -= np.bincount(top[far], moved[far], n)
            bend += np.bincount(top[far], curved[far], n)
        return pull, bend
