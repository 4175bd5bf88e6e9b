"""Forests whose bootstrap samples are hashes, so that a tree's sample is known again wherever a row is met."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow
from galewise.operators.metrics import LEAST_SHARE
from galewise.plans import hist_trees as ht
from galewise.session import cut_lineage

GROUP = 32  # trees grown together


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # of the Poisson distribution with mean 1


def bootstrap_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row, by the 64-bit hash of its key, is in the sample of a tree: Poisson with mean 1."""
    own = _mixed(np.array([seed * 1_000_003 + tree + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    share = (_mixed(keys.astype(np.int64).view(np.uint64) ^ own) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(STEPS, share, side="right").astype(float)


@dataclass
class Forest:
    bins: ht.Binning
    classes: int
    seed: int
    rows: DataFrame  # key, y, bins of the training rows
    trees: list[ht.Tree] = field(default_factory=list)


def train_forest(
    rows: DataFrame, label: str, classes: int, numeric: list[str], categorical: list[str], key: str = "row_id",
    trees: int = 300, depth: int = 5, least: float = 1, seed: int = 3,
) -> Forest:
    """A forest for ``label`` in 0 … ``classes`` - 1; every node chooses among as many features as the root of their number.

    GROUP trees grow at a time, a level of all of them in one pass over the bins.
    """
    bins = ht.learn_bins(rows, numeric, categorical)
    table = cut_lineage(ht.binned(rows, bins, F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("y")), "forest-bins")
    forest, width = Forest(bins, classes, seed, table), len(bins.names)
    some = max(1, math.ceil(math.sqrt(width)))

    def score(s: np.ndarray) -> np.ndarray:
        return (s[:, :-1] ** 2).sum(axis=1) / np.maximum(s[:, -1], 1e-12)

    def rank(s: np.ndarray) -> np.ndarray:
        return s[:, 0] / np.maximum(s[:, -1], 1e-12)

    for first in range(0, trees, GROUP):
        numbers = list(range(first, min(first + GROUP, trees)))

        def stats(b: pa.RecordBatch, x: np.ndarray, numbers=numbers):
            own = np.column_stack((np.eye(classes)[b["y"].to_numpy()], np.ones(b.num_rows)))
            keys = b["key"].to_numpy()
            return [own * bootstrap_weights(keys, t, seed)[:, None] for t in numbers], {}

        def allowed(t: int, node: int, first=first) -> np.ndarray:
            out = np.zeros(width, dtype=bool)
            out[np.random.default_rng([seed, first + t, node]).permutation(width)[:some]] = True
            return out

        grown = [ht.Tree() for _ in numbers]
        ht.grow(table, grown, bins, classes + 1, stats, score, rank, depth, least, allowed)
        for tree in grown:
            tree.value = [int(s[:-1].argmax()) for s in tree.stats]
        forest.trees += grown
    return forest


def oob_curve(forest: Forest) -> DataFrame:
    """``(trees, rows, accuracy, logloss)`` out of bag for the first 1, 2, … trees.

    A tree votes only for the rows outside its sample; a row counts from its first vote on. The class with most votes wins, the smaller one on a tie.
    """
    count, width, shared = len(forest.trees), len(forest.bins.names), forest.rows.sparkSession.sparkContext.broadcast(forest.trees)
    classes, seed = forest.classes, forest.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, 3))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, keys = ht.bins_of(b["bins"], width), b["y"].to_numpy(), b["key"].to_numpy()
            votes, at = np.zeros((b.num_rows, classes)), np.arange(b.num_rows)
            for t, tree in enumerate(shared.value):
                out = np.flatnonzero(bootstrap_weights(keys, t, seed) == 0)
                votes[out, np.array(tree.value)[tree.route(x[out])]] += 1
                total = votes.sum(axis=1)
                has = total > 0
                share = votes[at, y][has] / total[has]
                sums[t] += has.sum(), (votes.argmax(axis=1) == y)[has].sum(), -np.log(np.maximum(share, LEAST_SHARE)).sum()
        yield arrow.batch(trees=np.arange(1, count + 1, dtype=np.int32), n=sums[:, 0], hits=sums[:, 1], loss=sums[:, 2])

    made = forest.rows.mapInArrow(run, "trees int, n double, hits double, loss double").groupBy("trees")
    return made.agg(
        F.sum("n").cast("long").alias("rows"), F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy"), F.try_divide(F.sum("loss"), F.sum("n")).alias("logloss")
    )
