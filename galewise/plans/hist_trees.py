"""Trees grown level by level from histograms that Spark sums, for boosting and forests.

Values are cut into bins once and stored. For each level the tasks route their rows through the trees as far as they have grown and
add up statistics by (tree, node, feature, bin); the driver sees these sums, whose number depends on the model and not on the rows, and
picks the splits. Only the smaller child of a split is counted, the other is its parent less that one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow, mlp
from galewise.functions.vectors import sum_vectors

BINS = 64  # of a feature; the first one holds missing values


@dataclass
class Binning:
    """How the values of each feature become bins: upper edges of numbers, or categories from the most frequent one."""

    numeric: list[str]
    categorical: list[str]
    edges: dict[str, np.ndarray] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def is_category(self) -> np.ndarray:
        return np.array([c in self.values for c in self.names])

    def columns(self) -> list[Column]:
        return [F.col(c).cast("double").alias(c) for c in self.numeric] + [F.col(c).cast("string").alias(c) for c in self.categorical]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bins of every row and feature. Rare and unknown categories share the last bin."""
        out = np.zeros((batch.num_rows, len(self.names)), dtype=np.uint8)
        for f, name in enumerate(self.numeric):
            x = batch[name].to_numpy(zero_copy_only=False).astype(float)
            out[:, f] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[name], x))
        for f, name in enumerate(self.categorical, start=len(self.numeric)):
            codes = {v: min(i + 1, BINS - 1) for i, v in enumerate(self.values[name])}
            out[:, f] = [0 if v is None else codes.get(v, BINS - 1) for v in batch[name].to_pylist()]
        return out


def learn_bins(rows: DataFrame, numeric: list[str], categorical: list[str]) -> Binning:
    """Quantiles of the numbers and the ``BINS`` - 2 most frequent categories (ties in their order)."""
    made = Binning(numeric, categorical)
    if numeric:
        share = [i / (BINS - 2) for i in range(1, BINS - 2)]
        plain = rows.select(*[F.col(n).cast("double").alias(n) for n in numeric])
        found = plain.select(*[F.percentile_approx(F.when(~F.isnan(n), F.col(n)), share, 10_000).alias(n) for n in numeric]).first()
        made.edges = {n: np.unique(found[n]) if found[n] else np.empty(0) for n in numeric}
    for name in categorical:
        value = F.col(name).cast("string").alias("v")
        top = rows.select(value).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(BINS - 2)
        made.values[name] = [r.v for r in top.collect()]
    return made


def binned(rows: DataFrame, bins: Binning, *keep: str | Column) -> DataFrame:
    """The columns ``keep`` and ``bins``, one byte for each feature."""
    ready = rows.select(*keep, *[c.alias(f"__{n}") for c, n in zip(bins.columns(), bins.names)])
    kept = ready.columns[: len(keep)]
    schema = ", ".join(f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = bins.of(pa.RecordBatch.from_arrays(b.columns[len(kept) :], bins.names))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([r.tobytes() for r in x], pa.binary())], [*kept, "bins"])

    return ready.mapInArrow(run, f"{schema}, bins binary")


def bins_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


@dataclass
class Tree:
    """Nodes of one tree. A row goes to ``pos`` if its bin is in the node's mask, else to ``neg``; a leaf has the feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    mask: list[np.ndarray] = field(default_factory=lambda: [np.zeros(BINS, dtype=bool)])
    pos: list[int] = field(default_factory=lambda: [0])
    neg: list[int] = field(default_factory=lambda: [0])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, mask: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.mask[node] = feature, mask
        for _ in range(2):
            self.feature.append(-1), self.mask.append(np.zeros(BINS, dtype=bool)), self.pos.append(0), self.neg.append(0)
            self.stats.append(np.zeros(0)), self.value.append(0.0)
        self.neg[node], self.pos[node] = len(self.feature) - 2, len(self.feature) - 1
        return self.neg[node], self.pos[node]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        feature, pos, neg, mask = np.array(self.feature), np.array(self.pos), np.array(self.neg), np.array(self.mask)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.flatnonzero(feature[at] >= 0)
        while len(rows):
            own = at[rows]
            hit = mask[own, x[rows, feature[own]]]
            at[rows] = np.where(hit, pos[own], neg[own])
            rows = rows[feature[at[rows]] >= 0]
        return at


def level_sums(rows: DataFrame, trees: list[Tree], wanted: list[list[int]], width: int, size: int, stats: Callable) -> tuple[dict[tuple[int, int], np.ndarray], dict]:
    """Sums by (feature, bin, statistic) for the ``wanted`` nodes of each tree, and whatever further sums ``stats`` names.

    ``stats(batch, bins)`` gives a list of (n, size) arrays, one per tree (rows of zeros count for nothing), and a dict of names and further sums.
    """
    shared = rows.sparkSession.sparkContext.broadcast((trees, wanted))
    cells = width * BINS * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        extra: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = bins_of(b["bins"], width)
            per_tree, more = stats(b, x)
            for name, values in more.items():
                extra[name] = extra.get(name, 0.0) + np.asarray(values, dtype=float)
            for t, (tree, nodes, values) in enumerate(zip(trees, wanted, per_tree)):
                if not nodes:
                    continue
                at = tree.route(x)
                for node in nodes:
                    own = np.flatnonzero((at == node) & values.any(axis=1))
                    if not len(own):
                        continue
                    total = sums.setdefault((t, node), np.zeros((width, BINS, size)))
                    for f in range(width):
                        for s in range(size):
                            total[f, :, s] += np.bincount(x[own, f], weights=values[own, s], minlength=BINS)
        keys, places, blocks = [], [], []
        for (t, node), total in sums.items():
            own = mlp.blocks_of(total.ravel())
            some = np.flatnonzero(own.any(axis=1))
            keys += [f"{t}:{node}"] * len(some)
            places.append(some), blocks.append(own[some])
        for name, values in extra.items():
            own = mlp.blocks_of(values.ravel())
            keys += [name] * len(own)
            places.append(np.arange(len(own))), blocks.append(own)
        if keys:
            yield arrow.batch(key=pa.array(keys), place=np.concatenate(places).astype(np.int32), sums=np.vstack(blocks))

    made = rows.mapInArrow(run, "key string, place int, sums array<double>").groupBy("key", "place")
    found = made.agg(sum_vectors(F.col("sums"), mlp.BLOCK).alias("sums")).collect()  # the size of the model
    shared.destroy()
    out, more = {}, {}
    for r in found:
        if ":" in r.key:
            t, node = map(int, r.key.split(":"))
            flat = out.setdefault((t, node), np.zeros(-(-cells // mlp.BLOCK) * mlp.BLOCK))
            flat[r.place * mlp.BLOCK : (r.place + 1) * mlp.BLOCK] = r.sums
        else:
            more.setdefault(r.key, {})[r.place] = r.sums
    return (
        {k: v[:cells].reshape(width, BINS, size) for k, v in out.items()},
        {k: np.concatenate([v[i] for i in sorted(v)]) for k, v in more.items()},
    )


def best_split(sums: np.ndarray, is_category: np.ndarray, score: Callable, rank: Callable, least: float, allowed: np.ndarray | None = None):
    """(gain, feature, mask) of the best split of a node, or None.

    ``score`` rates summed statistics, ``rank`` orders the categories; the last statistic is the number of rows, of which either side needs ``least``.
    Equal gains go to the first feature and cut.
    """
    best = None
    whole = score(sums[0].sum(axis=0)[None])[0]
    for f in range(len(sums)) if allowed is None else np.flatnonzero(allowed):
        own = sums[f]
        order = np.argsort(rank(own), kind="stable") if is_category[f] else np.arange(BINS)
        used = order[own[order, -1] > 0]
        if len(used) < 2:
            continue
        low = np.cumsum(own[used], axis=0)[:-1]
        high = own.sum(axis=0) - low
        gain = score(low) + score(high) - whole
        gain[(low[:, -1] < least) | (high[:, -1] < least)] = -np.inf
        cut = int(gain.argmax())
        if gain[cut] > 1e-12 and (best is None or gain[cut] > best[0] + 1e-12):
            mask = np.zeros(BINS, dtype=bool)
            mask[used[cut + 1 :]] = True
            if not is_category[f]:
                mask[used[cut] + 1 :] = True  # bins without rows lie beside their neighbours
            best = float(gain[cut]), f, mask
    return best


def grow(
    rows: DataFrame, trees: list[Tree], bins: Binning, size: int, stats: Callable, score: Callable, rank: Callable, depth: int, least: float,
    allowed: Callable[[int, int], np.ndarray] | None = None,
) -> tuple[dict, dict[int, int]]:
    """Grow ``trees`` from their roots to ``depth``; returns the further sums of the first pass and the number of nodes counted in each level."""
    width, is_category = len(bins.names), bins.is_category
    sums, more = level_sums(rows, trees, [[0] for _ in trees], width, size, stats)
    counted = {0: len(sums)}
    for t, tree in enumerate(trees):
        tree.stats[0] = sums[t, 0][0].sum(axis=0) if (t, 0) in sums else np.zeros(size)
    for level in range(depth):
        halves, wanted = [], [[] for _ in trees]
        for (t, node), own in sorted(sums.items()):
            found = best_split(own, is_category, score, rank, least, allowed and allowed(t, node))
            if found is None:
                continue
            _, f, mask = found
            neg, pos = trees[t].split(node, f, mask)
            right = own[f][mask].sum(axis=0)
            trees[t].stats[pos], trees[t].stats[neg] = right, own[f].sum(axis=0) - right
            small, large = sorted((neg, pos), key=lambda n: trees[t].stats[n][-1])
            halves.append((t, node, small, large))
            wanted[t].append(small)
        if not halves or level + 1 == depth:
            break
        made, _ = level_sums(rows, trees, wanted, width, size, stats)
        counted[level + 1] = len(made)
        below = {}
        for t, node, small, large in halves:
            own = made.get((t, small), np.zeros_like(sums[t, node]))
            below[t, small], below[t, large] = own, sums[t, node] - own
        sums = below
    return more, counted


def newton(l2: float = 1.0) -> tuple[Callable, Callable, Callable]:
    """Score, category order and leaf value for statistics (gradient, curvature, rows)."""

    def score(s: np.ndarray) -> np.ndarray:
        return s[:, 0] ** 2 / (s[:, 1] + l2)

    def rank(s: np.ndarray) -> np.ndarray:
        return s[:, 0] / np.maximum(s[:, 1] + l2, 1e-300)

    return score, rank, lambda s: float(s[0] / (s[1] + l2))
