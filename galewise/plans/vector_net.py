"""A classifier over whole vectors: one relu layer with dropout and a softmax head, trained by local steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow, mlp
from galewise.functions.vectors import as_double
from galewise.plans.local_sgd import PIECE_ROWS, State, dealt, kept, one_round, piece_counts, shuffled
from galewise.session import cut_lineage


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropout_mask(keys: np.ndarray, units: int, step: int, share: float, seed: int) -> np.ndarray:
    """What each hidden unit of each row, by the hash of its key, is multiplied by in a step; a repeated task draws the same."""
    drawn = _mixed(np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + step))
    uniform = (_mixed(keys.astype(np.int64).view(np.uint64)[:, None] ^ drawn[None]) >> np.uint64(11)) / 2.0**53
    return (uniform >= share) / (1 - share)


def softmax_loss(x: np.ndarray, y: np.ndarray, mask: np.ndarray, layers: mlp.Layers) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed cross entropy of some rows, its gradient and the probabilities."""
    (w0, b0), (w1, b1) = layers
    hidden = np.maximum(x @ w0 + b0, 0)
    kept = hidden * mask
    z = kept @ w1 + b1
    z -= z.max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    d_z = np.exp(logs)
    probability = d_z.copy()
    d_z[np.arange(len(y)), y] -= 1
    d_hidden = (d_z @ w1.T) * mask * (hidden > 0)
    grads = [(x.T @ d_hidden, d_hidden.sum(axis=0)), (kept.T @ d_z, d_z.sum(axis=0))]
    return float(-logs[np.arange(len(y)), y].sum()), mlp.flatten(grads), probability


@dataclass
class VectorNet:
    sizes: list[int]
    layers: mlp.Layers
    losses: list[float] = field(default_factory=list)

    def predict(self, rows: DataFrame, vec: str, key: str) -> DataFrame:
        """``(key, prediction, probability)`` of every row; no unit is dropped."""
        layers, sizes = self.layers, self.sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    _, _, p = softmax_loss(arrow.matrix(b["x"]), np.zeros(b.num_rows, int), np.ones((1, sizes[1])), layers)
                    yield pa.RecordBatch.from_arrays([b[key], pa.array(p.argmax(axis=1).astype(float)), arrow.list_column(p)], [key, "prediction", "probability"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, as_double(F.col(vec)).alias("x")).mapInArrow(run, f"`{key}` {kind}, prediction double, probability array<double>")


def train_vector_net(
    rows: DataFrame, vec: str, label: str, key: str, classes: int, hidden: int = 128, dropout: float = 0.2, epochs: int = 5, batch: int = 32,
    rate: float = 1e-3, seed: int = 1, piece_rows: int = PIECE_ROWS,
) -> VectorNet:
    """Adam on mini-batches of whole vectors with labels 0 … ``classes`` - 1; an epoch is one round over the pieces."""
    ready = rows.select(F.xxhash64(key).alias("key"), as_double(F.col(vec)).alias("x"), F.col(label).cast("int").alias("y"), F.lit(0).alias("all"))
    counts = piece_counts(ready, "all", piece_rows)
    table = kept(cut_lineage(dealt(ready, "all", ["key"], piece_rows, counts), "net-rows"), ["piece"], sum(counts.values()))
    width = table.agg(F.max(F.size("x"))).first()[0]
    sizes = [width, hidden, classes]
    flat = mlp.flatten(mlp.start_layers(sizes, seed))
    state, losses = {0: np.concatenate((flat, np.zeros(2 * len(flat) + 1)))}, []

    def work(epoch: int):
        def train(_: int, piece: int, part: pa.RecordBatch, models: State):
            weights, m, v = np.split(models[0][:-1], 3)
            adam, total = mlp.Adam(rate), 0.0
            adam.m, adam.v, adam.step = m, v, round(models[0][-1])
            x, y, keys = arrow.matrix(part["x"]), part["y"].to_numpy(), part["key"].to_numpy()
            order = shuffled(len(y), seed, piece, epoch)
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                mask = dropout_mask(keys[at], hidden, epoch, dropout, seed)
                loss, gradient, _ = softmax_loss(x[at], y[at], mask, mlp.unflatten(weights, sizes))
                weights = adam.update(weights, gradient / len(at))
                total += loss
            yield 0, float(len(y)), total, np.concatenate((weights, adam.m, adam.v, [adam.step]))

        return train

    for epoch in range(epochs):
        state, means = one_round(table, "all", ["key"], state, work(epoch))
        losses.append(means.get(0, float("nan")))
    table.unpersist()
    return VectorNet(sizes, mlp.unflatten(np.split(state[0][:-1], 3)[0], sizes), losses)
