"""Ranking network over candidate and history vectors, trained where the samples are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import arrow, mlp
from galewise.functions.hashing import hash_bucket
from galewise.plans.local_sgd import PIECE_ROWS, State, dealt, kept, one_round, piece_counts

SIZES = [64, 64, 128, 1]


@dataclass
class Ranker:
    sizes: list[int]
    layers: mlp.Layers
    losses: list[float] = field(default_factory=list)

    def weights_table(self, spark) -> DataFrame:
        """The weights as rows ``(layer, row, values)``; the last row is the bias."""
        rows = [
            (i, r, [float(x) for x in values])
            for i, (w, b) in enumerate(self.layers)
            for r, values in enumerate(np.vstack([w, b]))
        ]
        return spark.createDataFrame(rows, "layer int, row int, values array<double>")

    def save(self, spark, path: str) -> None:
        self.weights_table(spark).write.parquet(path)

    @staticmethod
    def load(spark, path: str) -> Ranker:
        rows = spark.read.parquet(path).orderBy("layer", "row").collect()  # one row per input of a layer
        by_layer: dict[int, list] = {}
        for r in rows:
            by_layer.setdefault(r.layer, []).append(r["values"])
        layers = [(np.array(v[:-1]), np.array(v[-1])) for _, v in sorted(by_layer.items())]
        return Ranker([layers[0][0].shape[0], *(w.shape[1] for w, _ in layers)], layers)

    def score(self, samples: DataFrame) -> DataFrame:
        """``(sample_id, logit)`` for every sample."""
        layers = self.layers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    out = mlp.forward(arrow.matrix(b["x"]), layers)[-1]
                    yield arrow.batch(sample_id=b["sample_id"], logit=out[:, 0])

        rows = samples.select("sample_id", F.concat("embedding_query", "context").alias("x"))
        return rows.mapInArrow(run, "sample_id long, logit double")


def loss_and_gradient(x: np.ndarray, q: np.ndarray, y: np.ndarray, layers: mlp.Layers) -> tuple[float, np.ndarray]:
    """Summed weighted logistic loss of some rows and its gradient."""
    steps = mlp.forward(x, layers)
    z = steps[-1][:, 0]
    scale = 1 + (q - 1) * y
    loss = (1 - y) * z + scale * (np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0))
    d_z = (1 - y) - scale / (1 + np.exp(z))
    return float(loss.sum()), mlp.backward(steps, layers, d_z[:, None])[0]


def train_ranker(
    samples: DataFrame, epochs: int = 10, rate: float = 1e-3, batches: int = 500,
    sizes: list[int] | None = None, seed: int = 1, piece_rows: int = PIECE_ROWS,
) -> Ranker:
    """Weighted logistic training; the positive weight of a row scales its positive term.

    The rows are dealt into ``batches`` mini-batches by the hash of their id, and the batches into pieces of about ``piece_rows`` rows. An
    epoch is one round: every piece takes a step for each of its batches, then weights and optimizer states are averaged. The samples move to
    their pieces once.
    """
    sizes = sizes or SIZES
    ready = samples.select(
        "sample_id",
        F.concat("embedding_query", "context").alias("x"),
        F.col("weight").cast("double").alias("q"),
        F.col("label").cast("double").alias("y"),
    ).withColumn("batch", hash_bucket(batches, F.col("sample_id"))).withColumn("all", F.lit(0))
    counts = piece_counts(ready, "all", piece_rows)
    rows = kept(dealt(ready, "all", ["batch"], piece_rows, counts), ["piece"], sum(counts.values()))
    flat = mlp.flatten(mlp.start_layers(sizes, seed))
    state, losses = {0: np.concatenate((flat, np.zeros(2 * len(flat) + 1)))}, []

    def work(_: int, piece: int, part: pa.RecordBatch, models: State):
        weights, m, v = np.split(models[0][:-1], 3)
        adam, total = mlp.Adam(rate), 0.0
        adam.m, adam.v, adam.step = m, v, round(models[0][-1])
        x, q, y, batch = arrow.matrix(part["x"]), part["q"].to_numpy(), part["y"].to_numpy(), part["batch"].to_numpy()
        cuts = np.flatnonzero(np.diff(batch, prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            loss, gradient = loss_and_gradient(x[lo:hi], q[lo:hi], y[lo:hi], mlp.unflatten(weights, sizes))
            weights = adam.update(weights, gradient / (hi - lo))
            total += loss / (hi - lo)
        # the mean is over batches, each of the same weight
        yield 0, float(len(cuts) - 1), total, np.concatenate((weights, adam.m, adam.v, [adam.step]))

    for _ in range(epochs):
        state, means = one_round(rows, "all", ["batch", "sample_id"], state, work)
        losses.append(means.get(0, float("nan")))
    rows.unpersist()
    return Ranker(sizes, mlp.unflatten(np.split(state[0][:-1], 3)[0], sizes), losses)
